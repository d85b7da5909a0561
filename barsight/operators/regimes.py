"""State-count selection, session clustering and out-of-fold regime forecasts."""

from functools import reduce

import numpy as np
from pyspark.sql import functions as F, Window as W

from barsight.functions.stats import sharpe_of
from barsight.operators.emissions import SUMMARY_COLUMNS, session_summary
from barsight.operators.hmm import (
    Job,
    fit_models,
    forecast,
    forward_table,
    mixture_forecast,
    posteriors,
    responsibilities,
)
from barsight.operators.sizing import Sizing, apply_sizing
from barsight.session import cut_lineage


def standardised_vectors(df, columns):
    """Vector column ``features`` with mean 0 and population deviation 1."""
    from pyspark.ml.feature import VectorAssembler

    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    scaled = [
        ((F.coalesce(F.col(c), F.lit(0.0)) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0)).alias(f"_z_{i}")
        for i, c in enumerate(columns)
    ]
    rows = df.select("*", *scaled)
    names = [f"_z_{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def kmeans_labels(df, columns, k, seed=0, fit_on=None):
    """Cluster of every row; centres are fitted on ``fit_on`` rows (all by default)."""
    from pyspark.ml.clustering import KMeans

    if k <= 1:
        return df.withColumn("cluster", F.lit(0))
    rows = standardised_vectors(df, columns)
    train = rows if fit_on is None else rows.where(fit_on)
    model = KMeans(k=k, seed=seed, maxIter=300, predictionCol="cluster").fit(train)
    return model.transform(rows).drop("features")


def one_hot(df, k, column="cluster"):
    return df.select(
        "*", *[(F.col(column) == i).cast("double").alias(f"{column}_{i}") for i in range(k)]
    )


def oof_forecasts(seqs, folds, k=3, kind="diag", seen_bars=50, horizon=50, **fit):
    """Every session forecast by the model fitted without its fold; all folds share the passes."""
    return candidate_forecasts(seqs, folds, [(k, kind)], seen_bars, horizon, **fit).drop("candidate")


def candidate_forecasts(seqs, folds, candidates, seen_bars=50, horizon=50, **fit):
    """Out-of-fold forecasts of all (states, kind) candidates, marked with candidate and fold."""
    return candidate_fits(seqs, folds, candidates, seen_bars, horizon, pooled=False, **fit)[0]


def candidate_fits(seqs, folds, candidates, seen_bars=50, horizon=50, pooled=True, **fit):
    """``candidate_forecasts`` and, if ``pooled``, the models of the candidates on all sequences.

    One fit call holds every candidate and fold, so the passes over the sequences don't grow in
    number with either.
    """
    tags = folds.select("session", F.col("fold").alias("tag"))
    tagged = cut_lineage(seqs.drop("tag").join(tags, "session", "left" if pooled else "inner").fillna(-1, ["tag"]))
    ids = sorted(r[0] for r in folds.select("fold").distinct().collect())
    cells = [(c, i) for c in range(len(candidates)) for i in ids]
    jobs = [Job(*candidates[c], skip=i) for c, i in cells] + [Job(*c) for c in candidates if pooled]
    models = fit_models(tagged, jobs, **fit)
    # a session is read once, by the models without its fold
    final = cut_lineage(posteriors(tagged, models[: len(cells)], seen_bars, [i for _, i in cells]).select("session", "model", F.col("final").alias("w")))
    parts = [
        forecast(final.where(F.col("model") == j).select("session", "w"), [forward_table(model, horizon)]).withColumns(
            {"candidate": F.lit(c), "fold": F.lit(i)}
        )
        for j, ((c, i), model) in enumerate(zip(cells, models))
    ]
    return reduce(lambda a, b: a.unionByName(b), parts), models[len(cells) :]


def choose(table, bic_window=50.0, tie=0.01):
    """Adds ``selected`` to a candidate table (n_states, bic, mean_sharpe, ...).

    Only candidates within ``bic_window`` of the lowest BIC count. The highest Sharpe leads; a
    candidate with fewer states that trails it by ``tie`` at most goes first.
    """
    everyone = W.partitionBy(F.lit(0))  # a row per candidate
    near = F.col("bic") <= F.min("bic").over(everyone) + bic_window
    merit = F.struct(F.col("mean_sharpe"), -F.col("n_states"), -F.col("bic"))
    lead = F.max(F.when(F.col("_near"), merit)).over(everyone)
    smaller = F.col("n_states") < -F.col("_lead")["col2"]
    close = F.col("_lead")["mean_sharpe"] - F.col("mean_sharpe") <= tie
    place = F.row_number().over(
        everyone.orderBy(F.desc("_near"), F.desc("_first"), F.desc("mean_sharpe"), "n_states", "bic")
    )
    return (
        table.withColumn("_near", near)
        .withColumn("_lead", lead)
        .withColumn("_first", smaller & close)
        .withColumn("selected", place == 1)
        .drop("_near", "_lead", "_first")
    )


def select_states(seqs, labels, folds, states=(2, 3, 4), kinds=("diag",), sizing=Sizing(alpha=0.6),
                  bic_window=50.0, tie=0.01, seen_bars=50, rows=None, **fit):
    """Candidate table with likelihood, AIC, BIC and mean fold Sharpe, and the selected model."""
    candidates = [(k, kind) for kind in kinds for k in states]
    preds, pooled = candidate_fits(seqs, folds, candidates, seen_bars, **fit)
    preds = cut_lineage(preds)
    groups = sorted(tuple(r) for r in preds.select("candidate", "fold").distinct().collect())
    sized = [
        apply_sizing(preds.where((F.col("candidate") == c) & (F.col("fold") == i)), sizing, rows)
        .select("session", "target_position")
        .withColumns({"candidate": F.lit(c), "fold": F.lit(i)})
        for c, i in groups
    ]
    sharpes = (
        reduce(lambda a, b: a.unionByName(b), sized)
        .join(labels.where("R is not null").select("session", "R"), "session")
        .groupBy("candidate", "fold")
        .agg(sharpe_of(F.col("target_position") * F.col("R")).alias("s"))
        .groupBy("candidate")
        .agg(F.avg("s").alias("mean_sharpe"))
    )
    facts = seqs.sparkSession.createDataFrame(
        [(c, k, kind, float(m.log_likelihood), float(m.aic()), float(m.bic()), bool(m.converged))
         for c, ((k, kind), m) in enumerate(zip(candidates, pooled))],
        "candidate int, n_states int, kind string, log_likelihood double, aic double, bic double, converged boolean",
    )
    table = cut_lineage(choose(facts.join(sharpes, "candidate"), bic_window, tie))
    best = table.where("selected").first()["candidate"]
    columns = ["n_states", "kind", "log_likelihood", "aic", "bic", "mean_sharpe", "converged", "selected"]
    return table.select(*columns), pooled[best]


def _filled(state, n_clusters):
    """No cluster without sessions: an empty one takes over, by hash order, its share of the fullest."""
    sizes = {c: n for c, n in state.groupBy("tag").count().collect()}
    for empty in [c for c in range(n_clusters) if not sizes.get(c)]:
        fullest = max(sizes, key=sizes.get)
        share = max(1, sizes[fullest] // n_clusters)
        moved = state.where(F.col("tag") == fullest).orderBy(F.md5(F.col("session").cast("string"))).limit(share)
        moved = moved.select("session", F.lit(empty).alias("_new"))
        state = cut_lineage(state.join(moved, "session", "left").select("session", F.coalesce("_new", "tag").alias("tag")))
        sizes[empty], sizes[fullest] = share, sizes[fullest] - share
    return state


def _flow(seqs, state, jobs, temperature, **fit):
    """Models of the present clusters and (session, tag, best, resp): where each session would go."""
    tagged = cut_lineage(seqs.drop("tag").join(state, "session"))
    models = fit_models(tagged, jobs, **fit)
    return models, cut_lineage(state.join(responsibilities(posteriors(tagged, models), temperature), "session"))


def cluster_models(seqs, emissions, n_clusters=2, k=3, max_rounds=5, min_size=100, temperature=1.0,
                   seed=0, kind="diag", **fit):
    """Per-cluster models, (session, cluster, resp) and the table of moves per round.

    From a KMeans start, models are fitted to the clusters and sessions move to the likeliest one,
    until none would move, ``max_rounds`` are over, or a move would leave a cluster with fewer than
    ``min_size`` sessions; that last move is not made.
    """
    start = kmeans_labels(session_summary(emissions), SUMMARY_COLUMNS, n_clusters, seed)
    state = _filled(cut_lineage(start.select("session", F.col("cluster").alias("tag"))), n_clusters)
    jobs = [Job(k, kind, seed, only=c) for c in range(n_clusters)]
    moves, open_rounds = [], max(1, max_rounds)
    while open_rounds:
        models, flow = _flow(seqs, state, jobs, temperature, **fit)
        counts = np.zeros((n_clusters, n_clusters), int)
        for old, new, n in flow.groupBy("tag", "best").count().collect():
            counts[old, new] = n
        moves.append(counts)
        allowed = n_clusters == 1 or counts.sum(axis=0).min() >= min_size
        settled = counts.trace() == counts.sum()
        state = flow.select("session", F.col("best" if allowed else "tag").alias("tag"))
        open_rounds = open_rounds - 1 if allowed and not settled else 0
    return models, state.withColumnRenamed("tag", "cluster").join(flow.select("session", "resp"), "session"), moves


def _fold_starts(emissions, folds, ids, n_clusters, seed):
    """(session, g, tag): for the g-th fold, the first cluster of every session outside it."""
    summary = cut_lineage(session_summary(emissions).join(folds.select("session", "fold"), "session"))
    parts = []
    for g, fold in enumerate(ids):
        start = kmeans_labels(summary.where(F.col("fold") != fold), SUMMARY_COLUMNS, n_clusters, seed)
        state = _filled(cut_lineage(start.select("session", F.col("cluster").alias("tag"))), n_clusters)
        parts.append(state.select("session", F.lit(g).alias("g"), "tag"))
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))


def fold_cluster_models(seqs, emissions, folds, n_clusters=2, k=3, max_rounds=5, min_size=100, temperature=1.0,
                        seed=0, kind="diag", **fit):
    """``cluster_models`` for every leave-fold-out set at once: {fold: models}.

    A sequence carries its cluster for each fold left out (-1 in its own), and every (fold, cluster)
    is a job of the same passes. Folds follow the rules of ``cluster_models`` one by one; a fold
    that has settled takes no part in later rounds.
    """
    ids = sorted(r[0] for r in folds.select("fold").distinct().collect())
    state = _fold_starts(emissions, folds, ids, n_clusters, seed)
    models, running = {}, list(range(len(ids)))
    for _ in range(max(1, max_rounds)):
        lists = state.groupBy("session").agg(F.collect_list(F.struct("g", "tag")).alias("own"))
        found = lambda g: F.filter("own", lambda x: x["g"] == g)
        lists = lists.select("session", F.array(*[F.coalesce(F.get(found(g), F.lit(0))["tag"], F.lit(-1)) for g in range(len(ids))]).alias("tag"))
        tagged = cut_lineage(seqs.drop("tag").join(lists, "session"))
        jobs = [Job(k, kind, seed, only=c, group=g) for g in running for c in range(n_clusters)]
        fitted = fit_models(tagged, jobs, **fit)
        models.update({g: fitted[i * n_clusters : (i + 1) * n_clusters] for i, g in enumerate(running)})
        scores = posteriors(tagged, fitted).select("session", F.array(*map(F.lit, running))[F.floor(F.col("model") / n_clusters).cast("int")].alias("g"), "model", "loglik")
        best = responsibilities(scores, temperature, ("session", "g")).select("session", "g", "best")
        flow = cut_lineage(state.join(best, ["session", "g"], "left"))
        counts = {g: np.zeros((n_clusters, n_clusters), int) for g in running}
        for g, old, new, n in flow.where("best is not null").groupBy("g", "tag", "best").count().collect():
            counts[g][old, new] = n
        allowed = {g: n_clusters == 1 or c.sum(axis=0).min() >= min_size for g, c in counts.items()}
        running = [g for g in running if allowed[g] and counts[g].trace() != counts[g].sum()]
        if not running:
            break
        state = cut_lineage(flow.select("session", "g", F.when(F.col("g").isin(running), F.col("best")).otherwise(F.col("tag")).alias("tag")))
    return {ids[g]: m for g, m in models.items()}


def oof_mixture_forecasts(seqs, emissions, folds, n_clusters=2, seen_bars=50, horizon=50, **options):
    """Clustered forecasts, each fold predicted from clusters fitted on the others in shared passes."""
    tagged = seqs.drop("tag").join(folds.select("session", "fold"), "session")
    parts = [
        mixture_forecast(tagged.where(F.col("fold") == fold).drop("fold"), models, horizon, seen_bars).withColumn("fold", F.lit(fold))
        for fold, models in fold_cluster_models(seqs, emissions, folds, n_clusters, **options).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
