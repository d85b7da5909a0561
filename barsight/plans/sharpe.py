"""Full-train fits of the position models, cross-validation grids and monitors."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from barsight.functions.stats import sharpe_of
from barsight.operators import linear as LN
from barsight.operators.bars import BASELINE_COLUMNS, PATH_COLUMNS
from barsight.operators.labels import realized_returns, sharpe_features, training_table
from barsight.operators.news import SENTIMENT_COLUMNS
from barsight.operators.regimes import kmeans_labels, one_hot
from barsight.operators.sampling import block_split, kfold
from barsight.operators.sizing import blend_std_matched
from barsight.operators.trees import mean_regressor, predict_mean
from barsight.operators.validation import fold_sharpes
from barsight.session import cut_lineage

SHARPE_COLUMNS = (
    [c for c in BASELINE_COLUMNS if c != "open_first"] + PATH_COLUMNS + SENTIMENT_COLUMNS + ["cnn_r_pred"]
)
METHODS = ("sharpe_linear", "ridge", "momentum", "constant", "distributional_mono")


def training_tables(train, test, within_session=False, augment=True):
    """Feature tables written once, so every later pass reads them instead of the bars."""
    main, fit = training_table(train, test, within_session, augment)
    main = cut_lineage(main.where("R is not null"))
    return main, main if fit is main or not augment else cut_lineage(fit.where("R is not null"))


def position_column(fit, columns, method="sharpe_linear", strength=1.0, l1_ratio=0.0, label="identity", anchor=0.0):
    """Column f of a linear method fitted on ``fit``, with the model (None for plain signals)."""
    if method == "constant":
        return F.lit(1.0), None
    if method == "momentum":
        return F.col("cum_ret"), None
    m = LN.total(LN.moments(LN.with_label(fit, label if method == "sharpe_linear" else "identity"), columns, "_y"))
    if method == "ridge":
        model = LN.fit_ridge(m, columns, strength)
    elif method == "sharpe_linear":
        model = LN.fit_sharpe_linear(m, columns, strength, l1_ratio, anchor)
    else:
        raise ValueError(f"unknown method: {method}")
    return model.score(), model


def fit_full_train(train, test, method="sharpe_linear", policy="prob_sign", columns=None, within_session=False,
                   augment=True, scores=None, rows=None, **options):
    """(train predictions with R, f, w; submission; summary row) of one method.

    Sharpe is reported on the raw return even if the optimiser saw another label; all
    methods but sharpe_linear flip their sign where they lose on the fit rows.
    """
    columns = columns or SHARPE_COLUMNS
    main, fit = training_tables(train, test, within_session, augment)
    target = cut_lineage(sharpe_features(test["seen"], test["headlines"], test["events"], within_session))
    if scores is not None:
        from barsight.operators.labels import stack_score

        main, fit, target = (stack_score(t, scores) for t in (main, fit, target))
    if method == "distributional_mono":
        apply = lambda t: LN.policy_positions(fit, t, columns, policy, options.get("strength", 1.0), rows)[0]
    else:
        f, _ = position_column(fit, columns, method, **options)
        apply = lambda t: t.withColumn("f", f)
    mult = 1.0 if method == "sharpe_linear" else LN.direction(apply(fit))
    train_pred = apply(main).select("session", "R", "f", (mult * F.col("f")).alias("w"))
    submission = apply(target).select("session", (mult * F.col("f")).alias("target_position"))
    fitted = apply(fit)
    summary = fitted.agg(
        F.lit(method).alias("method"), F.lit(mult).alias("mult"),
        sharpe_of(mult * F.col("f") * F.col("R")).alias("train_sharpe"), F.count(F.lit(1)).alias("fit_rows"),
    )
    return train_pred, submission, summary


def cv_grid(train, test, alphas=(0.5, 1.0, 2.0, 5.0), l1_ratios=(0.0,), labels=("identity",), anchors=(0.0,),
            k=5, seed=0, augment=True, columns=None):
    """Sharpe-linear over a grid and session folds from one moment pass per label.

    Augmentation rows are in every fit and never in a validation side.
    """
    columns = columns or SHARPE_COLUMNS
    main, fit = training_tables(train, test, augment=augment)
    spark = main.sparkSession
    folds = kfold(main, k, seed)
    extra = fit.join(main.select("session"), "session", "left_anti").withColumn("fold", F.lit(-1))
    rows = cut_lineage(main.join(folds, "session").unionByName(extra))
    out = []
    for label in labels:
        fitted = LN.moments(LN.with_label(rows, label), columns, "_y", "fold")
        raw = fitted if label == "identity" else LN.moments(rows, columns, "R", "fold")
        everything = LN.total(fitted)
        for a, l1, anchor in product(alphas, l1_ratios, anchors):
            scores = []
            for j in sorted(x for x in fitted if x >= 0):
                rest = everything - fitted[j]
                model = LN.fit_sharpe_linear(rest, columns, a, l1, anchor)
                scores.append(model_sharpe(raw[j], model))
            out.append((a, l1, label, anchor, float(np.mean(scores)), float(np.std(scores)), [float(s) for s in scores]))
    schema = (
        "ridge_alpha double, l1_ratio double, label string, anchor double, mean_val_sharpe double, "
        "std_val_sharpe double, fold_val_sharpes array<double>"
    )
    return spark.createDataFrame(out, schema).orderBy(F.desc("mean_val_sharpe"))


def model_sharpe(m, model):
    """Sharpe of a linear model's positions on the rows behind ``m``, from their moments."""
    base, slope = model.raw()
    # moments are centred, so the intercept moves by the centre
    b = np.concatenate([[base + slope @ m.centre], slope])
    n = m.n
    mean = b @ m.plain[:-1, -1] / n
    var = b @ m.squared @ b / n - mean**2
    return float(16.0 * mean / np.sqrt(var)) if var > 1e-300 else 0.0


def compare_methods(train, test, k=5, seed=0, strength=1.0, augment=True, columns=None):
    """Sharpe-linear, sign probability and tuned sign probability on the same folds."""
    columns = columns or SHARPE_COLUMNS
    main, fit = training_tables(train, test, augment=augment)
    folds = kfold(main, k, seed)
    extra = fit.join(main.select("session"), "session", "left_anti").withColumn("fold", F.lit(-1))
    rows = cut_lineage(main.join(folds, "session").unionByName(extra))
    grams = LN.moments(rows, columns, "R", "fold")
    whole = LN.total(grams)
    out = None
    for j in sorted(x for x in grams if x >= 0):
        rest, held = rows.where(F.col("fold") != j), rows.where(F.col("fold") == j)
        linear = LN.fit_sharpe_linear(whole - grams[j], columns, strength)
        parts = {"sharpe_linear": held.withColumn("value", linear.score())}
        logistic = LN.fit_logistic(rest, columns, strength, "R", whole - grams[j])
        p = LN.probability(logistic)
        slope = LN.best_slope(rest.select(LN.logit_clip(p).alias("z"), "R"))
        for name, f in (("prob_sign", 2.0 * p - 1.0), ("prob_sign_sharpe", F.tanh(slope * LN.logit_clip(p)))):
            mult = LN.direction(rest.withColumn("f", f))
            parts[name] = held.withColumn("value", mult * f)
        for name, part in parts.items():
            part = part.select("session", "R", "fold", "value", F.lit(name).alias("method"))
            out = part if out is None else out.unionByName(part)
    return fold_sharpes(out, ["method", "fold"])


def block_monitor(train_pred, seed=0):
    """Sharpe on all train sessions and on two disjoint blocks of 25."""
    blocks = block_split(train_pred, seed)
    pnl = F.col("w") * F.col("R")
    whole = train_pred.agg(sharpe_of(pnl).alias("sharpe"), F.count(F.lit(1)).alias("n")).withColumn("block", F.lit("all"))
    parts = train_pred.join(blocks, "session").groupBy("block").agg(sharpe_of(pnl).alias("sharpe"), F.count(F.lit(1)).alias("n"))
    return whole.unionByName(parts)


def cluster_sharpe_linear(train, test, n_clusters=8, strength=1.0, seed=0, augment=True):
    """Sharpe-linear on the features plus one-hot KMeans clusters fitted on train sessions."""
    main, fit = training_tables(train, test, augment=augment)
    target = cut_lineage(sharpe_features(test["seen"], test["headlines"], test["events"]))
    tag = lambda df, name: df.select("session", *SHARPE_COLUMNS, *(["R"] if "R" in df.columns else []), F.lit(name).alias("_part"))
    extra = fit.join(main.select("session"), "session", "left_anti")
    everything = tag(main, "main").unionByName(tag(extra, "extra")).unionByName(
        tag(target, "target").withColumn("R", F.lit(None).cast("double"))
    )
    labelled = one_hot(kmeans_labels(everything, SHARPE_COLUMNS, n_clusters, seed, F.col("_part") == "main"), n_clusters)
    labelled = cut_lineage(labelled)
    columns = SHARPE_COLUMNS + [f"cluster_{i}" for i in range(n_clusters)]
    f, _ = position_column(labelled.where("_part <> 'target'"), columns, "sharpe_linear", strength)
    sub = labelled.where("_part = 'target'").select("session", f.alias("target_position"), "cluster")
    return sub


def boosted_positions(train, test, rounds=400, depth=5, seed=0):
    """Boosted-tree mean of R fitted on train sessions, with the sign flip."""
    main, _ = training_tables(train, test, augment=False)
    target = cut_lineage(sharpe_features(test["seen"], test["headlines"], test["events"]))
    model = mean_regressor(main, SHARPE_COLUMNS, rounds=rounds, depth=depth, seed=seed)
    fitted = predict_mean(model, main, SHARPE_COLUMNS, "f")
    mult = LN.direction(fitted)
    scored = predict_mean(model, target, SHARPE_COLUMNS, "f")
    return scored.select("session", (mult * F.col("f")).alias("target_position")), model


def parts_of(bars, headlines, events, labelled_split="train"):
    """Train and test inputs from tables that carry a ``split`` column."""
    def side(cond):
        return {
            "seen": bars.where(cond & (F.col("bar_ix") <= 49)).drop("split"),
            "unseen": bars.where(cond & (F.col("bar_ix") >= 50)).drop("split"),
            "headlines": headlines.where(cond & (F.col("bar_ix") <= 49)).drop("split"),
            "events": events.where(cond & (F.col("bar_ix") <= 49)).drop("split"),
        }

    is_train = F.col("split") == labelled_split
    return side(is_train), side(~is_train)


__all__ = [
    "METHODS", "SHARPE_COLUMNS", "block_monitor", "blend_std_matched", "boosted_positions", "cluster_sharpe_linear",
    "compare_methods", "cv_grid", "fit_full_train", "parts_of", "realized_returns", "training_tables",
]
