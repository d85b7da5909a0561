"""Event, session and variant validation tables."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from barsight.functions.ranking import average_ranks
from barsight.functions.stats import guarded_corr, hit_rate, paired_t, sharpe_of, weighted_corr
from barsight.operators.events import HORIZONS
from barsight.operators.reports import melt

MIN_ROWS = 10
FLAT = 1e-12


def long_returns(aligned, horizons=HORIZONS, keep=()):
    """One row per event and horizon with a finite forward return."""
    cells = F.array(
        *[F.struct(F.lit(k).alias("horizon"), F.col(f"fwd_ret_{k}").alias("fwd")) for k in horizons]
    )
    cols = ["event_id", "sentiment", "sentiment_score", "confidence", "sign", *keep]
    return aligned.select(*cols, F.inline(cells)).where(
        F.col("fwd").isNotNull() & ~F.isnan("fwd")
    )


def rank_correlation(long, by, x, y):
    """Spearman per group: Pearson of average ranks."""
    rx = average_ranks(long, by, x, "_rx")
    ry = average_ranks(long, by, y, "_ry")
    ranked = long.select(*by, x, y).join(rx, [*by, x]).join(ry, [*by, y])
    return ranked.groupBy(*by).agg(guarded_corr("_rx", "_ry", 3, FLAT, None).alias("spearman"))


def event_report(aligned, horizons=HORIZONS, keep=()):
    """Correlation, hit-rate and side statistics per horizon; thin horizons are left out."""
    long = long_returns(aligned, horizons, keep)
    keys = [*keep, "horizon"]
    high = F.col("confidence") >= 0.9
    side = F.lower("sentiment")
    pick = lambda cond, c: F.when(cond, F.col(c))
    part = lambda cond: guarded_corr(pick(cond, "sentiment_score"), pick(cond, "fwd"), MIN_ROWS, FLAT, None)
    buy, sell = F.avg(pick(side == "buy", "fwd")), F.avg(pick(side == "sell", "fwd"))
    table = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        guarded_corr("sentiment_score", "fwd", 3, FLAT, None).alias("pearson"),
        weighted_corr("sentiment_score", "fwd", "confidence").alias("pearson_weighted"),
        hit_rate("sign", "fwd").alias("sign_hit_buy_sell"),
        hit_rate("sentiment_score", "fwd").alias("sign_hit_score"),
        buy.alias("mean_ret_buy"),
        sell.alias("mean_ret_sell"),
        (buy - sell).alias("mean_ret_diff"),
        part(high).alias("pearson_high_conf"),
        part(~high).alias("pearson_low_conf"),
    )
    spearman = rank_correlation(long, keys, "sentiment_score", "fwd")
    return table.where(F.col("n") >= MIN_ROWS).join(spearman, keys)


SESSION_SIGNALS = (
    "weighted_score", "weighted_sign", "mean_score", "mean_sign", "last_score", "last_sign",
)


def session_report(features, labels, columns=SESSION_SIGNALS):
    """Correlation and hit rate of session features with the realised return."""
    merged = features.join(labels.where("R is not null").select("session", "R"), "session")
    long = melt(merged, columns, ("R",), "feature")
    table = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        guarded_corr("value", "R", 3, FLAT, None).alias("pearson"),
        hit_rate("value", "R").alias("sign_hit"),
    )
    return table.join(rank_correlation(long, ["feature"], "value", "R"), "feature")


# Distribution function of a Poisson(1) draw at 0, 1, 2, ...
_POISSON_CDF = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def _weights(ids, replicates, seed):
    """Poisson(1) weights from a hash of (row id, replicate): the same on any partitioning."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed * replicates + 1))[None, :] * np.uint64(
            0xD1B54A32D192ED03
        )
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON_CDF, u).astype(np.float64)


def bootstrap_interval(df, key, x, y, row_id, replicates=200, seed=0, q=(0.025, 0.975)):
    """Bootstrap interval of the Pearson correlation per key.

    Each task turns its rows into weighted moment sums of all replicates; only those sums
    are shuffled.
    """

    def moments(batches):
        for pdf in batches:
            out = []
            for k, g in pdf.groupby("k", sort=False):
                w = _weights(g["id"].to_numpy(), replicates, seed)
                a, b = g["x"].to_numpy(np.float64), g["y"].to_numpy(np.float64)
                m = np.column_stack([np.ones_like(a), a, b, a * a, b * b, a * b])
                s = w.T @ m
                out.append(
                    pd.DataFrame(
                        {
                            "k": k,
                            "rep": np.arange(replicates),
                            **{f"s{i}": s[:, i] for i in range(6)},
                        }
                    )
                )
            if out:
                yield pd.concat(out)

    rows = df.select(
        F.col(key).cast("string").alias("k"), F.col(row_id).cast("long").alias("id"),
        F.col(x).alias("x"), F.col(y).alias("y"),
    ).where("x is not null and y is not null")
    schema = "k string, rep int, " + ", ".join(f"s{i} double" for i in range(6))
    sums = rows.mapInPandas(moments, schema).groupBy("k", "rep").agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)]
    )
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{i}") for i in range(6))
    vx, vy = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n)
    corr = F.when((vx > 1e-24) & (vy > 1e-24), (sxy / n - sx / n * sy / n) / F.sqrt(vx * vy))
    return sums.select("k", corr.alias("c")).groupBy(F.col("k").alias(key)).agg(
        F.percentile("c", q[0]).alias("ci_lo"), F.percentile("c", q[1]).alias("ci_hi"),
        F.count("c").alias("replicates"),
    )


def fold_sharpes(long, keys):
    """Sharpe of ``value * R`` per key combination."""
    return long.groupBy(*keys).agg(sharpe_of(F.col("value") * F.col("R")).alias("sharpe"))


def variant_table(scores, flat="flat_long"):
    """Mean, deviation and paired t against the flat variant over (variant, fold, sharpe)."""
    base = scores.where(F.col("variant") == flat).select("fold", F.col("sharpe").alias("_flat"))
    joined = scores.join(base, "fold").withColumn("d", F.col("sharpe") - F.col("_flat"))
    return joined.groupBy("variant").agg(
        F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"),
        paired_t(F.col("d")).alias("t_vs_flat"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("fold", "sharpe"))),
                lambda s: F.format_number(s["sharpe"], 4),
            ),
            ";",
        ).alias("fold_sharpes"),
    )


def stability(scores):
    """Over seeds: mean of the fold means, population deviation, minimum and maximum."""
    seeds = scores.groupBy("method", "seed").agg(F.avg("sharpe").alias("m"))
    return seeds.groupBy("method").agg(
        F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.min("m").alias("min"),
        F.max("m").alias("max"), F.count(F.lit(1)).alias("seeds"),
    )


def group_winners(results, family, order):
    """Best row per family."""
    place = F.row_number().over(W.partitionBy(family).orderBy(*order))
    return results.withColumn("_k", place).where("_k = 1").drop("_k")


def leaderboard(results):
    """Winner of each family and the overall place of the winners."""
    order = [F.desc("validation_sharpe"), F.desc("oof_sharpe"), "candidate"]
    best = group_winners(results, "family", order)
    # one row per family
    return best.withColumn("place", F.row_number().over(W.orderBy(*order)))


def audit_summary(best):
    """Per augmentation flag: seeds and statistics of the best scores (sample deviation)."""
    return best.groupBy("augment").agg(
        F.countDistinct("seed").alias("seeds"),
        F.avg("mean_sharpe").alias("mean_best"),
        F.coalesce(F.stddev_samp("mean_sharpe"), F.lit(0.0)).alias("std_best"),
        F.min("mean_sharpe").alias("min_best"),
        F.max("mean_sharpe").alias("max_best"),
        F.avg("std_sharpe").alias("mean_fold_std"),
    )


def audit_deltas(best):
    """Per seed: augmented minus plain score, and the verdict of its sign."""
    wide = best.groupBy("seed").pivot("augment", [False, True]).agg(F.first("mean_sharpe"))
    delta = F.col("true") - F.col("false")
    verdict = F.when(delta > 0, "higher with augmentation").when(delta < 0, "lower with augmentation").otherwise("equal")
    return wide.select("seed", F.col("false").alias("plain"), F.col("true").alias("augmented"), delta.alias("delta"), verdict.alias("verdict"))


def honest_reference(table):
    """Best variant by mean, best by stability, and the flat one, as one labelled table."""
    others = table.where("variant <> 'flat_long'")
    pick = lambda df, order, name: df.orderBy(*order).limit(1).withColumn("role", F.lit(name))
    a = pick(others, [F.desc("mean_sharpe"), F.desc("t_vs_flat")], "best_honest_mean")
    b = pick(others, [F.desc("t_vs_flat"), F.desc("mean_sharpe")], "best_honest_stable")
    c = table.where("variant = 'flat_long'").withColumn("role", F.lit("flat_long"))
    return a.unionByName(b).unionByName(c)


def row_count_check(outputs, expected):
    """Sessions expected per split against rows and sessions written."""
    want = expected.groupBy("split").agg(F.countDistinct("session").alias("expected_rows"))
    have = outputs.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("sessions")
    )
    ok = (F.col("rows") == F.col("expected_rows")) & (F.col("sessions") == F.col("rows"))
    return want.join(have, "split", "left").fillna(0).withColumn("row_count_ok", ok)
