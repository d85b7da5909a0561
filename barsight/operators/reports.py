"""Tables behind the charts: counts, bands, histograms, correlation matrices, profiles."""

from pyspark.sql import functions as F

from barsight.functions.ranking import average_ranks, quantiles
from barsight.functions.stats import guarded_corr


def counts_by_phase(headlines, last_seen=49):
    """Headlines per bar in the seen and unseen phase, and in total."""
    phase = F.when(F.col("bar_ix") <= last_seen, "seen").otherwise("unseen")
    wide = (
        headlines.withColumn("phase", phase)
        .groupBy("bar_ix")
        .pivot("phase", ["seen", "unseen"])
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )
    return wide.withColumn("total", F.col("seen") + F.col("unseen"))


def path_bands(paths, sessions=None):
    """Cross-sectional quantiles and mean of the normalised close per bar."""
    bands = quantiles(paths, "norm_close", (0.05, 0.25, 0.5, 0.75, 0.95), ["bar_ix"], sessions)
    named = bands.select(
        "bar_ix",
        *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))],
    )
    return named.join(paths.groupBy("bar_ix").agg(F.avg("norm_close").alias("mean")), "bar_ix")


def histogram(df, value, low, high, bins):
    """Equal-width bin counts; the last bin includes the upper edge, outside rows do not count."""
    width = (high - low) / bins
    ix = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    return (
        df.where((F.col(value) >= low) & (F.col(value) <= high))
        .groupBy(ix.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def usable_columns(df, candidates):
    """Numeric columns with at least two values that differ, from one aggregate row."""
    aggs = []
    for c in candidates:
        aggs += [F.count(c).alias(f"n_{c}"), (F.max(c) > F.min(c)).alias(f"v_{c}")]
    row = df.agg(*aggs).first()
    return [c for c in candidates if row[f"n_{c}"] >= 2 and row[f"v_{c}"]]


def column_usability(df, candidates):
    """One row per column: non-null count and number of distinct values."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in candidates]
    )
    long = df.select(F.inline(cells))
    values = long.where("value is not null").groupBy("column", "value").count()
    return values.groupBy("column").agg(
        F.sum("count").alias("non_null"), F.count(F.lit(1)).alias("distinct_values")
    )


def melt(df, columns, keep=("session",), name="variable", value="value"):
    cells = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    )
    return df.select(*keep, F.inline(cells))


def ranked(df, columns):
    """Every column replaced by its average rank, all columns ranked in one pass."""
    long = melt(df, columns)
    ranks = average_ranks(long, ["variable"], "value")
    joined = long.join(ranks, ["variable", "value"])
    return joined.groupBy("session").pivot("variable", list(columns)).agg(F.first("rank"))


def correlation_block(df, rows, columns, method="pearson"):
    """Long table of correlations between two column lists."""
    source = df if method == "pearson" else ranked(df, sorted({*rows, *columns}))
    pairs = [(a, b) for a in rows for b in columns]
    wide = source.agg(*[guarded_corr(a, b, 2, 0.0, None).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("feature"), F.lit(b).alias("label"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(cells))


def pair_scatter(df, x, y):
    return df.select("session", F.col(x).alias("x"), F.col(y).alias("y")).dropna()


PROFILE_POINTS = (0, 1, 2, 5, 10, 25, 50, 75, 90, 95, 98, 99, 100)


def probability_report(df, rows=None):
    """Per split and measure: moments and thirteen percentiles of p, margin and entropy."""
    from barsight.functions.scalars import binary_entropy, probability_margin

    cols = df.select(
        "split", "session", "p", probability_margin("p").alias("margin"),
        binary_entropy("p").alias("entropy"),
    )
    long = melt(cols, ("p", "margin", "entropy"), ("split", "session"), "measure")
    keys = ["split", "measure"]
    moments = long.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    points = quantiles(long, "value", [q / 100 for q in PROFILE_POINTS], keys, rows)
    points = points.select(*keys, *[F.col(f"q{i}").alias(f"p{q}") for i, q in enumerate(PROFILE_POINTS)])
    return moments.join(points, keys)
