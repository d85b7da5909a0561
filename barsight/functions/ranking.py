"""Ranks, running totals and exact quantiles that never put one group into one task.

Every helper works in two levels: rows are counted in buckets that follow the
order, bucket offsets are summed (few rows), and only rows of one bucket meet
in one task.
"""

from pyspark.sql import Window as W, functions as F

from barsight.functions.scalars import col

# Buffers of the built-in exact percentile hold the distinct values of a group.
SMALL_GROUP = 1_000_000
HASH_PREFIX = 3


def bucket_rank(df, by, bucket, order, out="rank", total=None):
    """1-based row number inside ``by`` along (bucket, order).

    ``bucket`` must not decrease along the order and must take few values per group.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by).orderBy("_bucket")
    sums = counts.select(
        *by,
        "_bucket",
        (F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias("_total"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = rows.join(sums, by + ["_bucket"]).withColumn(
        out, F.row_number().over(inside) + F.col("_before")
    )
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_bucket", "_before", "_total")


def hash_rank(df, key, tie, out="rank", total=None, by=()):
    """Row number of a table in md5 order: the leading hex digits are even buckets."""
    rows = df.withColumn("_key", key)
    prefix = F.conv(F.substring("_key", 1, HASH_PREFIX), 16, 10).cast("int")
    return bucket_rank(rows, by, prefix, ["_key", tie], out, total).drop("_key")


def ntile_of(rank, total, n):
    """Zero-based ntile from a rank and the group size."""
    rank, total = col(rank).cast("long"), col(total).cast("long")
    small = F.floor(total / n)
    rest = total % n
    edge = rest * (small + 1)
    first = F.floor((rank - 1) / (small + 1))
    second = rest + F.floor((rank - 1 - edge) / F.greatest(small, F.lit(1)))
    return F.when(rank <= edge, first).otherwise(second).cast("int")


def dense_ids(df, key, start=0, width=1 << 16, out="id"):
    """Consecutive ids in the order of an integer key."""
    return bucket_rank(df, [], F.floor(col(key) / width), [key], "_rank").withColumn(
        out, (F.col("_rank") - 1 + start).cast("long")
    ).drop("_rank")


def _cuts(df, by, value, parts=64):
    probs = [i / parts for i in range(1, parts)]
    return df.groupBy(*by).agg(
        F.percentile_approx(value, probs, F.lit(10_000)).alias("_cuts")
    )


def value_positions(df, by, value, weight=None):
    """Distinct values of each group with their count and the rows below them.

    With ``weight`` a row counts as often as its weight says (0 only asks for a place).

    Columns: ``by``, value, n (rows with it), below (rows with a smaller value), total.
    Ties collapse first; cut points of a bounded sketch give the buckets.
    """
    by = list(by)
    values = (
        df.where(col(value).isNotNull())
        .groupBy(*by, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    )
    cuts = _cuts(values, by, value)
    placed = (values.join(cuts, by) if by else values.crossJoin(F.broadcast(cuts))).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    sums = placed.groupBy(*by, "_bucket").agg(F.sum("n").alias("_n"))
    w = W.partitionBy(*by).orderBy("_bucket")
    sums = sums.select(
        *by,
        "_bucket",
        (F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias("total"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    run = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return placed.join(sums, by + ["_bucket"]).select(
        *by, value, "n", (F.col("_before") + run - F.col("n")).alias("below"), "total"
    )


def average_ranks(df, by, value, out="rank"):
    """Rank with ties sharing their mean rank, one row per distinct value."""
    return value_positions(df, by, value).select(
        *by, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(out)
    )


def quantiles(df, value, qs, by=(), rows=None):
    """Exact linearly interpolated quantiles: columns q0, q1, ... per group.

    ``rows`` is a checked upper bound of the rows per group. Small groups use the
    built-in percentile; otherwise order statistics are read off the distributed
    value positions.
    """
    by = list(by)
    if rows is not None and rows <= SMALL_GROUP:
        return df.groupBy(*by).agg(
            *[F.percentile(value, float(q)).alias(f"q{i}") for i, q in enumerate(qs)]
        )
    positions = value_positions(df, by, value)
    picks = []
    for i, q in enumerate(qs):
        spot = (F.col("total") - 1) * float(q)
        floor = F.floor(spot)
        weight = spot - floor
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        low = F.max(F.when(holds(floor), F.col(value)))
        high = F.max(F.when(holds(F.least(floor + 1, F.col("total") - 1)), F.col(value)))
        frac = F.max(weight)
        picks.append((low + (high - low) * frac).alias(f"q{i}"))
    return positions.groupBy(*by).agg(*picks)


def running_before(df, by, order, width, measures):
    """Totals over all rows of ``by`` strictly before the row along integer ``order`` columns.

    ``order`` is (major, minor); rows that share both do not count for each other.
    ``width`` majors share a bucket. ``measures``: name -> column.
    """
    by, (major, minor) = list(by), order
    aggs = [F.sum(v).alias(k) for k, v in measures.items()]
    cells = df.groupBy(*by, major, minor).agg(*aggs)
    cells = cells.withColumn("_bucket", F.floor(F.col(major) / width))
    sums = cells.groupBy(*by, "_bucket").agg(*[F.sum(k).alias(f"_{k}") for k in measures])
    w = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).alias(f"_{k}") for k in measures]
    )
    inside = (
        W.partitionBy(*by, "_bucket").orderBy(major, minor).rowsBetween(W.unboundedPreceding, -1)
    )
    return cells.join(sums, by + ["_bucket"]).select(
        *by,
        major,
        minor,
        *[(F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(f"_{k}")).alias(k) for k in measures],
    )
