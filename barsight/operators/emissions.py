"""Per-bar emission table and its session summary."""

from pyspark.sql import Window as W, functions as F

from barsight.functions.scalars import EPS, log_floor, zero_if_null
from barsight.operators.bars import by_bar, whole
from barsight.schemas import EMISSION_COLUMNS

SUMMARY_COLUMNS = [
    "cum_log_ret", "realized_vol", "up_bar_frac", "ret_skew", "ret_kurt", "max_drawdown",
    "max_runup", "avg_body_frac", "wick_asymmetry", "slope_q1", "slope_q2", "slope_q3", "slope_q4",
    "ret_abs_mean",
]


def bar_scalars(bars):
    """Shape of each bar relative to its own range, plus level against the first close."""
    rng = F.greatest(F.col("high") - F.col("low"), F.lit(0.0))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    per_range = lambda v: F.when(rng > EPS, v / rng).otherwise(0.0)
    base = F.when(F.abs("open") > EPS, F.col("open")).otherwise(1.0)
    lc = log_floor("close")
    return bars.select(
        "session",
        "bar_ix",
        "high",
        "low",
        "close",
        lc.alias("lc"),
        ((F.col("close") - F.col("open")) / base).alias("oc"),
        F.log(F.greatest("high", F.lit(EPS)) / F.greatest("low", F.lit(EPS))).alias("hl"),
        (lc - F.first(lc).over(by_bar())).alias("co_level"),
        per_range(F.col("high") - top).alias("upper_wick"),
        per_range(bottom - F.col("low")).alias("lower_wick"),
        per_range(F.abs(F.col("close") - F.col("open"))).alias("body_frac"),
    )


def rolling_std(value, width):
    w = by_bar().rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(w) >= 2, F.stddev_pop(value).over(w)).otherwise(0.0)


def range_position(width=5):
    w = by_bar().rowsBetween(-(width - 1), 0)
    high, low = F.max("high").over(w), F.min("low").over(w)
    return F.when(high - low > EPS, (F.col("close") - low) / (high - low)).otherwise(0.5)


def emission_table(bars):
    """Ten columns per bar: returns, shape, rolling volatility and range position."""
    df = bar_scalars(bars)
    df = df.withColumn("r", zero_if_null(F.col("lc") - F.lag("lc").over(by_bar())))
    return df.select(
        "session",
        "bar_ix",
        "r",
        "oc",
        "hl",
        "co_level",
        rolling_std("r", 3).alias("rvol_3"),
        rolling_std("r", 5).alias("rvol_5"),
        "upper_wick",
        "lower_wick",
        "body_frac",
        range_position(5).alias("range_pos"),
    )


def first_rows(emissions, seen_bars):
    """The first ``seen_bars`` rows of each sequence."""
    return (
        emissions.withColumn("_i", F.row_number().over(by_bar()))
        .where(F.col("_i") <= seen_bars)
        .drop("_i")
    )


def with_proxy_price(emissions):
    run = by_bar().rowsBetween(W.unboundedPreceding, 0)
    return emissions.withColumn("price", F.exp(F.sum("r").over(run)))


def session_summary(emissions):
    run = by_bar().rowsBetween(W.unboundedPreceding, 0)
    df = (
        with_proxy_price(emissions)
        .withColumn("i", F.row_number().over(by_bar()) - 1)
        .withColumn("n", F.count(F.lit(1)).over(whole()))
        .withColumn("lp", log_floor("price"))
        .withColumn("q", F.greatest(F.floor(F.col("n") / 4), F.lit(1)))
    )
    df = df.withColumn("peak", F.max("price").over(run)).withColumn(
        "trough", F.min("price").over(run)
    )
    i, q = F.col("i"), F.col("q")

    def slope(k):
        inside = (i >= q * (k - 1)) & ((i < q * k) if k < 4 else F.lit(True))
        y, x = F.when(inside, F.col("lp")), F.when(inside, i)
        return zero_if_null(F.regr_slope(y, x)).alias(f"slope_q{k}")

    std = F.stddev_pop("r")
    ok = (F.count("r") >= 3) & (std > EPS)
    ratio = lambda level: F.col("price") / F.when(F.col(level) > EPS, F.col(level)).otherwise(1.0) - 1.0
    return df.groupBy("session").agg(
        F.sum("r").alias("cum_log_ret"),
        std.alias("realized_vol"),
        F.avg((F.col("r") > 0).cast("double")).alias("up_bar_frac"),
        F.when(ok, F.skewness("r")).otherwise(0.0).alias("ret_skew"),
        F.when(ok, F.kurtosis("r")).otherwise(0.0).alias("ret_kurt"),
        F.min(ratio("peak")).alias("max_drawdown"),
        F.max(ratio("trough")).alias("max_runup"),
        F.avg("body_frac").alias("avg_body_frac"),
        (F.avg("upper_wick") - F.avg("lower_wick")).alias("wick_asymmetry"),
        *[slope(k) for k in (1, 2, 3, 4)],
        F.avg(F.abs("r")).alias("ret_abs_mean"),
    )


def sequences(emissions, columns=EMISSION_COLUMNS):
    """One row per session: its bars in order as an array of vectors (bounded by the bar count)."""
    step = F.struct("bar_ix", F.array(*columns).alias("x"))
    return emissions.groupBy("session").agg(
        F.transform(F.sort_array(F.collect_list(step)), lambda s: s["x"]).alias("seq")
    )
