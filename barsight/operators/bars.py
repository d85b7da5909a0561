"""Bar-level windows and the session features built from them."""

from pyspark.sql import Window as W, functions as F

from barsight.functions.scalars import EPS, log_floor, zero_if_null
from barsight.schemas import FIRST_HALF_LAST_BAR

# A session has at most one row per bar index, so a session window stays small.
def by_bar():
    return W.partitionBy("session").orderBy("bar_ix")


def whole():
    return W.partitionBy("session")


BASELINE_COLUMNS = [
    "open_first",
    "close_last",
    "cum_ret",
    "vol",
    "range_hl",
    "max_high",
    "min_low",
    "mean_bar_ret",
    "headline_count",
]
PATH_COLUMNS = [
    "ret_last_5",
    "up_bar_frac",
    "up_minus_down",
    "max_drawdown",
    "p95_abs_bar_ret",
    "vol_first_half",
    "vol_second_half",
    "log_close_slope",
    "log_close_r2",
    "ret_skew",
]


def with_bar_returns(bars):
    """Adds prev_close and ret; the first bar of a session has return 0."""
    prev = F.lag("close").over(by_bar())
    return bars.withColumns(
        {"prev_close": prev, "ret": zero_if_null(F.col("close") / prev - 1.0)}
    )


def with_running_extremes(bars):
    run = by_bar().rowsBetween(W.unboundedPreceding, 0)
    return bars.withColumns(
        {"run_max": F.max("close").over(run), "run_min": F.min("close").over(run)}
    )


def with_positions(bars):
    """Zero-based position from the start (i), from the end (rev) and session length (n)."""
    i, n = F.row_number().over(by_bar()) - 1, F.count(F.lit(1)).over(whole())
    return bars.withColumns({"i": i, "n": n, "rev": n - 1 - i})


def last_bars(bars, k):
    return with_positions(bars).where(F.col("rev") < k).drop("i", "n", "rev")


def first_bars(bars, k):
    return with_positions(bars).where(F.col("i") < k).drop("i", "n", "rev")


def headline_counts(headlines, last_bar=None):
    """Headlines per session; cut at a bar only if the table carries bar positions."""
    if last_bar is not None and "bar_ix" in headlines.columns:
        headlines = headlines.where(F.col("bar_ix") <= last_bar)
    return headlines.groupBy("session").agg(F.count(F.lit(1)).alias("headline_count"))


def _baseline_aggregates():
    return [
        F.min_by("open", "bar_ix").alias("open_first"),
        F.max_by("close", "bar_ix").alias("close_last"),
        F.stddev_pop("ret").alias("vol"),
        F.max("high").alias("max_high"),
        F.min("low").alias("min_low"),
        F.avg("ret").alias("mean_bar_ret"),
    ]


def _with_counts(features, headlines, last_bar):
    if headlines is None:
        return features.withColumn("headline_count", F.lit(0).cast("long"))
    counts = headline_counts(headlines, last_bar)
    return features.join(counts, "session", "left").withColumn(
        "headline_count", F.coalesce("headline_count", F.lit(0))
    )


def _finish_baseline(df):
    return df.withColumn("cum_ret", F.col("close_last") / F.col("open_first") - 1.0).withColumn(
        "range_hl", F.col("max_high") - F.col("min_low")
    )


def baseline_features(bars, headlines=None, last_bar=None):
    """Nine session features from the bars up to ``last_bar`` (all bars if None)."""
    if last_bar is not None:
        bars = bars.where(F.col("bar_ix") <= last_bar)
    df = with_bar_returns(bars).groupBy("session").agg(*_baseline_aggregates())
    df = _with_counts(_finish_baseline(df), headlines, last_bar)
    return df.select("session", *BASELINE_COLUMNS)


def first_half_features(bars, headlines=None):
    return baseline_features(bars, headlines, FIRST_HALF_LAST_BAR)


def _path_prepared(bars):
    df = with_running_extremes(with_positions(with_bar_returns(bars)))
    return df.withColumns(
        {
            "body": F.when(F.col("i") > 0, F.col("ret")),
            "lc": log_floor("close"),
            "half": F.floor(F.col("n") / 2),
        }
    )


def _path_aggregates():
    body = F.col("body")
    close_5 = F.max(F.when(F.col("rev") == 5, F.col("close")))
    last = F.max_by("close", "bar_ix")
    m = F.count("body")
    half_std = lambda cond: F.when(
        F.max("n") >= 2, zero_if_null(F.stddev_pop(F.when(cond, F.col("ret"))))
    ).otherwise(0.0)
    total = F.var_pop("lc") * F.count("lc")
    # population skewness to the bias-corrected form
    correct = F.sqrt(m * (m - 1.0)) / (m - 2.0)
    residual = total * (1.0 - F.regr_r2(F.col("lc"), F.col("i")))
    return [
        F.when(
            F.max("n") > 5, last / F.greatest(close_5, F.lit(EPS)) - 1.0
        ).otherwise(0.0).alias("ret_last_5"),
        zero_if_null(F.avg(F.when(body.isNotNull(), (body > 0).cast("double")))).alias("up_bar_frac"),
        zero_if_null(F.sum(F.signum(body))).alias("up_minus_down"),
        F.max((F.col("run_max") - F.col("close")) / (F.col("run_max") + EPS)).alias("max_drawdown"),
        zero_if_null(F.percentile(F.abs(body), 0.95)).alias("p95_abs_bar_ret"),
        half_std(F.col("i") < F.col("half")).alias("vol_first_half"),
        half_std(F.col("i") >= F.col("half")).alias("vol_second_half"),
        F.when(F.max("n") >= 2, F.regr_slope(F.col("lc"), F.col("i"))).otherwise(0.0).alias(
            "log_close_slope"
        ),
        F.when((F.max("n") >= 2) & (total > EPS), 1.0 - residual / (total + EPS))
        .otherwise(0.0)
        .alias("log_close_r2"),
        F.when(m >= 3, F.coalesce(F.skewness("body") * correct, F.lit(0.0)))
        .otherwise(0.0)
        .alias("ret_skew"),
    ]


def path_features(bars):
    return _path_prepared(bars).groupBy("session").agg(*_path_aggregates())


def features_with_path(bars, headlines=None, first_half=False):
    """Baseline and path features from one window pass and one aggregate."""
    last = FIRST_HALF_LAST_BAR if first_half else None
    if first_half:
        bars = bars.where(F.col("bar_ix") <= last)
    df = _path_prepared(bars).groupBy("session").agg(*_baseline_aggregates(), *_path_aggregates())
    df = _with_counts(_finish_baseline(df), headlines, last)
    return df.select("session", *BASELINE_COLUMNS, *PATH_COLUMNS)


def _standardised(name):
    return lambda b: (b[name] - F.col(f"_m_{name}")) / F.col(f"_s_{name}")


def pad_sequences(bars, length=50):
    """Per session the first ``length`` bars as arrays, padded with the last bar, z-scored.

    Mean and deviation count the padded bar as often as it is repeated.
    """
    names = ("open", "high", "low", "close")
    df = with_positions(first_bars(bars, length))
    short = F.lit(length) - F.count(F.lit(1))
    aggs = [
        F.sort_array(F.collect_list(F.struct("bar_ix", *names))).alias("s"),
        short.cast("int").alias("short"),
    ]
    for c in names:
        last = F.max_by(c, "bar_ix")
        mean = (F.sum(c) + short * last) / length
        square = (F.sum(F.col(c) * F.col(c)) + short * last * last) / length
        aggs.append(mean.alias(f"_m_{c}"))
        aggs.append((F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) + 1e-8).alias(f"_s_{c}"))
    seq = df.groupBy("session").agg(*aggs)
    full = F.concat("s", F.array_repeat(F.element_at("s", -1), F.col("short")))
    return seq.select("session", *[F.transform(full, _standardised(c)).alias(c) for c in names])


def normalised_paths(bars):
    base = F.first("open").over(by_bar())
    return (
        bars.withColumn("_o", base)
        .where("_o <> 0")
        .select("session", "bar_ix", (F.col("close") / F.col("_o")).alias("norm_close"))
    )


def segment_stats(bars, prefix):
    df = _finish_baseline(with_bar_returns(bars).groupBy("session").agg(*_baseline_aggregates()))
    return df.select(
        "session",
        F.col("open_first").alias(f"{prefix}open_first"),
        F.col("close_last").alias(f"{prefix}close_last"),
        F.col("cum_ret").alias(f"{prefix}return"),
        F.col("vol").alias(f"{prefix}vol"),
        F.col("range_hl").alias(f"{prefix}range_hl"),
        F.col("mean_bar_ret").alias(f"{prefix}mean_bar_ret"),
    )


def segment_table(seen, unseen):
    """Seen statistics as features, unseen ones as labels; one bar 49 and one bar 99 required."""

    def single(bars, ix, name):
        picked = bars.where(F.col("bar_ix") == ix).groupBy("session")
        return (
            picked.agg(F.first("close").alias(name), F.count(F.lit(1)).alias("_c"))
            .where("_c = 1")
            .drop("_c")
        )

    df = (
        segment_stats(seen, "feat_seen_")
        .join(segment_stats(unseen, "label_unseen_"), "session")
        .join(single(seen, 49, "ref_close_bar49"), "session")
        .join(single(unseen, 99, "ref_close_bar99"), "session")
    )
    return df.withColumn(
        "R", F.col("ref_close_bar99") / F.col("ref_close_bar49") - 1.0
    ).withColumn(
        "full_session_return", F.col("ref_close_bar99") / F.col("feat_seen_open_first") - 1.0
    )


def session_overview(seen, unseen, headlines):
    """First open, last close, total return, headline count and bar count."""
    first = seen.groupBy("session").agg(
        F.min_by("open", "bar_ix").alias("first_open"), F.count(F.lit(1)).alias("_a")
    )
    last = unseen.groupBy("session").agg(
        F.max_by("close", "bar_ix").alias("last_close"), F.count(F.lit(1)).alias("_b")
    )
    counts = headline_counts(headlines)
    return (
        first.join(last, "session")
        .join(counts, "session", "left")
        .select(
            "session",
            "first_open",
            "last_close",
            (F.col("last_close") / F.col("first_open") - 1.0).alias("total_return"),
            F.coalesce("headline_count", F.lit(0)).alias("headline_count"),
            (F.col("_a") + F.col("_b")).alias("bars"),
        )
    )
