"""The 73-column OHLC feature row: one window pass, one aggregate, one projection."""

import math

from pyspark.sql import Window as W, functions as F

from barsight.functions.scalars import EPS, change, log_floor, safe_div, zero_if_null
from barsight.operators.bars import by_bar, with_positions, with_running_extremes

LAGS = (1, 3, 5, 10, 20)
ANCHORS = (0.25, 0.50, 0.75)

TREND = [
    "open_first", "close_last", "cum_ret", "log_cum_ret", "close_vs_mean", "close_vs_median",
    "trend_slope",
]
MOMENTS = ["ret_mean", "ret_std", "ret_skew", "ret_kurt", "ret_min", "ret_max", "ret_abs_mean"]
RANGE_VOL = ["parkinson_vol", "garman_klass_vol", "rogers_satchell_vol"]
EWM = ["ewm_vol_10", "ewm_vol_5"]
RANGES = ["range_hl", "range_hl_norm", "close_pos_in_range", "bar_range_mean", "bar_range_std"]
CANDLES = [
    "body_mean", "body_std", "upper_wick_mean", "lower_wick_mean", "wick_asymmetry", "up_bar_ratio",
]
SERIAL = ["ret_ac1", "ret_ac2", "ret_ac3"]
EXTREMES = ["max_drawdown", "max_runup", "argmax_pos", "argmin_pos"]
MOMENTUM = [
    "ret_last_5", "ret_last_10", "ret_last_20", "ret_first_10", "ma_dev_5", "ma_dev_10", "ma_dev_20",
    "half_ratio", "half_vol_ratio", "trend_strength", "breakout_up", "breakout_dn",
]
SHAPE = (
    [f"path_ret_q{int(100 * f)}" for f in ANCHORS]
    + [f"slope_q{k}" for k in (1, 2, 3, 4)]
    + ["close_vs_max_5", "close_vs_min_5", "close_vs_max_20", "close_vs_min_20"]
    + [f"close_ret_lag_{k}" for k in LAGS]
    + [f"high_minus_low_lag_{k}" for k in LAGS]
    + ["vol_ratio_last10_first10", "recency_weighted_ret"]
)
RICH_COLUMNS = (
    ["n_bars"] + TREND + MOMENTS + RANGE_VOL + EWM + RANGES + CANDLES + SERIAL + EXTREMES
    + MOMENTUM + SHAPE
)


def _prepare(bars):
    df = with_running_extremes(with_positions(bars)).withColumn("lc", log_floor("close"))
    df = df.withColumn("r", F.col("lc") - F.lag("lc").over(by_bar()))
    hl = F.log(F.greatest("high", F.lit(EPS)) / F.greatest("low", F.lit(EPS)))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    floor = {c: log_floor(c) for c in ("open", "high", "low", "close")}
    co = floor["close"] - floor["open"]
    gk = 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co
    rs = (floor["high"] - floor["open"]) * (floor["high"] - floor["close"]) + (
        floor["low"] - floor["open"]
    ) * (floor["low"] - floor["close"])
    m = F.col("n") - 1
    spread = F.greatest(m - 1, F.lit(1))
    return df.withColumns(
        {
            **{f"r_{k}": F.lag("r", k).over(by_bar()) for k in (1, 2, 3)},
            "hl2": hl * hl,
            "gk": F.greatest(gk, F.lit(0.0)),
            "rs": F.greatest(rs, F.lit(0.0)),
            "rng": F.greatest(F.col("high") - F.col("low"), F.lit(0.0)),
            "body": F.abs(F.col("close") - F.col("open")),
            "upper": F.col("high") - top,
            "lower": bottom - F.col("low"),
            "half": F.floor(F.col("n") / 2),
            "recency": F.exp(-2.0 + 2.0 * (F.col("i") - 1) / spread),
        }
    )


def _ewm(span, used):
    """Aggregate pieces of a normalised exponentially weighted variance."""
    w = F.when(used & F.col("r").isNotNull(), F.pow(F.lit(1.0 - 2.0 / (span + 1.0)), F.col("rev")))
    total = F.sum(w)
    scale = total + EPS
    mean = F.sum(w * F.col("r")) / scale
    var = F.sum(w * F.col("r") * F.col("r")) / scale - 2.0 * mean * mean + mean * mean * total / scale
    return zero_if_null(F.sqrt(F.greatest(var, F.lit(0.0))))


def _serial(k):
    a = F.col(f"r_{k}")
    b = F.when(a.isNotNull(), F.col("r"))
    ok = (F.count(a) > 1) & (F.stddev_pop(a) >= EPS) & (F.stddev_pop(b) >= EPS)
    return zero_if_null(F.when(ok, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))))


def _at(cond, value):
    return F.max(F.when(cond, F.col(value)))


def _anchor(fraction):
    return F.bround(F.lit(fraction) * (F.col("n") - 1), 0).cast("int")


def _quarter_slope(start, end):
    s, e = _anchor(start), _anchor(end)
    inside = (F.col("i") >= s) & (F.col("i") <= e)
    y, x = F.when(inside, F.col("lc")), F.when(inside, F.col("i"))
    width = F.max(e - s)
    return F.when((F.max("n") >= 3) & (width > 1), F.regr_slope(y, x) * width).otherwise(0.0)


def rich_features(bars):
    i, rev, n, r = F.col("i"), F.col("rev"), F.col("n"), F.col("r")
    m = F.count("r")
    first_half = i < F.greatest(F.col("half"), F.lit(1))
    second_half = i >= F.col("half")
    std = lambda cond, v: F.stddev_pop(F.when(cond, F.col(v)))
    lasts = sorted({5, 10, 20, *LAGS})
    spread = F.stddev_pop("r")

    aggregates = [
        F.max("n").alias("n_bars"),
        F.min_by("open", "i").alias("open_first"),
        F.max_by("close", "i").alias("close_last"),
        F.min_by("close", "i").alias("c0"),
        F.max_by("high", "i").alias("high_last"),
        (F.max_by("lc", "i") - F.min_by("lc", "i")).alias("log_cum_ret"),
        F.avg("close").alias("c_mean"),
        F.percentile("close", 0.5).alias("c_median"),
        (zero_if_null(F.regr_slope(F.col("lc"), i)) * F.greatest(F.max("n") - 1, F.lit(1))).alias(
            "trend_slope"
        ),
        zero_if_null(F.avg("r")).alias("ret_mean"),
        zero_if_null(spread).alias("ret_std"),
        F.when((m >= 3) & (spread >= EPS), F.skewness("r")).otherwise(0.0).alias("ret_skew"),
        F.when((m >= 4) & (spread >= EPS), F.kurtosis("r")).otherwise(0.0).alias("ret_kurt"),
        zero_if_null(F.min("r")).alias("ret_min"),
        zero_if_null(F.max("r")).alias("ret_max"),
        zero_if_null(F.avg(F.abs(r))).alias("ret_abs_mean"),
        F.sqrt(F.avg("hl2") / (4.0 * math.log(2.0))).alias("parkinson_vol"),
        F.sqrt(F.avg("gk")).alias("garman_klass_vol"),
        F.sqrt(F.avg("rs")).alias("rogers_satchell_vol"),
        _ewm(10, F.lit(True)).alias("ewm_vol_10"),
        _ewm(5, (n - 1 <= 10) | (rev < 10)).alias("ewm_vol_5"),
        F.max("high").alias("h_max"),
        F.min("low").alias("l_min"),
        F.avg("rng").alias("bar_range_mean"),
        F.stddev_pop("rng").alias("bar_range_std"),
        F.avg("body").alias("body_mean"),
        F.stddev_pop("body").alias("body_std"),
        F.avg("upper").alias("upper_wick_mean"),
        F.avg("lower").alias("lower_wick_mean"),
        F.avg((F.col("close") > F.col("open")).cast("double")).alias("up_bar_ratio"),
        *[_serial(k).alias(f"ret_ac{k}") for k in (1, 2, 3)],
        F.min(F.col("close") / F.col("run_max") - 1.0).alias("max_drawdown"),
        F.max(F.col("close") / F.col("run_min") - 1.0).alias("max_runup"),
        F.min_by("i", F.struct(-F.col("close"), i)).alias("argmax_i"),
        F.min_by("i", F.struct(F.col("close"), i)).alias("argmin_i"),
        *[_at(rev == k, "close").alias(f"c_back_{k}") for k in lasts],
        *[_at(i == F.greatest(n - 1 - k, F.lit(0)), "low").alias(f"l_back_{k}") for k in LAGS],
        _at(i == F.least(F.lit(10), n - 1), "close").alias("c_10"),
        *[F.avg(F.when(rev < k, F.col("close"))).alias(f"ma_{k}") for k in (5, 10, 20)],
        *[F.max(F.when(rev < k, F.col("close"))).alias(f"mx_{k}") for k in (5, 20)],
        *[F.min(F.when(rev < k, F.col("close"))).alias(f"mn_{k}") for k in (5, 20)],
        F.avg(F.when(first_half, F.col("close"))).alias("m1"),
        F.avg(F.when(second_half, F.col("close"))).alias("m2"),
        std(first_half, "close").alias("s1"),
        std(second_half, "close").alias("s2"),
        *[_at(i == _anchor(f), "close").alias(f"c_q{int(100 * f)}") for f in ANCHORS],
        *[
            _quarter_slope(0.25 * (k - 1), 0.25 * k).alias(f"slope_q{k}")
            for k in (1, 2, 3, 4)
        ],
        F.when(m >= 10, std(rev < 10, "r")).otherwise(0.0).alias("std_last10"),
        F.when(m >= 10, std((i >= 1) & (i <= 10), "r")).otherwise(0.0).alias("std_first10"),
        zero_if_null(
            F.sum(r * F.col("recency")) / F.sum(F.when(r.isNotNull(), F.col("recency")))
        ).alias("recency_weighted_ret"),
    ]
    g = _prepare(bars).groupBy("session").agg(*aggregates)

    c = F.col
    last, steps = c("close_last"), F.greatest(c("n_bars") - 1, F.lit(1))
    since = lambda k: F.when(c("n_bars") > k, change(last, c(f"c_back_{k}"))).otherwise(0.0)
    versus = lambda k, ref: F.when(c("n_bars") >= k, change(last, c(ref))).otherwise(0.0)
    span = c("h_max") - c("l_min")
    computed = {
        "cum_ret": change(last, c("open_first")),
        "close_vs_mean": change(last, c("c_mean")),
        "close_vs_median": change(last, c("c_median")),
        "range_hl": span,
        "range_hl_norm": safe_div(span, c("open_first")),
        "close_pos_in_range": safe_div(last - c("l_min"), span),
        "wick_asymmetry": c("upper_wick_mean") - c("lower_wick_mean"),
        "argmax_pos": safe_div(c("argmax_i").cast("double"), steps),
        "argmin_pos": safe_div(c("argmin_i").cast("double"), steps),
        "ret_first_10": F.when(c("n_bars") > 1, change(c("c_10"), c("c0"))).otherwise(0.0),
        "half_ratio": change(c("m2"), c("m1")),
        "half_vol_ratio": safe_div(c("s2"), c("s1") + EPS),
        "trend_strength": safe_div(F.abs("log_cum_ret"), c("ret_std") + EPS),
        "breakout_up": safe_div(last - c("h_max"), F.abs("h_max") + EPS),
        "breakout_dn": safe_div(last - c("l_min"), F.abs("l_min") + EPS),
        "vol_ratio_last10_first10": safe_div(c("std_last10"), c("std_first10") + EPS),
        **{f"ret_last_{k}": since(k) for k in (5, 10, 20)},
        **{f"ma_dev_{k}": versus(k, f"ma_{k}") for k in (5, 10, 20)},
        **{f"close_vs_max_{k}": versus(k, f"mx_{k}") for k in (5, 20)},
        **{f"close_vs_min_{k}": versus(k, f"mn_{k}") for k in (5, 20)},
        **{f"path_ret_q{int(100 * f)}": change(c(f"c_q{int(100 * f)}"), c("c0")) for f in ANCHORS},
        **{f"close_ret_lag_{k}": since(k) for k in LAGS},
        **{
            f"high_minus_low_lag_{k}": safe_div(c("high_last") - c(f"l_back_{k}"), c("open_first"))
            for k in LAGS
        },
    }
    return g.select("session", *[computed.get(k, c(k)).alias(k) for k in RICH_COLUMNS])


def feature_columns(df, drop=()):
    """Model columns of a feature table: everything but ids and labels."""
    skip = {"session", "R", "close_half", "close_end", *drop}
    return [name for name in df.columns if name not in skip]


def seen_feature_names(columns):
    return sorted(name for name in columns if name.startswith("feat_seen_"))


def label_names(columns):
    prices = {"label_unseen_open_first", "label_unseen_close_last"}
    found = [x for x in sorted(columns) if x.startswith("label_unseen_") and x not in prices]
    return found + [x for x in ("R", "full_session_return") if x in columns]
