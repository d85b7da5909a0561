"""Registered queries: scalars on bars, session features, windows (groups B, E1-E15, E32, F)."""

from pyspark.sql import functions as F

from barsight.catalog.base import query, shaped
from barsight.functions import scalars as S
from barsight.functions.ranking import average_ranks
from barsight.operators import bars as B, emissions as M, labels as L, rich as R

BASE9 = "session:i " + " ".join(B.BASELINE_COLUMNS[:-1]) + " headline_count:i"


@query("e01_baseline_features", shaped(BASE9, "SELECT * FROM base9", "base9"))
def baseline(m):
    return B.baseline_features(m.seen(), m.events(), last_bar=49)


FIRST_HALF = """
SELECT r.session, min_by(open, bar_ix) AS open_first, max_by(close, bar_ix) AS close_last,
       max_by(close, bar_ix) / min_by(open, bar_ix) - 1 AS cum_ret, stddev_pop(ret) AS vol,
       max(high) - min(low) AS range_hl, max(high) AS max_high, min(low) AS min_low,
       avg(ret) AS mean_bar_ret, max(coalesce(h.c, 0)) AS headline_count
FROM rets r LEFT JOIN (SELECT session, count(*) AS c FROM sent WHERE bar_ix <= 24 GROUP BY 1) h
  ON r.session = h.session WHERE bar_ix <= 24 GROUP BY r.session"""


@query("e02_first_half_features", shaped(BASE9, FIRST_HALF, "rets", "sent"))
def first_half(m):
    return B.first_half_features(m.bars(), m.events())


PATH_SQL = """
SELECT session,
  CASE WHEN max(n) > 5 THEN max(CASE WHEN rev = 0 THEN close END) / max(CASE WHEN rev = 5 THEN close END) - 1 ELSE 0 END AS ret_last_5,
  avg(CASE WHEN i > 0 THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS up_bar_frac,
  sum(CASE WHEN i > 0 THEN sign(ret) ELSE 0 END) AS up_minus_down,
  max((run_max - close) / (run_max + 1e-12)) AS max_drawdown,
  quantile_cont(CASE WHEN i > 0 THEN abs(ret) END, 0.95) AS p95_abs_bar_ret,
  stddev_pop(ret) FILTER (i < n // 2) AS vol_first_half,
  stddev_pop(ret) FILTER (i >= n // 2) AS vol_second_half,
  regr_slope(lc, i) AS log_close_slope,
  regr_r2(lc, i) * var_pop(lc) * count(*) / (var_pop(lc) * count(*) + 1e-12)
    + 1e-12 / (var_pop(lc) * count(*) + 1e-12) AS log_close_r2,
  skewness(CASE WHEN i > 0 THEN ret END) AS ret_skew
FROM rets {where} GROUP BY session"""
PATH_NAMES = "session:i " + " ".join(B.PATH_COLUMNS)


@query("e03_path_features", shaped(PATH_NAMES, PATH_SQL.format(where=""), "rets"))
def path(m):
    return B.path_features(m.seen())


@query(
    "e04_composed_features",
    shaped(
        BASE9 + " " + " ".join(B.PATH_COLUMNS),
        f"SELECT * FROM base9 JOIN ({PATH_SQL.format(where='')}) p USING (session)",
        "base9",
    ),
)
def composed(m):
    return B.features_with_path(m.seen(), m.events().where("bar_ix <= 49"))


# --- the 73-column row, block by block -------------------------------------------------

RICH_PREP = """
SELECT *, greatest(high - low, 0) AS rng, abs(close - open) AS body,
  high - greatest(open, close) AS upper_w, least(open, close) - low AS lower_w,
  lag(lr, 1) OVER w AS lr1, lag(lr, 2) OVER w AS lr2, lag(lr, 3) OVER w AS lr3
FROM rets WINDOW w AS (PARTITION BY session ORDER BY bar_ix)"""


def rich_block(name, columns, body):
    cols = "session:i " + " ".join(
        c + (":i" if c == "n_bars" else "") for c in columns
    )
    sql = shaped(cols, body, "rets", rp=RICH_PREP)

    @query(name, sql)
    def block(m):
        return R.rich_features(m.seen()).select("session", *columns)


LAST = "max_by(close, i)"
FIRST = "min_by(close, i)"
MID_LEN = "(max(n) - 1)"

rich_block("e06_trend_block", ["n_bars"] + R.TREND, f"""
SELECT session, count(*) AS n_bars, min_by(open, i) AS open_first, {LAST} AS close_last,
  {LAST} / min_by(open, i) - 1 AS cum_ret, max_by(lc, i) - min_by(lc, i) AS log_cum_ret,
  {LAST} / avg(close) - 1 AS close_vs_mean, {LAST} / median(close) - 1 AS close_vs_median,
  regr_slope(lc, i) * {MID_LEN} AS trend_slope FROM rp GROUP BY session""")

rich_block("e07_moment_block", R.MOMENTS, """
SELECT session, avg(lr) AS ret_mean, stddev_pop(lr) AS ret_std,
  skewness(lr) * (count(lr) - 2) / sqrt(count(lr) * (count(lr) - 1)) AS ret_skew,
  kurtosis_pop(lr) AS ret_kurt, min(lr) AS ret_min, max(lr) AS ret_max, avg(abs(lr)) AS ret_abs_mean
FROM rp GROUP BY session""")

rich_block("e08_range_volatility", R.RANGE_VOL, """
SELECT session, sqrt(avg(pow(ln(high / low), 2)) / (4 * ln(2))) AS parkinson_vol,
  sqrt(avg(greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0))) AS garman_klass_vol,
  sqrt(avg(greatest(ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close), 0))) AS rogers_satchell_vol
FROM rp GROUP BY session""")

rich_block("e09_ewm_volatility", R.EWM, """
SELECT a.session, sqrt(sum(w10 / (s10 + 1e-12) * pow(lr - m10, 2))) AS ewm_vol_10,
  sqrt(sum(w5 / (s5 + 1e-12) * pow(lr - m5, 2))) AS ewm_vol_5
FROM (SELECT session, rev, lr, pow(1 - 2.0 / 11, rev) AS w10,
        CASE WHEN n - 1 <= 10 OR rev < 10 THEN pow(1 - 2.0 / 6, rev) ELSE 0 END AS w5
      FROM rp WHERE lr IS NOT NULL) a
JOIN (SELECT session, sum(w10) AS s10, sum(w5) AS s5, sum(w10 * lr) / (sum(w10) + 1e-12) AS m10,
        sum(w5 * lr) / (sum(w5) + 1e-12) AS m5
      FROM (SELECT session, rev, lr, pow(1 - 2.0 / 11, rev) AS w10,
              CASE WHEN n - 1 <= 10 OR rev < 10 THEN pow(1 - 2.0 / 6, rev) ELSE 0 END AS w5
            FROM rp WHERE lr IS NOT NULL) GROUP BY session) b USING (session)
GROUP BY a.session""")

rich_block("e10_candle_block", R.RANGES + R.CANDLES, f"""
SELECT session, max(high) - min(low) AS range_hl, (max(high) - min(low)) / min_by(open, i) AS range_hl_norm,
  ({LAST} - min(low)) / (max(high) - min(low)) AS close_pos_in_range, avg(rng) AS bar_range_mean,
  stddev_pop(rng) AS bar_range_std, avg(body) AS body_mean, stddev_pop(body) AS body_std,
  avg(upper_w) AS upper_wick_mean, avg(lower_w) AS lower_wick_mean,
  avg(upper_w) - avg(lower_w) AS wick_asymmetry,
  avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS up_bar_ratio FROM rp GROUP BY session""")

rich_block("e11_serial_correlation", R.SERIAL, """
SELECT session, corr(lr, lr1) AS ret_ac1, corr(lr, lr2) AS ret_ac2, corr(lr, lr3) AS ret_ac3
FROM rp GROUP BY session""")

rich_block("e12_extremes", R.EXTREMES, f"""
SELECT session, min(close / run_max - 1) AS max_drawdown, max(close / run_min - 1) AS max_runup,
  min(CASE WHEN close = hi THEN i END)::DOUBLE / {MID_LEN} AS argmax_pos,
  min(CASE WHEN close = lo THEN i END)::DOUBLE / {MID_LEN} AS argmin_pos
FROM (SELECT *, max(close) OVER (PARTITION BY session) AS hi, min(close) OVER (PARTITION BY session) AS lo FROM rp)
GROUP BY session""")


def back(k, c="close"):
    return f"max(CASE WHEN rev = {k} THEN {c} END)"


rich_block("e13_window_momentum", R.MOMENTUM, f"""
SELECT session, {', '.join(f"{LAST} / {back(k)} - 1 AS ret_last_{k}" for k in (5, 10, 20))},
  max(CASE WHEN i = 10 THEN close END) / {FIRST} - 1 AS ret_first_10,
  {', '.join(f"{LAST} / avg(close) FILTER (rev < {k}) - 1 AS ma_dev_{k}" for k in (5, 10, 20))},
  avg(close) FILTER (i >= n // 2) / avg(close) FILTER (i < n // 2) - 1 AS half_ratio,
  stddev_pop(close) FILTER (i >= n // 2) / (stddev_pop(close) FILTER (i < n // 2) + 1e-12) AS half_vol_ratio,
  abs(max_by(lc, i) - min_by(lc, i)) / (stddev_pop(lr) + 1e-12) AS trend_strength,
  ({LAST} - max(high)) / (abs(max(high)) + 1e-12) AS breakout_up,
  ({LAST} - min(low)) / (abs(min(low)) + 1e-12) AS breakout_dn
FROM rp GROUP BY session""")


def quarter(k):
    s, e = f"round_even({0.25 * (k - 1)} * (n - 1), 0)", f"round_even({0.25 * k} * (n - 1), 0)"
    return (
        f"regr_slope(lc, i) FILTER (i >= {s} AND i <= {e}) * max({e} - {s}) AS slope_q{k}"
    )


rich_block("e14_path_shape", R.SHAPE, f"""
SELECT session,
  {', '.join(f"max(CASE WHEN i = round_even({f} * (n - 1), 0) THEN close END) / {FIRST} - 1 AS path_ret_q{int(100 * f)}" for f in R.ANCHORS)},
  {', '.join(quarter(k) for k in (1, 2, 3, 4))},
  {', '.join(f"{LAST} / max(close) FILTER (rev < {k}) - 1 AS close_vs_max_{k}, {LAST} / min(close) FILTER (rev < {k}) - 1 AS close_vs_min_{k}" for k in (5, 20))},
  {', '.join(f"{LAST} / {back(k)} - 1 AS close_ret_lag_{k}" for k in R.LAGS)},
  {', '.join(f"(max_by(high, i) - {back(k, 'low')}) / min_by(open, i) AS high_minus_low_lag_{k}" for k in R.LAGS)},
  stddev_pop(lr) FILTER (rev < 10) / (stddev_pop(lr) FILTER (i BETWEEN 1 AND 10) + 1e-12) AS vol_ratio_last10_first10,
  sum(lr * exp(-2 + 2.0 * (i - 1) / (n - 2))) / sum(exp(-2 + 2.0 * (i - 1) / (n - 2))) FILTER (i > 0) AS recency_weighted_ret
FROM rp GROUP BY session""")

# --- emissions ------------------------------------------------------------------------

EMIS = """
SELECT session, bar_ix, coalesce(lr, 0) AS r, (close - open) / open AS oc, ln(high / low) AS hl,
  lc - first_value(lc) OVER w AS co_level,
  CASE WHEN i >= 1 THEN stddev_pop(coalesce(lr, 0)) OVER w3 ELSE 0 END AS rvol_3,
  CASE WHEN i >= 1 THEN stddev_pop(coalesce(lr, 0)) OVER w5 ELSE 0 END AS rvol_5,
  CASE WHEN high - low > 1e-12 THEN (high - greatest(open, close)) / (high - low) ELSE 0 END AS upper_wick,
  CASE WHEN high - low > 1e-12 THEN (least(open, close) - low) / (high - low) ELSE 0 END AS lower_wick,
  CASE WHEN high - low > 1e-12 THEN abs(close - open) / (high - low) ELSE 0 END AS body_frac,
  CASE WHEN max(high) OVER w5 - min(low) OVER w5 > 1e-12
    THEN (close - min(low) OVER w5) / (max(high) OVER w5 - min(low) OVER w5) ELSE 0.5 END AS range_pos
FROM rets WINDOW w AS (PARTITION BY session ORDER BY bar_ix),
  w3 AS (PARTITION BY session ORDER BY bar_ix ROWS 2 PRECEDING),
  w5 AS (PARTITION BY session ORDER BY bar_ix ROWS 4 PRECEDING)"""
EMIS_NAMES = "session:i bar_ix:i " + " ".join(M.EMISSION_COLUMNS)


@query("f11_emission_table", shaped(EMIS_NAMES, EMIS, "rets"))
def emissions(m):
    return M.emission_table(m.seen())


@query("b14_bar_scalars", shaped(
    "session:i bar_ix:i oc hl co_level upper_wick lower_wick body_frac",
    f"SELECT session, bar_ix, oc, hl, co_level, upper_wick, lower_wick, body_frac FROM ({EMIS})", "rets"))
def bar_scalars(m):
    return M.bar_scalars(m.seen()).select(
        "session", "bar_ix", "oc", "hl", "co_level", "upper_wick", "lower_wick", "body_frac"
    )


@query("e15_session_summary", shaped(
    "session:i " + " ".join(M.SUMMARY_COLUMNS), """
SELECT session, sum(r) AS cum_log_ret, stddev_pop(r) AS realized_vol,
  avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS up_bar_frac,
  skewness(r) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS ret_skew, kurtosis_pop(r) AS ret_kurt,
  min(px / peak - 1) AS max_drawdown, max(px / trough - 1) AS max_runup, avg(body_frac) AS avg_body_frac,
  avg(upper_wick) - avg(lower_wick) AS wick_asymmetry,
  regr_slope(ln(px), i) FILTER (i < n // 4) AS slope_q1,
  regr_slope(ln(px), i) FILTER (i >= n // 4 AND i < 2 * (n // 4)) AS slope_q2,
  regr_slope(ln(px), i) FILTER (i >= 2 * (n // 4) AND i < 3 * (n // 4)) AS slope_q3,
  regr_slope(ln(px), i) FILTER (i >= 3 * (n // 4)) AS slope_q4, avg(abs(r)) AS ret_abs_mean
FROM (SELECT *, max(px) OVER w AS peak, min(px) OVER w AS trough, row_number() OVER w - 1 AS i,
        count(*) OVER (PARTITION BY session) AS n
      FROM (SELECT *, exp(sum(r) OVER (PARTITION BY session ORDER BY bar_ix)) AS px FROM em)
      WINDOW w AS (PARTITION BY session ORDER BY bar_ix))
GROUP BY session""", "rets", em=EMIS))
def summary(m):
    return M.session_summary(M.emission_table(m.seen()))


@query("e32_sequence_assembly", shaped("session:i k:i open_z high_z low_z close_z", """
SELECT session, i AS k, (open - avg(open) OVER s) / (stddev_pop(open) OVER s + 1e-8) AS open_z,
  (high - avg(high) OVER s) / (stddev_pop(high) OVER s + 1e-8) AS high_z,
  (low - avg(low) OVER s) / (stddev_pop(low) OVER s + 1e-8) AS low_z,
  (close - avg(close) OVER s) / (stddev_pop(close) OVER s + 1e-8) AS close_z
FROM rets WINDOW s AS (PARTITION BY session)""", "rets"))
def sequence_assembly(m):
    seq = B.pad_sequences(m.bars())
    cols = ("open", "high", "low", "close")
    z = F.arrays_zip(*[F.col(c).alias(f"{c}_z") for c in cols])
    flat = seq.select("session", F.posexplode(z).alias("k", "z"))
    return flat.select("session", "k", *[F.col("z")[f"{c}_z"].alias(f"{c}_z") for c in cols])


# --- windows --------------------------------------------------------------------------


@query("f01_bar_returns", shaped("session:i bar_ix:i prev_close ret", """
SELECT session, bar_ix, lag(close) OVER w AS prev_close, coalesce(close / lag(close) OVER w - 1, 0) AS ret
FROM bars WINDOW w AS (PARTITION BY session ORDER BY bar_ix)""", "bars"))
def bar_returns(m):
    return B.with_bar_returns(m.bars()).select("session", "bar_ix", "prev_close", "ret")


@query("f02_running_extremes", shaped("session:i bar_ix:i run_max run_min", """
SELECT session, bar_ix, max(close) OVER w AS run_max, min(close) OVER w AS run_min
FROM bars WINDOW w AS (PARTITION BY session ORDER BY bar_ix ROWS UNBOUNDED PRECEDING)""", "bars"))
def running_extremes(m):
    return B.with_running_extremes(m.bars()).select("session", "bar_ix", "run_max", "run_min")


@query("f03_rolling_std", shaped("session:i bar_ix:i s3 s5", """
SELECT session, bar_ix, CASE WHEN row_number() OVER w > 1 THEN stddev_pop(ret) OVER w3 ELSE 0 END AS s3,
  CASE WHEN row_number() OVER w > 1 THEN stddev_pop(ret) OVER w5 ELSE 0 END AS s5
FROM (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY session ORDER BY bar_ix) - 1, 0) AS ret FROM bars)
WINDOW w AS (PARTITION BY session ORDER BY bar_ix),
  w3 AS (PARTITION BY session ORDER BY bar_ix ROWS 2 PRECEDING),
  w5 AS (PARTITION BY session ORDER BY bar_ix ROWS 4 PRECEDING)""", "bars"))
def rolling(m):
    return B.with_bar_returns(m.bars()).select(
        "session", "bar_ix", M.rolling_std("ret", 3).alias("s3"), M.rolling_std("ret", 5).alias("s5")
    )


@query("f04_range_position", shaped("session:i bar_ix:i range_pos", """
SELECT session, bar_ix, CASE WHEN h - l > 1e-12 THEN (close - l) / (h - l) ELSE 0.5 END AS range_pos
FROM (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l FROM bars
      WINDOW w AS (PARTITION BY session ORDER BY bar_ix ROWS 4 PRECEDING))""", "bars"))
def range_pos(m):
    return m.bars().select("session", "bar_ix", M.range_position(5).alias("range_pos"))


@query("f05_proxy_price", shaped("session:i bar_ix:i price", """
SELECT session, bar_ix, exp(sum(r) OVER (PARTITION BY session ORDER BY bar_ix)) AS price FROM em""",
    "rets", em=EMIS))
def proxy_price(m):
    return M.with_proxy_price(M.emission_table(m.seen())).select("session", "bar_ix", "price")


@query("f06_average_rank", shaped("sentiment_score rank", """
SELECT sentiment_score, min(rk) + (count(*) - 1) / 2.0 AS rank
FROM (SELECT sentiment_score, rank() OVER (ORDER BY sentiment_score) AS rk FROM sent) GROUP BY 1""", "sent"))
def average_rank(m):
    return average_ranks(m.events(), [], "sentiment_score")


@query("f07_rank_percentile", shaped("session:i cum_ret pct", """
SELECT a.session, a.cum_ret, (SELECT count(*) FROM base9 b WHERE b.session % 10 <= 5 AND b.cum_ret <= a.cum_ret)::DOUBLE
  / (SELECT count(*) FROM base9 WHERE session % 10 <= 5) AS pct FROM base9 a""", "base9"))
def rank_percentile(m):
    from barsight.operators.linear import percentile_against

    f = B.baseline_features(m.seen())
    train = f.where(F.col("session") % 10 <= 5)
    return percentile_against(f.select("session", "cum_ret"), train, "cum_ret", "pct")


@query("f10_edge_bars", shaped("session:i edge:s bar_ix:i close", """
SELECT session, 'last' AS edge, bar_ix, close FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY bar_ix DESC) AS k FROM seen) WHERE k <= 10
UNION ALL
SELECT session, 'first', bar_ix, close FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY bar_ix) AS k FROM seen) WHERE k <= 10""", "seen"))
def edge_bars(m):
    seen = m.seen()
    pick = lambda df, name: df.select("session", F.lit(name).alias("edge"), "bar_ix", "close")
    return pick(B.last_bars(seen, 10), "last").unionByName(pick(B.first_bars(seen, 10), "first"))


# --- scalar functions -----------------------------------------------------------------


@query("b01_guarded_division", shaped("session:i bar_ix:i ratio change", """
SELECT session, bar_ix, CASE WHEN abs(close - open) > 1e-12 THEN (high - low) / (close - open) ELSE 0 END AS ratio,
  CASE WHEN abs(close - open) > 1e-12 THEN (high - low) / (close - open) ELSE 0 END - 1 AS change FROM bars""", "bars"))
def guarded_division(m):
    top, bottom = F.col("high") - F.col("low"), F.col("close") - F.col("open")
    return m.bars().select(
        "session", "bar_ix", S.safe_div(top, bottom).alias("ratio"), S.change(top, bottom).alias("change")
    )


@query("b02_floored_log", shaped("session:i bar_ix:i body_log close_log", """
SELECT session, bar_ix, ln(greatest(close - open, 1e-12)) AS body_log, ln(greatest(close, 1e-12)) AS close_log FROM bars""", "bars"))
def floored_log(m):
    return m.bars().select(
        "session", "bar_ix", S.log_floor(F.col("close") - F.col("open")).alias("body_log"),
        S.log_floor("close").alias("close_log"),
    )


@query("b03_signed_square_label", shaped("session:i R r2 same",
    "SELECT session, R, R * R * 100 * sign(R) AS r2, R AS same FROM labels_all", "labels_all"))
def signed_square_label(m):
    r = L.realized_returns(m.seen(), m.unseen())
    return r.select(
        "session", "R", S.optimizer_label("R", "r2_sign_100").alias("r2"),
        S.optimizer_label("R", "identity").alias("same"),
    )


RULE_P = "SELECT session, 1 / (1 + exp(-50 * cum_ret)) AS p FROM base9"


def rule_probability(m):
    f = B.baseline_features(m.seen())
    return f.select("session", (1.0 / (1.0 + F.exp(-50.0 * F.col("cum_ret")))).alias("p"))


@query("b04_clipped_log_odds", shaped("session:i z", f"""
SELECT session, least(greatest(ln(q / (1 - q)), -10), 10) AS z
FROM (SELECT session, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM ({RULE_P}))""", "base9"))
def log_odds(m):
    return rule_probability(m).select("session", S.logit_clip("p").alias("z"))


@query("b05_entropy_and_margin", shaped("session:i entropy margin", f"""
SELECT session, -(q * ln(q) + (1 - q) * ln(1 - q)) AS entropy, abs(p - 0.5) AS margin
FROM (SELECT session, p, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM ({RULE_P}))""", "base9"))
def entropy_margin(m):
    return rule_probability(m).select(
        "session", S.binary_entropy("p").alias("entropy"), S.probability_margin("p").alias("margin")
    )


def _horner_sql(cs, x):
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


GAUSS = f"""
SELECT session, mu, CASE WHEN t > 0 THEN 1 - tail ELSE tail END AS p_up,
  mu + s * {S.normal_quantile(0.1)!r} AS q_lower, mu + s * {S.normal_quantile(0.5)!r} AS q_median,
  mu + s * {S.normal_quantile(0.9)!r} AS q_upper,
  greatest(s * {S.normal_quantile(0.9) - S.normal_quantile(0.1)!r}, 1e-6) AS u, s AS sigma, s * s AS sigma2
FROM (SELECT *, CASE WHEN a < 7.07106781186547
        THEN exp(-a * a / 2) * {_horner_sql(S._HART_TOP, 'a')} / {_horner_sql(S._HART_BOTTOM, 'a')}
        WHEN a <= 37 THEN exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
        ELSE 0 END AS tail
      FROM (SELECT session, cum_ret / 10 AS mu, greatest(vol / 10, 1e-9) AS s,
              (cum_ret / 10) / greatest(vol / 10, 1e-9) AS t, abs((cum_ret / 10) / greatest(vol / 10, 1e-9)) AS a FROM base9))"""


@query("b06_gaussian_projection", shaped("session:i mu p_up q_lower q_median q_upper u sigma sigma2", GAUSS, "base9"))
def gaussian(m):
    f = B.baseline_features(m.seen())
    return S.gaussian_projection(
        f.select("session", (F.col("cum_ret") / 10).alias("mu"), (F.col("vol") / 10).alias("sigma"))
    )


@query("b07_decay_weight", shaped("event_id:i w", "SELECT event_id, exp(-ln(2.0) * greatest(49 - bar_ix, 0) / 10) * confidence AS w FROM sent", "sent"))
def decay(m):
    return m.events().select("event_id", S.decay_weight("bar_ix", "confidence").alias("w"))


@query("b08_economic_weight", shaped("session:i w", """
SELECT session, least(greatest(1 + 0.5 * abs(R) / s, 0), 4) AS w
FROM labels_all, (SELECT stddev_pop(R) AS s FROM labels_all) WHERE R IS NOT NULL""", "labels_all"))
def weights(m):
    r = L.realized_returns(m.seen(), m.unseen()).where("R is not null")
    std = F.broadcast(r.agg(F.stddev_pop("R").alias("s")))
    return r.crossJoin(std).select("session", S.economic_weight("R", "s").alias("w"))


@query("b12_normalised_path", shaped("session:i bar_ix:i norm_close", """
SELECT session, bar_ix, close / first_value(open) OVER (PARTITION BY session ORDER BY bar_ix) AS norm_close FROM bars""", "bars"))
def normalised(m):
    return B.normalised_paths(m.bars())


@query("b13_return_quadrant", shaped("session:i seen_up:i r_up:i", """
SELECT session, CASE WHEN s > 0 AND r IS NOT NULL THEN 1 ELSE 0 END AS seen_up, CASE WHEN r > 0 AND s IS NOT NULL THEN 1 ELSE 0 END AS r_up
FROM (SELECT session, max(CASE WHEN bar_ix = 49 THEN close END) / max(CASE WHEN bar_ix = 0 THEN open END) - 1 AS s,
        max(CASE WHEN bar_ix = 99 THEN close END) / max(CASE WHEN bar_ix = 49 THEN close END) - 1 AS r FROM bars GROUP BY 1)""", "bars"))
def quadrant(m):
    return L.return_quadrant(L.seen_and_unseen_returns(m.bars()))


@query("b15_halfway_bar", shaped("session:i n:i half:i", """
SELECT session, count(*) AS n, CASE WHEN count(*) >= 2 AND count(*) % 2 = 0 THEN count(*) // 2 - 1 END AS half FROM bars GROUP BY 1""", "bars"))
def halfway(m):
    n = m.bars().groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return n.select("session", "n", S.halfway_bar("n").alias("half"))
