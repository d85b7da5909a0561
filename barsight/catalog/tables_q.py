"""Registered queries: sources, sinks, pools, splits, joins, reports (A, C, D, E23-E31, G, H, N)."""

import os

from pyspark.sql import functions as F

from barsight import schemas
from barsight.catalog.base import query, shaped
from barsight.catalog.texts import CLEAN, FWD  # noqa: F401
from barsight.operators import bars as B, events as E, labels as L, news as N, reports as P, sampling as G, scoring as Z
from barsight.operators.sizing import baseline_positions
from barsight.session import cut_lineage, new_path
from barsight.sources import tables as T
from barsight.sources.market import split_of
from barsight.streaming.incremental import score_incrementally


def write_layout(m, sentiments=False):
    """The data layout of the reader functions, written once per call to a fresh folder."""
    folder = new_path(m.spark, "layout")
    bars = m.bars().withColumn("session", F.col("session").cast("long"))
    for split, cond in (("train", "seen_train"), ("public", "seen_public_test"), ("private", "seen_private_test")):
        bars.where(split_of("session") == split).where("bar_ix <= 49").write.parquet(os.path.join(folder, T.BARS[cond]))
    bars.where(split_of("session") == "train").where("bar_ix >= 50").write.parquet(os.path.join(folder, T.BARS["unseen_train"]))
    return folder


def write_sentiments(m):
    folder = new_path(m.spark, "sentiments")
    cols = [f.name for f in schemas.SENTIMENTS.fields]
    ev = m.sentiments().where("bar_ix <= 49")
    for split, name in (("train", "seen_train"), ("public", "seen_public_test"), ("private", "seen_private_test")):
        ev.where(split_of("session") == split).select(*cols).write.options(**T.CSV_OPTIONS).csv(os.path.join(folder, T.SENTIMENTS[name]))
    return folder


ALL_SEEN = ("seen_train", "seen_public_test", "seen_private_test")


@query("a01_bars_scan", shaped("session:i bar_ix:i close", "SELECT session, bar_ix, close FROM seen WHERE session % 10 <= 5", "seen"))
def bars_scan(m):
    return T.read_bars(m.spark, write_layout(m), "seen_train", ["session", "bar_ix", "close"])


@query("a02_optional_headlines", shaped("session:i headline_count:i", "SELECT s.session, coalesce(c, 0) AS headline_count FROM (SELECT DISTINCT session FROM seen) s LEFT JOIN (SELECT session, count(*) AS c FROM head WHERE bar_ix <= 49 GROUP BY 1) h ON h.session = s.session AND s.session % 10 <= 5 WHERE s.session % 10 <= 7", "seen", "head"))
def optional_headlines(m):
    """With a headline file for the train sessions, and without one for the public sessions."""
    folder = write_layout(m)
    own = m.headlines().where((split_of("session") == "train") & (F.col("bar_ix") <= 49))
    own.select(*[F.col(f.name).cast(f.dataType) for f in schemas.HEADLINES.fields]).write.parquet(os.path.join(folder, T.HEADLINES["seen_train"]))
    out = [
        B.baseline_features(T.read_bars(m.spark, folder, s), T.read_headlines(m.spark, folder, s)).select("session", "headline_count")
        for s in ("seen_train", "seen_public_test")
    ]
    return out[0].unionByName(out[1])


@query("a03_sentiment_scan", shaped("session:i bar_ix:i company:s sentiment:s sentiment_score confidence sign digest:s", """
SELECT h.session, h.bar_ix, company, sentiment, sentiment_score, confidence, sgn AS sign, md5(headline) AS digest
FROM head h JOIN (SELECT event_id, company, sentiment, sentiment_score, confidence, sgn FROM ev) USING (event_id) WHERE h.session % 10 <= 5""", "head", "ev"))
def sentiment_scan(m):
    df = T.read_sentiments(m.spark, write_sentiments(m), "seen_train")
    return df.select("session", "bar_ix", "company", "sentiment", "sentiment_score", "confidence", "sign", F.md5("headline").alias("digest"))


@query("a04_feature_splits", shaped("session:i events:i chars:i", """
SELECT session, count(*) AS events, sum(length(headline)) AS chars FROM head WHERE bar_ix <= 49 GROUP BY 1""", "head"))
def feature_splits(m):
    df = T.read_feature_sentiments(m.spark, write_sentiments(m), ALL_SEEN)
    return df.groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.sum(F.length("headline")).alias("chars"))


@query("a05_split_union", shaped("session:i bars:i close_sum", "SELECT session, count(*) AS bars, sum(close) AS close_sum FROM seen GROUP BY 1", "seen"))
def split_union(m):
    df = T.read_bar_splits(m.spark, write_layout(m), ALL_SEEN)
    return df.groupBy("session").agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("close_sum"))


@query("a06_full_trajectory", shaped("session:i bar_ix:i open high low close", "SELECT * FROM bars", "bars"))
def trajectory(m):
    return L.full_trajectories(m.seen(), m.unseen())


@query("a07_tagged_path", shaped("session:i bar_ix:i close phase:s", "SELECT session, bar_ix, close, CASE WHEN bar_ix <= 49 THEN 'seen' ELSE 'unseen' END AS phase FROM bars", "bars"))
def tagged(m):
    return L.tagged_trajectories(m.seen(), m.unseen()).select("session", "bar_ix", "close", "phase")


@query("a08_session_pools", shaped("session:i pool:s", "SELECT DISTINCT session, CASE WHEN session % 10 <= 5 THEN 'train' ELSE 'test' END AS pool FROM seen", "seen"))
def pools(m):
    seen = m.seen()
    part = lambda s: seen.where(split_of("session") == s)
    train = L.session_pool(part("train")).withColumn("pool", F.lit("train"))
    return train.unionByName(L.session_pool(part("public"), part("private")).withColumn("pool", F.lit("test")))


@query("a09_submission_sink", shaped("session:i target_position", "SELECT session, cum_ret AS target_position FROM base9", "base9"))
def submission(m):
    path = new_path(m.spark, "submission")
    T.write_submission(B.baseline_features(m.seen()).select("session", F.col("cum_ret").alias("target_position")), path)
    return T.read_submission(m.spark, path)


def rule_predictions(m):
    """Predictions without a model, from the momentum and volatility of each session."""
    f = B.baseline_features(m.seen())
    mu, u = F.col("cum_ret") / 10, F.greatest("vol", F.lit(1e-4))
    return f.select("session", mu.alias("mu"), (1 / (1 + F.exp(-5 * mu))).alias("p_up"), (mu - u / 2).alias("q_lower"), mu.alias("q_median"), (mu + u / 2).alias("q_upper"), u.alias("u"))


RANKED = """SELECT *, mu * (2 * p_up - 1) AS edge, mu * (2 * p_up - 1) / greatest(u, 1e-6) AS z, 1.0 AS target_position FROM preds"""
RANK_NAMES = "session:i mu p_up q_lower q_median q_upper u edge z target_position"


@query("a10_ranking_sink", shaped(RANK_NAMES, RANKED, "preds"))
def ranking_sink(m):
    from barsight.operators.sizing import ranking, size_with_fallback

    p = rule_predictions(m)
    path = new_path(m.spark, "ranking")
    T.write_table(ranking(p, size_with_fallback(p)), path, "json", ["session"])
    schema = ", ".join(f"{c.split(':')[0]} {'long' if c.endswith(':i') else 'double'}" for c in RANK_NAMES.split())
    return m.spark.read.schema(schema).json(path)


@query("a11_incremental_scoring", shaped("session:i results:i scored_in_second_run:i first_new_bar:i", """
SELECT session, count(*) AS results, nullif(count(DISTINCT (bar_ix, headline)) FILTER (bar_ix >= 50), 0) AS scored_in_second_run,
  min(bar_ix) FILTER (bar_ix >= 50) AS first_new_bar FROM head GROUP BY 1""", "head"))
def incremental(m):
    path = new_path(m.spark, "cache")
    heads = m.headlines()
    score_incrementally(heads.where("bar_ix <= 49"), path)
    scored, fresh = score_incrementally(heads, path)
    late = fresh.groupBy("session").agg(F.count(F.lit(1)).alias("scored_in_second_run"), F.min("bar_ix").alias("first_new_bar"))
    return scored.groupBy("session").agg(F.count(F.lit(1)).alias("results")).join(late, "session", "left")


@query("a12_export_profile", shaped("column:s type:s rows:i non_null:i", """
SELECT unnest(['session', 'bar_ix', 'open', 'high', 'low', 'close']) AS "column", unnest(['bigint', 'int', 'double', 'double', 'double', 'double']) AS type,
  n AS rows, n AS non_null FROM (SELECT count(*) AS n FROM bars)""", "bars"))
def export(m):
    return T.export_with_profile(m.bars(), new_path(m.spark, "export")).drop("sample")


SIDES = """SELECT session, CASE WHEN row_number() OVER (ORDER BY md5('0|' || session), session) <= greatest(1, least(n - 1, round_even(0.2 * n, 0)))
  THEN 'validation' ELSE 'train' END AS side FROM (SELECT session, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM seen))"""


@query("a13_split_dataset", shaped("table_name:s sessions:i rows:i", f"""
WITH s AS ({SIDES})
SELECT 'seen_train' AS table_name, count(DISTINCT b.session) AS sessions, count(*) AS rows FROM seen b JOIN s USING (session) WHERE side = 'train'
UNION ALL SELECT 'unseen_train', count(DISTINCT b.session), count(*) FROM unseen b JOIN s USING (session) WHERE side = 'train'
UNION ALL SELECT 'seen_public_test', count(DISTINCT b.session), count(*) FROM seen b JOIN s USING (session) WHERE side = 'validation'
UNION ALL SELECT 'seen_private_test', 0, 0""", "seen", "unseen"))
def split_dataset(m):
    bars = cut_lineage(m.bars())
    seen, unseen = bars.where("bar_ix <= 49"), bars.where("bar_ix >= 50")
    sides = G.holdout_split(seen, 0.2, 0)
    folder = T.write_split_dataset(new_path(m.spark, "split"), sides, seen, unseen, m.events().drop("sign"))
    parts = [T.read_bars(m.spark, folder, s).agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(s)) for s in T.BARS]
    return L.union_all(parts).select("table_name", "sessions", "rows")


SPLIT = "CASE WHEN session % 10 <= 5 THEN 'train' WHEN session % 10 <= 7 THEN 'public' ELSE 'private' END"


@query("a14_pool_reference", shaped("split:s first_session:i last_session:i sessions:i", f"""
SELECT {SPLIT} AS split, min(session) AS first_session, max(session) AS last_session, count(DISTINCT session) AS sessions FROM seen GROUP BY 1""", "seen"))
def pool_reference(m):
    return T.pool_reference(m.seen().withColumn("split", split_of("session")))


# --- filters ---------------------------------------------------------------------------


@query("c01_bar_pick", shaped("session:i c24 c49 c99 c_last", """
SELECT session, max(CASE WHEN bar_ix = 24 THEN close END) AS c24, max(CASE WHEN bar_ix = 49 THEN close END) AS c49,
  max(CASE WHEN bar_ix = 99 THEN close END) AS c99, max(CASE WHEN bar_ix = (SELECT max(bar_ix) FROM bars) THEN close END) AS c_last FROM bars GROUP BY 1""", "bars"))
def bar_pick(m):
    b = m.bars()
    out = L.last_bar_pick(b, "c_last")
    for k in (24, 49, 99):
        out = out.join(L.bar_pick(b, k, f"c{k}"), "session", "full")
    return out


@query("c02_observability_cut", shaped("session:i first_half:i seen:i rows:i", """
SELECT session, count(*) FILTER (bar_ix <= 24) AS first_half, count(*) FILTER (bar_ix <= 49) AS seen, count(*) FILTER (k <= 50) AS rows
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY bar_ix) AS k FROM bars) GROUP BY 1""", "bars"))
def cut(m):
    from barsight.operators.emissions import first_rows

    b = m.bars()
    n = lambda df, name: df.groupBy("session").agg(F.count(F.lit(1)).alias(name))
    return n(b.where("bar_ix <= 24"), "first_half").join(n(b.where("bar_ix <= 49"), "seen"), "session").join(n(first_rows(b, 50), "rows"), "session")


@query("c03_leakage_guard", shaped("session:i events:i", "SELECT session, count(*) AS events FROM ev GROUP BY 1", "ev"))
def guard(m):
    return N.assert_no_future(m.events().where("bar_ix <= 49")).groupBy("session").agg(F.count(F.lit(1)).alias("events"))


@query("c04_membership", shaped("session:i bars:i", "SELECT session, count(*) AS bars FROM bars WHERE session IN (SELECT session FROM sent WHERE confidence >= 0.95) GROUP BY 1", "bars", "sent"))
def membership(m):
    return L.members(m.bars(), m.events().where("confidence >= 0.95")).groupBy("session").agg(F.count(F.lit(1)).alias("bars"))


@query("c05_finite_horizons", shaped("horizon:i n:i", "\nUNION ALL ".join(
    f"SELECT {k} AS horizon, count(fwd_ret_{k}) AS n FROM ({FWD}) HAVING count(fwd_ret_{k}) >= 10" for k in E.HORIZONS), "sent", "bars"))
def finite(m):
    from barsight.operators.validation import MIN_ROWS, long_returns

    long = long_returns(E.align_forward_returns(m.events(), m.bars()))
    return long.groupBy("horizon").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS)


SEGMENT = """
SELECT a.session, a.open_first AS feat_seen_open_first, a.close_last AS feat_seen_close_last, a.ret AS feat_seen_return, a.vol AS feat_seen_vol,
  a.rng AS feat_seen_range_hl, a.mean AS feat_seen_mean_bar_ret, b.open_first AS label_unseen_open_first, b.close_last AS label_unseen_close_last,
  b.ret AS label_unseen_return, b.vol AS label_unseen_vol, b.rng AS label_unseen_range_hl, b.mean AS label_unseen_mean_bar_ret,
  a.c49 AS ref_close_bar49, b.c99 AS ref_close_bar99, b.c99 / a.c49 - 1 AS R, b.c99 / a.open_first - 1 AS full_session_return
FROM seg a JOIN seg b ON a.session = b.session AND a.s = 1 AND b.s = 0"""
SEG = """
SELECT session, s, min_by(open, bar_ix) AS open_first, max_by(close, bar_ix) AS close_last, max_by(close, bar_ix) / min_by(open, bar_ix) - 1 AS ret,
  stddev_pop(r) AS vol, max(high) - min(low) AS rng, avg(r) AS mean, max(CASE WHEN bar_ix = 49 THEN close END) AS c49, max(CASE WHEN bar_ix = 99 THEN close END) AS c99
FROM (SELECT *, CASE WHEN bar_ix <= 49 THEN 1 ELSE 0 END AS s,
        coalesce(close / lag(close) OVER (PARTITION BY session, bar_ix <= 49 ORDER BY bar_ix) - 1, 0) AS r FROM bars) GROUP BY 1, 2"""
SEG_COLS = [f"{p}{c}" for p in ("feat_seen_", "label_unseen_") for c in ("open_first", "close_last", "return", "vol", "range_hl", "mean_bar_ret")] + ["ref_close_bar49", "ref_close_bar99", "R", "full_session_return"]


@query("e24_segment_table", shaped("session:i " + " ".join(SEG_COLS), SEGMENT, "bars", seg=SEG))
def segment(m):
    return B.segment_table(m.seen(), m.unseen())


@query("c06_usable_columns", shaped("column:s non_null:i distinct_values:i", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM ({SEGMENT})" for c in SEG_COLS), "bars", seg=SEG))
def usable(m):
    return P.column_usability(B.segment_table(m.seen(), m.unseen()), SEG_COLS)


@query("c07_feature_columns", shaped("column:s block:s mean", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'feature' if c.startswith('feat') else 'label'}' AS block, avg({c}) AS mean FROM ({SEGMENT})"
    for c in SEG_COLS if not c.startswith("ref") and c not in ("label_unseen_open_first", "label_unseen_close_last")), "bars", seg=SEG))
def columns(m):
    from barsight.operators.rich import label_names, seen_feature_names

    df = B.segment_table(m.seen(), m.unseen())
    long = P.melt(df, seen_feature_names(df.columns), (), "column").withColumn("block", F.lit("feature"))
    long = long.unionByName(P.melt(df, label_names(df.columns), (), "column").withColumn("block", F.lit("label")))
    return long.groupBy("column", "block").agg(F.avg("value").alias("mean"))


MODAL = "SELECT session, sector FROM (SELECT session, sector, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, sector) AS k FROM sent GROUP BY session, sector) WHERE k = 1"


@query("c08_sector_filter", shaped("session:i bars:i", f"SELECT session, count(*) AS bars FROM bars WHERE session IN (SELECT session FROM ({MODAL}) WHERE sector IN ('view', 'click')) GROUP BY 1", "bars", "sent"))
def sector_filter(m):
    keep = E.modal_sector(m.events(), m.bars()).where(F.col("sector").isin("view", "click"))
    return L.members(m.bars(), keep).groupBy("session").agg(F.count(F.lit(1)).alias("bars"))


# --- joins -----------------------------------------------------------------------------

LABEL_NAMES = "session:i close_half close_end R"


@query("d01_full_outer_label", shaped(LABEL_NAMES, "SELECT * FROM labels_all", "labels_all"))
def label_outer(m):
    return L.realized_returns(m.seen(), m.unseen())


@query("d02_inner_label", shaped(LABEL_NAMES, "SELECT * FROM labels_all WHERE R IS NOT NULL", "labels_all"))
def label_inner(m):
    return L.realized_returns_inner(m.seen(), m.unseen())


PROXY = "SELECT session, max(CASE WHEN bar_ix = 24 THEN close END) AS close_24, max(CASE WHEN bar_ix = 49 THEN close END) AS close_49, max(CASE WHEN bar_ix = 49 THEN close END) / max(CASE WHEN bar_ix = 24 THEN close END) - 1 AS R FROM seen WHERE bar_ix IN (24, 49) GROUP BY 1"


@query("d03_proxy_label", shaped("session:i close_24 close_49 R", PROXY, "seen"))
def proxy(m):
    return L.proxy_returns(m.seen())


@query("d04_feature_label_join", shaped("session:i cum_ret vol R", "SELECT session, cum_ret, vol, R FROM base9 JOIN labels_all USING (session)", "base9", "labels_all"))
def feature_label(m):
    return L.join_labels(B.baseline_features(m.seen()), L.realized_returns(m.seen(), m.unseen())).select("session", "cum_ret", "vol", "R")


@query("d05_feature_blocks", shaped("session:i cum_ret headline_count:i mean_score entity_count:i", """
SELECT b.session, cum_ret, b.headline_count, coalesce(mean_score, 0) AS mean_score, coalesce(entity_count, 0) AS entity_count FROM base9 b
LEFT JOIN (SELECT session, avg(sentiment_score) AS mean_score, count(DISTINCT company) AS entity_count FROM ev GROUP BY 1) USING (session)""", "base9", "ev"))
def feature_blocks(m):
    base = B.baseline_features(m.seen(), m.events(), 49).select("session", "cum_ret", "headline_count")
    early = N.compact_aggregates(m.events()).select("session", "mean_score", "entity_count")
    return N.left_join_zero(base, [early])


@query("d12_anti_join", shaped("session:i", "SELECT DISTINCT session FROM bars WHERE session % 10 > 5", "bars"))
def anti(m):
    pool = m.bars().where(split_of("session") == "train")
    return L.non_members(m.bars(), pool).select("session").distinct()


@query("d16_label_alignment", shaped("session:i cum_log_ret R", "SELECT session, sum(coalesce(lr, 0)) AS cum_log_ret, max(R) AS R FROM rets JOIN labels_all USING (session) GROUP BY 1", "rets", "labels_all"))
def alignment(m):
    from barsight.operators.emissions import emission_table, session_summary

    s = session_summary(emission_table(m.seen())).select("session", "cum_log_ret")
    return L.require_labels(s, L.realized_returns_inner(m.seen(), m.unseen()))


# --- reports ---------------------------------------------------------------------------


@query("e23_session_overview", shaped("session:i first_open last_close total_return headline_count:i bars:i", """
SELECT b.session, min_by(open, bar_ix) AS first_open, max_by(close, bar_ix) AS last_close, max_by(close, bar_ix) / min_by(open, bar_ix) - 1 AS total_return,
  max(coalesce(c, 0)) AS headline_count, count(*) AS bars FROM bars b LEFT JOIN (SELECT session, count(*) AS c FROM sent GROUP BY 1) h USING (session) GROUP BY 1""", "bars", "sent"))
def overview(m):
    return B.session_overview(m.seen(), m.unseen(), m.events())


@query("e25_path_bands", shaped("bar_ix:i p05 p25 p50 p75 p95 mean", """
SELECT bar_ix, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95, avg(x) AS mean
FROM (SELECT bar_ix, close / first_value(open) OVER (PARTITION BY session ORDER BY bar_ix) AS x FROM bars) GROUP BY 1""", "bars"))
def bands(m):
    return P.path_bands(B.normalised_paths(m.bars()), m.rows("supplier"))


@query("e26_return_maps", shaped("session:i seen_return R", """
SELECT session, max(CASE WHEN bar_ix = 49 THEN close END) / max(CASE WHEN bar_ix = 0 THEN open END) - 1 AS seen_return,
  max(CASE WHEN bar_ix = 99 THEN close END) / max(CASE WHEN bar_ix = 49 THEN close END) - 1 AS R FROM bars GROUP BY 1""", "bars"))
def return_maps(m):
    return L.seen_and_unseen_returns(m.bars())


CORR_F = ["feat_seen_return", "feat_seen_vol", "feat_seen_range_hl", "feat_seen_mean_bar_ret"]
CORR_L = ["label_unseen_return", "label_unseen_vol", "R", "full_session_return"]
RANKED_SEG = "SELECT session, " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in CORR_F + CORR_L) + f" FROM ({SEGMENT})"


def _corr_sql(src, method):
    return "\nUNION ALL ".join(f"SELECT '{method}' AS method, '{a}' AS feature, '{b}' AS label, corr({a}, {b}) AS corr FROM {src}" for a in CORR_F for b in CORR_L)


@query("e30_correlation_block", shaped("method:s feature:s label:s corr", _corr_sql("sg", "pearson") + "\nUNION ALL " + _corr_sql("rk", "spearman"), "bars", seg=SEG, sg=SEGMENT, rk=RANKED_SEG))
def correlation(m):
    bars = cut_lineage(m.bars())
    table = B.segment_table(bars.where("bar_ix <= 49"), bars.where("bar_ix >= 50"))
    df = cut_lineage(table.select("session", *CORR_F, *CORR_L))
    parts = [P.correlation_block(df, CORR_F, CORR_L, k).withColumn("method", F.lit(k)) for k in ("pearson", "spearman")]
    return parts[0].unionByName(parts[1])


@query("e31_histogram", shaped("bin:i n:i", """
SELECT least(floor((ret + 1) / 0.1), 39) AS bin, count(*) AS n FROM (SELECT coalesce(close / lag(close) OVER (PARTITION BY session ORDER BY bar_ix) - 1, 0) AS ret FROM bars)
WHERE ret BETWEEN -1 AND 3 GROUP BY 1""", "bars"))
def histogram(m):
    return P.histogram(B.with_bar_returns(m.bars()), "ret", -1.0, 3.0, 40)


@query("l14_pair_scatter", shaped("session:i x y corr", f"SELECT session, feat_seen_return AS x, R AS y, (SELECT corr(feat_seen_return, R) FROM sg) AS corr FROM sg", "bars", seg=SEG, sg=SEGMENT))
def scatter(m):
    df = B.segment_table(m.seen(), m.unseen())
    c = P.correlation_block(df, ["feat_seen_return"], ["R"]).select("corr")
    return P.pair_scatter(df, "feat_seen_return", "R").crossJoin(F.broadcast(c))


# --- order, samples, sets --------------------------------------------------------------


@query("g01_total_order", shaped("session:i cum_ret", "SELECT session, cum_ret FROM base9 ORDER BY session", "base9"))
def total_order(m):
    return B.baseline_features(m.seen()).select("session", "cum_ret").orderBy("session")


@query("g05_block_split", shaped("session:i block:s", """
SELECT session, CASE WHEN row_number() OVER (ORDER BY session) <= 25 THEN 'first' ELSE 'second' END AS block
FROM (SELECT session FROM (SELECT DISTINCT session FROM bars) ORDER BY md5('0|' || session), session LIMIT 50)""", "bars"))
def block_split(m):
    return G.block_split(m.bars(), 0)


@query("g06_holdout_split", shaped("session:i side:s", SIDES, "seen"))
def holdout(m):
    return G.holdout_split(m.seen(), 0.2, 0)


@query("g07_kfold", shaped("seed:i session:i fold:i", "\nUNION ALL ".join(
    f"SELECT {s} AS seed, session, ntile(5) OVER (ORDER BY md5('{s}|' || session), session) - 1 AS fold FROM (SELECT DISTINCT session FROM bars)" for s in (0, 1, 2)), "bars"))
def folds(m):
    return G.repeated_kfold(m.bars(), 5, (0, 1, 2))


@query("g08_path_sample", shaped("session:i bar_ix:i norm_close", """
SELECT session, bar_ix, close / first_value(open) OVER (PARTITION BY session ORDER BY bar_ix) AS norm_close FROM bars
WHERE session IN (SELECT session FROM (SELECT DISTINCT session FROM bars) ORDER BY md5('0|' || session), session LIMIT 28)""", "bars"))
def path_sample(m):
    b = m.bars()
    return B.normalised_paths(L.members(b, G.sample_paths(b, 28, 0)))


@query("f09_first_headlines", shaped("session:i event_id:i", """
SELECT session, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY bar_ix, event_id) AS k FROM sent) WHERE k <= 5""", "sent"))
def first_headlines(m):
    return G.first_headlines(m.events(), 5).select("session", "event_id")


@query("h01_union_all", shaped("session:i bars:i", "SELECT session, count(*) AS bars FROM bars GROUP BY 1", "bars"))
def union_all(m):
    b = m.bars()
    return L.union_all([b.where(split_of("session") == s) for s in ("train", "public", "private")]).groupBy("session").agg(F.count(F.lit(1)).alias("bars"))


@query("h02_union_distinct", shaped("session:i", "SELECT DISTINCT session FROM bars UNION SELECT DISTINCT session FROM sent", "bars", "sent"))
def union_distinct(m):
    return L.session_pool(m.bars(), m.events())


@query("h03_intersect", shaped("session:i", "SELECT session FROM seen INTERSECT SELECT session FROM unseen", "seen", "unseen"))
def intersect(m):
    return L.shared_sessions(m.seen(), m.unseen())


@query("h04_common_columns", shaped("column:s mean", """
SELECT 'cum_ret' AS "column", avg(cum_ret) AS mean FROM base9 UNION ALL SELECT 'vol', avg(vol) FROM base9 UNION ALL SELECT 'range_hl', avg(range_hl) FROM base9""", "base9"))
def common(m):
    a = B.baseline_features(m.seen()).select("session", "cum_ret", "vol", "range_hl", "max_high")
    b = B.baseline_features(m.seen()).select("session", "cum_ret", "vol", "range_hl", "min_low")
    both = [c for c in a.columns if c in b.columns and c != "session"]
    return P.melt(a, both, (), "column").groupBy("column").agg(F.avg("value").alias("mean"))


# --- stored responses and scoring --------------------------------------------------------


def _responses(m):
    """Stored JSON responses built from the events, eight requests a batch."""
    ev = m.events().select("event_id", "company", "sentiment", "confidence", F.floor(F.col("event_id") / 8).alias("batch_id"), (F.col("event_id") % 8).cast("int").alias("id"))
    item = F.struct("id", F.when(F.col("id") == 3, "None").otherwise(F.col("company")).alias("company"), "sentiment", "confidence", F.concat(F.lit("because "), "sentiment").alias("reasoning"))
    text = F.concat(F.lit("note {\"results\":"), F.to_json(F.sort_array(F.collect_list(item))), F.lit("} end"))
    bad = F.when(F.col("batch_id") % 10 == 9, F.lit("no answer")).otherwise(F.col("response"))
    stored = ev.groupBy("batch_id").agg(text.alias("response")).withColumn("response", bad)
    return ev.select("event_id", "batch_id", "id"), stored


@query("n02_stored_responses", shaped("event_id:i company:s sentiment:s confidence reasoning:s", """
SELECT event_id, CASE WHEN ok AND event_id % 8 <> 3 THEN company END AS company, CASE WHEN ok THEN sentiment END AS sentiment, CASE WHEN ok THEN confidence END AS confidence,
  CASE WHEN ok THEN 'because ' || sentiment ELSE 'Failed to parse JSON from response: no answer' END AS reasoning
FROM (SELECT *, (event_id // 8) % 10 <> 9 AS ok FROM sent)""", "sent"))
def responses(m):
    req, stored = _responses(m)
    return Z.apply_responses(req, stored).select("event_id", "company", "sentiment", "confidence", "reasoning")


@query("n01_batch_scoring")
def scoring(m):
    return Z.score_headlines(m.headlines()).groupBy("company", "sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("score"), F.avg("confidence").alias("confidence"))


@query("n04_grouped_functions", shaped("session:i max_abs sector:s", f"""
SELECT session, max_abs, sector FROM (SELECT session, max(abs(sentiment_score)) AS max_abs FROM sent GROUP BY 1) JOIN ({MODAL}) USING (session)""", "sent"))
def grouped_functions(m):
    ev = m.events()
    top = ev.groupBy("session").agg(F.max(F.abs("sentiment_score")).alias("max_abs"))
    return top.join(E.modal_sector(ev, ev), "session")


@query("k10_baseline_positions")
def baselines(m):
    z = baseline_positions(m.bars(), "zeros").withColumn("method", F.lit("zeros"))
    return z.unionByName(baseline_positions(m.bars(), "gaussian", 7).withColumn("method", F.lit("gaussian")))
