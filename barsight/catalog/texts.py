"""Registered queries: sentiment and news features, entities, text (E5, E16-E22, E27-E29, I, B9-B11, C9, D8-D11)."""

from pyspark.sql import functions as F

from barsight.catalog.base import query, shaped, with_parts
from barsight.functions import scalars as S
from barsight.operators import events as E, news as N

SHARES = """
SELECT session, kind, value, count(*) AS cnt, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY session, kind) AS p
FROM (SELECT session, 's' AS kind, sector AS value FROM ev UNION ALL SELECT session, 'g', granular_sector FROM ev) GROUP BY 1, 2, 3"""
MIX = """SELECT session, -sum(CASE WHEN kind = 's' THEN p * ln(p + 1e-12) END) AS sector_entropy,
  sum(CASE WHEN kind = 's' THEN p * p END) AS sector_hhi, count(*) FILTER (kind = 's') AS sector_num_unique,
  max(CASE WHEN kind = 's' THEN p END) AS sector_max_share,
  -sum(CASE WHEN kind = 'g' THEN p * ln(p + 1e-12) END) AS granular_sector_entropy FROM shares GROUP BY session"""

MOOD = f"""
SELECT b.session, {', '.join(f'coalesce({c}, 0) AS {c}' for c in N.SENTIMENT_COLUMNS)}
FROM (SELECT DISTINCT session FROM seen) b LEFT JOIN
 (SELECT session, corr(CASE WHEN mv IS NOT NULL THEN sentiment_score END, mv) AS sentiment_ret_corr,
    sum(sentiment_score) AS sentiment_sum, avg(sentiment_score) AS sentiment_mean, count(*) AS headline_sentiment_count,
    sum(sentiment_score * confidence) / sum(confidence) AS sentiment_weighted_mean, avg(confidence) AS confidence_mean,
    stddev_pop(sentiment_score) AS sentiment_std, avg(CASE WHEN sentiment = 'buy' THEN 1.0 ELSE 0 END) AS buy_frac,
    avg(sentiment_score) FILTER (bar_ix <= 24) AS sentiment_mean_early,
    avg(sentiment_score) FILTER (bar_ix >= 25) AS sentiment_mean_late
  FROM (SELECT e.*, a.close / p.close - 1 AS mv FROM ev e
        LEFT JOIN seen a ON a.session = e.session AND a.bar_ix = e.bar_ix AND e.bar_ix > 0
        LEFT JOIN seen p ON p.session = e.session AND p.bar_ix = e.bar_ix - 1) GROUP BY session) s USING (session)
 LEFT JOIN ({MIX}) m USING (session)"""


@query("e05_sentiment_features", shaped("session:i " + " ".join(N.SENTIMENT_COLUMNS), MOOD, "seen", "ev", shares=SHARES))
def sentiment(m):
    return N.sentiment_features(m.seen(), m.events())


AGG = """
SELECT session, count(*) AS news_headline_count, count(DISTINCT company) AS news_entity_count,
  avg(sentiment_score) AS news_mean_score, avg(sgn) AS news_mean_sign, avg(confidence) AS news_mean_conf,
  sum(sw) / sum(w) AS news_weighted_score, sum(gw) / sum(w) AS news_weighted_sign,
  max_by(sentiment_score, bar_ix * 1e9 + event_id) AS news_last_score, max_by(sgn, bar_ix * 1e9 + event_id) AS news_last_sign,
  max(abs(sentiment_score)) AS news_max_abs_score, count(*) FILTER (confidence >= 0.9) AS news_high_conf_count,
  count(*) FILTER (bar_ix >= 40) AS news_late_count,
  coalesce(sum(sw) FILTER (bar_ix >= 40) / sum(w) FILTER (bar_ix >= 40), 0) AS news_late_weighted_score,
  coalesce(sum(gw) FILTER (bar_ix >= 40) / sum(w) FILTER (bar_ix >= 40), 0) AS news_late_weighted_sign,
  coalesce(avg(sentiment_score) FILTER (bar_ix >= 40), 0) AS news_late_mean_score,
  coalesce(avg(sgn) FILTER (bar_ix >= 40), 0) AS news_late_mean_sign FROM ev GROUP BY session"""
AGG_NAMES = " ".join(c + (":i" if c.endswith("count") else "") for c in N.AGGREGATE_COLUMNS)


@query("e17_news_aggregates", shaped("session:i " + AGG_NAMES, AGG, "ev"))
def aggregates(m):
    return N.news_aggregates(m.events())


COMPACT = """
SELECT session, count(*) AS headline_count, avg(sentiment_score) AS mean_score,
  coalesce(stddev_samp(sentiment_score), 0) AS std_score, avg(sgn) AS mean_sign, avg(confidence) AS mean_conf,
  max(abs(sentiment_score)) AS max_abs_score, max_by(sentiment_score, bar_ix * 1e9 + event_id) AS last_score,
  max_by(sgn, bar_ix * 1e9 + event_id) AS last_sign, count(DISTINCT company) AS entity_count,
  sum(sw) / sum(w) AS weighted_score, sum(gw) / sum(w) AS weighted_sign, avg(sgn) AS buy_sell_balance
FROM ev GROUP BY session"""


@query("e18_compact_aggregates", shaped(
    "session:i " + " ".join(c + (":i" if c.endswith("count") else "") for c in N.COMPACT_COLUMNS), COMPACT, "ev"))
def compact(m):
    return N.compact_aggregates(m.events())


ARRIVAL = """
SELECT session, avg(CASE WHEN bar_ix < 12 THEN 1.0 ELSE 0 END) AS news_frac_q1,
  avg(CASE WHEN bar_ix BETWEEN 12 AND 24 THEN 1.0 ELSE 0 END) AS news_frac_q2,
  avg(CASE WHEN bar_ix BETWEEN 25 AND 36 THEN 1.0 ELSE 0 END) AS news_frac_q3,
  avg(CASE WHEN bar_ix >= 37 THEN 1.0 ELSE 0 END) AS news_frac_q4, avg(bar_ix) AS news_mean_bar_ix FROM ev GROUP BY session"""


@query("e19_arrival_profile", shaped("session:i " + " ".join(N.ARRIVAL_COLUMNS), ARRIVAL, "ev"))
def arrivals(m):
    return N.arrival_profile(m.events())


ENTITY = """
SELECT session, -sum(p * ln(greatest(p, 1e-12))) AS news_entity_entropy, max(p) AS news_top_entity_share,
  max(CASE WHEN rk = 1 THEN sw / w END) AS news_top_entity_weighted_sent, count(*) AS news_unique_entities
FROM (SELECT *, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY session) AS p,
        row_number() OVER (PARTITION BY session ORDER BY cnt DESC, company) AS rk
      FROM (SELECT session, company, count(*) AS cnt, sum(w) AS w, sum(sw) AS sw FROM ev GROUP BY 1, 2)) GROUP BY session"""


@query("e20_entity_concentration", shaped(
    "session:i " + " ".join(N.ENTITY_COLUMNS) + " news_unique_entities:i", ENTITY, "ev"))
def entity_concentration(m):
    return N.entity_concentration(m.events(), with_count=True)


SECTOR = """
SELECT session, sector_entropy AS news_sector_entropy, sector_hhi AS news_sector_hhi,
  sector_num_unique AS news_sector_num_unique, sector_max_share AS news_sector_max_share,
  granular_sector_entropy AS news_granular_sector_entropy FROM (%s)""" % MIX


@query("e21_sector_concentration", shaped("session:i " + " ".join(N.SECTOR_COLUMNS), SECTOR, "ev", shares=SHARES))
def sector_concentration(m):
    return N.sector_concentration(m.events())


TOP = "SELECT company, count(*) AS mentions FROM ev WHERE session % 10 <= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


@query("g02_top_companies", shaped("company:s mentions:i", TOP, "ev"))
def top_companies(m):
    from barsight.sources.market import split_of

    return N.top_entities(m.events().where(split_of("session") == "train"))


# the footprint keeps one column pair per company, so the check is on the long form
@query("e22_entity_footprint", shaped("session:i bucket:s cnt sent", """
SELECT session, bucket, count(*) AS cnt, avg(sentiment_score) AS sent
FROM (SELECT session, sentiment_score, CASE WHEN company IN (SELECT company FROM (
  SELECT company FROM ev GROUP BY 1 ORDER BY count(*) DESC, company LIMIT 10)) THEN company ELSE 'other' END AS bucket FROM ev)
GROUP BY 1, 2""", "ev"))
def footprint(m):
    names = [r[0] for r in N.top_entities(m.events()).collect()]
    wide = N.entity_footprint(m.events(), names)
    cells = F.array(*[
        F.struct(F.lit(n).alias("bucket"), F.col(f"news_ent_{n}_cnt").alias("cnt"), F.col(f"news_ent_{n}_sent").alias("sent"))
        for n in [*names, "other"]
    ])
    return wide.select("session", F.inline(cells)).where("cnt > 0")


@query("e16_modal_sector", shaped("session:i sector:s", """
SELECT session, sector FROM (SELECT session, sector, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, sector) AS k
FROM sent GROUP BY session, sector) WHERE k = 1""", "sent"))
def modal(m):
    return E.modal_sector(m.events(), m.events())


@query("e27_counts_by_phase", shaped("bar_ix:i seen:i unseen:i total:i", """
SELECT bar_ix, count(*) FILTER (bar_ix <= 49) AS seen, count(*) FILTER (bar_ix >= 50) AS unseen, count(*) AS total FROM sent GROUP BY 1""", "sent"))
def by_phase(m):
    from barsight.operators.reports import counts_by_phase

    return counts_by_phase(m.events())


@query("e28_company_report", shaped("company:s session:i bar_ix:i event_id:i sentiment:s sentiment_score confidence associated_sessions:i", """
SELECT company, session, bar_ix, event_id, sentiment, sentiment_score, confidence,
  (SELECT count(DISTINCT session) FROM sent b WHERE b.company = a.company) AS associated_sessions FROM sent a""", "sent"))
def report(m):
    return E.company_report(m.events()).select(
        "company", "session", "bar_ix", "event_id", "sentiment", "sentiment_score", "confidence", "associated_sessions")


W3 = "list_filter(string_split_regex(headline, '\\s+'), lambda x: x <> '')"
STOP = ", ".join(f"'{w}'" for w in S.SCORING_STOP_WORDS)
STOP_BATCH = ", ".join(f"'{w}'" for w in S.BATCH_STOP_WORDS)


def _granular_sql(stop):
    return f"""CASE WHEN len(w) < 2 THEN 'None' WHEN len(w) > 2 AND regexp_matches(w[3], '^\\p{{Lu}}') AND w[3] NOT IN ({stop})
    THEN w[2] || ' ' || w[3] ELSE w[2] END"""


@query("b10_entity_and_sector", shaped("event_id:i entity:s granular:s granular_batch:s", f"""
SELECT event_id, CASE WHEN len(w) > 0 THEN w[1] ELSE 'None' END AS entity, {_granular_sql(STOP)} AS granular,
  {_granular_sql(STOP_BATCH)} AS granular_batch FROM (SELECT event_id, {W3} AS w FROM head)""", "head"))
def entity_and_sector(m):
    return m.headlines().select(
        "event_id", S.entity("headline").alias("entity"), S.granular_sector("headline").alias("granular"),
        S.granular_sector("headline", S.BATCH_STOP_WORDS).alias("granular_batch"))


TITLES = ", ".join(f"'{w}'" for w in S.TITLE_WORDS)
CLEAN = f"""SELECT event_id, session, bar_ix, headline, array_to_string(list_filter(list_slice({W3}, 1, 3), lambda x:
  (NOT (suffix(x, 'ing') OR suffix(x, 's')) OR regexp_matches(x, '^\\P{{L}}*\\p{{Lu}}\\p{{Ll}}*(\\P{{L}}+\\p{{Lu}}\\p{{Ll}}*)*\\P{{L}}*$'))
  AND lower(x) NOT IN ({TITLES})), ' ') AS entity FROM head"""


def named(m):
    return m.headlines().withColumn("entity", S.cleaned_entity("headline"))


@query("b11_cleaned_entity", shaped("event_id:i entity:s", CLEAN, "head"))
def cleaned(m):
    return named(m).select("event_id", "entity")


@query("e29_entity_presence", shaped("entity:s mentions:i sessions:i bars:i", f"""
SELECT entity, count(*) AS mentions, count(DISTINCT session) AS sessions, count(DISTINCT bar_ix) AS bars FROM ({CLEAN}) GROUP BY 1""", "head"))
def presence(m):
    return E.entity_presence(named(m))


# every name against every headline
@query("c09_mention_position", shaped("entity:s headlines:i at_start:i elsewhere:i", f"""
SELECT entity, any_value(own) AS headlines, coalesce(sum(n) FILTER (starts_with(headline, entity)), 0) AS at_start,
  coalesce(sum(n) FILTER (contains(headline, entity) AND NOT starts_with(headline, entity)), 0) AS elsewhere
FROM (SELECT entity, count(*) AS own FROM ({CLEAN}) GROUP BY 1), (SELECT headline, count(*) AS n FROM head GROUP BY 1) GROUP BY 1""", "head"))
def mentions(m):
    return E.mention_position(named(m), "entity")


@query("i05_name_containment", shaped("entity:s n_words:i in_longer:i", f"""
SELECT entity, len(words) AS n_words, (array_to_string(words, ' ') IN (
    SELECT array_to_string(words[i:i + n - 1], ' ') FROM (SELECT words, i, unnest(range(1, least(len(words) - i + 1, len(words) - 1) + 1)) AS n
      FROM (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM nm WHERE len(words) > 1))))::INT AS in_longer FROM nm""", "head",
    nm=f"SELECT entity, list_filter(string_split(entity, ' '), lambda x: x <> '') AS words FROM (SELECT DISTINCT entity FROM ({CLEAN}))"))
def containment(m):
    return E.name_containment(named(m).select("entity"))


PROBS = "SELECT event_id, exp(a) / (exp(a) + exp(b) + exp(c)) AS pos, exp(b) / (exp(a) + exp(b) + exp(c)) AS neg, exp(c) / (exp(a) + exp(b) + exp(c)) AS neu FROM (SELECT event_id, sentiment_score * 2 AS a, -sentiment_score * 2 AS b, 1 - confidence AS c FROM sent)"


@query("b09_class_decision", shaped("event_id:i sentiment_score sentiment:s confidence", f"""
SELECT event_id, round(pos - neg + 1e-10, 4) AS sentiment_score, CASE WHEN pos - neg > 0 THEN 'buy' ELSE 'sell' END AS sentiment,
  round(greatest(pos, neg, neu), 4) AS confidence FROM ({PROBS})""", "sent"))
def class_decision(m):
    a, b, c = (F.exp(x) for x in (F.col("sentiment_score") * 2, -F.col("sentiment_score") * 2, 1 - F.col("confidence")))
    p = m.events().select("event_id", (a / (a + b + c)).alias("pos"), (b / (a + b + c)).alias("neg"), (c / (a + b + c)).alias("neu"))
    return p.select("event_id", *S.class_decision("pos", "neg", "neu"))


@query("d06_bar_and_previous", shaped("event_id:i close prev_close move", """
SELECT event_id, a.close, p.close AS prev_close, a.close / p.close - 1 AS move FROM sent e
JOIN bars a ON a.session = e.session AND a.bar_ix = e.bar_ix JOIN bars p ON p.session = e.session AND p.bar_ix = e.bar_ix - 1
WHERE e.bar_ix > 0""", "sent", "bars"))
def with_previous(m):
    return E.bar_and_previous(m.events(), m.bars()).select("event_id", "close", "prev_close", "move")


FWD = "SELECT e.event_id, e.sentiment, e.sentiment_score, e.confidence, e.sgn, r.close AS close_ref, " + ", ".join(
    f"ln(b{k}.close) - ln(r.close) AS fwd_ret_{k}" for k in E.HORIZONS
) + " FROM sent e LEFT JOIN bars r ON r.session = e.session AND r.bar_ix = e.bar_ix " + " ".join(
    f"LEFT JOIN bars b{k} ON b{k}.session = e.session AND b{k}.bar_ix = e.bar_ix + {k}" for k in E.HORIZONS
)
FWD_NAMES = [f"fwd_ret_{k}" for k in E.HORIZONS]


@query("d07_forward_returns", shaped("event_id:i close_ref " + " ".join(FWD_NAMES) + " valid_20:i",
    f"SELECT *, CASE WHEN fwd_ret_20 IS NOT NULL THEN 1 ELSE 0 END AS valid_20 FROM ({FWD})", "sent", "bars"))
def forward(m):
    return E.align_forward_returns(m.events(), m.bars()).select("event_id", "close_ref", *FWD_NAMES, "valid_20")


@query("d08_chart_marks", shaped("event_id:i session:i bar_ix:i mark_y", """
SELECT event_id, e.session, e.bar_ix, high * 1.002 AS mark_y FROM sent e LEFT JOIN bars b ON b.session = e.session AND b.bar_ix = e.bar_ix""", "sent", "bars"))
def marks(m):
    return E.chart_marks(m.events().select("event_id", "session", "bar_ix"), m.bars()).select("event_id", "session", "bar_ix", "mark_y")


@query("d09_prior_history", shaped("event_id:i n_prior:i score_prior n_prior_in_session:i", """
SELECT event_id, coalesce(sum(n) FILTER (WHERE true), 0) AS n_prior, coalesce(sum(s), 0) AS score_prior, coalesce(sum(n) FILTER (bs = a.session), 0) AS n_prior_in_session
FROM sent a LEFT JOIN (SELECT company AS bc, session AS bs, bar_ix AS bb, count(*) AS n, sum(sentiment_score) AS s FROM sent GROUP BY 1, 2, 3) b
  ON bc = a.company AND (bs < a.session OR (bs = a.session AND bb < a.bar_ix)) GROUP BY event_id""", "sent"))
def history(m):
    return E.history_totals(m.events()).select("event_id", "n_prior", "score_prior", "n_prior_in_session")


@query("d09_last_events", shaped("event_id:i back:i prior_event_id:i prior_session:i prior_bar_ix:i prior_score", """
SELECT * FROM (SELECT a.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.session DESC, b.bar_ix DESC, b.event_id DESC) AS back,
  b.event_id AS prior_event_id, b.session AS prior_session, b.bar_ix AS prior_bar_ix, b.sentiment_score AS prior_score
FROM sent a JOIN sent b ON a.company = b.company AND (b.session < a.session OR (b.session = a.session AND b.bar_ix < a.bar_ix))) WHERE back <= 5""", "sent"))
def last_history(m):
    return E.last_events(m.events(), 5)


BROAD = """CASE WHEN sector IN ('purchase', 'click') THEN 'Industrials' WHEN sector = 'signup' THEN 'Finance' ELSE 'Energy' END"""


def _sector_table(m):
    pairs = m.events().select("granular_sector", "sector").distinct()
    broad = F.when(F.col("sector").isin("purchase", "click"), "Industrials").when(F.col("sector") == "signup", "Finance").otherwise("Energy")
    return pairs.select("granular_sector", broad.alias("broad"))


def _half_mapped(m):
    keep = F.when(F.col("confidence") >= 0.75, F.col("sector"))
    return m.events().withColumn("sector", keep)


@query("d10_sector_lookup", shaped("event_id:i sector:s", f"""
SELECT event_id, CASE WHEN confidence >= 0.75 THEN sector ELSE CASE WHEN {BROAD} = 'Industrials' THEN 'Technology' ELSE {BROAD} END END AS sector FROM sent""", "sent"))
def sector_lookup(m):
    return E.map_sectors(_half_mapped(m), _sector_table(m)).select("event_id", "sector")


@query("n03_unmapped_sectors", shaped("granular_sector:s", "SELECT DISTINCT granular_sector FROM sent WHERE confidence < 0.75", "sent"))
def unmapped(m):
    return E.unmapped_sectors(_half_mapped(m))


@query("d11_result_upsert", shaped("event_id:i company:s sentiment:s sentiment_score", """
SELECT h.event_id, r.company, r.sentiment, r.sentiment_score FROM head h
LEFT JOIN (SELECT session, bar_ix, headline, min(company) AS company, min(sentiment) AS sentiment, min(sentiment_score) AS sentiment_score
  FROM head JOIN (SELECT event_id AS eid, company, sentiment, sentiment_score, confidence FROM sent) ON eid = event_id
  WHERE confidence >= 0.75 GROUP BY 1, 2, 3) r
ON r.session = h.session AND r.bar_ix = h.bar_ix AND r.headline = h.headline""", "head"))
def upsert(m):
    stored = (
        m.sentiments().where("confidence >= 0.75").groupBy("session", "bar_ix", E.text_id("headline").alias("headline_id"))
        .agg(*[F.min(c).alias(c) for c in ("company", "sentiment", "sentiment_score")])
    )
    return E.upsert_results(m.headlines(), stored, ("company", "sentiment", "sentiment_score")).select(
        "event_id", "company", "sentiment", "sentiment_score")


@query("i01_session_documents", shaped("session:i event_id:i position:i digest:s", """
SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY bar_ix, event_id) AS position, md5(headline) AS digest
FROM head WHERE bar_ix <= 49""", "head"))
def documents(m):
    d = N.ordered_documents(m.headlines(), 49)
    return d.select("session", "event_id", "position", F.md5("headline").alias("digest"))


def _q(text):
    return text.replace("'", "''")


DOC = f"SELECT session, regexp_extract_all(translate(lower(string_agg(headline, ' ' ORDER BY bar_ix, event_id)), '{_q(S.ACCENTS)}', '{_q(S.PLAIN)}'), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM head WHERE bar_ix <= 49 GROUP BY session"
GRAMS = """SELECT session, unnest(t) AS g FROM doc UNION ALL
SELECT session, unnest(list_transform(range(1, len(t)), lambda k: t[k] || ' ' || t[k + 1])) AS g FROM doc"""
BUCKETS = "SELECT session, ('0x' || substr(md5(g), 1, 8))::BIGINT % 32 AS b, count(*)::DOUBLE AS c FROM grams GROUP BY 1, 2"
HASH_NAMES = " ".join(f"news_hash_{i}" for i in range(32))
HASHED = "SELECT session, " + ", ".join(
    f"coalesce(max(CASE WHEN b = {i} THEN c END) / sqrt(sum(c * c)), 0) AS news_hash_{i}" for i in range(32)
) + " FROM buckets GROUP BY session"


@query("i02_hashed_fingerprint", shaped("session:i " + HASH_NAMES, HASHED, "head", doc=DOC, grams=GRAMS, buckets=BUCKETS))
def fingerprint(m):
    return N.hashed_fingerprint(m.headlines().where("bar_ix <= 49"))


NEWS_BLOCK = f"""
SELECT s.session, {', '.join(f'coalesce({c}, 0) AS {c}' for c in N.news_columns(32))} FROM (SELECT DISTINCT session FROM bars) s
LEFT JOIN ({AGG}) a USING (session) LEFT JOIN ({ARRIVAL}) b USING (session) LEFT JOIN ({ENTITY}) c USING (session)
LEFT JOIN ({SECTOR}) d USING (session) LEFT JOIN ({HASHED}) e USING (session)"""


@query("i04_news_spine", shaped("session:i " + AGG_NAMES + " " + " ".join(N.news_columns(32)[16:]), NEWS_BLOCK,
    "bars", "ev", "head", shares=SHARES, doc=DOC, grams=GRAMS, buckets=BUCKETS))
def news_spine(m):
    return N.news_features(m.bars(), m.events().where("bar_ix <= 49"), m.headlines().where("bar_ix <= 49"))
