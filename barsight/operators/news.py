"""Session features of timed sentiment events and headline texts."""

from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W, functions as F

from barsight.functions.scalars import (
    EPS,
    decay_weight,
    first_word,
    last_word,
    md5_bucket,
    sentiment_sign,
    text_tokens,
    zero_if_null,
)
from barsight.functions.stats import entropy_clipped, entropy_of, guarded_corr
from barsight.operators.bars import by_bar

# "Last" needs an order: the bar, then the event id.
EVENT_ORDER = ("bar_ix", "event_id")

SENTIMENT_COLUMNS = [
    "sentiment_ret_corr", "sentiment_sum", "sentiment_mean", "headline_sentiment_count",
    "sector_entropy", "sector_hhi", "sector_num_unique", "sector_max_share",
    "sentiment_weighted_mean", "confidence_mean", "sentiment_std", "buy_frac",
    "sentiment_mean_early", "sentiment_mean_late", "granular_sector_entropy",
]
AGGREGATE_COLUMNS = [
    "news_headline_count", "news_entity_count", "news_mean_score", "news_mean_sign",
    "news_mean_conf", "news_weighted_score", "news_weighted_sign", "news_last_score",
    "news_last_sign", "news_max_abs_score", "news_high_conf_count", "news_late_count",
    "news_late_weighted_score", "news_late_weighted_sign", "news_late_mean_score",
    "news_late_mean_sign",
]
COMPACT_COLUMNS = [
    "headline_count", "mean_score", "std_score", "mean_sign", "mean_conf", "max_abs_score",
    "last_score", "last_sign", "entity_count", "weighted_score", "weighted_sign",
    "buy_sell_balance",
]
ARRIVAL_COLUMNS = ["news_frac_q1", "news_frac_q2", "news_frac_q3", "news_frac_q4", "news_mean_bar_ix"]
ENTITY_COLUMNS = ["news_entity_entropy", "news_top_entity_share", "news_top_entity_weighted_sent"]
SECTOR_COLUMNS = [
    "news_sector_entropy", "news_sector_hhi", "news_sector_num_unique", "news_sector_max_share",
    "news_granular_sector_entropy",
]


def category_shares(events, **kinds):
    """Rows (session, kind, value, cnt, share) for several category columns in one shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]
    )
    counts = (
        events.select("session", F.inline(pairs))
        .groupBy("session", "kind", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    total = F.sum("cnt").over(W.partitionBy("session", "kind"))
    return counts.withColumn("share", F.col("cnt") / total)


def _of(kind, value):
    return F.when(F.col("kind") == kind, value)


def sentiment_features(bars, events, last_bar=49):
    """Fifteen sentiment features for every session that has bars; silent ones get zeros."""
    inside = events.where((F.col("bar_ix") >= 0) & (F.col("bar_ix") <= last_bar))
    prev_close, prev_ix = F.lag("close").over(by_bar()), F.lag("bar_ix").over(by_bar())
    moves = bars.select(
        "session",
        "bar_ix",
        F.when(
            prev_ix == F.col("bar_ix") - 1,
            F.col("close") / F.greatest(prev_close, F.lit(EPS)) - 1.0,
        ).alias("_move"),
    ).where("_move is not null and bar_ix > 0")
    joined = inside.join(moves, ["session", "bar_ix"], "left")
    split = 25 if last_bar >= 25 else 12
    score = F.col("sentiment_score")
    conf = F.greatest("confidence", F.lit(0.0))
    early, late = F.col("bar_ix") < split, F.col("bar_ix") >= split
    sums = joined.groupBy("session").agg(
        guarded_corr("sentiment_score", "_move").alias("sentiment_ret_corr"),
        F.sum(score).alias("sentiment_sum"),
        F.avg(score).alias("sentiment_mean"),
        F.count(F.lit(1)).cast("double").alias("headline_sentiment_count"),
        F.when(F.sum(conf) > EPS, F.sum(score * conf) / F.sum(conf))
        .otherwise(F.avg(score))
        .alias("sentiment_weighted_mean"),
        F.avg(conf).alias("confidence_mean"),
        F.stddev_pop(score).alias("sentiment_std"),
        F.avg((F.lower(F.trim("sentiment")) == "buy").cast("double")).alias("buy_frac"),
        zero_if_null(F.avg(F.when(early, score))).alias("sentiment_mean_early"),
        zero_if_null(F.avg(F.when(late, score))).alias("sentiment_mean_late"),
    )
    # a missing category is a category of its own here
    shares = category_shares(
        inside,
        s=F.coalesce("sector", F.lit("nan")),
        g=F.coalesce("granular_sector", F.lit("nan")),
    )
    p = F.col("share")
    mix = shares.groupBy("session").agg(
        entropy_of(_of("s", p)).alias("sector_entropy"),
        F.sum(_of("s", p * p)).alias("sector_hhi"),
        F.count(_of("s", p)).cast("double").alias("sector_num_unique"),
        F.max(_of("s", p)).alias("sector_max_share"),
        entropy_of(_of("g", p)).alias("granular_sector_entropy"),
    )
    spine = bars.select("session").distinct()
    return left_join_zero(spine, [sums, mix]).select("session", *SENTIMENT_COLUMNS)


def left_join_zero(spine, blocks):
    """Left join feature blocks onto a session spine, nulls to 0."""
    out = spine
    for block in blocks:
        out = out.join(block, "session", "left")
    return out.fillna(0.0).fillna(0)


def with_weights(events, decision_bar=49, half_life=10.0, high_conf=0.9):
    """Event weights; rows after the decision bar are dropped."""
    w = decay_weight("bar_ix", "confidence", decision_bar, half_life)
    sign = F.col("sign") if "sign" in events.columns else sentiment_sign("sentiment")
    return (
        events.where(F.col("bar_ix") <= decision_bar)
        .withColumn("sign", sign)
        .withColumn("w", w)
        .withColumn("score_w", F.col("sentiment_score") * F.col("w"))
        .withColumn("sign_w", F.col("sign") * F.col("w"))
        .withColumn("high", (F.col("confidence") >= high_conf).cast("int"))
    )


def assert_no_future(events, decision_bar=49):
    """Fails the job, where the rows are read, if any event lies after the decision bar."""
    check = F.assert_true(
        F.col("bar_ix") <= decision_bar,
        F.concat(
            F.lit(f"event after decision bar {decision_bar}: session "),
            F.col("session").cast("string"),
        ),
    )
    return events.withColumn("_ok", check).where("_ok is null").drop("_ok")


def _weighted(value, cond=None):
    v, w = F.col(value), F.col("w")
    if cond is not None:
        v, w = F.when(cond, v), F.when(cond, w)
    return F.sum(v) / F.greatest(F.sum(w), F.lit(EPS))


def news_aggregates(events, decision_bar=49, half_life=10.0, late_window=10, high_conf=0.9):
    e = with_weights(events, decision_bar, half_life, high_conf)
    late = F.col("bar_ix") >= decision_bar - late_window + 1
    order = F.struct(*EVENT_ORDER)
    return e.groupBy("session").agg(
        F.count(F.lit(1)).alias("news_headline_count"),
        F.countDistinct("company").alias("news_entity_count"),
        F.avg("sentiment_score").alias("news_mean_score"),
        F.avg("sign").alias("news_mean_sign"),
        F.avg("confidence").alias("news_mean_conf"),
        _weighted("score_w").alias("news_weighted_score"),
        _weighted("sign_w").alias("news_weighted_sign"),
        F.max_by("sentiment_score", order).alias("news_last_score"),
        F.max_by("sign", order).alias("news_last_sign"),
        F.max(F.abs("sentiment_score")).alias("news_max_abs_score"),
        F.sum("high").alias("news_high_conf_count"),
        F.count(F.when(late, 1)).alias("news_late_count"),
        zero_if_null(_weighted("score_w", late)).alias("news_late_weighted_score"),
        zero_if_null(_weighted("sign_w", late)).alias("news_late_weighted_sign"),
        zero_if_null(F.avg(F.when(late, F.col("sentiment_score")))).alias("news_late_mean_score"),
        zero_if_null(F.avg(F.when(late, F.col("sign")))).alias("news_late_mean_sign"),
    )


def compact_aggregates(events, decision_bar=49, half_life=10.0):
    """Twelve aggregates with sample deviation (0 for single events) and side balance."""
    e = with_weights(events, decision_bar, half_life)
    order = F.struct(*EVENT_ORDER)
    return e.groupBy("session").agg(
        F.count(F.lit(1)).alias("headline_count"),
        F.avg("sentiment_score").alias("mean_score"),
        zero_if_null(F.stddev_samp("sentiment_score")).alias("std_score"),
        F.avg("sign").alias("mean_sign"),
        F.avg("confidence").alias("mean_conf"),
        F.max(F.abs("sentiment_score")).alias("max_abs_score"),
        F.max_by("sentiment_score", order).alias("last_score"),
        F.max_by("sign", order).alias("last_sign"),
        F.countDistinct("company").alias("entity_count"),
        _weighted("score_w").alias("weighted_score"),
        _weighted("sign_w").alias("weighted_sign"),
        F.avg("sign").alias("buy_sell_balance"),
    )


def arrival_profile(events, decision_bar=49):
    b = F.col("bar_ix")
    share = lambda cond: F.avg(cond.cast("double"))
    return (
        events.where(b <= decision_bar)
        .groupBy("session")
        .agg(
            share(b < 12).alias("news_frac_q1"),
            share((b >= 12) & (b < 25)).alias("news_frac_q2"),
            share((b >= 25) & (b < 37)).alias("news_frac_q3"),
            share(b >= 37).alias("news_frac_q4"),
            F.avg("bar_ix").alias("news_mean_bar_ix"),
        )
    )


def entity_concentration(events, decision_bar=49, half_life=10.0, with_count=False):
    """Spread over companies and the weighted score of the most frequent one.

    Unnamed companies do not count; ties of the top company go to the smaller name.
    ``with_count`` is the variant that also reports the number of companies.
    """
    e = with_weights(events, decision_bar, half_life)
    named = F.col("company").isNotNull()
    if not with_count:
        named = named & (F.col("company") != "")
    cells = (
        e.where(named)
        .groupBy("session", "company")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("w").alias("w"), F.sum("score_w").alias("sw"))
    )
    cells = cells.withColumn("share", F.col("cnt") / F.sum("cnt").over(W.partitionBy("session")))
    top = F.struct(-F.col("cnt"), F.col("company"))
    aggs = [
        entropy_clipped("share").alias("news_entity_entropy"),
        F.max("share").alias("news_top_entity_share"),
        F.min_by(F.col("sw") / F.greatest("w", F.lit(EPS)), top).alias(
            "news_top_entity_weighted_sent"
        ),
    ]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias("news_unique_entities"))
    found = cells.groupBy("session").agg(*aggs)
    return left_join_zero(e.select("session").distinct(), [found])


def sector_concentration(events, decision_bar=49):
    """Spread over sectors; the empty text is a category of its own."""
    e = events.where(F.col("bar_ix") <= decision_bar)
    shares = category_shares(
        e, s=F.coalesce("sector", F.lit("")), g=F.coalesce("granular_sector", F.lit(""))
    )
    p = F.col("share")
    return shares.groupBy("session").agg(
        entropy_of(_of("s", p)).alias("news_sector_entropy"),
        F.sum(_of("s", p * p)).alias("news_sector_hhi"),
        F.count(_of("s", p)).cast("double").alias("news_sector_num_unique"),
        F.max(_of("s", p)).alias("news_sector_max_share"),
        entropy_of(_of("g", p)).alias("news_granular_sector_entropy"),
    )


def top_entities(events, k=10, decision_bar=49):
    """Most frequent companies, ties by name."""
    return (
        events.where((F.col("bar_ix") <= decision_bar) & F.col("company").isNotNull())
        .groupBy("company")
        .agg(F.count(F.lit(1)).alias("mentions"))
        .orderBy(F.desc("mentions"), "company")
        .limit(k)
    )


def entity_footprint(events, names, decision_bar=49):
    """Mention count and mean score per listed company, the rest under ``other``."""
    e = events.where(F.col("bar_ix") <= decision_bar)
    bucket = F.when(F.col("company").isin(*names), F.col("company")).otherwise("other")
    e = e.withColumn("_bucket", bucket)
    out = []
    for name in [*names, "other"]:
        hit = F.when(F.col("_bucket") == name, F.col("sentiment_score"))
        out.append(F.count(hit).cast("double").alias(f"news_ent_{name}_cnt"))
        out.append(zero_if_null(F.avg(hit)).alias(f"news_ent_{name}_sent"))
    return e.groupBy("session").agg(*out)


def ordered_documents(headlines, decision_bar=None, drop_blank=False):
    """A session's document as its headlines with their 1-based position.

    The rows stay separate: the concatenation of a busy session may not fit one value.
    """
    from barsight.functions.ranking import bucket_rank

    h = headlines
    if decision_bar is not None:
        h = h.where(F.col("bar_ix") <= decision_bar)
    if drop_blank:
        h = h.where(F.trim("headline") != "")
    return bucket_rank(h, ["session"], F.col("bar_ix"), ["event_id"], out="position")


def crossing_pairs(headlines):
    """Word pairs of a session document that go from one headline into the next, one row each.

    They are found from the outer words of the headlines: inside a bar by a lag, between bars from a
    table of one row per bar.
    """
    in_bar = W.partitionBy("session", "bar_ix")
    by_event = in_bar.orderBy("event_id")
    ends = (
        headlines.select(
            "session",
            "bar_ix",
            "event_id",
            first_word("headline").alias("first"),
            last_word("headline").alias("last"),
        )
        .where("first <> ''")
        .withColumn("before", F.lag("last").over(by_event))
        .withColumn("bar_last", F.max_by("last", "event_id").over(in_bar))
    )
    starts = ends.where("before is null").withColumn("before", F.lag("bar_last").over(by_bar()))
    joined = lambda df: df.where("before is not null").select(
        "session", F.concat_ws(" ", "before", "first").alias("gram")
    )
    return joined(ends).unionByName(joined(starts))


def session_grams(headlines, ngram_max=2):
    """Words and word pairs of each session document, one row per occurrence."""
    # one row per headline, its words held once
    tok = headlines.select("session", F.explode(F.array(text_tokens("headline"))).alias("tok"))
    size = F.size("tok")
    grams = F.col("tok")
    if ngram_max >= 2:
        pairs = F.zip_with(
            F.slice("tok", 1, F.greatest(size - 1, F.lit(0))),
            F.slice("tok", 2, size),
            lambda a, b: F.concat_ws(" ", a, b),
        )
        grams = F.concat("tok", pairs)
    inner = tok.select("session", F.explode(grams).alias("gram"))
    if ngram_max < 2:
        return inner
    return inner.unionByName(crossing_pairs(headlines))


CHUNK = 500_000  # words that are hashed at once


def _hashed(batches, buckets, ngram_max):
    """Bucket counts of the words and word pairs inside headlines, added up by session and batch part."""

    def places(texts):
        return np.array([int.from_bytes(md5(t.encode()).digest()[:4], "big") % buckets for t in texts], np.int64)

    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("tok")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for start, end in zip(cuts, cuts[1:]):
            sessions = batch.column("session").slice(start, end - start).dictionary_encode("encode")
            row = np.repeat(sessions.indices.to_numpy(), sizes[start:end]).astype(np.int64)
            words = batch.column("tok").slice(start, end - start).flatten().dictionary_encode()
            code, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
            cells = [row * buckets + places(names)[code]]
            if ngram_max >= 2:
                headline = np.repeat(np.arange(end - start), sizes[start:end])
                inside = np.flatnonzero(headline[1:] == headline[:-1])
                pairs = pa.array(code[inside] * len(names) + code[inside + 1]).dictionary_encode()
                texts = (f"{names[p // len(names)]} {names[p % len(names)]}" for p in pairs.dictionary.to_pylist())
                cells.append(row[inside] * buckets + places(texts)[pairs.indices.to_numpy()])
            counts = np.bincount(np.concatenate(cells), minlength=1)
            found = np.flatnonzero(counts)
            yield pa.record_batch(
                {"session": sessions.dictionary.take(pa.array(found // buckets)), "b": pa.array(found % buckets), "c": pa.array(counts[found])}
            )


def hashed_fingerprint(headlines, buckets=32, ngram_max=2):
    """L2-normalised counts of hashed words and word pairs per session.

    A task hashes the different words and pairs of a batch once and adds up their buckets, so that
    counts are shuffled instead of words.
    """
    words = headlines.select("session", text_tokens("headline").alias("tok"))
    kind = headlines.schema["session"].dataType.simpleString()
    counts = words.mapInArrow(partial(_hashed, buckets=buckets, ngram_max=ngram_max), f"session {kind}, b long, c long")
    if ngram_max >= 2:
        across = crossing_pairs(headlines).select("session", md5_bucket("gram", buckets).alias("b"), F.lit(1).cast("long").alias("c"))
        counts = counts.unionByName(across)
    counts = counts.groupBy("session", "b").agg(F.sum("c").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")))
    cell = lambda i: zero_if_null(F.max(F.when(F.col("b") == i, F.col("c"))) / norm)
    return counts.groupBy("session").agg(*[cell(i).alias(f"news_hash_{i}") for i in range(buckets)])


def news_columns(buckets=32):
    return (
        AGGREGATE_COLUMNS + ARRIVAL_COLUMNS + ENTITY_COLUMNS + SECTOR_COLUMNS
        + [f"news_hash_{i}" for i in range(buckets)]
    )


def news_features(sessions, events, headlines, enabled=True, decision_bar=49, buckets=32):
    """All news blocks, one row per requested session, zeros where it is silent."""
    spine = sessions.select("session").distinct()
    names = news_columns(buckets)
    if not enabled:
        return spine.select("session", *[F.lit(0.0).alias(c) for c in names])
    e = assert_no_future(events, decision_bar)
    blocks = [
        news_aggregates(e, decision_bar),
        arrival_profile(e, decision_bar),
        entity_concentration(e, decision_bar),
        sector_concentration(e, decision_bar),
        hashed_fingerprint(assert_no_future(headlines, decision_bar), buckets),
    ]
    return left_join_zero(spine, blocks).select("session", *names)


def regime_news_features(sessions, events, names, decision_bar=49):
    """Compact aggregates, arrivals, concentration and footprint on a session spine."""
    compact = compact_aggregates(events, decision_bar)
    compact = compact.select(
        "session", *[F.col(c).alias(f"news_{c}") for c in COMPACT_COLUMNS]
    )
    blocks = [
        compact,
        arrival_profile(events, decision_bar),
        entity_concentration(events, decision_bar, 10.0, with_count=True),
        entity_footprint(events, names, decision_bar),
    ]
    return left_join_zero(sessions.select("session").distinct(), blocks)
