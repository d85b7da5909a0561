"""Bars, sentiment events and headlines as views over the star-schema tables."""

import os

from pyspark.sql import functions as F, Window as W

from barsight.functions.ranking import bucket_rank, ntile_of

BARS_PER_SESSION = 100
# A session above this many ticks is ranked in buckets instead of one window partition.
HOT_SESSION_ROWS = 4_000_000


class Market:
    """Lazy views on one data directory; nothing here triggers a data scan
    except row counts, which parquet answers from its footers."""

    def __init__(self, spark, path):
        self.spark = spark
        self.path = path
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name):
        return self.spark.read.parquet(os.path.join(self.path, f"{name}.parquet"))

    def rows(self, name):
        return self.table(name).count()

    def bars(self):
        return ticks_to_bars(
            self.table("lineitem").select(
                F.col("l_suppkey").alias("session"),
                F.col("l_extendedprice").alias("px"),
                F.col("l_shipdate").alias("day"),
                F.col("l_orderkey").alias("order_key"),
                F.col("l_linenumber").alias("line"),
                F.col("l_partkey").alias("part"),
            )
        )

    def seen(self):
        return self.bars().where("bar_ix <= 49")

    def unseen(self):
        return self.bars().where("bar_ix >= 50")

    def events(self):
        return events_to_sentiments(self.table("events"), self.rows("supplier"))

    def spread(self, name, key):
        """A table over all cores even if its file is a single scan task."""
        raw = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        if raw.rdd.getNumPartitions() < cores:
            raw = raw.repartition(cores, key)
        return raw

    def headlines(self):
        return self.sentiments().select("event_id", "session", "bar_ix", "headline")

    def sentiments(self):
        """Events with their headline text."""
        return attach_headlines(
            self.events(), self.spread("documents", "doc_id"), self.rows("documents")
        )


def _rank_whole(ticks):
    w = W.partitionBy("session")
    return ticks.withColumns(
        {
            "tick": F.row_number().over(w.orderBy(*TICK_ORDER)),
            "n_ticks": F.count(F.lit(1)).over(w),
        }
    )


def _rank_by_bucket(ticks, n, hot_rows):
    top = ticks.agg(F.max("order_key")).first()[0]
    pieces = min(1024, 1 + n // (256 * hot_rows))
    part = F.floor(F.col("order_key") * pieces / ((top or 0) + 1))
    bucket = F.struct(F.col("day").alias("d"), part.alias("p"))
    return bucket_rank(ticks, ["session"], bucket, TICK_ORDER, out="tick", total="n_ticks")


def split_of(session):
    tail = F.col(session) % 10
    return F.when(tail <= 5, "train").when(tail <= 7, "public").otherwise("private")


TICK_ORDER = ["day", "order_key", "line", "part", "px"]


def ticks_to_bars(ticks, hot_rows=HOT_SESSION_ROWS):
    """Cut each session's ordered ticks into 100 equal bars, first price scaled to 1.

    Ordinary sessions are ranked by a window on one shuffle that the bars then reuse. A
    session above ``hot_rows`` never sits in one task: its ranks come from counts of
    (day, order-key range) buckets.
    """
    n = ticks.count()
    if n <= hot_rows:
        ranked = _rank_whole(ticks)
    else:
        # at most n / hot_rows sessions can be this large, so the list is small
        hot = F.broadcast(
            ticks.groupBy("session").count().where(F.col("count") > hot_rows).select("session")
        )
        ranked = _rank_whole(ticks.join(hot, "session", "left_anti")).unionByName(
            _rank_by_bucket(ticks.join(hot, "session", "left_semi"), n, hot_rows)
        )
    bars = (
        ranked.withColumn("bar_ix", ntile_of("tick", "n_ticks", BARS_PER_SESSION))
        .groupBy("session", "bar_ix")
        .agg(
            F.min_by("px", "tick").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "tick").alias("close"),
        )
    )
    base = F.first("open").over(W.partitionBy("session").orderBy("bar_ix"))
    bars = bars.withColumn("_base", base)
    return bars.select(
        "session",
        "bar_ix",
        *[(F.col(c) / F.col("_base")).alias(c) for c in ("open", "high", "low", "close")],
    )


def events_to_sentiments(events, n_sessions):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)
    k = F.get_json_object("props", "$.k").cast("int")
    buy = F.col("event_type").isin("purchase", "signup", "click")
    share = micros / 1e6 / (30 * 86400) * 100
    sign = F.when(buy, 1).otherwise(-1)
    return events.select(
        "event_id",
        (F.col("user_id") % n_sessions).alias("session"),
        F.least(F.lit(99), F.floor(share).cast("int")).alias("bar_ix"),
        F.when(buy, "buy").otherwise("sell").alias("sentiment"),
        F.round(sign * (1 - F.exp(-F.col("value") / 50)), 4).alias("sentiment_score"),
        F.round(0.5 + (k % 50) / 100.0, 2).cast("double").alias("confidence"),
        F.concat(F.lit("C"), (k % 12).cast("string")).alias("company"),
        F.col("event_type").alias("sector"),
        F.concat_ws("_", "event_type", (k % 3).cast("string")).alias("granular_sector"),
        sign.cast("double").alias("sign"),
    )


def attach_headlines(events, documents, n_documents):
    """Give each event the whole text of its document."""
    docs = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("headline"))
    return (
        events.withColumn("_doc", F.col("event_id") % n_documents).join(docs, "_doc").drop("_doc")
    )
