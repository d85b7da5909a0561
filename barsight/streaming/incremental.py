"""Incremental scoring: only headlines without a stored result are scored."""

import os

from pyspark.sql import functions as F

from barsight.operators.events import text_id, upsert_results
from barsight.operators.scoring import RESULT_SCHEMA, score_headlines
from barsight.streaming.store import ResultStore

KEYS = ["session", "bar_ix", "headline"]


def pending(headlines, cache):
    """Headlines (distinct by session, bar and text) with no stored sentiment.

    They meet the stored ones by ids of the texts; only the texts' distinct values are shuffled.
    """
    key = ["session", "bar_ix", "_id"]
    own = F.coalesce(text_id("headline"), F.lit(""))
    # a missing text equals no stored one
    done = cache.where("sentiment is not null and headline is not null").select("session", "bar_ix", own.alias("_id"))
    texts = headlines.select("headline").distinct().withColumn("_id", own)
    wanted = headlines.select("session", "bar_ix", own.alias("_id")).distinct().join(done, key, "left_anti")
    return wanted.join(texts, "_id").select(*KEYS)


def score_incrementally(headlines, cache_path, scorer=None, schema=None, key=None):
    """Score what the store at ``cache_path`` lacks, commit it, and return every headline with its result.

    Running it again scores nothing. A lost run commits nothing; runs at the same time each commit
    whole results, and of several results for a headline one is taken. A retried run that gives
    the same ``key`` is committed once.
    """
    spark = headlines.sparkSession
    store = ResultStore(spark, cache_path, schema or RESULT_SCHEMA)
    part = store.stage(score_headlines(pending(headlines, store.read()), scorer))
    fresh = spark.read.schema(store.schema).parquet(os.path.join(store.path, part))
    scored = upsert_results(headlines, store.read(store.commit(part, key)))
    return scored.where("sentiment is not null"), fresh
