"""Batch scoring of headlines with a pluggable scorer, and stored model responses."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

from barsight.functions.scalars import class_decision, entity, granular_sector

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("bar_ix", T.IntegerType()),
        T.StructField("headline", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("granular_sector", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Default scorer: plain word lists.
POSITIVE = frozenset(("gain", "growth", "win", "strong", "record", "best", "good", "new", "up", "great"))
NEGATIVE = frozenset(("loss", "fall", "weak", "cut", "bad", "risk", "down", "worst", "old", "fail"))

PROBABILITIES = ("p_pos", "p_neg", "p_neu")


def word_list_scorer(texts):
    """Three class probabilities per text from counts of listed words."""
    words = texts.str.lower().str.findall(r"[a-z]+")
    pos = words.map(lambda w: sum(map(POSITIVE.__contains__, w)))
    neg = words.map(lambda w: sum(map(NEGATIVE.__contains__, w)))
    total = pos + neg + 1.0
    return pd.DataFrame({"p_pos": pos / total, "p_neg": neg / total, "p_neu": 1.0 / total})


def class_probabilities(df, scorer=None, text="headline", batch_size=256):
    """Adds p_pos, p_neg, p_neu; the scorer sees at most ``batch_size`` texts at once."""
    scorer = scorer or word_list_scorer

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [scorer(texts.iloc[k : k + batch_size].reset_index(drop=True)) for k in range(0, max(len(texts), 1), batch_size)]
            yield pd.concat(found, ignore_index=True)[list(PROBABILITIES)].astype("float64")

    # only the text goes to the scorer, and only the numbers come back
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in PROBABILITIES])
    scored = F.pandas_udf(run, schema)(F.col(text))
    return df.withColumn("_p", scored).select(*df.columns, *[F.col("_p")[c].alias(c) for c in PROBABILITIES])


def score_headlines(headlines, scorer=None, batch_size=256):
    """Scored headlines in the result layout; the broad sector is mapped later."""
    scored = class_probabilities(headlines, scorer, "headline", batch_size)
    return scored.select(
        "session",
        "bar_ix",
        "headline",
        entity("headline").alias("company"),
        granular_sector("headline").alias("granular_sector"),
        F.lit(None).cast("string").alias("sector"),
        *_ordered(class_decision("p_pos", "p_neg", "p_neu")),
    )


def _ordered(columns):
    score, side, confidence = columns
    return [side, score, confidence]


RESPONSE = "struct<results:array<struct<id:int,company:string,sentiment:string,confidence:double,reasoning:string>>>"


def apply_responses(requests, responses):
    """Join stored JSON responses to their requests by (batch, id).

    The company text "None" becomes null; a response that cannot be read leaves a failure
    note as reasoning. The outermost braces of the text are parsed.
    """
    body = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    parsed = responses.select("batch_id", "response", F.from_json(body, RESPONSE).alias("r"))
    bad = F.col("r").isNull() | F.col("r.results").isNull()
    items = parsed.where(~bad).select("batch_id", F.inline("r.results"))
    failed = parsed.where(bad).select(
        "batch_id", F.concat(F.lit("Failed to parse JSON from response: "), "response").alias("_failure")
    )
    company = F.when(F.col("company") != "None", F.col("company"))
    items = items.select("batch_id", "id", company.alias("company"), "sentiment", "confidence", "reasoning")
    return (
        requests.join(items, ["batch_id", "id"], "left")
        .join(failed, "batch_id", "left")
        .withColumn("reasoning", F.coalesce("reasoning", "_failure"))
        .drop("_failure")
    )
