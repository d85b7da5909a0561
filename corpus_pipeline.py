"""Corpus preparation: each stage reads what the one before kept.

STAGES: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
"""

import os

from barsight.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from barsight.session import new_path


def good_quality(spark, docs, sf_dir):
    """Rows that the classifier accepts; it is fitted on the labelled rows among ``docs``."""
    return quality.good_texts(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))


def no_exact_copies(spark, docs, sf_dir):
    """Of texts that are equal but for white space, the longest original stays."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark, docs, sf_dir):
    """Of each group linked by a similarity of 0.8 on five-word shingles, the smallest id stays."""
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def no_secrets(spark, docs, sf_dir):
    """Secrets are replaced in place; every row stays."""
    return secret_scan.redact(docs)


def packed(spark, docs, sf_dir):
    """Pieces of all remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("secrets", no_secrets),
    ("pack", packed),
]

# A fitted classifier and a tokenizer can't be written in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``; every stage's result is written to the shared folder and reread."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
