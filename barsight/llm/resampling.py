"""Importance resampling towards a target: hashed n-gram gains and a Gumbel draw.

The text work is Arrow kernels on slices of a column; the draw is DataFrame functions.
"""

import math
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W, functions as F

from barsight.session import cut_lineage

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
SLICE = 4 << 20  # bytes of text whose words share a dictionary, or one longer text
ACCURACY = 10_000  # of the approximate quantile that precedes the exact draw
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _slices(column, size=SLICE):
    """(first row, texts) for slices of a string column of about ``size`` bytes; null is empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def _distinct(codes):
    """(distinct values, place of each code among them) by Arrow's hash table."""
    encoded = pc.dictionary_encode(pa.array(codes))
    return encoded.dictionary.to_numpy(), encoded.indices.to_numpy().astype(np.int64)


def hashed_runs(column, buckets):
    """Per slice: (first row, words per text, [(text, bucket) of every run of 1, 2 and 3 words]).

    A run is a pair of the run before it and one more word, so only distinct pairs are hashed; the
    CRC of a run goes on from that of its first words.
    """
    for first, texts in _slices(column):
        words = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
        flat, text = pc.list_flatten(words), pc.list_parent_indices(words)
        filled = pc.greater(pc.binary_length(flat), 0)
        flat, text = flat.filter(filled), text.filter(filled).to_numpy()
        encoded = pc.dictionary_encode(flat)
        word = encoded.indices.to_numpy().astype(np.int64)
        parts = encoded.dictionary.cast(pa.large_binary()).to_pylist()
        suffix = [b" " + w for w in parts]
        crc = np.fromiter(map(crc32, parts), np.int64, len(parts))
        run = word
        found = [(text, (crc % buckets)[run])]
        for n in (2, 3):
            if len(word) < n:
                break
            inside = np.flatnonzero(text[: len(word) - n + 1] == text[n - 1 :])
            pairs, at = _distinct(run[inside] * len(parts) + word[inside + n - 1])
            head, tail = pairs // max(len(parts), 1), pairs % max(len(parts), 1)
            crc = np.fromiter(map(crc32, map(suffix.__getitem__, tail.tolist()), crc[head].tolist()), np.int64, len(pairs))
            found.append((text[inside], (crc % buckets)[at]))
            run = np.zeros(len(word), np.int64)
            run[inside] = at
        yield first, np.bincount(text, minlength=len(texts)), found


def _counted(batches, buckets):
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, found in hashed_runs(batch.column(0), buckets):
            for _, bucket in found:
                total += np.bincount(bucket, minlength=buckets)
    filled = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(filled), "n": pa.array(total[filled])})


def bucket_counts(texts, buckets=BUCKETS):
    """Features of all rows of a one-column table by bucket: a list of fixed length."""
    rows = texts.mapInArrow(partial(_counted, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for r in rows.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source, target):
    """Whole thousandths of the log ratio of smoothed shares, target over source, by bucket."""
    s_all, t_all, b = sum(source), sum(target), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source, target)], np.int64)


def _weighed(batches, gain):
    of = pa.array(gain.value)
    for batch in batches:
        for first, words, found in hashed_runs(batch.column(1), len(of)):
            features, weight = np.zeros((2, len(words)), np.int64)
            for text, bucket in found:
                per = np.bincount(text, minlength=len(words))
                # runs lie in text order, so the gains of a text are one segment
                sums = np.concatenate([[0], np.cumsum(of.take(pa.array(bucket)).to_numpy())])
                ends = np.cumsum(per)
                weight += sums[ends] - sums[ends - per]
                features += per
            yield pa.record_batch(
                {
                    "id": batch.column(0).slice(first, len(words)),
                    "n_words": pa.array(words),
                    "n_features": pa.array(features),
                    "weight": pa.array(weight),
                }
            )


def importance_sample(docs, target, id_col="doc_id", text_col="text", percent=PERCENT, least=LEAST_WORDS, buckets=BUCKETS, seed=SEED):
    """One row per input row: id, n_features, weight, score, rank (null if not drawn).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case;
    features are all runs of one to three words of a text, hashed to ``buckets``. The weight of a
    text is the sum of its features' gains: the log ratio of a bucket's smoothed share of all
    ``target`` texts and of all ``docs``. The score adds Gumbel noise from the id's SHA-256, so
    that the highest scores are a sample without replacement in proportion to the weights.

    Of the rows with at least ``least`` words, ``percent`` of a hundred with the highest scores are
    drawn; ties go to the smaller id. An approximate quantile, lowered by its error, leaves few
    rows to sort; the ranks are exact: each sorted partition adds the sizes of those before it.

    Nulls and empty texts have no features and weight 0. A null id has no score, is never drawn
    and doesn't count among the rows to draw from. Repeated rows count and are drawn each. Of an
    empty target all counts are 0. Other columns are not read. Memory follows the slice, or the
    longest single text. Only the fixed table of bucket counts passes through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = bucket_counts(rows.select("text"), buckets)
    wanted = bucket_counts(target.select(F.col(text_col).alias("text")), buckets)
    gain = spark.sparkContext.broadcast(gains(source, wanted))
    weighed = rows.mapInArrow(partial(_weighed, gain=gain), "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise))
    fit = scored.where((F.col("n_words") >= least) & F.col("id").isNotNull())
    total = fit.count()
    draw = percent * total // 100
    none = F.lit(None).cast("long")
    if not draw:
        return scored.select(F.col("id").alias(id_col), "n_features", "weight", "score", none.alias("rank"))
    share = max(0.0, 1 - draw / total - 3 / ACCURACY)
    low = fit.agg(F.percentile_approx("score", share, ACCURACY)).first()[0]
    if fit.where(F.col("score") >= low).count() < draw:
        low = fit.agg(F.min("score")).first()[0]
    near = (F.col("n_words") >= least) & F.col("id").isNotNull() & (F.col("score") >= low)
    # equal rows can lie in several partitions of the sort, as their order number differs
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = scored.where(near).withColumn("row", F.monotonically_increasing_id()).orderBy(*order)
    ordered = cut_lineage(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", place))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition of the sort
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("place") + F.col("before") + 1)
    drawn = ranked.select("id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = scored.where(~F.coalesce(near, F.lit(False))).select("id", "n_features", "weight", "score", none.alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)
