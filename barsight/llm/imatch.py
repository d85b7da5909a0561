"""I-Match fingerprints over randomised lexicon subsets."""

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.llm.words import Words, mix, runs, slices
from barsight.session import cut_lineage

LOW, HIGH = 0.002, 0.1  # share of the documents that hold a term of the band
SUBSETS = ((8, 8), (32, 24), (128, 32), (512, 32))  # (one term in so many, subsets)
LISTED = 1_000_000
HELD = 1 << 21
PART_BYTES = 16 << 20


def subset_values(h):
    """(terms, subsets): a term's hash in the subsets that hold it, 0 in the others."""
    columns = []
    for one_in, count in SUBSETS:
        for _ in range(count):
            x = mix(h + np.uint64((len(columns) + 1) * 0x9E3779B97F4A7C15 % 2**64))
            columns.append(np.where(x % np.uint64(one_in) == 0, mix(x) | np.uint64(1), np.uint64(0)))
    return np.stack(columns, axis=1)


def distinct_terms(column):
    """(term hashes, offsets per text) for slices of a column."""
    for _, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        text = np.repeat(np.arange(len(offsets) - 1), words.counts())
        hashes = words.hashes()
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield hashes[fresh], runs(text[fresh], len(offsets) - 1)


def _counted(batches, floor=None, known=None):
    """(term, documents) of a task. ``floor``: only terms in that share of a group of texts."""

    def flush(held, texts):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        if floor is not None:
            h, n = h[n >= floor * texts], n[n >= floor * texts]
        return pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    held, size, texts = [], 0, 0
    for batch in batches:
        for terms, offsets in distinct_terms(batch.column(0)):
            if known is not None and len(known.value):
                terms = terms[known.value[np.minimum(np.searchsorted(known.value, terms), len(known.value) - 1)] == terms]
            held.append(terms)
            size, texts = size + len(terms), texts + len(offsets) - 1
            if size >= HELD:
                yield flush(held, texts)
                held, size, texts = [], 0, 0
    if held:
        yield flush(held, texts)


def lexicon(texts, low=LOW, high=HIGH):
    """Hashes of the terms whose document frequency lies in the band, as a sorted array.

    A term of the band holds at least ``low`` of the texts in some group of texts of some task
    (else it would hold less overall), so a first pass lists those terms and a second counts
    only them; if the list should exceed LISTED terms, all terms are counted instead. At most
    (mean number of terms per text) / low terms are in the band, however large the table.
    """
    spark = texts.sparkSession
    total = texts.count()
    listed = texts.mapInArrow(partial(_counted, floor=low), "h long, n long").select("h").distinct()
    listed = cut_lineage(listed)
    known = None
    if listed.count() <= LISTED:
        found = np.array([r[0] for r in listed.toLocalIterator()], np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(found))
    counts = texts.mapInArrow(partial(_counted, known=known), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("h")
    return np.sort(np.array([r[0] for r in band.toLocalIterator()], np.int64).view(np.uint64))


class Printer:
    def __init__(self, terms):
        self.terms, self.values = terms, subset_values(terms)

    def prints(self, texts):
        """(texts, subsets) 16-bit signatures; 0 where a subset holds none of the text's terms."""
        out = []
        for terms, offsets in distinct_terms(pa.array(texts, pa.large_string())):
            count = len(offsets) - 1
            text = np.repeat(np.arange(count), np.diff(offsets))
            at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
            inside = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
            # a text without a term of the band is judged by all its terms
            bare = np.bincount(text[inside], minlength=count) == 0
            rest = bare[text]
            total = np.zeros((count, self.values.shape[1]), np.uint64)
            for mask, value in ((inside, self.values[at[inside]] if len(self.terms) else None), (rest, None)):
                if mask.any():
                    value = subset_values(terms[mask]) if value is None else value
                    heads = np.flatnonzero(np.diff(text[mask], prepend=-1))
                    total[text[mask][heads]] = np.add.reduceat(value, heads, axis=0)
            short = (mix(total) >> np.uint64(48)).astype(np.uint16)
            out.append(np.where(total == 0, 0, np.maximum(short, 1)).astype(">u2"))
        return np.concatenate(out) if out else np.zeros((0, self.values.shape[1]), ">u2")


def likeness(a, b):
    """Share of equal signatures among those that either text has; 1 if neither has any."""
    told = (a != 0) | (b != 0)
    n = told.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & told).sum(axis=1) / np.maximum(n, 1))


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids, texts, following, prints, next_prints, printer):
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, other, new = prints, next_prints, printer.prints(changed)
    return {
        "id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([r.tobytes().hex() for r in own], pa.string()),
        "edited_fingerprint": pa.array([r.tobytes().hex() for r in new], pa.string()),
        "near_edited": pa.array(likeness(own, new)),
        "near_next": pa.array(likeness(own, other)),
    }


OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches, terms):
    """Rows of a sorted partition with their successor; its first and last text stay open."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    printer = Printer(terms.value)

    def closed(rows, open_row=None):
        n = len(rows["id"])
        extra = {"part": [None] * n, "end": [None] * n, "text": [None] * n}
        rows = {k: v.to_pylist() for k, v in rows.items()} | extra
        if open_row:
            for k in rows:
                rows[k].append(open_row.get(k))
        return pa.record_batch(rows, schema=SCHEMA)

    empty = {k: pa.array([]) for k in SCHEMA.names[:7]}
    held = None
    for batch in batches:
        if not len(batch):
            continue
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        prints = printer.prints(texts)
        if held is None:
            yield closed(empty, {"id": ids[0], "part": part, "end": "first", "text": texts[0]})
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
            prints = np.concatenate([held[2], prints])
        if len(ids) > 1:
            yield closed(_rows(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:], printer))
        held = ids[-1], texts[-1], prints[-1:]
    if held:
        yield closed(empty, {"id": held[0], "part": part, "end": "last", "text": held[1]})


SCHEMA = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("part", pa.int32()), ("end", pa.string()), ("text", pa.string())]
)


def _pairs(batches, terms):
    printer = Printer(terms.value)
    for batch in batches:
        texts, after = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
        yield pa.record_batch(_rows(batch.column(0), texts, after, printer.prints(texts), printer.prints(after), printer))


def fingerprints(docs, id_col="doc_id", text_col="text", low=LOW, high=HIGH):
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Terms are words in lower case. The lexicon holds the terms in ``low`` to ``high`` of all
    documents; each randomised subset of it (one term in 8, 32, 128 or 512) hashes the sorted
    distinct terms that a text shares with it to 16 bits. The likeness of two fingerprints is the
    share of equal signatures among those that either has. A text without a term of the band is
    judged by all its terms, so equal texts always have equal fingerprints.

    A document's successor is the next row by falling id (equal ids by text; null ids last), found
    in range-sorted partitions in one shuffle of the texts; the ends of the partitions are
    paired in a second, small step, the last row with the first.

    Null is empty; an empty text has no signatures (all zero), like another empty text by 1 and
    others by 0. A single row follows itself. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    terms = spark.sparkContext.broadcast(lexicon(rows.select("text"), low, high))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(1 + size // PART_BYTES, F.col("id").desc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(
        F.col("id").desc_nulls_last(), F.xxhash64("text"), "text"
    )
    found = cut_lineage(ordered.mapInArrow(partial(_neighbours, terms=terms), OUT + ", part int, end string, text string"))
    first = found.where("end = 'first'").select("part", F.col("text").alias("following"))
    last = found.where("end = 'last'").select("part", "id", "text")
    parts = sorted(r[0] for r in first.select("part").collect())  # one number per partition
    if not parts:
        return found.select(*[F.col(c) for c in found.columns[:7]]).withColumnRenamed("id", id_col)
    order = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, then int")
    ends = last.join(order, "part").join(first.withColumnRenamed("part", "then"), "then").select("id", "text", "following")
    out = found.where("end is null").select(*found.columns[:7]).unionByName(ends.mapInArrow(partial(_pairs, terms=terms), OUT))
    return out.withColumnRenamed("id", id_col)
