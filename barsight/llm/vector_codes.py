"""Compression of vectors to codes of integer codebooks; nearest entries by slices and bit masks.

A codebook has at most 64 entries, so a set of entries is one unsigned 64-bit mask.
"""

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.session import cut_lineage

PARTS = 16
ENTRIES = 64  # bits of a mask
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26  # of a component, so that squared distances of wide parts fit 64 bits
ROWS = 1 << 13  # parts searched at once
LISTED = 1_000_000


class Slices:
    """Nearest entry of one codebook (entries x width, integers), exact, ties to the lower index.

    Each dimension keeps the entries' coordinates sorted, with the mask of the entries before each
    place. A range of coordinates is two searches and the difference of two prefix masks; the AND
    over the dimensions are the entries in a box around the part. Entries outside a box of radius
    r are farther than r, so a candidate within r is the nearest of all.
    """

    def __init__(self, entries):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.prefix[1:])
        self.radius = self._first_radius()

    def _first_radius(self):
        """A typical distance between neighbouring entries; it changes the work, not the result."""
        gaps = self.entries[:, None] - self.entries[None]
        squares = (gaps * gaps).sum(axis=2)
        squares = np.sort(squares, axis=1)[:, 1:2]
        return int(np.sqrt(np.median(squares))) + 1 if squares.size else 1

    def masks(self, x, radius):
        """Mask of the entries within ``radius`` (one per row) of x in every dimension."""
        out = np.full(len(x), (1 << len(self.entries)) - 1, np.uint64)
        for d in range(self.entries.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            out &= self.prefix[high, d] & ~self.prefix[low, d]
        return out

    def nearest(self, x):
        """(index, squared distance) of the nearest entry of each row of x."""
        index = np.zeros(len(x), np.int64)
        best = np.full(len(x), np.iinfo(np.int64).max)
        left = np.arange(len(x))
        radius = np.full(len(x), self.radius, np.int64)
        while len(left):
            mask = self.masks(x[left], radius)
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            gap = x[left[row]] - self.entries[entry]
            square = (gap * gap).sum(axis=1)
            # candidates of a row lie together, lower entries first
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            if len(heads):
                low = np.minimum.reduceat(square, heads)
                at = np.where(square == np.repeat(low, np.diff(heads, append=len(row))), entry, ENTRIES)
                to = left[row[heads]]
                best[to], index[to] = low, np.minimum.reduceat(at, heads)
            # the next box reaches past the best candidate, or is twice as wide where none was found
            found = best[left] < np.iinfo(np.int64).max
            good = found & (best[left] <= radius * radius)
            wider = np.where(found, np.sqrt(np.where(found, best[left], 0)).astype(np.int64) + 1, 2 * radius)
            left, radius = left[~good], wider[~good]
        return index, best


def _vectors(column, size):
    """(rows with ``size`` components that fit, their integers); the column holds finite lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    small = np.bincount(row, np.abs(flat) > LARGEST, minlength=len(lengths)) == 0
    good = small & (lengths == size)
    return np.flatnonzero(good), flat[good[row]].astype(np.int64).reshape(int(good.sum()), size)


def _cut(values, parts):
    """Parts of equal width, padded with zeros at the end: rows x parts x width."""
    width = -(-values.shape[1] // parts)
    out = np.zeros((len(values), parts * width), np.int64)
    out[:, : values.shape[1]] = values
    return out.reshape(len(values), parts, width)


def _assigned(batches, size, books):
    """Per batch: (the batch, rows that are coded, their parts, entry and error of each part)."""
    search = [Slices(b) for b in books.value]
    for batch in batches:
        rows, values = _vectors(batch.column(0), size)
        cut = _cut(values, len(search))
        index, error = np.zeros((2, len(rows), len(search)), np.int64)
        for p, s in enumerate(search):
            for a in range(0, len(rows), ROWS):
                index[a : a + ROWS, p], error[a : a + ROWS, p] = s.nearest(cut[a : a + ROWS, p])
        yield batch, rows, cut, index, error


def _sums(batches, size, books):
    parts, entries, width = books.value.shape
    count = np.zeros(parts * entries, np.int64)
    total = np.zeros((parts * entries, width), np.int64)
    for _, _, cut, index, _ in _assigned(batches, size, books):
        cell = (index + entries * np.arange(parts)).ravel()
        count += np.bincount(cell, minlength=len(count))
        np.add.at(total, cell, cut.reshape(len(cell), width))
    used = np.flatnonzero(count)
    yield pa.record_batch({"cell": pa.array(used), "n": pa.array(count[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})


def _coded(batches, size, books):
    names = np.array([f"{i:02x}" for i in range(ENTRIES)], object)
    for batch, rows, _, index, error in _assigned(batches, size, books):
        code = np.full(len(batch), None, object)
        code[rows] = ["".join(names[i]) for i in index]
        sums = np.zeros(len(batch), np.int64)
        sums[rows] = error.sum(axis=1)
        missing = np.ones(len(batch), bool)
        missing[rows] = False
        yield pa.record_batch(
            {
                "vec_id": batch.column(1),
                "label": batch.column(2),
                "code": pa.array(code, pa.string()),
                "error": pa.array(sums, mask=missing),
            }
        )


def usable(vectors, vector_col):
    """Rows whose vector has finite components only."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & good)


def first_books(kept, parts, entries):
    """(length of a vector, codebooks): the parts of the vectors with the smallest ids, ascending.

    Of rows that repeat an id, the smallest vector counts.
    """
    ids = [r["id"] for r in kept.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    rows = kept.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    rows = rows or [r for r in kept.select(F.min("vector").alias("vector")).collect() if r["vector"] is not None]
    if not rows:
        return 0, np.zeros((parts, 0, 0), np.int64)
    size = len(rows[0]["vector"])
    column = pa.array([r["vector"] for r in rows], pa.list_(pa.float64()))
    return size, np.ascontiguousarray(_cut(_vectors(column, size)[1], parts).transpose(1, 0, 2))


def refined(vectors, size, books):
    """Each entry replaced by the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = books.shape
    here = vectors.sparkSession.sparkContext.broadcast(books)
    sums = vectors.select("vector").mapInArrow(partial(_sums, size=size, books=here), "cell long, n long, total array<long>")
    sums = sums.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    out = books.reshape(parts * entries, width).copy()
    for r in sums.collect():  # one row per entry at most
        out[r["cell"]] = np.array(r["total"], np.int64) // r["n"]
    return out.reshape(books.shape)


def compress(vectors, id_col="vec_id", vector_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """One row per usable vector: id, code, error, label_error, codebooks_sha256.

    Components become floor(256 x); a vector is cut into ``parts`` equal consecutive parts. A part
    position's codebook starts as that part of the ``entries`` smallest ids (64 at most); each
    round assigns every part to its nearest entry and replaces entries by the floor of their mean;
    parts are assigned once more for the codes. ``error`` sums a row's squared distances,
    ``label_error`` those of all rows with its label, nulls together. Only the codebooks, of a size
    the parameters fix, are broadcast or pass through the driver; a task sends one partial sum per
    entry, so a frequent vector or label costs nothing more.

    Rows whose vector is null or holds null or non-finite components are dropped. A vector with
    another length than that of the smallest id, or with a component beyond 2^26 in absolute value
    after scaling, is returned with a null code and error and changes no codebook. Lengths that the
    number of parts doesn't divide are padded with zeros. A null id is coded and never a first entry
    (if all are null, the smallest vector is the only one). Repeated rows count and are returned
    each. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"1 to {ENTRIES} entries")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    kept = usable(rows, "vector")
    size, books = first_books(kept, parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = refined(kept, size, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if not books.shape[1]:
        coded = kept.select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        here = spark.sparkContext.broadcast(books)
        kind = vectors.schema[label_col].dataType.simpleString()
        coded = cut_lineage(
            kept.select("vector", "id", "label").mapInArrow(
                partial(_coded, size=size, books=here), f"vec_id long, label {kind}, code string, error long"
            )
        )
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    if books.shape[1]:
        per = cut_lineage(per)
        if per.count() <= LISTED:
            per = F.broadcast(per)
    return coded.join(per, coded["label"].eqNullSafe(per["_label"])).select(
        F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
