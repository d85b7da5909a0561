"""Repeated passages: a count-min prefilter, then exact grouping of what it lets through."""

import hashlib
import zlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from barsight.llm.words import SECOND, Words, grams, mix, slices
from barsight.session import cut_lineage

ROWS = 2  # rows of the sketch
MOST_BITS = 29  # a sketch row has 2^29 cells at most: 64 MB once merged, 128 MB broadcast
BLOCK = 20  # cells of 2^20 are merged together
HELD = 1 << 22  # windows a task holds before it hands out a partial sketch
LISTED = 1_000_000  # ids of eight bytes that are broadcast at most
BYTES_PER_WORD = 5  # only for sizing


def cells(h, row, bits):
    return mix(h + np.uint64(row + 1) * SECOND) >> np.uint64(64 - bits)


def pack_cells(places, span):
    """Sorted cells of a block: low bytes, then the high parts in unary."""
    high = places >> 8
    unary = np.zeros(len(places) + (span >> 8), np.uint8)
    unary[high + np.arange(len(places))] = 1
    return (places & 255).astype(np.uint8).tobytes() + np.packbits(unary).tobytes()


def unpack_cells(data, n):
    raw = np.frombuffer(data, np.uint8)
    high = np.flatnonzero(np.unpackbits(raw[n:]))[:n] - np.arange(n)
    return (high << 8) | raw[:n]


def _window_hashes(column, k):
    for first, data, offsets in slices(column):
        words = Words(data, offsets)
        hashes = words.hashes()
        h, place, text = grams(hashes, words.bounds, k)
        yield first, hashes, words, h, place, text


def _partial_sketches(batches, k, bits):
    """(row, block, count, cells) of a task's windows; a cell counts twice at most."""
    block = min(bits, BLOCK)

    def flush(held):
        h = np.concatenate(held)
        for row in range(ROWS):
            at = np.sort(cells(h, row, bits).astype(np.int64))
            if len(at) > 2:  # more than twice says no more than twice
                at = np.concatenate([at[:2], at[2:][at[2:] != at[:-2]]])
            cuts = np.searchsorted(at, np.arange((1 << (bits - block)) + 1) << block)
            used = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch(
                {
                    "row": pa.array(np.full(len(used), row, np.int32)),
                    "block": pa.array(used.astype(np.int32)),
                    "n": pa.array(np.diff(cuts)[used].astype(np.int32)),
                    "cells": pa.array(
                        [pack_cells(at[cuts[b] : cuts[b + 1]] - (int(b) << block), 1 << block) for b in used], pa.binary()
                    ),
                }
            )

    held, size = [], 0
    for batch in batches:
        for *_, h, _, _ in _window_hashes(batch.column(0), k):
            held.append(h)
            size += len(h)
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
    if size:
        yield from flush(held)


def _merged(batches, bits):
    """Adds up partial sketches; a block comes out as one bit per cell, set from a count of two."""
    block = min(bits, BLOCK)
    total = {}
    for batch in batches:
        for row, at, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            one, two = total.setdefault((row, at), (np.zeros(1 << block, bool), np.zeros(1 << block, bool)))
            places = unpack_cells(data, n)
            again = places[1:][places[1:] == places[:-1]]
            two[again] = True
            two[places[one[places]]] = True
            one[places] = True
    for (row, at), (_, two) in total.items():
        yield pa.record_batch(
            {"row": pa.array([row], pa.int32()), "block": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(two).tobytes()], pa.binary())}
        )


class Sketch:
    """Merged bitmaps, compressed while they travel."""

    def __init__(self, rows):
        self.rows = rows

    def __getstate__(self):
        return self.rows.shape, zlib.compress(self.rows.tobytes(), 1)

    def __setstate__(self, state):
        shape, data = state
        self.rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape)

    def twice(self, h, bits):
        """Whether all cells of a window count two or more."""
        good = np.ones(len(h), bool)
        for row in range(ROWS):
            at = cells(h, row, bits)
            good &= (self.rows[row][at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return good


def _settled(held):
    """Windows of a task: those with a smaller id in the task go, the others are yet to be grouped.

    The first come as one row per text (``gone``), the second as one row per window.
    """
    h, g, ids, place = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((ids, g, h))
    h, g, ids, place = h[order], g[order], ids[order], place[order]
    heads = np.ones(len(h), bool)
    heads[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    low = ids[np.maximum.accumulate(np.where(heads, np.arange(len(h)), 0))]
    open_ = ids == low
    own, places = ids[~open_], place[~open_]
    order = np.argsort(own, kind="stable")
    own, places = own[order], places[order]
    texts, starts = np.unique(own, return_index=True)
    n, rest = int(open_.sum()), len(texts)

    def column(values, kind):
        return pa.concat_arrays([pa.array(values, kind), pa.nulls(rest, kind)])

    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)), pa.int32()), pa.array(places, pa.int32()))
    salt = (mix(texts.astype(np.uint64)) >> np.uint64(33)).astype(np.int32)
    return pa.record_batch(
        {
            "h": column(h[open_].view(np.int64), pa.int64()),
            "g": pa.array(np.concatenate([g[open_], salt]), pa.int32()),
            "id": pa.array(np.concatenate([ids[open_], texts]), pa.int64()),
            "place": column(place[open_], pa.int32()),
            "gone": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists]),
        }
    )


def _estimated(batches, k, bits, sketch):
    """Windows whose every cell says that they occur at least twice, as far as a task can settle them."""
    held, size = [], 0
    for batch in batches:
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        for first, hashes, words, h, place, text in _window_hashes(batch.column(0), k):
            good = np.flatnonzero(sketch.value.twice(h, bits))
            other, _, _ = grams(hashes, words.bounds, k, SECOND)
            held.append(
                (
                    h[good],
                    (other[good] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    ids[first + text[good]].astype(np.int64),
                    (place - words.bounds[text])[good].astype(np.int32),
                )
            )
            size += len(good)
            if size >= HELD // 2:
                yield _settled(held)
                held, size = [], 0
    if held:
        yield _settled(held)


def _plain(batches):
    """Texts of which nothing goes."""
    for batch in batches:
        split = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            {
                "id": batch.column(0),
                "n_words": pa.array([len(w) for w in split], pa.int64()),
                "n_removed": pa.array(np.zeros(len(split), np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string()),
            }
        )


def _cut(batches, k, with_text):
    for batch in batches:
        out = []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            step = np.zeros(len(words) + 1, np.int32)
            at = np.array(places, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + k, -1)
            stay = np.cumsum(step[:-1]) == 0
            left = b" ".join(compress(words, stay))
            out.append((len(words), int(len(words) - stay.sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
        n, gone, digest, left = zip(*out) if out else ((), (), (), ())
        yield pa.record_batch(
            {
                "id": batch.column(0),
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()),
                "kept_text": pa.array(left, pa.string()),
            }
        )


def merged_sketch(texts, k, bits):
    """Bitmaps of the cells that count two or more, one per sketch row; 2 * 2^bits / 8 bytes."""
    spark = texts.sparkSession
    parts = texts.mapInArrow(partial(_partial_sketches, k=k, bits=bits), "row int, block int, n int, cells binary")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    merged = parts.repartition(count, "row", "block").mapInArrow(partial(_merged, bits=bits), "row int, block int, bits binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    width = (1 << min(bits, BLOCK)) // 8
    for r in merged.toLocalIterator(prefetchPartitions=True):
        out[r["row"], r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeated_windows(docs, id_col="doc_id", text_col="text", k=13, most_bits=MOST_BITS):
    """(id, places): windows of k words whose sequence also starts in a row with a smaller id.

    Pass 1: each task writes the count-min sketch of its windows, block by block; sketches are
    added per block. A window's cells count at least as much as it does, so keeping windows
    whose cells all reach two loses none. Pass 2: a task settles the windows it holds a smaller id
    for and sends one text's worth of every other kept window, with a 96-bit hash, to be grouped
    exactly for the smallest id. A group so has one row per task, however common a window is.

    The sketch takes two cells per window up to ``2^most_bits`` cells a row; what is broadcast
    never exceeds ``2 * 2^most_bits`` bits. Beyond that it lets more windows through, and the
    exact grouping, an ordinary shuffle, does more of the work; results are the same.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id")).where("id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(2 * size / BYTES_PER_WORD, 2))), 10, most_bits))
    sketch = spark.sparkContext.broadcast(Sketch(merged_sketch(rows.select("text"), k, bits)))
    found = rows.mapInArrow(
        partial(_estimated, k=k, bits=bits, sketch=sketch), "h long, g int, id long, place int, gone array<int>"
    )
    found = found.withColumn("low", F.min("id").over(Window.partitionBy("h", "g"))).where("gone is not null or low < id")
    return found.groupBy("id").agg(F.concat(F.collect_list("place"), F.flatten(F.collect_list("gone"))).alias("places"))


def remove_repeats(docs, id_col="doc_id", text_col="text", k=13, with_text=False, most_bits=MOST_BITS):
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text on request).

    A word goes when a window over it also starts in a row with a smaller id; windows are judged
    on the input. Kept words are joined by one space; kept_text is null where nothing goes.

    Null and empty texts have no words. A null id compares with nothing: its row neither loses
    words nor makes others lose any. Repeated rows share an id, so they lose nothing to each
    other; ids stand for one text each. Other columns are not read.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = cut_lineage(repeated_windows(docs, id_col, text_col, k, most_bits))
    ids = gone.select("id")
    if ids.count() <= LISTED:
        ids = F.broadcast(ids)
    base = text.join(ids, "id", "left_anti").mapInArrow(_plain, "id long, n_words long, n_removed long, kept_sha256 string")
    touched = text.join(ids, "id", "left_semi").join(gone, "id").select("id", "text", "places")
    cut = touched.mapInArrow(
        partial(_cut, k=k, with_text=with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    out = base.withColumn("kept_text", F.lit(None).cast("string")).unionByName(cut)
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")
