"""Packing documents into token sequences by linear grouping."""

import json
import re
from collections import defaultdict
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W, functions as F

from barsight.llm.words import small_batches
from barsight.session import cut_lineage

CAPACITY = 2048
END = 0
LISTED = 1_000_000  # (task, length) counts that are broadcast at most
SMALL = 16  # lengths up to capacity / SMALL are small
GROUPS = 1024
# Characters whose classes do not depend on a library's Unicode version.
COMMON = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")
SPECIAL = "<|endoftext|>"
# The pattern that cuts text before byte-level merges; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def encoders(path):
    """The tokenizer of the file, and a faster encoder with the same vocabulary and merge order."""
    import tiktoken
    from tokenizers import Tokenizer

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printable}
    names |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if t != SPECIAL}
    return Tokenizer.from_file(path), tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def encode(text, path):
    """Ids of the tokenizer in the file. Texts of common characters take the faster encoder."""
    slow, fast = encoders(path)
    if COMMON.search(text) or SPECIAL in text:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=())


def cut_points(n, capacity=CAPACITY):
    """Starts of the pieces of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [0]
    return list(range(0, n, capacity)) if n % capacity == 0 else [0, *range(n % capacity, n, capacity)]


def _pieces(batches, path, capacity):
    """Pieces of the texts, numbered by task and, for each length, in the task's order."""
    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = ["id", "piece", "start", "length", "ids", "part", "ordinal"]
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(text or "", path), np.uint32(END)).astype("<u4")
            starts = cut_points(len(ids), capacity)
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                rows.append((i, piece, a, b - a, ids[a:b].tobytes(), part, seen[b - a]))
                seen[b - a] += 1
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class Gaps:
    """Runs of equal sequences by free space: gap -> [(number, lengths)]."""

    def __init__(self, capacity):
        self.capacity, self.open = capacity, defaultdict(list)

    def put(self, n, lengths):
        self.open[self.capacity - sum(lengths)].append((n, lengths))

    def best_fit(self, length, count):
        """Put ``count`` items of one length where the least space is left over."""
        gap = length
        while count and gap <= self.capacity:
            runs = self.open.get(gap)
            if not runs:
                gap += 1
                continue
            n, lengths = runs.pop()
            used = min(n, count)
            if used < n:
                runs.append((n - used, lengths))
            self.put(used, (*lengths, length))
            count -= used
            gap = length
        if count:
            each = self.capacity // length
            if count >= each:
                self.put(count // each, (length,) * each)
            if count % each:
                self.put(1, (length,) * (count % each))

    def runs(self):
        merged = defaultdict(int)
        for runs in self.open.values():
            for n, lengths in runs:
                merged[lengths] += n
        return sorted(((n, lengths) for lengths, n in merged.items()), key=lambda r: r[1], reverse=True)


def linear_groups(counts, groups):
    """Large lengths, longest first, in groups of equal cardinality: [[(length, n), ...], ...]."""
    total = sum(counts.values())
    size = -(-total // groups)
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def configuration(sizes, left, capacity):
    """The fullest configuration that holds one of the largest group left: {group: copies}.

    Sizes fall. Reachable sums of the groups behind are kept as bit sets; the way back takes
    the large groups first.
    """
    head = next(g for g, n in enumerate(left) if n)
    room = capacity - sizes[head]
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for g in range(len(sizes) - 1, head - 1, -1):
        copies = min(left[g] - (g == head), room // sizes[g])
        if copies <= 0:
            continue
        before = reach
        for _ in range(copies):
            grown = (reach | reach << sizes[g]) & mask
            if grown == reach:
                break
            reach = grown
        trail.append((g, copies, before))
    at = reach.bit_length() - 1
    out = {head: 1}
    for g, copies, before in reversed(trail):
        for c in range(min(copies, at // sizes[g]), -1, -1):
            if before >> (at - c * sizes[g]) & 1:
                break
        if c:
            out[g] = out.get(g, 0) + c
            at -= c * sizes[g]
    return out


def _take(pool, n):
    """The next n items of a group's pool as (length, n) segments."""
    out = []
    while n:
        length, have = pool[-1]
        used = min(have, n)
        out.append((length, used))
        n -= used
        if used == have:
            pool.pop()
        else:
            pool[-1] = (length, have - used)
    return out


def _overlay(slots):
    """Segments of several slots over the same sequences -> (number, lengths) runs."""
    at = [0] * len(slots)
    used = [0] * len(slots)
    while at[0] < len(slots[0]):
        n = min(slots[j][at[j]][1] - used[j] for j in range(len(slots)))
        yield n, tuple(slots[j][at[j]][0] for j in range(len(slots)))
        for j in range(len(slots)):
            used[j] += n
            if used[j] == slots[j][at[j]][1]:
                at[j], used[j] = at[j] + 1, 0


def plan(counts, capacity=CAPACITY, groups=GROUPS, small=SMALL):
    """{length: number} -> [(number of sequences, lengths in place order)].

    Works on lengths only, so its input and time do not grow with the table. Large lengths are
    put in groups of equal cardinality and rounded up to the group's largest; configurations
    of these few sizes are made as full as the counts allow, with their multiplicity; the actual
    lengths take the places of their group; small lengths, longest first, then go where least
    space remains.
    """
    gaps = Gaps(capacity)
    if counts.get(capacity):
        gaps.put(counts[capacity], (capacity,))
    large = {x: n for x, n in counts.items() if capacity // small < x < capacity and n}
    pools = linear_groups(large, groups)
    sizes = [g[0][0] for g in pools]
    left = [sum(n for _, n in g) for g in pools]
    pools = [g[::-1] for g in pools]
    while any(left):
        chosen = configuration(sizes, left, capacity)
        times = min(left[g] // c for g, c in chosen.items())
        slots = []
        for g, c in chosen.items():
            left[g] -= c * times
            slots += [_take(pools[g], times) for _ in range(c)]
        for n, lengths in _overlay(slots):
            gaps.put(n, lengths)
    for length in sorted((x for x in counts if x <= capacity // small), reverse=True):
        gaps.best_fit(length, counts[length])
    return gaps.runs()


def places(runs):
    """Arrays (key of length and first rank, first sequence, offset): where ranked items go."""
    ranks = defaultdict(int)
    rows, sequence = [], 0
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            rows.append(((length << 40) + ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def _placing(table):
    """Column function of (length, rank from 0): (sequence_id, offset)."""

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << 40) + rank.to_numpy()
        row = table.value[np.searchsorted(table.value[:, 0], key, "right") - 1]
        return pd.DataFrame({"sequence_id": row[:, 1] + key - row[:, 0], "offset": row[:, 2]})

    return place


def _lists():
    """Column function of the little-endian bytes of ids: lists of int."""

    @F.arrow_udf("array<int>")
    def lists(raw: pa.Array) -> pa.Array:
        cells = raw.to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in cells])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(cells), "<i4"), pa.int32()))

    return lists


def _joined(batches):
    for batch in batches:
        parts = batch.column("parts")
        inner = parts.flatten().field("ids")
        # pieces lie in order and without gaps, so only the bounds change
        ends = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy())])
        bounds = ends[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])]
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner.flatten())
        yield pa.record_batch({"sequence_id": batch.column("sequence_id"), "length": pa.array(np.diff(bounds)), "ids": ids})


def sequences(packed):
    """(sequence_id, length, ids): the packed sequences themselves, from the rows of ``pack``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "parts").mapInArrow(_joined, "sequence_id long, length long, ids array<int>")


def pack(docs, id_col="doc_id", text_col="text", path=None, capacity=CAPACITY):
    """One row per piece: id, piece, start, length, ids, sequence_id, offset, ids_crc32.

    ``ids`` are the piece's token ids, ``ids_crc32`` the digest of their little-endian bytes;
    ``sequences`` joins the ids of each packed sequence. A document is its token ids and the end id. Documents longer than ``capacity`` are cut into pieces of it, of which the first may be
    shorter; no other is cut.

    Texts are tokenised once, by tasks that also number their pieces of each length. The counts per
    task and length, summed in task order, give every piece its rank among all pieces of its length
    without another shuffle of pieces; the counts per length (at most ``capacity`` rows) are planned
    on the driver, and rank and length give the place. The plan's table depends on the number of
    lengths only. The ids are read again only if they are asked for.

    Null and empty texts are one piece of the end id. A null id is carried along. Repeated rows
    are packed each. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = cut_lineage(
        rows.mapInArrow(
            partial(_pieces, path=path or vocabulary_path(), capacity=capacity),
            "id long, piece int, start long, length long, ids binary, part int, ordinal long",
        ).withColumn("ids_crc32", F.crc32("ids"))
    )
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    per_task = cut_lineage(per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    offsets = per_task.select("part", "length", "before")
    if offsets.count() <= LISTED:
        offsets = F.broadcast(offsets)
    placed = pieces.join(offsets, ["part", "length"]).withColumn("place", _placing(table)("length", F.col("before") + F.col("ordinal")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", _lists()("ids").alias("ids"), "place.sequence_id", "place.offset", "ids_crc32")
