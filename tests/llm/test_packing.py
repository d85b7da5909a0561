"""Packing: every piece once, gapless, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from barsight.llm import packing

from .edge import ROWS, table


def fixed_ids(text):
    slow, _ = packing.encoders(packing.vocabulary_path())
    return slow.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, got, capacity=2048):
    want = defaultdict(int)
    for i, t in rows:
        ids = fixed_ids(t)
        short = len(ids) % capacity if len(ids) > capacity else len(ids)
        starts = sorted({0, *range(short, len(ids), capacity)})
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    return len(sequences), -(-total // capacity)


def test_edge_cases(spark):
    check(ROWS, packing.pack(table(spark)).collect())


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used, least = check(rows, packing.pack(docs).collect())
    assert used <= least * 1.01 + 1


def test_empty_table(spark):
    assert packing.pack(table(spark, [])).collect() == []


@pytest.mark.parametrize("high", [40, 2048])
def test_plan_keeps_every_length(high):
    rng = np.random.default_rng(high)
    lengths, counts = np.unique(rng.integers(1, high + 1, 20_000), return_counts=True)
    counts = dict(zip(lengths.tolist(), counts.tolist()))
    runs = packing.plan(counts)
    used = defaultdict(int)
    for n, parts in runs:
        assert sum(parts) <= 2048
        for x in parts:
            used[x] += n
    assert used == counts
    least = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert sum(n for n, _ in runs) <= least * 1.01 + 1


def test_groups_have_equal_cardinality():
    groups = packing.linear_groups({10: 5, 20: 7, 30: 4}, 4)
    assert [sum(n for _, n in g) for g in groups] == [4, 4, 4, 4]
    assert [g[0][0] for g in groups] == [30, 20, 20, 10]


def test_fast_encoder_equals_the_tokenizer():
    slow, fast = packing.encoders(packing.vocabulary_path())
    for c in [chr(x) for x in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))]:
        for text in (c, f"a{c}b", f" {c}{c} 1", f"{c}\n {c}'s"):
            assert not packing.COMMON.search(text)
            assert list(fast.encode_ordinary(text)) == slow.encode(text, add_special_tokens=False).ids


def test_sequences_hold_the_ids(spark):
    got = packing.pack(table(spark))
    rows = got.collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    assert set(made) == {r["sequence_id"] for r in rows} and sum(map(len, made.values())) == sum(r["length"] for r in rows)
    assert all(made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)
    assert packing.sequences(packing.pack(table(spark, []))).collect() == []
