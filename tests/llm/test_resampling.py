"""Importance resampling against a plain version."""

import hashlib
import math
import re
from zlib import crc32

import pytest

from barsight.llm import resampling
from llm.edge import ASCII_LOWER, LONG, ROWS, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [crc32(r.encode()) % 10000 for r in runs]


def plain(rows, target, percent=5):
    own = [(i, *plain_features(t)) for i, t in rows]
    s, t = [0] * 10000, [0] * 10000
    for _, _, f in own:
        for b in f:
            s[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(f), weight, score, None])
    fit = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = rank
    return [(r[0], *r[2:]) for r in out]


def same(got, want):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# words of the target, repeated rows of one id, equal scores, empty runs, other scripts
MORE = [(100 + i, f"alpha beta{i % 7} gamma delta " * (4 + i % 9) + "ünï-漢字 A1") for i in range(300)]
MORE += [(5000, "alpha beta1 gamma " * 9)] * 40


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_equals_plain_version(spark, monkeypatch, percent):
    monkeypatch.setattr(resampling, "SLICE", 3000)
    rows = ROWS + MORE
    target = ["Alpha BETA1 gamma", None, "", "the quick brown fox", "漢字 a1"]
    docs = table(spark, rows).repartition(5)
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.importance_sample(docs, aims, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), plain(rows, target, percent))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = table(spark)
    assert resampling.importance_sample(none, none).collect() == []
    assert resampling.importance_sample(none, some).collect() == []
    same(resampling.importance_sample(some, none).collect(), plain(ROWS, []))


def test_runs_do_not_cross_texts_or_slices(spark):
    import pyarrow as pa

    column = pa.array(["a b c", None, "d", "", "..", "e f", LONG])
    for size in (1, 10, 1 << 20):
        resampling.SLICE, kept = size, resampling.SLICE
        seen = {}
        for first, words, found in resampling.hashed_runs(column, 10000):
            for text, bucket in found:
                for t, b in zip(text.tolist(), bucket.tolist()):
                    seen.setdefault(first + t, []).append(b)
        resampling.SLICE = kept
        for i, text in enumerate(column.to_pylist()):
            assert sorted(seen.get(i, [])) == sorted(plain_features(text)[1])
