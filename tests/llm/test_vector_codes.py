"""Vector codes against a plain version; candidate masks against all entries."""

import hashlib
import math

import numpy as np
import pytest

from barsight.llm import vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    firsts = [firsts[i] for i in sorted(firsts)][:entries]
    size = len(firsts[0])
    width = -(-size // parts)

    def whole(v):
        v = [math.floor(256 * x) for x in v]
        return None if len(v) != size or any(abs(x) > 2**26 for x in v) else v + [0] * (parts * width - size)

    def cut(v, p):
        return v[p * width : (p + 1) * width]

    books = [[cut(whole(v), p) for v in firsts] for p in range(parts)]
    values = [whole(v) for _, v, _ in kept]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in values:
                if v:
                    members.setdefault(nearest(cut(v, p), books[p])[0], []).append(cut(v, p))
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, per = [], {}
    for (i, _, label), v in zip(kept, values):
        found = [nearest(cut(v, p), books[p]) for p in range(parts)] if v else None
        code, error = ("".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)) if v else (None, None)
        out.append((i, code, error, label))
        per[label] = None if error is None and per.get(label) is None else (per.get(label) or 0) + (error or 0)
    return [(i, c, e, per[label], digest) for i, c, e, label in out]


def same(got, want):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def rows_of(n, size, seed=1):
    draw = np.random.default_rng(seed).normal(0, 0.3, (n, size)).astype(np.float32)
    return [(i, [float(x) for x in v], i % 3 if i % 7 else None) for i, v in enumerate(draw, 10)]


SCHEMA = "vec_id long, embedding array<float>, label int, id int, code string, error int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x", 2, 3) for i, v, l in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [16, 32, 41])
def test_equals_plain_version(spark, size):
    rows = rows_of(200, size)
    rows += [
        (None, [0.25] * size, 1), (1, None, 1), (2, [0.5] * (size - 1) + [None], 1), (3, [float("nan")] + [0.5] * (size - 1), 2),
        (4, [float("-inf")] * size, 2), (5, [0.1] * (size + 1), 5), (6, [], None), (7, [1e30] * size, 5), (8, [1e5] * size, 6),
    ]
    rows += [rows[20]] * 30 + [(12, [0.0] * size, 9)]
    # the smallest ids give the length
    rows = [(i + 100 if i is not None and i in (5, 6, 7) else i, v, l) for i, v, l in rows]
    got = vector_codes.compress(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same(got.collect(), plain(rows))


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = [(i, [float(i % 2)] * 16, None) for i in range(9)]
    same(vector_codes.compress(frame(spark, rows)).collect(), plain(rows))
    same(vector_codes.compress(frame(spark, rows), entries=3, rounds=1).collect(), plain(rows, entries=3, rounds=1))


def test_nothing_usable(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [float("nan")], 1)])).collect() == []
    assert [tuple(r)[:3] for r in vector_codes.compress(frame(spark, [(1, [], 1)])).collect()] == [(1, "00" * 16, 0)]


@pytest.mark.parametrize("spread", [1, 20, 3000])
def test_masks_hold_the_nearest_entry(spread):
    draw = np.random.default_rng(spread)
    for entries in (1, 2, 63, 64):
        book = draw.integers(-spread, spread + 1, (entries, 5))
        x = draw.integers(-2 * spread, 2 * spread + 1, (500, 5))
        search = vector_codes.Slices(book)
        square = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        for radius in (1, search.radius):
            search.radius = radius
            index, best = search.nearest(x)
            assert (index == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
        box = (abs(x[:, None] - book[None]).max(axis=2) <= radius) * (np.uint64(1) << np.arange(entries, dtype=np.uint64))
        assert (search.masks(x, np.full(500, radius)) == box.sum(axis=1, dtype=np.uint64)).all()
