"""Exact, near and passage duplicates against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barsight.llm import exact_dedup, near_dedup, substring_dedup
from barsight.llm.components import components

from .edge import LONG, ROWS, table, words

BLANK = re.compile("[\x20\x09-\x0D]")


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i))
    keep = {k: sorted(v)[0][2] for k, v in groups.items()}
    out = []
    for i, t in rows:
        k = BLANK.sub("", t or "")
        out.append((i, keep[k], len(groups[k]), i == keep[k], hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    got = [tuple(r) for r in exact_dedup.exact_groups(table(spark)).collect()]
    assert sorted(got, key=str) == exact(ROWS)


def test_exact_contents_under_one_digest_stay_apart(spark):
    got = exact_dedup.exact_groups(table(spark), digest=lambda text: F.lit("same")).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact(ROWS)


def test_exact_drop_keeps_columns_and_rows(spark):
    docs = table(spark)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    kept = {i for i, _, _, k, _ in exact(ROWS) if k}
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, _ in ROWS if i in kept), key=str)


def shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def compare_near(spark, rows, k):
    got = near_dedup.near_groups(table(spark, rows), k=k).collect()
    want = near(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("k", [2, 5])
def test_near_edge_cases(spark, k):
    compare_near(spark, ROWS, k)


def test_near_chains_and_large_group(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):  # edits from none to too many
        w = list(base)
        for _ in range(rng.randint(0, 16)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(150, 260):  # a common passage and nothing else in common
        rows.append((i, " ".join(base[:25] + [rng.choice(vocabulary) for _ in range(70)])))
    chain = [f"c{i}" for i in range(100)]
    for i in range(260, 290):  # each is near the next only
        j = i - 260
        rows.append((i, " ".join(f"c{x}" for x in range(5 * j, 5 * j + len(chain)))))
    rng.shuffle(rows)
    compare_near(spark, rows, 2)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 560)] + [(9, 9), (1, 2), (2, 1), (3, 1)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(101, 141)} | {i: 7 for i in range(500, 560)} | {2: 1, 3: 1}


def passages(rows, k):
    first = {}
    texts = [(i, words(t)) for i, t in rows]
    for i, w in texts:
        for p in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[p : p + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left if gone else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_bits", [10, 29])
def test_passages(spark, most_bits):
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(40)]
    rows = list(ROWS)
    for i in range(20, 60):
        w = [f"r{rng.randrange(400)}" for _ in range(rng.randrange(80))]
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + shared[rng.randrange(10) : rng.randrange(20, 40)] + w[at:])))
    got = substring_dedup.remove_repeats(table(spark, rows), with_text=True, most_bits=most_bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == passages(rows, 13)


def test_packed_cells_round_trip():
    import numpy as np

    places = np.sort(np.random.default_rng(1).integers(0, 1 << 16, 3000))
    data = substring_dedup.pack_cells(places, 1 << 16)
    assert (substring_dedup.unpack_cells(data, len(places)) == places).all()


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, near_dedup.near_groups, substring_dedup.remove_repeats])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).collect() == []
    assert len(run(table(spark, [(1, None), (2, "")])).collect()) == 2


def test_long_text_stands_alone(spark):
    got = near_dedup.near_groups(table(spark, [(1, LONG), (2, LONG + " z")])).collect()
    assert {r["component_id"] for r in got} == {1}
