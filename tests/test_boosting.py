"""Boosting with shared passes against a plain single-process version; names in headlines; folds in one fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsight.operators import boosting as BO
from barsight.operators import events as E

COLUMNS = ["a", "b", "c"]


def plain(x, y, fit, rounds, base, scale, rate, depth, penalty, min_rows):
    """Scores after the rounds, grown level by level from all rows at once."""
    score = np.full(len(y), base)
    for _ in range(rounds):
        g, h = BO.slopes(fit, y, score, scale)
        node = np.zeros(len(y), int)
        for _ in range(depth):
            new = node.copy()
            for n in np.unique(node):
                own = np.flatnonzero(node == n)
                best, cut = 1e-12, None
                for f in range(x.shape[1]):
                    for b in range(BO.BINS):
                        left = own[x[own, f] <= b]
                        right = own[x[own, f] > b]
                        if min(len(left), len(right)) < min_rows:
                            continue
                        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
                        gain = part(left) + part(right) - part(own)
                        if gain > best + 1e-9:
                            best, cut = gain, (f, b)
                if cut:
                    new[own] = 2 * n + 1 + (x[own, cut[0]] > cut[1])
            node = new
        for n in np.unique(node):
            own = node == n
            if fit.loss == "pinball":
                r = np.sort((y - score)[own])
                score[own] += rate * r[max(int(np.ceil(fit.q * len(r) - 1e-12)) - 1, 0)]
            else:
                score[own] -= rate * g[own].sum() / (h[own].sum() + penalty)
    return score


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame(rng.normal(size=(n, 3)).round(2), columns=COLUMNS)
    pdf["session"] = np.arange(n)
    pdf["R"] = np.sin(2 * pdf.a) + pdf.b * (pdf.c > 0) + rng.normal(0, 0.2, n)
    pdf["up"] = (pdf.R > 0).astype(float)
    pdf["fold"] = np.arange(n) % 4
    return pdf, spark.createDataFrame(pdf).selectExpr("session", *COLUMNS, "R", "up", "array(cast(fold as int)) folds")


@pytest.mark.parametrize("tasks", [1, 12])
def test_equals_plain_version(rows, monkeypatch, tasks):
    pdf, df = rows
    if tasks > 1:
        # many tasks: salted sums, and quantiles of leaves by repeated counts
        monkeypatch.setattr(BO, "ROWS", len(pdf) // (tasks - 1))
        monkeypatch.setattr(BO, "EXACT", 3)
        monkeypatch.setattr(BO, "STEPS", 8)
    fits = [BO.Fit("square", "R", fold=1, rounds=4), BO.Fit("log", "up", rounds=4), BO.Fit("pinball", "R", q=0.8, rounds=4), BO.Fit("huber", "R", fold=2, rounds=3)]
    model = BO.Booster(COLUMNS, fits, rate=0.3, depth=2, min_rows=10).fit(df)
    got = model.predict(df).toPandas().sort_values("session")
    x = BO.binned(pdf, COLUMNS, model.edges)
    for i, (fit, m) in enumerate(zip(fits, model.models)):
        own = (pdf.fold != fit.fold).to_numpy()
        y = pdf[fit.label].to_numpy()
        want = plain(x[own], y[own], fit, fit.rounds, m.base, m.scale, 0.3, 2, 1.0, 10)
        assert m.best == fit.rounds == len(m.trees)
        np.testing.assert_allclose(got[f"p{i}"].to_numpy()[own], BO.link(fit.loss, want), atol=1e-7)


def test_rounds_of_a_small_table_take_few_jobs(spark, rows, monkeypatch):
    pdf, df = rows
    fits = [BO.Fit("huber", "R", fold=1, rounds=30, patience=4), BO.Fit("log", "up", rounds=30), BO.Fit("pinball", "R", q=0.3, rounds=30, hold=0.2, patience=3)]
    grown = lambda: BO.Booster(COLUMNS, fits, rate=0.3, depth=3, min_rows=10).fit(df)
    spark.sparkContext.setJobGroup("rounds", "rounds of small fits")
    dealt = grown()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 30
    # the same rows by a job for each level
    monkeypatch.setattr(BO.Booster, "_grow_dealt", BO.Booster._grow)
    x = BO.binned(pdf, COLUMNS, dealt.edges)
    for a, b in zip(dealt.models, grown().models):
        assert a.best == b.best
        np.testing.assert_allclose(BO.added(a.trees, x), BO.added(b.trees, x), atol=1e-9)


def test_early_stopping_keeps_the_best_round(rows):
    pdf, df = rows
    noise = BO.Fit("log", "up", rounds=60, fold=0, patience=5)
    model = BO.Booster(COLUMNS, [noise], rate=1.0, depth=4, min_rows=2).fit(df)
    m = model.models[0]
    assert 0 < m.best < 60 and len(m.trees) == m.best
    x = BO.binned(pdf, COLUMNS, model.edges)
    held = (pdf.fold == 0).to_numpy()
    loss = [BO.losses(noise, pdf.up.to_numpy(), m.base + BO.added(m.trees[:k], x), 1)[held].mean() for k in range(m.best + 1)]
    assert min(loss) == loss[-1]


def test_pinball_beats_the_start_on_other_rows(rows):
    pdf, df = rows
    fits = [BO.Fit("pinball", "R", q=q, fold=3, rounds=15) for q in (0.1, 0.9)]
    model = BO.Booster(COLUMNS, fits, rate=0.2, depth=3, min_rows=10).fit(df)
    got = model.predict(df).toPandas().sort_values("session")
    held = (pdf.fold == 3).to_numpy()
    for i, fit in enumerate(fits):
        y = pdf.R.to_numpy()[held]
        assert BO.losses(fit, y, got[f"p{i}"].to_numpy()[held], 1).mean() < 0.9 * BO.losses(fit, y, np.full(len(y), model.models[i].base), 1).mean()


def test_missing_labels_and_constant_features(spark):
    df = spark.createDataFrame([(i, 1.0, None, float(i % 2) if i < 8 else None, [0]) for i in range(10)], "session long, a double, b double, R double, folds array<int>")
    model = BO.Booster(["a", "b"], [BO.Fit("square", rounds=2), BO.Fit("pinball", rounds=2)]).fit(df)
    got = model.predict(df).toPandas()
    assert len(got) == 10 and np.allclose(got.p0, 0.5)


def test_names_in_all_headlines(spark):
    heads = [
        ("Acme Corp wins", "Acme Corp"), ("Now Acme Corp wins. Acme", "Now"), ("Ac", "Ac"), ("Ac", "Ac"), ("xAcme Corp", ""),
        (None, "Ghost"), ("Ünïcode 漢字\nline", "漢字\nl"), ("nothing", None), ("Now", "Now"), ("A", "A"), ("", "zzzz"),
    ]
    df = spark.createDataFrame(heads, "headline string, entity string")
    got = {r["entity"]: tuple(r)[1:] for r in E.mention_position(df, "entity").collect()}
    texts = [h for h, _ in heads if h is not None]
    for name in {n for _, n in heads if n is not None}:
        own = sum(n == name for _, n in heads)
        start = sum(t.startswith(name) for t in texts)
        assert got[name] == (own, start, sum(name in t for t in texts) - start)
    assert None not in got


def test_rows_of_several_partitions_are_held_by_the_tasks(spark, rows, monkeypatch):
    pdf, df = rows
    fits = [BO.Fit("huber", "R", fold=1, rounds=12, patience=4, weight="w"), BO.Fit("pinball", "R", q=0.3, rounds=12), BO.Fit("log", "up", rounds=12)]
    weighted = df.withColumn("w", F.lit(1.0) + F.abs("R"))
    grown = lambda: BO.Booster(COLUMNS, fits, rate=0.3, depth=3, min_rows=10).fit(weighted)
    monkeypatch.setattr(BO, "ROWS", len(pdf) // 3)
    spark.sparkContext.setJobGroup("held", "rounds of rows in several partitions")
    held = grown()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("held")) < 30
    # a pass for each level over all partitions gives the same trees
    monkeypatch.setattr(BO, "HELD", 0)
    x = BO.binned(pdf, COLUMNS, held.edges)
    for a, b in zip(held.models, grown().models):
        assert a.best == b.best and len(a.trees) == len(b.trees)
        np.testing.assert_allclose(BO.added(a.trees, x), BO.added(b.trees, x), atol=1e-9)


def test_larger_child_is_the_parent_without_the_smaller():
    rng = np.random.default_rng(0)
    x, g = rng.integers(0, 4, (2, 90)).astype(np.uint8), rng.standard_normal(90)
    parent = np.repeat([0, 1], 45)
    child = 2 * parent + (rng.random(90) < 0.3)
    above = BO._binned_sums(parent, x, (g, None), 2, 4)
    every = BO._binned_sums(child, x, (g, None), 4, 4)
    size = np.bincount(child, minlength=4)
    halves = {c + 3: ((c ^ 1) + 3, bool(size[c] < size[c ^ 1]), c // 2) for c in range(4)}
    nodes = [3, 5, 6]
    summed = BO._smaller(nodes, halves)
    assert all(halves[n][1] for n in summed)
    found = BO._both(every[:, [n - 3 for n in summed]], summed, nodes, halves, above)
    np.testing.assert_allclose(found, every[:, [n - 3 for n in nodes]], atol=1e-12)


def test_joint_bins_give_the_sums_of_each_feature():
    rng = np.random.default_rng(1)
    x, place = rng.integers(0, 32, (7, 4000)).astype(np.uint8), rng.integers(0, 2, 4000)
    values = (BO.rounded(BO.Fit("log"), rng.standard_normal(4000), 1.0), None)
    want = BO._binned_sums(place, x, values, 2, 32)
    for group in (2, 3):
        assert (BO._joint_sums(place, BO._codes(x, group, 32), group, 7, values, 2, 32) == want).all()
