"""Augmentation audit: sums against plain numpy, copies out of the held fold, scores from the sums."""

import numpy as np
import pytest

from barsight.catalog.models_q import parts
from barsight.operators import linear as LN
from barsight.operators.sampling import kfold
from barsight.plans import audit as AU, sharpe as SP

SEEDS = (0, 3)


@pytest.fixture(scope="module")
def sides(market):
    train, test = parts(market)
    return tuple({k: v.cache() for k, v in side.items()} for side in (train, test))


@pytest.fixture(scope="module")
def found(sides):
    return AU.audit_moments(*sides, SEEDS, 2, 4)


def test_sums_are_those_of_the_rows(sides, found):
    """Every group's moments, made again from the collected rows; copies go with their source's fold."""
    train, test = sides
    part, plan = AU.copied(train, 4)
    main, copies, proxy = (AU.labelled(*x).toPandas() for x in ((train,), (part,), (test, True)))
    source = plan.toPandas().set_index("augmented_session")["session"]
    assert len(copies) == 4 * len(main) and len(found) == 2 * 2 * len(SEEDS) + 1

    def check(rows, group):
        x = rows[list(SP.SHARPE_COLUMNS)].to_numpy(float) - found[group].centre
        v = np.column_stack([np.ones(len(x)), x, rows.R.to_numpy(float)])
        np.testing.assert_allclose(found[group].plain, v.T @ v, rtol=1e-9, atol=1e-9)
        u = v[:, :-1] * v[:, -1:]
        np.testing.assert_allclose(found[group].squared, u.T @ u, rtol=1e-9, atol=1e-9)

    check(proxy, AU.PROXY_GROUP)
    for i, seed in enumerate(SEEDS):
        fold = kfold(AU.labelled(train), 2, seed).toPandas().set_index("session")["fold"]
        for j in (0, 1):
            check(main[main.session.map(fold).to_numpy() == j], 2 * (2 * i + j))
            check(copies[copies.session.map(source).map(fold).to_numpy() == j], 2 * (2 * i + j) + 1)
    same = copies.assign(source=copies.session.map(source)).merge(main, left_on="source", right_on="session")
    np.testing.assert_allclose(same.R_x, same.R_y, atol=1e-9)


def test_scores_follow_from_the_sums(found):
    grid = AU.grid_points(found, SEEDS, 2, (0.5, 2.0), (0.0,), (0.0, 1.0))
    assert len(grid) == len(SEEDS) * 3 * 4
    for seed, kind, alpha, l1, anchor, mean, std, scores in grid:
        first = 4 * SEEDS.index(seed)
        for j in (0, 1):
            other = first + 2 * (1 - j)
            rows = {"none": [], "proxy": [AU.PROXY_GROUP], "copies": [other + 1]}[kind]
            m = sum((found[g] for g in rows), found[other])
            want = SP.model_sharpe(found[first + 2 * j], LN.fit_sharpe_linear(m, SP.SHARPE_COLUMNS, alpha, l1, anchor))
            # six sessions hardly settle thirty columns, so sums that differ in their last digits may show
            if anchor:
                np.testing.assert_allclose(scores[j], want, rtol=0.02, atol=0.02)
        np.testing.assert_allclose([mean, std], [np.mean(scores), np.std(scores)])
    of = {kind: np.mean([r[5] for r in grid if r[1] == kind and r[4]]) for kind in AU.KINDS}
    assert len(set(of.values())) == 3


def test_best_points_and_deltas(spark):
    rows = [
        (0, "none", 0.5, 0.0, 0.0, 1.0, 0.2, [1.0]), (0, "none", 1.0, 0.0, 0.0, 1.0, 0.1, [1.0]),
        (0, "proxy", 0.5, 0.0, 0.0, 0.5, 0.1, [0.5]), (0, "proxy", 1.0, 0.0, 0.0, 0.5, 0.1, [0.5]),
        (0, "copies", 0.5, 0.0, 0.0, 1.5, 0.1, [1.5]), (1, "none", 0.5, 0.0, 0.0, 2.0, 0.1, [2.0]),
        (1, "proxy", 0.5, 0.0, 0.0, 2.0, 0.1, [2.0]),
    ]
    grid = spark.createDataFrame(rows, "seed int, augment string, ridge_alpha double, l1_ratio double, anchor double, mean_sharpe double, std_sharpe double, fold_sharpes array<double>")
    best = AU.best_points(grid)
    got = {(r.seed, r.augment): r for r in best.collect()}
    assert got[0, "none"].ridge_alpha == 1.0 and got[0, "proxy"].ridge_alpha == 0.5
    deltas = {(r.seed, r.augment): (r.delta, r.verdict) for r in AU.augmentation_deltas(best).collect()}
    assert deltas == {
        (0, "proxy"): (-0.5, "lower with augmentation"), (0, "copies"): (0.5, "higher with augmentation"),
        (1, "proxy"): (0.0, "equal"),
    }
    assert AU.augmentation_deltas(AU.best_points(grid.where("seed > 5"))).count() == 0
