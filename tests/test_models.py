"""Linear models, sizing, state models, augmentation and validation against brute force."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barsight.operators import augment as A, hmm as H, labels as L, linear as LN, regimes as RG, sizing as Z, trees as TR, validation as V
from barsight.operators.sampling import kfold

COLS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.standard_normal((n, 3)) * [1.0, 5.0, 0.1] + [0.0, 100.0, 3.0]
    y = 0.02 * x[:, 0] - 0.004 * (x[:, 1] - 100) + 0.05 * rng.standard_normal(n) + 0.01
    pdf = pd.DataFrame(x, columns=COLS[:3]).assign(flat=2.0, R=y, session=np.arange(n), fold=np.arange(n) % 4)
    return pdf, spark.createDataFrame(pdf).cache()


def design(pdf):
    x = pdf[COLS].to_numpy()
    s = x.std(0)
    return np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(s < 1e-12, 1.0, s)])


def test_ridge_and_fold_moments(table):
    pdf, df = table
    folds = LN.moments(df, COLS, "R", "fold")
    for part, m in [(pdf, LN.total(folds)), (pdf[pdf.fold != 2], LN.without(folds)[2])]:
        xd, y = design(part), part.R.to_numpy()
        p = np.diag([0.0, 3, 3, 3, 3])
        want = np.linalg.pinv(xd.T @ xd + p) @ xd.T @ y
        np.testing.assert_allclose(LN.ridge_beta(m, 3.0), want, atol=1e-8)
    held, rest = folds[1], LN.without(folds)[1]
    beta = LN.ridge_beta(rest, 1.0)
    model = LN.fit_ridge(rest, COLS, 1.0)
    got = df.where("fold = 1").agg(F.avg((F.col("R") - model.score()) ** 2)).first()[0]
    assert LN.squared_error(held, rest, beta) == pytest.approx(got, rel=1e-8)


def test_elastic_net_is_optimal(table):
    pdf, df = table
    m = LN.total(LN.moments(df, COLS))
    beta = LN.elastic_beta(m, 0.01, 0.5)
    xd, y = design(pdf), pdf.R.to_numpy()
    loss = lambda b: np.mean((y - xd @ b) ** 2) / 2 + 0.01 * (0.5 * np.abs(b[1:]).sum() + 0.25 * (b[1:] ** 2).sum())
    rng = np.random.default_rng(0)
    assert all(loss(beta) <= loss(beta + 0.01 * rng.standard_normal(5)) + 1e-12 for _ in range(200))


def test_sharpe_direction_beats_others(table):
    pdf, df = table
    m = LN.total(LN.moments(df, COLS))
    beta = LN.sharpe_beta(m)
    xd, y = design(pdf), pdf.R.to_numpy()
    score = lambda b: (lambda p: p.mean() / p.std() * 16)(xd @ b * y)
    assert LN.beta_sharpe(m, beta) == pytest.approx(score(beta), rel=1e-6)
    rng = np.random.default_rng(0)
    assert all(score(beta) >= score(beta + 0.05 * rng.standard_normal(5)) - 1e-9 for _ in range(300))
    model = LN.fit_sharpe_linear(m, COLS)
    from barsight.plans.sharpe import model_sharpe

    assert model_sharpe(m, model) == pytest.approx(score(beta), rel=1e-6)


def test_anchor_improves_its_objective(table):
    pdf, df = table
    m = LN.total(LN.moments(df, COLS))
    start = LN.ridge_beta(m, 1.0)
    beta = LN.anchored_beta(m, start, 5.0)
    xd, y = design(pdf), pdf.R.to_numpy()
    obj = lambda b: -(lambda p: p.mean() / p.std() * 16)(xd @ b * y) + 5.0 * np.mean((xd @ b - xd @ start) ** 2)
    rng = np.random.default_rng(0)
    assert obj(beta) <= obj(start)
    assert all(obj(beta) <= obj(beta + 0.01 * rng.standard_normal(5)) + 1e-7 for _ in range(200))


def test_logistic(table):
    pdf, df = table
    model = LN.fit_logistic(df, COLS, 2.0)
    xd, y = design(pdf), (pdf.R > 0).to_numpy(float)
    b = np.zeros(5)
    pen = np.array([0.0, 2, 2, 2, 2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xd @ b))
        h = (xd * (p * (1 - p))[:, None]).T @ xd + np.diag(pen) + 1e-12 * np.eye(5)
        b = b - np.linalg.solve(h, xd.T @ (p - y) + pen * b)
    np.testing.assert_allclose([model.intercept, *model.coef], b, atol=1e-4)
    one_sided = df.withColumn("R", F.abs("R") + 1.0)
    assert LN.fit_logistic(one_sided, COLS) is None


def test_quantile_models(table):
    pdf, df = table
    low, mid, high = LN.fit_quantiles(df, COLS[:3], (0.1, 0.5, 0.9), 0.0001, rounds=25)
    assert LN.pinball(df, mid, 0.5) < 0.5 * np.mean(np.abs(pdf.R - pdf.R.median()))
    share = df.agg(F.avg((F.col("R") < high.score()).cast("double"))).first()[0]
    assert abs(share - 0.9) < 0.04
    flat = LN.fit_quantiles(df, COLS, (0.5,), 1.0)[0]
    assert not flat.coef.any() and flat.intercept == pytest.approx(pdf.R.median())


def test_policies(table):
    pdf, df = table
    f, _ = LN.policy_positions(df, df, COLS, "rank_score")
    got = f.toPandas().sort_values("session").f.to_numpy()
    assert got.min() == pytest.approx(2 / 400 - 1) and got.max() == pytest.approx(1.0)
    g, _ = LN.policy_positions(df, df, COLS, "prob_sign_sharpe")
    assert g.where("abs(f) > 1").count() == 0
    with pytest.raises(ValueError):
        LN.policy_positions(df, df, COLS, "other")


def test_heads_cover_every_session_once(table):
    pdf, df = table
    oof, heads = LN.heteroskedastic_oof(df, COLS)
    got = oof.toPandas()
    assert sorted(got.session) == pdf.session.tolist() and (got.sigma2 > 0).all()
    assert np.corrcoef(got.mu, got.R)[0, 1] > 0.3
    three = LN.linear_heads_oof(df.where("session < 200"), COLS[:3], rounds=3).toPandas()
    assert sorted(three.session) == list(range(200)) and (three.u > 0).all()


def numpy_positions(p, c):
    mu, prob, u = p.mu.to_numpy(), np.clip(p.p_up, 0, 1).to_numpy(), p.u.to_numpy()
    lean = 2 * prob - 1
    z = mu * lean / np.maximum(u, max(np.quantile(u, c.tau_quantile), 1e-6))
    v = {"z_tanh": z, "edge_linear": z, "mu_scaled": mu / np.median(np.abs(mu))}.get(c.mode, lean)
    raw = np.tanh(c.lam * v) if c.mode.endswith("tanh") else v
    raw = np.where(np.abs(v) > c.theta, raw, 0.0) if c.theta > 0 else raw
    t = c.scale * (c.baseline + c.alpha * raw)
    t = t if c.allow_short else np.maximum(t, 0)
    q = np.quantile(np.abs(t), c.clip_quantile)
    return np.clip(t, -q, q) if q > 0 else t


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(2)
    n = 1500
    mu = np.round(rng.standard_t(2, n) * 0.02, 4)
    pdf = pd.DataFrame({"session": np.arange(n), "mu": mu, "p_up": 1 / (1 + np.exp(-40 * mu + rng.standard_normal(n))), "u": np.abs(rng.standard_normal(n)) * 0.05 + 1e-3})
    pdf["R"] = 0.3 * mu + 0.03 * rng.standard_normal(n)
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("rows", [None, 5000])
def test_sizing_matches_arrays(preds, rows):
    pdf, df = preds
    configs = [
        Z.Sizing(mode, b, a, lam, th, tq, short)
        for mode in Z.ALL_MODES
        for b, a, lam, th, tq, short in [(1, 0.4, 2.0, 0.0, 0.1, True), (0, 1.5, 8.0, 0.05, 0.5, False), (0, 1.0, 1.0, 0.1, 0.3, True)]
    ]
    grid = [Z.with_variable(i, c) for i, c in enumerate(configs)]
    got = Z.grid_positions(df, grid, ("session",), rows).toPandas()
    for i, c in enumerate(configs):
        part = got[got.config_id == i].sort_values("session").target.to_numpy()
        np.testing.assert_allclose(part, numpy_positions(pdf, c), atol=1e-9, err_msg=str(c))


def test_grid_sizes_and_tuning(preds):
    assert len(Z.sizing_grid()) == 1664
    assert len(Z.sizing_grid(Z.ALL_MODES)) == 1728
    assert len(Z.sizing_grid(Z.ALL_MODES, (0.0, 1.0))) == 3456
    pdf, df = preds
    grid = Z.sizing_grid()[::40]
    tuned = Z.tune_sizing(df, grid).toPandas().set_index("config_id").sharpe
    for g in grid[:8]:
        c = Z.Sizing(**{k: v for k, v in g.items() if k not in ("config_id", "variable", "simplicity")})
        pnl = numpy_positions(pdf, c) * pdf.R
        assert tuned[g["config_id"]] == pytest.approx(pnl.mean() / pnl.std(ddof=0) * 16, abs=1e-8)


def test_ensemble_weights(preds):
    pdf, df = preds
    m = df.select("session", "R", F.col("mu").alias("h1"), F.signum("mu").alias("h2"), F.lit(1.0).alias("h3"))
    w, s = Z.ensemble_weights(m, ["h1", "h2", "h3"], 0.1)
    assert sum(w.values()) == pytest.approx(1.0)
    x = np.column_stack([pdf.mu, np.sign(pdf.mu), np.ones(len(pdf))])
    score = lambda v: (lambda p: p.mean() / p.std() * 16)(x @ v * pdf.R.to_numpy())
    assert s == pytest.approx(score(np.array(list(w.values()))), rel=1e-8)
    assert s >= max(score(np.array(v) / 10) for v in itertools.product(range(11), repeat=3) if sum(v) == 10) - 1e-9


MODEL = H.StateModel(
    np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[0.01, 0.0], [-0.02, 1.0]]),
    np.array([[0.0004, 1.0], [0.0009, 0.5]]),
)


def test_forward_backward_by_enumeration():
    x = np.random.default_rng(1).standard_normal((1, 4, 2)) * [0.03, 1.0]
    dens = np.exp(H.log_density(x, MODEL))[0]
    joint = {}
    for s in itertools.product(range(2), repeat=4):
        p = MODEL.start[s[0]] * dens[0, s[0]]
        for t in range(1, 4):
            p *= MODEL.trans[s[t - 1], s[t]] * dens[t, s[t]]
        joint[s] = p
    total = sum(joint.values())
    post, pairs, ll = H.forward_backward(x, MODEL)
    assert ll[0] == pytest.approx(np.log(total))
    for t in range(4):
        assert post[0, t, 1] == pytest.approx(sum(p for s, p in joint.items() if s[t] == 1) / total)
    assert pairs[0, 0, 1] == pytest.approx(sum(p * sum(s[t] == 0 and s[t + 1] == 1 for t in range(3)) for s, p in joint.items()) / total)


@pytest.mark.parametrize("kind", ["diag", "full", "tied", "spherical"])
def test_fit_recovers_states(spark, kind):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        s, seq = rng.integers(2), []
        for _ in range(30):
            seq.append((rng.standard_normal(2) * 0.3 + [[-1.0, 0.5], [1.0, -0.5]][s]).tolist())
            s = s if rng.random() < 0.9 else 1 - s
        rows.append((i, seq))
    seqs = spark.createDataFrame(rows, "session long, seq array<array<double>>")
    m = H.fit_models(seqs, [H.Job(2, kind)], n_iter=8, n_starts=2, columns=["x", "y"])[0]
    np.testing.assert_allclose(m.means[:, 0], [-1, 1], atol=0.15)
    assert abs(m.trans[0, 0] - 0.9) < 0.05
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history[1:], m.history[2:]))
    assert m.bic() > m.aic() > 0
    f = H.posterior_features(seqs, m, 15).toPandas()
    assert len(f.columns) == 1 + 3 * 2 + 2
    np.testing.assert_allclose(f.hmm_pfinal_0 + f.hmm_pfinal_1, 1.0)
    resp = H.responsibilities(H.posteriors(seqs, [m, m])).toPandas()
    np.testing.assert_allclose([sum(r) for r in resp.resp], 1.0)


def test_fit_takes_few_jobs_and_equals_a_job_for_each_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(i % 2, 0.5, (12 + i % 2, 2)).tolist()) for i in range(40)]
    seqs = spark.createDataFrame(rows, "session long, tag int, seq array<array<double>>")
    jobs = [H.Job(2), H.Job(2, "full", skip=1), H.Job(3, only=2)]
    fit = lambda: H.fit_models(seqs, jobs, n_iter=25, tol=0.0, n_starts=2, columns=["x", "y"])
    spark.sparkContext.setJobGroup("few", "passes of a fit")
    dealt = fit()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 15
    monkeypatch.setattr(H, "PARTITION", 0)
    for a, b in zip(dealt, fit()):
        np.testing.assert_allclose(a.means, b.means, rtol=1e-6)
        np.testing.assert_allclose(a.history[:10], b.history[:10], rtol=1e-9)
    with pytest.raises(ValueError):
        H.fit_models(seqs, [H.Job(2, only=7)], columns=["x", "y"])


@pytest.mark.parametrize("kind", ["diag", "spherical"])
def test_stacked_sums_are_those_of_each_sequence(kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((23, 2, 9)) + 50.0
    models = []
    for s in range(3):
        m = H._first_model(H.Job(3, kind, seed=s), np.full(2, 50.0), np.ones(2), s)
        m.trans = rng.dirichlet(np.ones(3), 3)
        models.append(m)
    got = H._stack_statistics(*H._design(x), models)
    turned = x.transpose(2, 0, 1)
    for m, row in zip(models, got):
        post, pairs, ll = H.forward_backward(turned, m)
        first = np.einsum("btk,btf->kf", post, turned)
        second = np.einsum("btk,btf->kf", post, turned**2)
        want = [post[:, 0].sum(0), pairs.sum(0).ravel(), post.sum((0, 1)), first.ravel(), second.ravel(), [ll.sum()]]
        np.testing.assert_allclose(row, np.concatenate(want), rtol=1e-9, atol=1e-12)


def test_sizes_share_each_pass_over_a_large_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.normal(i % 2, 0.5, (12, 2)).tolist()) for i in range(30)]
    seqs = spark.createDataFrame(rows, "session long, tag int, seq array<array<double>>")
    monkeypatch.setattr(H, "PARTITION", 0)
    spark.sparkContext.setJobGroup("sizes", "passes of a fit")
    H.fit_models(seqs, [H.Job(k) for k in (1, 2, 3, 4)], n_iter=10, tol=-1e9, n_starts=1, columns=["x", "y"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # ten passes and the last likelihood, not ten for each size
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sizes")) < 20


def test_posteriors_work_on_bounded_blocks():
    n = 2 * H.BLOCK + 5
    seq = pa.array([[[float(i), 0.5]] * (2 + i % 2) for i in range(n)])
    found = list(H._stacks(seq, 2))
    assert max(len(rows) for rows, _ in found) <= H.BLOCK and all(x.shape == (len(rows), 2, 2) for rows, x in found)
    assert sorted(np.concatenate([rows for rows, _ in found])) == list(range(n))
    assert all((x[:, :, 0] == rows[:, None]).all() for rows, x in found)


def test_small_blocks_of_equal_length_are_worked_on_together():
    blocks = [(np.full((t, 2, 3), float(i)), np.full((3, 2), i)) for i, t in enumerate([4, 5, 4, 4, 5])]
    joined = list(H._joined(blocks))
    assert sorted(x.shape for x, _ in joined) == [(4, 2, 9), (5, 2, 6)]
    assert all((x[0, 0] == tags[:, 0]).all() for x, tags in joined)


def test_fold_and_pooled_models_come_from_one_fit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal((60, 10)) * 0.1 + i % 2).tolist()) for i in range(24)]
    seqs = spark.createDataFrame(rows, "session long, seq array<array<double>>")
    # two sessions have no label and no fold, but belong to the pooled model
    folds = spark.createDataFrame([(i, i % 3) for i in range(22)], "session long, fold int")
    fits, fit = [], H.fit_models
    monkeypatch.setattr(RG, "fit_models", lambda *a, **k: fits.append(a) or fit(*a, **k))
    options = {"n_iter": 4, "n_starts": 1}
    preds, (pooled,) = RG.candidate_fits(seqs, folds, [(2, "diag")], **options)
    assert len(fits) == 1
    alone = fit(seqs, [H.Job(2)], **options)[0]
    np.testing.assert_allclose(pooled.means, alone.means, rtol=1e-9)
    assert pooled.n_obs == 24 * 60
    own = seqs.join(folds.where("fold <> 1"), "session")
    want = H.forecast_sessions(seqs.join(folds.where("fold = 1"), "session"), fit(own, [H.Job(2)], **options)[0]).toPandas()
    got = preds.where("fold = 1").toPandas()
    np.testing.assert_allclose(got.sort_values("session").mu, want.sort_values("session").mu, rtol=1e-9)
    assert sorted(preds.toPandas().session) == list(range(22))


def test_forward_table_against_simulation(spark):
    rng = np.random.default_rng(0)
    table = H.forward_table(MODEL, 20)
    n = 40_000
    s, total = np.zeros(n, int), np.zeros(n)
    for _ in range(20):
        s = (rng.random(n) > MODEL.trans[s, 0]).astype(int)
        total += MODEL.means[s, 0] + rng.standard_normal(n) * np.sqrt(MODEL.cov[s, 0])
    assert table["mean"][0] == pytest.approx(np.expm1(total).mean(), abs=0.004)
    assert table["p_up"][0] == pytest.approx((total > 0).mean(), abs=0.01)
    w = spark.createDataFrame([(1, [1.0, 0.0])], "session long, w array<double>")
    got = H.forecast(w, [table]).first()
    for name, q in (("q_lower", 0.1), ("q_median", 0.5), ("q_upper", 0.9)):
        assert got[name] == pytest.approx(np.expm1(np.quantile(total, q)), abs=0.006)


def test_copies_keep_label_and_bar_order(market):
    bars = market.bars().cache()
    plan = A.copy_plan(bars, 4)
    out = A.augment_bars(bars, plan).toPandas()
    assert len(out) == 4 * bars.count()
    old = bars.toPandas().set_index(["session", "bar_ix"]).close
    for ix in (49, 99):
        end = out[out.bar_ix == ix]
        np.testing.assert_allclose(end.close, old.loc[list(zip(end.source_session, end.bar_ix))], rtol=1e-9)
    assert (out.high >= out[["open", "close", "low"]].max(axis=1)).all()
    assert (out.low <= out[["open", "close"]].min(axis=1)).all()
    moved = out.merge(old.rename("old").reset_index(), left_on=["source_session", "bar_ix"], right_on=["session", "bar_ix"])
    assert (moved.groupby("transform").apply(lambda g: (g.close - g.old).abs().mean(), include_groups=False) > 1e-4).all()


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(800)
    pdf = pd.DataFrame({"k": "h", "id": np.arange(800), "x": x, "y": 0.5 * x + rng.standard_normal(800)})
    df = spark.createDataFrame(pdf)
    a = V.bootstrap_interval(df.repartition(1), "k", "x", "y", "id").first()
    b = V.bootstrap_interval(df.repartition(7), "k", "x", "y", "id").first()
    assert a.ci_lo == pytest.approx(b.ci_lo) and a.ci_hi == pytest.approx(b.ci_hi)
    assert a.ci_lo < np.corrcoef(pdf.x, pdf.y)[0, 1] < a.ci_hi and a.replicates == 200


def test_tree_heads(table):
    pdf, df = table
    heads = TR.TreeHeads(COLS[:3], rounds=5, rate=0.3, depth=3, trees=5).fit(df)
    p = heads.predict(df).toPandas()
    assert sorted(p.session) == pdf.session.tolist()
    assert (p.q_lower <= p.q_upper).all() and (p.u >= 1e-6).all() and p.p_up.between(0, 1).all()


def test_folds(spark, table):
    _, df = table
    f = kfold(df, 5).toPandas()
    assert f.fold.value_counts().to_dict() == {i: 80 for i in range(5)}
