"""Registered queries: models, regimes, trees, topics, augmentation (groups E4, G3, H5, I3, J, L1-L4, M)."""

import numpy as np
from pyspark.sql import functions as F

from barsight.catalog.base import query, shaped
from barsight.catalog.features import BASE9, PATH_SQL  # noqa: F401
from barsight.functions import scalars as S
from barsight.operators import augment as A, bars as B, emissions as M, hmm as H, labels as L, linear as LN, regimes as RG, rich as R, sampling as G, sizing as Z, topics as TP, trees as TR, validation as V
from barsight.plans import audit as AU, predictors as PP, sharpe as SP
from barsight.session import cut_lineage
from barsight.sources.market import split_of

PLAIN = ["cum_ret", "vol", "range_hl", "max_high", "min_low", "mean_bar_ret"]


def parts(m, texts=False):
    """Train and test inputs; bars and events are cut once and read by every later step.

    Headlines carry their text only if a model reads it, as counts don't need the documents. Of events
    and headlines only those of the seen bars belong to the inputs.
    """
    bars = cut_lineage(m.bars()).withColumn("split", split_of("session"))
    seen = F.col("bar_ix") <= 49
    events = cut_lineage(m.events().where(seen)).withColumn("split", split_of("session"))
    heads = cut_lineage(m.headlines().where(seen)).withColumn("split", split_of("session")) if texts else events.select("session", "bar_ix", "split")
    return SP.parts_of(bars, heads, events)


def labelled_baseline(m):
    bars = cut_lineage(m.bars())
    seen, unseen = bars.where("bar_ix <= 49"), bars.where("bar_ix >= 50")
    f = B.baseline_features(seen).join(L.realized_returns(seen, unseen).select("session", "R"), "session")
    return cut_lineage(f.where("R is not null"))


def sequences_of(m):
    emissions = cut_lineage(M.emission_table(m.bars()))
    return emissions, cut_lineage(M.sequences(emissions))


@query("h05_training_table", shaped("session:i cum_ret vol R mode:s", """
SELECT session, cum_ret, vol, R, 'train_only' AS mode FROM base9 JOIN train_labels USING (session)
UNION ALL SELECT session, cum_ret, vol, R, 'augmented' FROM base9 JOIN train_labels USING (session)
UNION ALL SELECT session, cum_ret, vol, R, 'augmented' FROM half JOIN px USING (session) WHERE session % 10 > 5
UNION ALL SELECT session, cum_ret, vol, R, 'within_session' FROM half JOIN px USING (session) WHERE session % 10 <= 5""", "base9", "train_labels",
    half="SELECT session, max_by(close, bar_ix) / min_by(open, bar_ix) - 1 AS cum_ret, stddev_pop(ret) AS vol FROM rets WHERE bar_ix <= 24 GROUP BY 1",
    px="SELECT session, max(CASE WHEN bar_ix = 49 THEN close END) / max(CASE WHEN bar_ix = 24 THEN close END) - 1 AS R FROM seen GROUP BY 1"))
def training_table(m):
    train, test = parts(m)
    out = []
    for name, options in (("train_only", (False, False)), ("augmented", (False, True)), ("within_session", (True, False))):
        _, fit = L.training_table(train, test, *options)
        out.append(fit.select("session", "cum_ret", "vol", "R").withColumn("mode", F.lit(name)))
    return L.union_all(out)


STD = "SELECT session, " + ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}" for c in PLAIN) + " FROM base9 JOIN labels_all USING (session) WHERE R IS NOT NULL"


@query("j01_standardise", shaped("session:i " + " ".join(PLAIN), STD, "base9", "labels_all"))
def standardise(m):
    x = labelled_baseline(m)
    model = LN.fit_ridge(LN.total(LN.moments(x, PLAIN)), PLAIN)
    return x.select("session", *[model.standardised(c).alias(c) for c in PLAIN])


# one feature makes the ridge solution a closed form, so SQL can state it
ONE = """SELECT session, b * (cum_ret - mx) / sx + my AS mu FROM base9, (SELECT avg(cum_ret) AS mx, stddev_pop(cum_ret) AS sx, avg(R) AS my,
  count(*) * covar_pop(cum_ret, R) / stddev_pop(cum_ret) / (count(*) + 1.0) AS b FROM base9 JOIN labels_all USING (session) WHERE R IS NOT NULL)"""


@query("j02_ridge_one_feature", shaped("session:i mu", ONE, "base9", "labels_all"))
def ridge_one(m):
    x = labelled_baseline(m)
    model = LN.fit_ridge(LN.total(LN.moments(x, ["cum_ret"])), ["cum_ret"], 1.0)
    return B.baseline_features(m.seen()).select("session", model.score().alias("mu"))


@query("j02_ridge")
def ridge(m):
    x = labelled_baseline(m)
    model = LN.fit_ridge(LN.total(LN.moments(x, B.BASELINE_COLUMNS)), B.BASELINE_COLUMNS, 1.0)
    return x.select("session", "R", model.score().alias("mu"))


@query("j03_cross_validated_mean")
def cv_mean(m):
    x = labelled_baseline(m)
    x = cut_lineage(x.join(G.kfold(x, 5), "session"))
    folds = LN.moments(x, PLAIN, "R", "fold")
    a, b = LN.fit_mean(folds, PLAIN), LN.fit_mean(folds, PLAIN, "elastic_net")
    return x.select("session", "R", a.score().alias("ridge"), b.score().alias("elastic_net"))


@query("j04_sharpe_linear")
def sharpe_linear(m):
    x = labelled_baseline(m)
    model = LN.fit_sharpe_linear(LN.total(LN.moments(x, PLAIN)), PLAIN)
    return x.select("session", "R", model.score().alias("w"))


@query("j05_anchored_sharpe")
def anchored(m):
    x = labelled_baseline(m)
    g = LN.total(LN.moments(x, PLAIN))
    a, b = LN.fit_sharpe_linear(g, PLAIN, anchor=5.0), LN.fit_sharpe_linear(g, PLAIN, 0.1, 0.5, anchor=5.0)
    return x.select("session", "R", a.score().alias("w"), b.score().alias("w_elastic"))


@query("j07_full_train_fit")
def full_train(m):
    train, test = parts(m)
    pred, sub, _ = SP.fit_full_train(train, test, rows=m.rows("supplier"))
    return pred.select("session", F.lit("train").alias("part"), F.col("w").alias("position")).unionByName(
        sub.select("session", F.lit("test").alias("part"), F.col("target_position").alias("position")))


def _policy(m, policy):
    x = labelled_baseline(m)
    f, _ = LN.policy_positions(x, x, PLAIN, policy, 1.0, m.rows("supplier"))
    return f.select("session", "R", "f")


@query("j08_sign_probability")
def sign_probability(m):
    return _policy(m, "prob_sign")


@query("j09_tuned_sign_probability")
def tuned_probability(m):
    return _policy(m, "prob_sign_sharpe")


# at the default strength every slope is zero and the position is the sign of the median
@query("j10_quantile_median", shaped("session:i R f", "SELECT session, R, (SELECT sign(median(R)) FROM labels_all) AS f FROM labels_all WHERE R IS NOT NULL", "labels_all"))
def quantile_median(m):
    return _policy(m, "quantile_median")


@query("j11_rank_score")
def rank_score(m):
    return _policy(m, "rank_score")


@query("j12_heteroskedastic_heads")
def heteroskedastic(m):
    x = labelled_baseline(m)
    x = cut_lineage(x.join(G.kfold(x, 5), "session"))
    oof, _ = LN.heteroskedastic_oof(x, PLAIN, rows=m.rows("supplier"))
    return S.gaussian_projection(oof)


@query("j13_linear_heads")
def linear_heads(m):
    x = labelled_baseline(m)
    x = cut_lineage(x.join(G.kfold(x, 5), "session"))
    return LN.linear_heads_oof(x, PLAIN, rows=m.rows("supplier"))


# A fixed three-state model: its forward table is exact, so SQL can state the dot products.
FIXED = H.StateModel(
    np.array([0.4, 0.3, 0.3]), np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]),
    np.array([[-0.004], [0.0005], [0.005]]), np.array([[0.0004], [0.0001], [0.0009]]),
)
TABLE = H.forward_table(FIXED, 50)
POST = "SELECT session, exp(a) / (exp(a) + exp(b) + 1) AS p0, exp(b) / (exp(a) + exp(b) + 1) AS p1, 1 / (exp(a) + exp(b) + 1) AS p2 FROM (SELECT session, greatest(least(-cum_ret, 5), -5) AS a, vol / 10 AS b FROM base9)"


def rule_posteriors(m):
    f = B.baseline_features(m.seen())
    a, b = F.exp(S.clamp(-F.col("cum_ret"), -5.0, 5.0)), F.exp(F.col("vol") / 10)
    z = a + b + 1
    return f.select("session", F.array(a / z, b / z, 1 / z).alias("w"))


def _dot(names, values):
    return " + ".join(f"{n} * {float(v)!r}" for n, v in zip(names, values))


@query("j14_regime_forecast", shaped("session:i mu p_up", f"SELECT session, {_dot(['p0', 'p1', 'p2'], TABLE['mean'])} AS mu, {_dot(['p0', 'p1', 'p2'], TABLE['p_up'])} AS p_up FROM ({POST})", "base9"))
def regime_forecast(m):
    return H.forecast(rule_posteriors(m), [TABLE]).select("session", "mu", "p_up")


SECOND = H.forward_table(H.StateModel(
    np.array([0.5, 0.5]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[-0.002], [0.003]]), np.array([[0.0009], [0.0004]])), 50)


MIXED = ["0.6 * p0", "0.6 * p1", "0.6 * p2", "0.4 * p0", "0.4 * (p1 + p2)"]


def _mixed(key):
    return _dot(MIXED, [*TABLE[key], *SECOND[key]])


@query("j19_mixture_forecast", shaped("session:i mu p_up", f"SELECT session, {_mixed('mean')} AS mu, {_mixed('p_up')} AS p_up FROM ({POST})", "base9"))
def mixture(m):
    w = F.col("w")
    states = F.array(w[0] * 0.6, w[1] * 0.6, w[2] * 0.6, w[0] * 0.4, (w[1] + w[2]) * 0.4)
    return H.forecast(rule_posteriors(m).select("session", states.alias("w")), [TABLE, SECOND]).select("session", "mu", "p_up")


@query("j15_pooled_states")
def pooled(m):
    _, seqs = sequences_of(m)
    model = H.fit_models(seqs, [H.Job(3)])[0]
    rows = [(k, float(model.start[k]), [float(x) for x in model.trans[k]], float(model.means[k, 0]), model.log_likelihood, float(model.aic()), float(model.bic())) for k in range(model.k)]
    return m.spark.createDataFrame(rows, "state int, start double, trans array<double>, mean_return double, log_likelihood double, aic double, bic double").withColumn("trans", F.array_join(F.transform("trans", lambda x: F.format_number(x, 6)), ";"))


@query("j16_posterior_features")
def posterior_features(m):
    _, seqs = sequences_of(m)
    model = H.fit_models(seqs, [H.Job(3)])[0]
    return H.posterior_features(seqs, model, 50)


@query("j17_state_selection")
def selection(m):
    _, seqs = sequences_of(m)
    labels = L.realized_returns_inner(m.seen(), m.unseen())
    table, _ = RG.select_states(seqs, labels, cut_lineage(G.kfold(labels, 4)), rows=m.rows("supplier"), n_starts=4)
    return table


@query("j18_session_clusters")
def clusters(m):
    emissions, seqs = sequences_of(m)
    _, members, _ = RG.cluster_models(seqs, emissions)
    return members.select("session", "cluster", F.col("resp")[0].alias("resp_0"), F.col("resp")[1].alias("resp_1"))


@query("j20_cluster_one_hot")
def cluster_one_hot(m):
    return SP.cluster_sharpe_linear(*parts(m), n_clusters=8)


@query("j21_boosted_mean")
def boosted(m):
    sub, _ = SP.boosted_positions(*parts(m))
    return sub


@query("j23_tree_heads")
def tree_heads(m):
    x = labelled_baseline(m)
    return TR.TreeHeads(PLAIN, rows=m.rows("supplier")).fit(x).predict(x)


@query("j24_repeated_tree_heads")
def repeated_heads(m):
    x = labelled_baseline(m)
    folds = cut_lineage(G.repeated_kfold(x, 5, (0, 1)))
    oof, _ = TR.cross_validated_heads(x, PLAIN, folds, rows=m.rows("supplier"))
    return oof


@query("j25_feature_importance")
def importance(m):
    x = labelled_baseline(m)
    model = TR.mean_regressor(x, PLAIN)
    return TR.importance_table(m.spark, model, PLAIN)


@query("g03_top_features")
def top_features(m):
    x = labelled_baseline(m)
    model = TR.mean_regressor(x, PLAIN)
    return TR.importance_table(m.spark, model, PLAIN, 3)


@query("j26_shift_check")
def shift(m):
    f = cut_lineage(B.baseline_features(m.seen()))
    train, test = f.where(split_of("session") == "train"), f.where(split_of("session") != "train")
    table, _ = TR.shift_check(train, test, PLAIN, cut_lineage(G.kfold(f, 5)))
    return table


COEF = {c: (i + 1) / 10 for i, c in enumerate(PLAIN)}


@query("j27_linear_attribution", shaped("feature:s mean_abs mean", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(abs({v} * {c})) AS mean_abs, avg({v} * {c}) AS mean FROM st" for c, v in COEF.items()), "base9", "labels_all", st=STD))
def attribution(m):
    x = labelled_baseline(m)
    model = LN.fit_ridge(LN.total(LN.moments(x, PLAIN)), PLAIN)
    model.coef = np.array(list(COEF.values()))
    return LN.attribution(x, model)


@query("j29_oof_regime_forecasts")
def oof_regimes(m):
    emissions, seqs = sequences_of(m)
    folds = cut_lineage(G.kfold(seqs, 5))
    a = RG.oof_forecasts(seqs, folds).withColumn("method", F.lit("m1"))
    b = RG.oof_mixture_forecasts(seqs, emissions, folds)
    return a.unionByName(b.withColumn("method", F.lit("m2")))


@query("i03_topic_features")
def topic_features(m):
    heads = m.headlines().where("bar_ix <= 49")
    return TP.session_topics(heads, split_of("session") == "train")


@query("l01_grid_cross_validation")
def grid_cv(m):
    g = SP.cv_grid(*parts(m), labels=("identity", "r2_sign_100"), anchors=(0.0, 1.0))
    return g.withColumn("fold_val_sharpes", F.array_join(F.transform("fold_val_sharpes", lambda x: F.format_number(x, 6)), ";"))


@query("l02_method_comparison")
def method_comparison(m):
    return SP.compare_methods(*parts(m))


@query("l04_block_monitor")
def monitor(m):
    pred, _, _ = SP.fit_full_train(*parts(m), "ridge", rows=m.rows("supplier"))
    return SP.block_monitor(pred, 0)


# --- augmentation ------------------------------------------------------------------------


def augmented(m):
    bars = cut_lineage(m.bars())
    plan = A.copy_plan(L.shared_sessions(bars.where("bar_ix <= 49"), bars.where("bar_ix >= 50")), 4)
    return bars, plan


PLAN = """SELECT session, copy, ['path_noise', 'path_noise_shape', 'vol_scale', 'time_warp'][copy % 4 + 1] AS transform, 30000 + ix * 4 + copy AS augmented_session
FROM (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM bars)), (SELECT unnest([0, 1, 2, 3]) AS copy)"""


@query("m05_copy_plan", shaped("session:i copy:i transform:s augmented_session:i events:i", f"""
SELECT p.session, copy, transform, augmented_session, coalesce(c, 0) AS events FROM ({PLAN}) p LEFT JOIN (SELECT session, count(*) AS c FROM sent GROUP BY 1) e USING (session)""", "bars", "sent"))
def copy_plan(m):
    _, plan = augmented(m)
    news = A.duplicate_rows(m.events(), plan).groupBy(F.col("session").alias("augmented_session")).agg(F.count(F.lit(1)).alias("events"))
    return plan.join(news, "augmented_session", "left").fillna(0, ["events"])


SCALED = f"""
SELECT p.augmented_session AS session, b.bar_ix, exp(start_log + coalesce(sum(d + (0.75 + 0.6 * u) * (step - d)) OVER (PARTITION BY b.session, ph ORDER BY bar_ix), 0)) AS close
FROM (SELECT *, avg(step) OVER (PARTITION BY session, ph) AS d, first_value(lc - coalesce(step, 0)) OVER (PARTITION BY session, ph ORDER BY bar_ix) AS start_log,
        (('0x' || substr(md5('0|' || session || '|2|' || ph), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
      FROM (SELECT session, bar_ix, ln(greatest(close, 1e-12)) AS lc, CASE WHEN bar_ix <= 49 THEN 'seen' ELSE 'unseen' END AS ph,
              CASE WHEN bar_ix > 0 THEN ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) OVER (PARTITION BY session ORDER BY bar_ix) END AS step FROM bars)) b
JOIN ({PLAN}) p ON p.session = b.session AND p.transform = 'vol_scale'"""


@query("m02_volatility_scaling", shaped("session:i bar_ix:i close", f"SELECT session, bar_ix, coalesce(close, 1e-300) AS close FROM ({SCALED})", "bars"))
def volatility(m):
    bars, plan = augmented(m)
    rows = A.vol_scale(A.log_steps(bars, plan.where("transform = 'vol_scale'")))
    return rows.select(F.col("augmented_session").alias("session"), "bar_ix", F.col("new_close").alias("close"))


@query("m04_rebuilt_bars", shaped("session:i bar_ix:i open high low close", f"""
SELECT session, bar_ix, o AS open, greatest(h, o, c) AS high, l AS low, c AS close FROM (
  SELECT session, bar_ix, greatest(o, l) AS o, h, l, greatest(c, l) AS c FROM (
    SELECT s.session, s.bar_ix, s.close * b.open / b.close AS o, s.close * b.high / b.close AS h, greatest(s.close * b.low / b.close, 1e-12) AS l, s.close AS c
    FROM ({SCALED}) s JOIN ({PLAN}) p ON p.augmented_session = s.session JOIN bars b ON b.session = p.session AND b.bar_ix = s.bar_ix))""", "bars"))
def rebuilt(m):
    bars, plan = augmented(m)
    rows = A.rebuild_bars(A.vol_scale(A.log_steps(bars, plan.where("transform = 'vol_scale'"))))
    return rows.select("session", "bar_ix", "open", "high", "low", "close")


def _shifted_labels(m, name):
    bars, plan = augmented(m)
    out = A.augment_bars(bars, plan.where(F.col("transform") == name))
    new = L.realized_returns(out.where("bar_ix <= 49"), out.where("bar_ix >= 50")).select("session", F.col("R").alias("new_R"))
    return new.join(out.select("session", "source_session").distinct(), "session").join(
        L.realized_returns(bars.where("bar_ix <= 49"), bars.where("bar_ix >= 50")).select(F.col("session").alias("source_session"), "R"), "source_session")


# the label of a copy must equal the label of its source, which SQL can state
def _same_label(name, offset):
    return shaped("source_session:i session:i R new_R", f"SELECT p.session AS source_session, p.augmented_session AS session, R, R AS new_R FROM ({PLAN}) p JOIN labels_all l ON l.session = p.session WHERE transform = '{name}' AND R IS NOT NULL", "labels_all")


@query("m01_path_noise", _same_label("path_noise", 0))
def path_noise(m):
    return _shifted_labels(m, "path_noise")


@query("m03_time_warp", _same_label("time_warp", 3))
def time_warp(m):
    return _shifted_labels(m, "time_warp")


@query("m05_augmented_bars")
def augmented_bars(m):
    bars, plan = augmented(m)
    return A.augment_bars(bars, plan).groupBy("session", "source_session", "transform").agg(
        F.count(F.lit(1)).alias("bars"), F.max("high").alias("high"), F.min("low").alias("low"))


@query("l10_augmentation_audit")
def augmentation_audit(m):
    """Fits without augmentation, with proxy rows and with copies, on the same folds of five seeds."""
    return V.audit_summary(AU.best_points(AU.augmentation_grid(*parts(m), anchors=(0.0, 1.0))))


@query("l10_augmentation_deltas")
def augmentation_deltas(m):
    return AU.augmentation_deltas(AU.best_points(AU.augmentation_grid(*parts(m), anchors=(0.0, 1.0))))


# --- end-to-end predictors ---------------------------------------------------------------


@query("p01_tailored_predictor")
def tailored(m):
    return PP.tailored(*parts(m), rows=m.rows("supplier"))["ranking"]


@query("p02_probabilistic_predictor")
def probabilistic(m):
    return PP.probabilistic(*parts(m, texts=True), rows=m.rows("supplier"))["ranking"]


@query("p03_regime_predictor")
def regime(m):
    return PP.regime(*parts(m), rows=m.rows("supplier"))["ranking"]
