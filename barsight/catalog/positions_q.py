"""Registered queries: Sharpe, sizing, ensembles, validation (groups K, L, D13-D15, F8, G4)."""

from pyspark.sql import functions as F

from barsight.catalog.base import query, shaped
from barsight.catalog.tables_q import MODAL, RANK_NAMES, rule_predictions  # noqa: F401
from barsight.catalog.texts import COMPACT, FWD
from barsight.functions.stats import sharpe_of
from barsight.operators import bars as B, events as E, labels as L, news as N, reports as P, sampling as G, sizing as Z, validation as V
from barsight.operators.linear import direction
from barsight.session import cut_lineage
from barsight.sources.market import split_of

SH = "CASE WHEN stddev_pop({0}) > 0 THEN avg({0}) / stddev_pop({0}) * 16 ELSE 0 END"


def sh(x):
    return SH.format(x)


def labelled_predictions(m):
    p = rule_predictions(m)
    return p.join(L.realized_returns(m.seen(), m.unseen()).select("session", "R"), "session")


# Positions of plain signals, long form, on every labelled session.
SIGNALS = ("momentum", "reversal", "flat_long", "range", "quiet")
SIGNAL_SQL = """
SELECT session, R, unnest(['momentum', 'reversal', 'flat_long', 'range', 'quiet']) AS method,
  unnest([cum_ret, -sign(cum_ret), 1.0, range_hl, 1 / (1 + vol)]) AS f FROM base9 JOIN labels_all USING (session) WHERE R IS NOT NULL"""


def signals(m):
    f = B.baseline_features(m.seen()).join(L.realized_returns(m.seen(), m.unseen()).select("session", "R"), "session")
    wide = f.where("R is not null").select(
        "session", "R", F.col("cum_ret").alias("momentum"), (-F.signum("cum_ret")).alias("reversal"),
        F.lit(1.0).alias("flat_long"), F.col("range_hl").alias("range"), (1 / (1 + F.col("vol"))).alias("quiet"))
    return P.melt(wide, SIGNALS, ("session", "R"), "method", "f")


SIG = dict(sig=SIGNAL_SQL)
FOLDS = "SELECT seed, session, ntile(5) OVER (PARTITION BY seed ORDER BY md5(seed || '|' || session), session) - 1 AS fold FROM (SELECT DISTINCT session FROM bars), (SELECT unnest([0, 1, 2]) AS seed)"
SCORES = f"SELECT method, seed, fold, {sh('f * R')} AS sharpe FROM sig JOIN folds USING (session) GROUP BY 1, 2, 3"
CV = dict(sig=SIGNAL_SQL, folds=FOLDS, scores=SCORES)


def scores(m):
    folds = G.repeated_kfold(m.bars(), 5, (0, 1, 2))
    return V.fold_sharpes(signals(m).withColumnRenamed("f", "value").join(folds, "session"), ["method", "seed", "fold"])


@query("k01_sharpe", shaped("method:s sharpe n:i", f"SELECT method, {sh('f * R')} AS sharpe, count(*) AS n FROM sig GROUP BY 1", "base9", "labels_all", **SIG))
def sharpe(m):
    return signals(m).groupBy("method").agg(sharpe_of(F.col("f") * F.col("R")).alias("sharpe"), F.count(F.lit(1)).alias("n"))


@query("k02_fold_sharpe", shaped("method:s seed:i fold:i sharpe", "SELECT * FROM scores", "base9", "labels_all", **CV))
def fold_sharpe(m):
    return scores(m)


@query("j06_momentum_signal", shaped("session:i target_position mult train_sharpe", f"""
SELECT session, mult * cum_ret AS target_position, mult, train_sharpe FROM base9,
 (SELECT CASE WHEN avg(cum_ret * R) < 0 THEN -1.0 ELSE 1.0 END AS mult,
    CASE WHEN avg(cum_ret * R) < 0 THEN -1 ELSE 1 END * {sh('cum_ret * R')} AS train_sharpe FROM base9 JOIN labels_all USING (session) WHERE session % 10 <= 5)""", "base9", "labels_all"))
def momentum(m):
    f = B.baseline_features(m.seen()).select("session", "cum_ret")
    train = f.where(split_of("session") == "train").join(L.realized_returns(m.seen(), m.unseen()).select("session", "R"), "session")
    pnl = F.col("cum_ret") * F.col("R")
    stats = train.agg(F.when(F.avg(pnl) < 0, -1.0).otherwise(1.0).alias("mult"), sharpe_of(pnl).alias("s"))
    return f.crossJoin(F.broadcast(stats)).select(
        "session", (F.col("mult") * F.col("cum_ret")).alias("target_position"), "mult", (F.col("mult") * F.col("s")).alias("train_sharpe"))


# --- sizing ----------------------------------------------------------------------------

VIEW = "SELECT p.*, R, ntile(5) OVER (ORDER BY md5('0|' || session), session) - 1 AS fold FROM preds p JOIN labels_all USING (session) WHERE R IS NOT NULL"


def grid_sql(modes, baselines):
    lams, alphas = list(Z.LAMBDAS), list(Z.ALPHAS)
    return f"""SELECT mode, baseline, alpha, lam, theta, tau_quantile, short FROM (SELECT unnest({list(modes)}) AS mode), (SELECT unnest({list(baselines)}) AS baseline),
  (SELECT unnest({alphas}) AS alpha), (SELECT unnest({lams}) AS lam), (SELECT unnest({list(Z.THETAS)}) AS theta),
  (SELECT unnest({list(Z.TAU_QUANTILES)}) AS tau_quantile), (SELECT unnest([true, false]) AS short)
  WHERE (lam = 1.0 OR mode IN ('z_tanh', 'p_tanh')) AND (theta = 0.0 OR mode = 'z_tanh')"""


TAUS = "SELECT tau_quantile, greatest(quantile_cont(u, tau_quantile), 1e-6) AS tau FROM pv, (SELECT unnest([%s]) AS tau_quantile) GROUP BY 1" % ", ".join(map(str, Z.TAU_QUANTILES))
# DuckDB wants a constant quantile, so the floors are listed one by one
TAUS = "\nUNION ALL ".join(f"SELECT {q} AS tau_quantile, greatest(quantile_cont(u, {q}), 1e-6) AS tau FROM pv" for q in Z.TAU_QUANTILES)
TARGET = """
SELECT *, CASE WHEN short THEN t ELSE greatest(t, 0) END AS target FROM (
 SELECT *, baseline + alpha * CASE WHEN theta <= 0 OR abs(v) > theta THEN CASE WHEN mode LIKE '%tanh' THEN tanh(lam * v) ELSE v END ELSE 0 END AS t FROM (
  SELECT g.*, pv.session, pv.R, pv.fold, CASE WHEN mode IN ('p_linear', 'p_tanh') THEN 2 * p_up - 1 WHEN mode = 'mu_scaled' THEN mu / med
    ELSE mu * (2 * p_up - 1) / greatest(u, tau) END AS v
  FROM pv, grid g JOIN taus USING (tau_quantile), (SELECT median(abs(mu)) AS med FROM pv)))"""
SIZED = """SELECT s.*, CASE WHEN clip > 0 THEN least(greatest(target, -clip), clip) ELSE target END AS w
FROM tgt s JOIN (SELECT mode, baseline, alpha, lam, theta, tau_quantile, short, quantile_cont(abs(target), 0.999) AS clip FROM tgt GROUP BY ALL) c
USING (mode, baseline, alpha, lam, theta, tau_quantile, short)"""
CONFIG = "mode:s baseline alpha lam theta tau_quantile allow_short:i"
CONFIG_SQL = "mode, baseline, alpha, lam, theta, tau_quantile, CASE WHEN short THEN 1 ELSE 0 END AS allow_short"


def sizing_parts(modes, baselines):
    return dict(pv=VIEW, taus=TAUS, grid=grid_sql(modes, baselines), tgt=TARGET, sized=SIZED)


CONFIG_COLS = ["mode", "baseline", "alpha", "lam", "theta", "tau_quantile", "allow_short"]
FIVE = [Z.Sizing(mode=mode, alpha=0.6, lam=3.0, theta=0.05 if mode == "z_tanh" else 0.0) for mode in Z.ALL_MODES]
FIVE_SQL = "\nUNION ALL ".join(
    f"SELECT '{c.mode}' AS mode, {c.baseline} AS baseline, {c.alpha} AS alpha, {c.lam} AS lam, {c.theta} AS theta, {c.tau_quantile} AS tau_quantile, true AS short" for c in FIVE)


@query("k03_sizing_modes", shaped("session:i mode:s target_position", "SELECT session, mode, w AS target_position FROM sized", "preds", "labels_all",
    **{**sizing_parts((), ()), "grid": FIVE_SQL}))
def sizing_modes(m):
    p = rule_predictions(m)
    grid = [Z.with_variable(i, c) for i, c in enumerate(FIVE)]
    sized = Z.grid_positions(p, grid, ("session",), m.rows("supplier"))
    names = F.create_map(*[x for i, c in enumerate(FIVE) for x in (F.lit(i), F.lit(c.mode))])
    return sized.select("session", names[F.col("config_id")].alias("mode"), F.col("target").alias("target_position"))


@query("k04_sizing_grid", shaped(CONFIG + " sharpe", f"SELECT {CONFIG_SQL}, {sh('w * R')} AS sharpe FROM sized GROUP BY mode, baseline, alpha, lam, theta, tau_quantile, short",
    "preds", "labels_all", **sizing_parts(Z.BASIC_MODES, (1.0,))))
def sizing_grid(m):
    p = cut_lineage(labelled_predictions(m))
    return Z.tune_sizing(p, Z.sizing_grid(), m.rows("supplier")).select(*CONFIG_COLS, "sharpe")


TSTAT = "CASE WHEN count(*) < 2 THEN 0 WHEN stddev_samp(d) > 1e-12 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) ELSE sign(round(avg(d), 13)) * 1e6 END"


@query("k05_sizing_grid_by_fold", shaped(CONFIG + " sharpe t_vs_flat", f"""
SELECT {CONFIG_SQL}, sharpe, t AS t_vs_flat FROM (
  SELECT mode, baseline, alpha, lam, theta, tau_quantile, short, {TSTAT} AS t FROM (
    SELECT s.*, s.fs - f.fs AS d FROM (SELECT mode, baseline, alpha, lam, theta, tau_quantile, short, fold, {sh('w * R')} AS fs FROM sized GROUP BY ALL) s
    JOIN (SELECT fold, {sh('R')} AS fs FROM pv GROUP BY 1) f USING (fold)) GROUP BY mode, baseline, alpha, lam, theta, tau_quantile, short)
JOIN (SELECT mode, baseline, alpha, lam, theta, tau_quantile, short, {sh('w * R')} AS sharpe FROM sized GROUP BY ALL) USING (mode, baseline, alpha, lam, theta, tau_quantile, short)""",
    "preds", "labels_all", **sizing_parts(Z.ALL_MODES, (0.0, 1.0))))
def sizing_grid_folds(m):
    p = labelled_predictions(m).where("R is not null")
    p = cut_lineage(p.join(G.kfold(p, 5, 0), "session"))
    grid = Z.sizing_grid(Z.ALL_MODES, (0.0, 1.0))
    return Z.tune_sizing_by_fold(p, grid, m.rows("supplier")).select(*CONFIG_COLS, "sharpe", "t_vs_flat")


@query("d15_config_predictions", shaped(CONFIG + " rows:i target_sum", f"SELECT {CONFIG_SQL}, count(*) AS rows, sum(target) AS target_sum FROM tgt GROUP BY mode, baseline, alpha, lam, theta, tau_quantile, short",
    "preds", "labels_all", **{k: v for k, v in sizing_parts(Z.BASIC_MODES, (1.0,)).items() if k != "sized"}))
def config_predictions(m):
    p = cut_lineage(rule_predictions(m))
    grid = [{**g, "clip_quantile": 1.0} for g in Z.sizing_grid()]
    sums = Z.grid_positions(p, grid, ("session",), m.rows("supplier")).groupBy("config_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("target_sum"))
    return Z.grid_frame(m.spark, grid).join(sums, "config_id").select(*CONFIG_COLS, "rows", "target_sum")


BEST_SIZED = """SELECT session, w AS target_position FROM sized WHERE (mode, alpha, lam, theta, tau_quantile, short) = (
  SELECT (mode, alpha, lam, theta, tau_quantile, short) FROM (SELECT mode, alpha, lam, theta, tau_quantile, short, {s} AS s FROM sized GROUP BY ALL)
  ORDER BY round(s, 6) DESC, CASE mode WHEN 'p_linear' THEN 0 WHEN 'p_tanh' THEN 1 WHEN 'z_tanh' THEN 3 ELSE 4 END, alpha, lam, theta, tau_quantile, short DESC LIMIT 1)""".format(s=sh("w * R"))


@query("k06_tuned_sizing", shaped("session:i target_position", BEST_SIZED, "preds", "labels_all", **sizing_parts(Z.BASIC_MODES, (1.0,))))
def tuned(m):
    p = cut_lineage(labelled_predictions(m))
    n = m.rows("supplier")
    best = Z.best_sizing(Z.tune_sizing(p, Z.sizing_grid(), n)).first()
    return Z.size_with_fallback(p, Z.config_from_row(best), n)


RANK7 = """SELECT p.*, mu * (2 * p_up - 1) AS edge, mu * (2 * p_up - 1) / greatest(u, 1e-6) AS z, w AS target_position FROM preds p
JOIN (SELECT session, w FROM sized) USING (session)"""


@query("k07_ranking", shaped(RANK_NAMES, RANK7, "preds", "labels_all", **{**sizing_parts((), ()), "grid": FIVE_SQL.split("\nUNION ALL ")[2]}))
def rank_frame(m):
    p = rule_predictions(m)
    return Z.ranking(p, Z.apply_sizing(p, FIVE[2], m.rows("supplier")))


HEADS = "SELECT session, R, cum_ret AS a, -sign(cum_ret) AS b, range_hl AS c FROM base9 JOIN labels_all USING (session) WHERE R IS NOT NULL"


def heads(m):
    f = B.baseline_features(m.seen())
    tables = {
        "a": f.select("session", F.col("cum_ret").alias("target_position")),
        "b": f.select("session", (-F.signum("cum_ret")).alias("target_position")),
        "c": f.select("session", F.col("range_hl").alias("target_position")),
    }
    return Z.position_matrix(tables)


@query("d13_position_matrix", shaped("session:i a b c", "SELECT session, a, b, c FROM hd", "base9", "labels_all", hd=HEADS))
def matrix(m):
    return heads(m)


WGRID = """SELECT i / {k}.0 AS wa, j / {k}.0 AS wb, 1 - (i + j) / {k}.0 AS wc FROM (SELECT unnest(range(0, {k} + 1)) AS i), (SELECT unnest(range(0, {k} + 1)) AS j) WHERE i + j <= {k}"""
WSHARPE = """SELECT wa, wb, wc, round((wa * ma + wb * mb + wc * mc) / sqrt(wa * wa * aa + wb * wb * bb + wc * wc * cc + 2 * wa * wb * ab + 2 * wa * wc * ac + 2 * wb * wc * bc) * 16, 9) AS s
FROM {g}, (SELECT avg(a * R) AS ma, avg(b * R) AS mb, avg(c * R) AS mc, var_pop(a * R) AS aa, var_pop(b * R) AS bb, var_pop(c * R) AS cc,
  covar_pop(a * R, b * R) AS ab, covar_pop(a * R, c * R) AS ac, covar_pop(b * R, c * R) AS bc FROM hd)"""


@query("k08_ensemble_weights", shaped("head:s weight sharpe", """
SELECT unnest(['a', 'b', 'c']) AS head, unnest([wa, wb, wc]) AS weight, s AS sharpe FROM (
  SELECT * FROM (SELECT *, 0 AS r FROM coarse_best UNION ALL SELECT *, 1 AS r FROM fine_s) ORDER BY s DESC, r, wa, wb LIMIT 1)""",
  "base9", "labels_all", hd=HEADS, coarse=WGRID.format(k=50), coarse_best="SELECT * FROM (" + WSHARPE.format(g="coarse") + ") ORDER BY s DESC, wa, wb LIMIT 1",
  fine="SELECT f.* FROM (" + WGRID.format(k=200) + ") f, coarse_best b WHERE abs(f.wa - b.wa) <= 0.06 + 1e-9 AND abs(f.wb - b.wb) <= 0.06 + 1e-9 AND abs(f.wc - b.wc) <= 0.06 + 1e-9",
  fine_s=WSHARPE.format(g="fine")))
def weights(m):
    table = heads(m).join(L.realized_returns(m.seen(), m.unseen()).select("session", "R"), "session")
    w, s = Z.ensemble_weights(table, ["a", "b", "c"])
    return m.spark.createDataFrame([(k, float(v), s) for k, v in w.items()], "head string, weight double, sharpe double")


@query("k09_locked_blend", shaped("session:i target_position", "SELECT session, 0.1 + 0.56 * a + 0.34 * b + 0 * c AS target_position FROM hd", "base9", "labels_all", hd=HEADS))
def blend(m):
    return Z.combine(heads(m), {"a": 0.56, "b": 0.34, "c": 0.0}, flat_long=0.1)


@query("k11_head_ablations", shaped("session:i mean_only mean_sign mean_quantile", """
SELECT session, mu / med_m AS mean_only, sign(mu) * CASE WHEN p_up > 0.5 THEN 1 ELSE -1 END AS mean_sign, k / med_k AS mean_quantile
FROM (SELECT *, mu / pow(greatest(u, 1e-4), 2) AS k FROM preds), (SELECT median(abs(mu)) AS med_m, median(abs(mu / pow(greatest(u, 1e-4), 2))) AS med_k FROM preds)""", "preds"))
def ablations(m):
    return Z.head_ablations(rule_predictions(m), m.rows("supplier"))


@query("k12_diagnostic_signals", shaped("signal:s sharpe", f"""
SELECT signal, {sh('v * R')} AS sharpe FROM (SELECT R, unnest(['sign_mu', 'p_side', 'edge', 'kelly']) AS signal,
  unnest([sign(mu), CASE WHEN p_up > 0.5 THEN 1.0 ELSE -1.0 END, mu * (2 * p_up - 1), mu / greatest(u * u, 1e-12)]) AS v FROM pv) GROUP BY 1""", "preds", "labels_all", pv=VIEW))
def diagnostics(m):
    return Z.diagnostic_signals(labelled_predictions(m))


@query("d14_submission_score", shaped("sharpe sessions:i", f"SELECT {sh('a * R')} AS sharpe, count(*) AS sessions FROM hd", "base9", "labels_all", hd=HEADS))
def submission_score(m):
    sub = heads(m).select("session", F.col("a").alias("target_position"))
    both = sub.join(L.realized_returns(m.seen(), m.unseen()).where("R is not null").select("session", "R"), "session")
    return both.agg(sharpe_of(F.col("target_position") * F.col("R")).alias("sharpe"), F.count(F.lit(1)).alias("sessions"))


@query("j22_std_matched_blend", shaped("session:i R target_position", """
SELECT session, R, 0.5 * a + 0.5 * CASE WHEN e < 0 THEN -1 ELSE 1 END * c * sa / (sc + 1e-12) AS target_position FROM hd,
  (SELECT stddev_pop(a) AS sa, stddev_pop(c) AS sc, avg(c * R) AS e FROM hd)""", "base9", "labels_all", hd=HEADS))
def std_blend(m):
    table = heads(m).join(L.realized_returns(m.seen(), m.unseen()).where("R is not null").select("session", "R"), "session")
    return Z.blend_std_matched(table, "a", "c", 0.5)


@query("j28_score_stacking", shaped("session:i cum_ret cnn_r_pred", """
SELECT session, cum_ret, coalesce(s, 0) AS cnn_r_pred FROM base9 LEFT JOIN (SELECT session, avg(sentiment_score) AS s FROM ev GROUP BY 1) USING (session)""", "base9", "ev"))
def stacking(m):
    s = m.events().where("bar_ix <= 49").groupBy("session").agg(F.avg("sentiment_score").alias("score"))
    base = B.baseline_features(m.seen()).select("session", "cum_ret").withColumn("cnn_r_pred", F.lit(0.0))
    return L.stack_score(base, s)


# --- validation ------------------------------------------------------------------------


def _horizon_sql(k, src, extra=""):
    f = f"fwd_ret_{k}"
    return f"""SELECT {extra}{k} AS horizon, count(*) AS n, corr(sentiment_score, {f}) AS pearson,
  (sum(confidence * sentiment_score * {f}) / sum(confidence) - sum(confidence * sentiment_score) * sum(confidence * {f}) / pow(sum(confidence), 2))
  / sqrt((sum(confidence * sentiment_score * sentiment_score) / sum(confidence) - pow(sum(confidence * sentiment_score) / sum(confidence), 2))
       * (sum(confidence * {f} * {f}) / sum(confidence) - pow(sum(confidence * {f}) / sum(confidence), 2))) AS pearson_weighted,
  corr(rx, ry) AS spearman,
  avg(CASE WHEN abs({f}) > 1e-12 THEN (sign(sgn) = sign({f}))::INT END) AS sign_hit_buy_sell,
  avg(CASE WHEN abs({f}) > 1e-12 AND abs(sentiment_score) > 1e-12 THEN (sign(sentiment_score) = sign({f}))::INT END) AS sign_hit_score,
  avg({f}) FILTER (sentiment = 'buy') AS mean_ret_buy, avg({f}) FILTER (sentiment = 'sell') AS mean_ret_sell,
  avg({f}) FILTER (sentiment = 'buy') - avg({f}) FILTER (sentiment = 'sell') AS mean_ret_diff,
  corr(sentiment_score, {f}) FILTER (confidence >= 0.9) AS pearson_high_conf, corr(sentiment_score, {f}) FILTER (confidence < 0.9) AS pearson_low_conf
FROM (SELECT *, rank() OVER (ORDER BY sentiment_score) + (count(*) OVER (PARTITION BY sentiment_score) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS ry FROM {src} WHERE {f} IS NOT NULL {{w}})"""


REPORT = "horizon:i n:i pearson pearson_weighted spearman sign_hit_buy_sell sign_hit_score mean_ret_buy mean_ret_sell mean_ret_diff pearson_high_conf pearson_low_conf"


@query("l05_event_validation", shaped(REPORT, "\nUNION ALL ".join(_horizon_sql(k, "fw").replace("{w}", "") for k in E.HORIZONS), "sent", "bars", fw=FWD))
def event_validation(m):
    return V.event_report(cut_lineage(E.align_forward_returns(m.events(), m.bars())))


@query("l06_bootstrap_interval")
def bootstrap(m):
    aligned = E.align_forward_returns(m.events(), m.bars())
    return V.bootstrap_interval(V.long_returns(aligned), "horizon", "sentiment_score", "fwd", "event_id")


FEAT = V.SESSION_SIGNALS
SESSION_SQL = "\nUNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS n, corr({c}, R) AS pearson, corr(rx, ry) AS spearman,
  avg(CASE WHEN abs({c}) > 1e-12 AND abs(R) > 1e-12 THEN (sign({c}) = sign(R))::INT END) AS sign_hit
FROM (SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY R) + (count(*) OVER (PARTITION BY R) - 1) / 2.0 AS ry
  FROM ca JOIN labels_all USING (session) WHERE R IS NOT NULL)""" for c in FEAT)


@query("l07_session_correlations", shaped("feature:s n:i pearson spearman sign_hit", SESSION_SQL, "ev", "labels_all", ca=COMPACT))
def session_correlations(m):
    return V.session_report(N.compact_aggregates(m.events()), L.realized_returns(m.seen(), m.unseen()))


SPLIT_SQL = "\nUNION ALL ".join(
    _horizon_sql(k, "fs", f"'{name}' AS split, ").replace("{w}", f"AND split = '{name}'")
    for k in E.HORIZONS for name in ("train", "public", "private"))
FS = FWD.replace("SELECT e.event_id,", "SELECT CASE WHEN e.session % 10 <= 5 THEN 'train' WHEN e.session % 10 <= 7 THEN 'public' ELSE 'private' END AS split, e.event_id,")


@query("l08_split_validation", shaped("split:s " + REPORT, SPLIT_SQL, "sent", "bars", fs=FS))
def split_validation(m):
    ev = m.events().withColumn("split", split_of("session"))
    return V.event_report(cut_lineage(E.align_forward_returns(ev, m.bars())), keep=("split",))


@query("l03_seed_stability", shaped("method:s mean std min max seeds:i", """
SELECT method, avg(m) AS mean, stddev_pop(m) AS std, min(m) AS min, max(m) AS max, count(*) AS seeds FROM (SELECT method, seed, avg(sharpe) AS m FROM scores GROUP BY 1, 2) GROUP BY 1""", "base9", "labels_all", **CV))
def stability(m):
    return V.stability(scores(m))


VARIANTS = f"""SELECT method AS variant, avg(sharpe) AS mean_sharpe, stddev_pop(sharpe) AS std_sharpe, {TSTAT} AS t_vs_flat
FROM (SELECT a.*, a.sharpe - b.sharpe AS d FROM scores a JOIN scores b ON b.method = 'flat_long' AND a.fold = b.fold AND a.seed = b.seed WHERE a.seed = 0) GROUP BY 1"""


@query("l09_variant_benchmark", shaped("variant:s mean_sharpe std_sharpe t_vs_flat", VARIANTS, "base9", "labels_all", **CV))
def variants(m):
    s = scores(m).where("seed = 0").withColumnRenamed("method", "variant")
    return V.variant_table(s).drop("fold_sharpes")


GRIDSCORE = "SELECT method, seed, avg(sharpe) AS mean_sharpe, stddev_pop(sharpe) AS std_sharpe FROM scores GROUP BY 1, 2"


def grid_scores(m):
    return scores(m).groupBy("method", "seed").agg(F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"))


@query("g04_best_first", shaped("method:s seed:i mean_sharpe std_sharpe", "SELECT * FROM gs ORDER BY mean_sharpe DESC", "base9", "labels_all", **CV, gs=GRIDSCORE))
def best_first(m):
    return grid_scores(m).orderBy(F.desc("mean_sharpe"), "method", "seed")


@query("f08_family_winner", shaped("method:s seed:i mean_sharpe", """
SELECT method, seed, mean_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mean_sharpe DESC, std_sharpe, method) AS k FROM gs) WHERE k = 1""", "base9", "labels_all", **CV, gs=GRIDSCORE))
def winners(m):
    return V.group_winners(grid_scores(m), "seed", [F.desc("mean_sharpe"), "std_sharpe", "method"]).select("method", "seed", "mean_sharpe")


AUDIT = "SELECT method = 'range' AS augment, seed, mean_sharpe, std_sharpe FROM gs WHERE method IN ('momentum', 'range')"


def audit_rows(m):
    g = grid_scores(m).where(F.col("method").isin("momentum", "range"))
    return g.withColumn("augment", F.col("method") == "range")


@query("l10_audit", shaped("augment:i seeds:i mean_best std_best min_best max_best mean_fold_std", """
SELECT augment::INT AS augment, count(DISTINCT seed) AS seeds, avg(mean_sharpe) AS mean_best, stddev_samp(mean_sharpe) AS std_best, min(mean_sharpe) AS min_best, max(mean_sharpe) AS max_best,
  avg(std_sharpe) AS mean_fold_std FROM au GROUP BY 1""", "base9", "labels_all", **CV, gs=GRIDSCORE, au=AUDIT))
def audit(m):
    return V.audit_summary(audit_rows(m))


@query("l10_audit_deltas", shaped("seed:i plain augmented delta verdict:s", """
SELECT seed, p AS plain, q AS augmented, q - p AS delta, CASE WHEN q > p THEN 'higher with augmentation' WHEN q < p THEN 'lower with augmentation' ELSE 'equal' END AS verdict
FROM (SELECT seed, max(mean_sharpe) FILTER (NOT augment) AS p, max(mean_sharpe) FILTER (augment) AS q FROM au GROUP BY 1)""", "base9", "labels_all", **CV, gs=GRIDSCORE, au=AUDIT))
def audit_deltas(m):
    return V.audit_deltas(audit_rows(m))


@query("l10_honest_reference", shaped("role:s variant:s mean_sharpe t_vs_flat", """
SELECT * FROM (SELECT 'best_honest_mean' AS role, variant, mean_sharpe, t_vs_flat FROM va WHERE variant <> 'flat_long' ORDER BY mean_sharpe DESC, t_vs_flat DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'best_honest_stable', variant, mean_sharpe, t_vs_flat FROM va WHERE variant <> 'flat_long' ORDER BY t_vs_flat DESC, mean_sharpe DESC LIMIT 1)
UNION ALL SELECT 'flat_long', variant, mean_sharpe, t_vs_flat FROM va WHERE variant = 'flat_long'""", "base9", "labels_all", **CV, va=VARIANTS))
def honest(m):
    s = scores(m).where("seed = 0").withColumnRenamed("method", "variant")
    return V.honest_reference(V.variant_table(s)).select("role", "variant", "mean_sharpe", "t_vs_flat")


@query("l11_leaderboard", shaped("family:s candidate:s validation_sharpe place:i", """
SELECT *, row_number() OVER (ORDER BY validation_sharpe DESC, oof DESC, candidate) AS place FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY validation_sharpe DESC, oof DESC, candidate) AS k FROM (
    SELECT CASE WHEN method IN ('momentum', 'reversal') THEN 'trend' ELSE 'level' END AS family, method || '_' || seed AS candidate, mean_sharpe AS validation_sharpe, std_sharpe AS oof FROM gs)) WHERE k = 1)""",
  "base9", "labels_all", **CV, gs=GRIDSCORE))
def leaderboard(m):
    family = F.when(F.col("method").isin("momentum", "reversal"), "trend").otherwise("level")
    g = grid_scores(m).select(family.alias("family"), F.concat_ws("_", "method", "seed").alias("candidate"), F.col("mean_sharpe").alias("validation_sharpe"), F.col("std_sharpe").alias("oof_sharpe"))
    return V.leaderboard(g).select("family", "candidate", "validation_sharpe", "place")


@query("l12_output_check", shaped("split:s expected_rows:i rows:i sessions:i row_count_ok:i", """
SELECT split, count(DISTINCT session) AS expected_rows, count(DISTINCT session) AS rows, count(DISTINCT session) AS sessions, 1 AS row_count_ok
FROM (SELECT session, CASE WHEN session % 10 <= 5 THEN 'train' WHEN session % 10 <= 7 THEN 'public' ELSE 'private' END AS split FROM seen) GROUP BY 1""", "seen"))
def output_check(m):
    want = m.seen().select("session", split_of("session").alias("split"))
    have = heads(m).select("session", split_of("session").alias("split"))
    return V.row_count_check(have, want)


PR = """SELECT split, unnest(['p', 'margin', 'entropy']) AS measure, unnest([p, abs(p - 0.5), -(q * ln(q) + (1 - q) * ln(1 - q))]) AS v
FROM (SELECT CASE WHEN session % 10 <= 5 THEN 'train' ELSE 'test' END AS split, p_up AS p, least(greatest(p_up, 1e-15), 1 - 1e-15) AS q FROM preds)"""
PNAMES = " ".join(f"p{q}" for q in P.PROFILE_POINTS)


@query("l13_probability_report", shaped("split:s measure:s min max mean std " + PNAMES, "SELECT split, measure, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, "
    + ", ".join(f"quantile_cont(v, {q / 100}) AS p{q}" for q in P.PROFILE_POINTS) + " FROM pr GROUP BY 1, 2", "preds", pr=PR))
def probability_report(m):
    side = F.when(split_of("session") == "train", "train").otherwise("test")
    return P.probability_report(rule_predictions(m).select("session", F.col("p_up").alias("p"), side.alias("split")), m.rows("supplier"))
