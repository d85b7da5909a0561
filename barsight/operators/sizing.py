"""Predictions to positions: sizing rules, grid search, ranking, ensembles."""

from dataclasses import asdict, dataclass
from itertools import product

import numpy as np
from pyspark.sql import Window as W, functions as F, types as T

from barsight.functions.ranking import quantiles
from barsight.functions.scalars import EPS, clamp, seeded_gaussian
from barsight.functions.stats import paired_t, sharpe_from_sums, sharpe_of
from barsight.operators.reports import melt

ALL_MODES = ("z_tanh", "p_linear", "p_tanh", "edge_linear", "mu_scaled")
BASIC_MODES = ALL_MODES[:4]
SIMPLICITY = {"p_linear": 0, "p_tanh": 1, "mu_scaled": 2, "z_tanh": 3, "edge_linear": 4}
ALPHAS = (0.0, 0.1, 0.25, 0.4, 0.6, 0.8, 1.0, 1.5)
LAMBDAS = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0)
THETAS = (0.0, 0.05, 0.1)
TAU_QUANTILES = (0.1, 0.2, 0.3, 0.5)


@dataclass(frozen=True)
class Sizing:
    mode: str = "z_tanh"
    baseline: float = 1.0
    alpha: float = 0.0
    lam: float = 3.0
    theta: float = 0.0
    tau_quantile: float = 0.2
    allow_short: bool = True
    scale: float = 1.0
    clip_quantile: float = 0.999


def sizing_grid(modes=BASIC_MODES, baselines=(1.0,)):
    """Every configuration with its id, the variable it acts on and its simplicity rank."""
    rows = []
    for mode, baseline, alpha in product(modes, baselines, ALPHAS):
        for lam in LAMBDAS if mode in ("z_tanh", "p_tanh") else (1.0,):
            for theta in THETAS if mode == "z_tanh" else (0.0,):
                for tau, short in product(TAU_QUANTILES, (True, False)):
                    rows.append(Sizing(mode, baseline, alpha, lam, theta, tau, short))
    return [with_variable(i, c) for i, c in enumerate(rows)]


def tau_name(q):
    return f"z_{round(q * 1000)}"


def with_variable(i, config):
    mode = config.mode
    variable = {"p_linear": "lean", "p_tanh": "lean", "mu_scaled": "mu"}.get(mode)
    numbers = {k: v if isinstance(v, (str, bool)) else float(v) for k, v in asdict(config).items()}
    return {
        "config_id": i,
        **numbers,
        "variable": variable or tau_name(config.tau_quantile),
        "simplicity": SIMPLICITY[mode],
    }


GRID_SCHEMA = T.StructType(
    [
        T.StructField("config_id", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("baseline", T.DoubleType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("lam", T.DoubleType()),
        T.StructField("theta", T.DoubleType()),
        T.StructField("tau_quantile", T.DoubleType()),
        T.StructField("allow_short", T.BooleanType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("clip_quantile", T.DoubleType()),
        T.StructField("variable", T.StringType()),
        T.StructField("simplicity", T.IntegerType()),
    ]
)


def grid_frame(spark, grid):
    return spark.createDataFrame([tuple(g[f.name] for f in GRID_SCHEMA.fields) for g in grid], GRID_SCHEMA)


def population(preds, tau_quantiles, rows=None):
    """Row count, uncertainty floors and the mean-head scale: one row of scalars."""
    taus = quantiles(preds, "u", tau_quantiles, (), rows)
    scale = quantiles(preds.select(F.abs("mu").alias("a")), "a", (0.5,), (), rows)
    row = taus.crossJoin(scale.withColumnRenamed("q0", "med")).crossJoin(
        preds.agg(F.count(F.lit(1)).alias("n"))
    ).first()
    floors = {q: max(row[f"q{i}"] or 0.0, 1e-6) for i, q in enumerate(tau_quantiles)}
    return row["n"], floors, row["med"] or 0.0


def decision_variables(preds, floors, median_mu):
    """Columns the sizing modes act on: edge over floored risk, side lean, scaled mean."""
    lean = 2.0 * clamp("p_up", 0.0, 1.0) - 1.0
    out = preds.withColumn("lean", lean)
    edge = F.col("mu") * F.col("lean")
    for q, tau in floors.items():
        out = out.withColumn(tau_name(q), edge / F.greatest("u", F.lit(tau)))
    scaled = F.col("mu") / median_mu if median_mu > EPS else F.lit(0.0)
    return out.withColumn("mu", scaled)


def _raw():
    v = F.col("value")
    shaped = (
        F.when(~F.col("mode").endswith("tanh"), v)
        .when(F.col("lam") > 0, F.tanh(F.col("lam") * v))
        .otherwise(0.0)
    )
    open_gate = (F.col("theta") <= 0) | (F.abs(v) > F.col("theta"))
    return F.when(open_gate, shaped).otherwise(0.0)


def _target():
    t = F.col("scale") * (F.col("baseline") + F.col("alpha") * _raw())
    return F.when(F.col("allow_short"), t).otherwise(F.greatest(t, F.lit(0.0)))


def _melted(variables, grid, keep):
    return melt(variables, sorted({g["variable"] for g in grid}), keep)


def clip_thresholds(variables, grid, n, rows=None):
    """Exact clip quantile of |target| for every configuration.

    |target| falls and then rises along the variable of a configuration, so its largest
    values sit in the two tails of that variable. Only tail rows meet the grid.
    """
    spark = variables.sparkSession
    long = _melted(variables, grid, ())
    q = grid[0]["clip_quantile"]
    spot = q * (n - 1)
    low_ix = int(np.floor(spot))
    m = n - low_ix
    inner = min(1.0, (m + 1.0) / max(n - 1, 1))
    cuts = quantiles(long, "value", (inner, 1.0 - inner), ["variable"], rows)
    # one row per variable
    tails = long.join(F.broadcast(cuts), "variable").where(
        (F.col("value") <= F.col("q0")) | (F.col("value") >= F.col("q1"))
    )
    sized = tails.join(F.broadcast(grid_frame(spark, grid)), "variable").select(
        "config_id", F.abs(_target()).alias("a")
    )
    place = F.row_number().over(W.partitionBy("config_id").orderBy(F.desc("a")))
    top = sized.withColumn("k", place).where(F.col("k") <= m)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("a")))
    low, high = at(m), at(max(m - 1, 1))
    return top.groupBy("config_id").agg((low + (high - low) * (spot - low_ix)).alias("clip"))


def clipped(target="target", clip="clip"):
    t, c = F.col(target), F.col(clip)
    return F.when(c > 0, F.least(F.greatest(t, -c), c)).otherwise(t)


def grid_positions(preds, grid, keep=("session",), rows=None):
    """Long positions (keep..., config_id, target). The fixed grid is broadcast, so no shuffle."""
    spark = preds.sparkSession
    taus = sorted({g["tau_quantile"] for g in grid})
    n, floors, med = population(preds, taus, rows)
    variables = decision_variables(preds, floors, med)
    limits = clip_thresholds(variables, grid, n, rows)
    configs = grid_frame(spark, grid).join(limits, "config_id")
    return (
        _melted(variables, grid, keep)
        .join(F.broadcast(configs), "variable")
        .select(*keep, "config_id", _target().alias("target"), "clip")
        .select(*keep, "config_id", clipped().alias("target"))
    )


def apply_sizing(preds, config=Sizing(), rows=None):
    """Positions of one configuration: (session, target_position)."""
    grid = [with_variable(0, config)]
    return grid_positions(preds, grid, ("session",), rows).select(
        "session", F.col("target").alias("target_position")
    )


def tune_sizing(preds, grid, rows=None):
    """Sharpe of every configuration on rows that carry the realised return R."""
    scored = grid_positions(preds.where("R is not null"), grid, ("R",), rows)
    pnl = F.col("target") * F.col("R")
    sums = scored.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("s"), F.sum(pnl * pnl).alias("ss")
    )
    sums = sums.select("config_id", sharpe_from_sums(F.col("n"), F.col("s"), F.col("ss")).alias("sharpe"))
    return grid_frame(preds.sparkSession, grid).join(sums, "config_id")


def tune_sizing_by_fold(preds, grid, rows=None):
    """Adds the paired t of fold Sharpes against a flat long position."""
    labelled = preds.where("R is not null")
    scored = grid_positions(labelled, grid, ("fold", "R"), rows)
    pnl = F.col("target") * F.col("R")
    cells = scored.groupBy("config_id", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("s"), F.sum(pnl * pnl).alias("ss")
    )
    flat = labelled.groupBy("fold").agg(sharpe_of(F.col("R")).alias("flat"))
    fold_sharpe = sharpe_from_sums(F.col("n"), F.col("s"), F.col("ss"))
    joined = cells.join(F.broadcast(flat), "fold").withColumn("d", fold_sharpe - F.col("flat"))
    total = sharpe_from_sums(F.sum("n"), F.sum("s"), F.sum("ss"))
    best = joined.groupBy("config_id").agg(total.alias("sharpe"), paired_t(F.col("d")).alias("t_vs_flat"))
    return grid_frame(preds.sparkSession, grid).join(best, "config_id")


def best_sizing(tuned, by_fold=False):
    """First row: rounded score, then the simpler mode, then the smaller id."""
    keys = [F.desc(F.round("sharpe", 6)), "simplicity", "config_id"]
    if by_fold:
        keys = [F.desc(F.round("t_vs_flat", 6)), *keys]
    return tuned.orderBy(*keys).limit(1)


def config_from_row(row):
    names = ("mode", "baseline", "alpha", "lam", "theta", "tau_quantile", "allow_short", "scale", "clip_quantile")
    return Sizing(**{n: row[n] for n in names})


def size_with_fallback(preds, config=None, rows=None):
    """Tuned or frozen configuration; without one, or at alpha 0, the position is flat long."""
    if config is None:
        config = Sizing(alpha=0.0)
    if isinstance(config, dict):
        config = Sizing(**config)
    return apply_sizing(preds, config, rows)


def ranking(preds, positions):
    edge = F.col("mu") * (2.0 * F.col("p_up") - 1.0)
    return preds.join(positions, "session").select(
        "session", "mu", "p_up", "q_lower", "q_median", "q_upper", "u",
        edge.alias("edge"),
        (edge / F.greatest("u", F.lit(1e-6))).alias("z"),
        "target_position",
    )


def position_matrix(tables):
    """Inner join of position tables, one column per name."""
    out = None
    for name, table in tables.items():
        column = table.select("session", F.col("target_position").alias(name))
        out = column if out is None else out.join(column, "session")
    return out


def simplex(heads, step):
    """All non-negative weights in multiples of ``step`` that sum to one."""
    k = int(round(1.0 / max(min(step, 1.0), 0.001)))
    points = np.indices((k + 1,) * (heads - 1)).reshape(heads - 1, -1).T
    points = points[points.sum(axis=1) <= k]
    return np.column_stack([points, k - points.sum(axis=1)]) / k


def pnl_moments(matrix, heads):
    """Mean vector and covariance of the head PnLs, from one aggregate row."""
    pnl = {h: F.col(h) * F.col("R") for h in heads}
    aggs = [F.avg(pnl[h]).alias(f"m_{i}") for i, h in enumerate(heads)]
    for i, a in enumerate(heads):
        aggs += [F.covar_pop(pnl[a], pnl[b]).alias(f"c_{i}_{j}") for j, b in enumerate(heads) if j >= i]
    row = matrix.where("R is not null").agg(*aggs).first()
    mean = np.array([row[f"m_{i}"] for i in range(len(heads))])
    cov = np.array(
        [[row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(len(heads))] for i in range(len(heads))]
    )
    return mean, cov


def _sharpe_of_weights(points, mean, cov):
    var = np.einsum("ij,jk,ik->i", points, cov, points)
    std = np.sqrt(np.maximum(var, 0.0))
    return np.where(std > 1e-12, points @ mean / np.maximum(std, 1e-300) * 16.0, 0.0)


def ensemble_weights(matrix, heads, step=0.02):
    """Convex weights of best Sharpe on the grid, then on a finer grid around the winner."""
    mean, cov = pnl_moments(matrix, heads)
    points = simplex(len(heads), step)
    score = _sharpe_of_weights(points, mean, cov)
    best = int(np.argmax(np.round(score, 9)))
    w, s = points[best], score[best]
    fine = simplex(len(heads), max(step / 4.0, 0.0025))
    fine = fine[np.all(np.abs(fine - w) <= 3.0 * step + 1e-9, axis=1)]
    if len(fine):
        score = _sharpe_of_weights(fine, mean, cov)
        best = int(np.argmax(np.round(score, 9)))
        if score[best] > s:
            w, s = fine[best], score[best]
    return dict(zip(heads, w.tolist())), float(s)


def combine(matrix, weights, flat_long=0.0):
    """Weighted sum of head columns, plus an optional constant long head."""
    total = F.lit(float(flat_long))
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.col(name)
    return matrix.select("session", total.alias("target_position"))


def blend_std_matched(table, linear, tree, weight=0.5):
    """weight * linear + (1 - weight) * tree scaled to the deviation of the linear column.

    The tree column is flipped where its mean product with R is negative.
    """
    stats = table.agg(
        F.stddev_pop(linear).alias("_a"), F.stddev_pop(tree).alias("_b"),
        F.avg(F.col(tree) * F.col("R")).alias("_e"),
    )
    side = F.when(F.col("_e") < 0, -1.0).otherwise(1.0)
    part = side * F.col(tree) * F.col("_a") / (F.col("_b") + EPS)
    blended = weight * F.col(linear) + (1.0 - weight) * part
    return table.crossJoin(F.broadcast(stats)).select("session", "R", blended.alias("target_position"))


def baseline_positions(sessions, method="zeros", seed=0):
    """Zeros, or Gaussian draws that depend on the seed and the session only."""
    value = F.lit(0.0) if method == "zeros" else seeded_gaussian(seed, "session")
    return sessions.select("session").distinct().withColumn("target_position", value)


def head_ablations(preds, rows=None):
    """Positions from the mean head alone, sign agreement, and mean over squared spread."""
    with_kelly = preds.withColumn("k", F.col("mu") / F.pow(F.greatest("u", F.lit(1e-4)), F.lit(2.0)))
    meds = quantiles(
        melt(with_kelly.select(F.abs("mu").alias("m"), F.abs("k").alias("k")), ("m", "k"), ()),
        "value", (0.5,), ["variable"], rows,
    ).collect()
    med = {r["variable"]: r["q0"] or 1.0 for r in meds}
    lean = F.when(F.col("p_up") > 0.5, 1.0).otherwise(-1.0)
    return with_kelly.select(
        "session",
        (F.col("mu") / med["m"]).alias("mean_only"),
        (F.signum("mu") * lean).alias("mean_sign"),
        (F.col("k") / med["k"]).alias("mean_quantile"),
    )


def diagnostic_signals(preds):
    """Sharpe of the plain signals: mean sign, probability side, edge, mean over variance."""
    edge = F.col("mu") * (2.0 * F.col("p_up") - 1.0)
    wide = preds.where("R is not null").select(
        "R",
        F.signum("mu").alias("sign_mu"),
        F.when(F.col("p_up") > 0.5, 1.0).otherwise(-1.0).alias("p_side"),
        edge.alias("edge"),
        (F.col("mu") / F.greatest(F.col("u") * F.col("u"), F.lit(EPS))).alias("kelly"),
    )
    long = melt(wide, ("sign_mu", "p_side", "edge", "kelly"), ("R",), "signal")
    return long.groupBy("signal").agg(sharpe_of(F.col("value") * F.col("R")).alias("sharpe"))
