"""Linear models from distributed moment sums.

One Spark pass gives the moment matrices of every fold; the driver only solves systems of
the size of the feature list. Predictions are column expressions.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barsight.functions.ranking import quantiles, value_positions
from barsight.functions.scalars import EPS, logit_clip, optimizer_label
from barsight.functions.stats import sharpe_from_sums
from barsight.schemas import SHARPE_FACTOR

SLOTS = 64
CUT = 1e-10


@dataclass
class Moments:
    """Sums over rows of v v' and of y^2 u u' with v = (1, x, y), u = (1, x), x centred."""

    plain: np.ndarray
    squared: np.ndarray
    centre: np.ndarray

    def __add__(self, other):
        return Moments(self.plain + other.plain, self.squared + other.squared, self.centre)

    def __sub__(self, other):
        return Moments(self.plain - other.plain, self.squared - other.squared, self.centre)

    @property
    def n(self):
        return self.plain[0, 0]

    def scaler(self):
        """Mean (around the centre) and population deviation; a constant column keeps scale 1."""
        mean = self.plain[0, 1:-1] / self.n
        var = np.diag(self.plain)[1:-1] / self.n - mean**2
        size = np.abs(np.diag(self.plain)[1:-1] / self.n) + 1e-300
        flat = var <= np.maximum(1e-14 * size, 1e-24)
        return mean, np.where(flat, 1.0, np.sqrt(np.maximum(var, 1e-300)))

    def design(self):
        """Matrix T with (1, standardised x) = T (1, x)."""
        mean, scale = self.scaler()
        t = np.diag(np.concatenate([[1.0], 1.0 / scale]))
        t[1:, 0] = -mean / scale
        return t


def _collect_sums(rows, width):
    """Sum arrays in two levels: per task, then per slot; the driver adds a fixed number."""

    def add(pdf):
        total = np.sum(np.stack(pdf["m"].to_numpy()), axis=0)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "m": [total]})

    parts = rows.groupBy("g", "slot").applyInPandas(add, "g long, m array<double>").collect()
    out = {}
    for r in parts:
        out[r["g"]] = out.get(r["g"], np.zeros(width)) + np.array(r["m"])
    return out


def moments(df, columns, label="R", group=None):
    """Moments per value of an integer ``group`` column (one group without it)."""
    d = len(columns)
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    rows = df.select(
        g.alias("_g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        F.col(label).cast("double").alias("y"),
    ).where("y is not null")
    means = rows.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(d)]).first()
    centre = np.array([means[i] or 0.0 for i in range(d)])
    width = (d + 2) ** 2 + (d + 1) ** 2

    def partial(batches):
        sums = {}
        for pdf in batches:
            x = np.nan_to_num(pdf.iloc[:, 1 : d + 1].to_numpy(np.float64)) - centre
            y = pdf["y"].to_numpy(np.float64)
            v = np.column_stack([np.ones(len(y)), x, y])
            for k in np.unique(pdf["_g"]):
                part = v[pdf["_g"].to_numpy() == k]
                scaled = part[:, :-1] * part[:, -1:]
                add = np.concatenate([(part.T @ part).ravel(), (scaled.T @ scaled).ravel()])
                sums[k] = sums.get(k, 0.0) + add
        if sums:
            # any label that spreads the tasks works: the sums do not depend on it
            slot = hash(tuple(np.round(next(iter(sums.values()))[:3], 6))) % SLOTS
            yield pd.DataFrame(
                {"g": list(sums), "slot": [slot] * len(sums), "m": [s for s in sums.values()]}
            )

    found = _collect_sums(rows.mapInPandas(partial, "g long, slot int, m array<double>"), width)
    cut = (d + 2) ** 2
    return {
        k: Moments(m[:cut].reshape(d + 2, d + 2), m[cut:].reshape(d + 1, d + 1), centre)
        for k, m in found.items()
    }


def total(folds):
    parts = list(folds.values())
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def without(folds):
    """Moments of all rows outside each fold."""
    everything = total(folds)
    return {k: everything - m for k, m in folds.items()}


@dataclass
class LinearModel:
    """Coefficients on standardised columns."""

    columns: list
    mean: np.ndarray
    scale: np.ndarray
    intercept: float
    coef: np.ndarray

    def raw(self):
        """Intercept and slopes on the raw columns."""
        slope = self.coef / self.scale
        return float(self.intercept - slope @ self.mean), slope

    def score(self):
        base, slope = self.raw()
        out = F.lit(base)
        for c, b in zip(self.columns, slope):
            if b != 0.0:
                out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(b)
        return out

    def standardised(self, column):
        i = self.columns.index(column)
        return (F.col(column) - float(self.mean[i])) / float(self.scale[i])


def _model(m, columns, beta):
    mean, scale = m.scaler()
    return LinearModel(list(columns), mean + m.centre, scale, float(beta[0]), np.asarray(beta[1:]))


def _standard(m):
    """Second moments of (1, standardised x) and its products with y, both as means."""
    t = m.design()
    a = t @ m.plain[:-1, :-1] @ t.T / m.n
    b = t @ m.plain[:-1, -1] / m.n
    return a, b


def ridge_beta(m, alpha):
    a, b = _standard(m)
    penalty = np.diag(np.concatenate([[0.0], np.full(len(b) - 1, alpha / m.n)]))
    return np.linalg.pinv(a + penalty, rcond=1e-13, hermitian=True) @ b


def elastic_beta(m, alpha, l1_ratio, rounds=2000, tol=1e-10):
    """Coordinate descent on the moment matrix (mean squared error / 2 + penalties)."""
    a, b = _standard(m)
    q, c = a[1:, 1:], b[1:] - a[1:, 0] * b[0]
    w = np.zeros(len(c))
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    for _ in range(rounds):
        shift = 0.0
        for j in range(len(w)):
            rho = c[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (q[j, j] + l2) if q[j, j] > 0 else 0.0
            shift, w[j] = max(shift, abs(new - w[j])), new
        if shift < tol:
            break
    return np.concatenate([[b[0]], w])


def fit_ridge(m, columns, alpha=1.0):
    return _model(m, columns, ridge_beta(m, alpha))


def squared_error(m, model_from, beta):
    """Mean squared error on the rows of ``m`` of a model standardised on other rows."""
    t = model_from.design()
    v = np.concatenate([-(t.T @ beta), [1.0]])
    return float(v @ m.plain @ v / m.n)


# Default penalty grids.
RIDGE_ALPHAS = (0.05, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
VARIANCE_ALPHAS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
L1_RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9)


def choose_ridge(folds, alphas=RIDGE_ALPHAS):
    """Penalty of least mean fold error; every fold fit is a difference of moments."""
    rest = without(folds)
    errors = [
        np.mean([squared_error(folds[k], rest[k], ridge_beta(rest[k], a)) for k in folds])
        for a in alphas
    ]
    return alphas[int(np.argmin(errors))]


def choose_elastic(folds, alphas=RIDGE_ALPHAS, ratios=L1_RATIOS):
    rest = without(folds)
    best = None
    for ratio in ratios:
        for a in alphas:
            err = np.mean([squared_error(folds[k], rest[k], elastic_beta(rest[k], a, ratio)) for k in folds])
            if best is None or err < best[0]:
                best = (err, a, ratio)
    return best[1], best[2]


def fit_mean(folds, columns, regularizer="ridge"):
    """Mean head with a cross-validated penalty."""
    m = total(folds)
    if regularizer == "elastic_net":
        return _model(m, columns, elastic_beta(m, *choose_elastic(folds)))
    return fit_ridge(m, columns, choose_ridge(folds))


def _pnl_moments(m):
    """Mean and covariance of z = y (1, standardised x)."""
    t = m.design()
    mean = t @ m.plain[:-1, -1] / m.n
    second = t @ m.squared @ t.T / m.n
    return mean, second - np.outer(mean, mean)


def sharpe_beta(m):
    """Direction of best mean over deviation of y (Xd b): pinv(Cov) mean, unit length."""
    mean, cov = _pnl_moments(m)
    beta = np.linalg.pinv(cov, rcond=CUT, hermitian=True) @ mean
    norm = np.linalg.norm(beta)
    return beta / norm if norm > 1e-12 else np.eye(len(mean))[0]


def beta_sharpe(m, beta):
    mean, cov = _pnl_moments(m)
    var = beta @ cov @ beta
    return float(SHARPE_FACTOR * (beta @ mean) / np.sqrt(var)) if var > 0 else 0.0


def anchored_beta(m, start, strength, rounds=500):
    """Minimise -Sharpe + strength * mean squared distance to the starting positions."""
    mean, cov = _pnl_moments(m)
    a, _ = _standard(m)
    lift = np.linalg.pinv(a + 1e-9 * np.eye(len(a)), hermitian=True)

    def value(b):
        s = np.sqrt(max(b @ cov @ b, 1e-300))
        d = b - start
        return -SHARPE_FACTOR * (b @ mean) / s + strength * d @ a @ d

    def slope(b):
        s = np.sqrt(max(b @ cov @ b, 1e-300))
        d = b - start
        gain = mean / s - (b @ mean) * (cov @ b) / s**3
        return -SHARPE_FACTOR * gain + 2.0 * strength * a @ d

    b, f = start.copy(), value(start)
    step = 1.0
    for _ in range(rounds):
        g = slope(b)
        move = lift @ g
        fall = g @ move
        if fall < 1e-14:
            break
        step = min(step * 2.0, 1.0)
        while step > 1e-14 and value(b - step * move) > f - 1e-4 * step * fall:
            step /= 2.0
        if step <= 1e-14:
            break
        b = b - step * move
        new = value(b)
        if f - new < 1e-12 * max(1.0, abs(f)):
            break
        f = new
    return b


def fit_sharpe_linear(m, columns, alpha=1.0, l1_ratio=0.0, anchor=0.0):
    """Sharpe-optimal linear positions, pure or tied to the ridge / elastic-net positions."""
    if anchor > 0.0:
        start = ridge_beta(m, alpha) if l1_ratio <= 1e-12 else elastic_beta(m, alpha, l1_ratio)
        return _model(m, columns, anchored_beta(m, start, anchor))
    return _model(m, columns, sharpe_beta(m))


def with_label(df, kind="identity", label="R"):
    """Adds the optimiser target ``_y``."""
    return df.withColumn("_y", optimizer_label(label, kind))


def direction(df, signal="f"):
    """-1 where the mean of signal * R is negative, else 1 (one aggregate row)."""
    e = df.agg(F.avg(F.col(signal) * F.col("R")).alias("e")).first()["e"]
    return -1.0 if (e or 0.0) < 0 else 1.0


# --- probability and rank policies -------------------------------------------------------


def fit_logistic(df, columns, strength=1.0, label="R", scaler=None):
    """L2 logistic model of label > 0 on standardised columns, intercept free.

    The penalty is strength / n per row with no further scaling, i.e. C = 1 / strength.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    m = scaler or total(moments(df, columns, label))
    mean, scale = m.scaler()
    mean = mean + m.centre
    probe = LinearModel(list(columns), mean, scale, 0.0, np.zeros(len(columns)))
    labelled = df.where(F.col(label).isNotNull())
    rows = labelled.select(
        (F.col(label) > 0).cast("double").alias("label"),
        *[probe.standardised(c).alias(f"x{i}") for i, c in enumerate(columns)],
    )
    sides = labelled.agg(F.avg((F.col(label) > 0).cast("double")).alias("p")).first()["p"]
    if sides in (None, 0.0, 1.0):
        return None
    vector = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features")
    fit = LogisticRegression(
        regParam=strength / m.n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9
    ).fit(vector.transform(rows))
    return LinearModel(list(columns), mean, scale, float(fit.intercept), np.array(fit.coefficients))


def probability(model):
    """P(R > 0); one half when the training side had a single class."""
    if model is None:
        return F.lit(0.5)
    return 1.0 / (1.0 + F.exp(-model.score()))


def best_slope(df, z="z", label="R"):
    """The slope a in [e^-4, e^4] of best Sharpe for tanh(a z), by two grid passes."""
    low, high = -4.0, 4.0
    best = 0.0
    for _ in range(2):
        grid = np.linspace(low, high, 81)
        rows = df.select(z, label, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("g"))
        pnl = F.tanh(F.exp("g") * F.col(z)) * F.col(label)
        sums = rows.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("s"), F.sum(pnl * pnl).alias("q")
        )
        scored = sums.select("g", F.abs(sharpe_from_sums(F.col("n"), F.col("s"), F.col("q"))).alias("v"))
        best = scored.orderBy(F.desc("v"), "g").first()["g"]
        width = (high - low) / 80
        low, high = max(-4.0, best - width), min(4.0, best + width)
    return float(np.exp(best))


def percentile_against(scores, reference, column, out):
    """Share of reference rows at or below each score."""
    both = reference.select(column, F.lit(1).alias("_w")).unionByName(
        scores.select(column, F.lit(0).alias("_w"))
    )
    places = value_positions(both, [], column, F.col("_w"))
    share = (F.col("below") + F.col("n")) / F.greatest("total", F.lit(1))
    return scores.join(places.select(column, share.alias(out)), column)


# --- quantile regression -----------------------------------------------------------------


def fit_quantiles(df, columns, qs=(0.1, 0.5, 0.9), strength=0.01, label="R", rounds=12, rows=None):
    """Linear quantile models with an L1 penalty, all quantiles in the same passes.

    From ``strength`` >= max(q, 1 - q) on, every slope is exactly zero and the model is the
    sample quantile. Below, reweighted least squares smooths the absolute values at 1e-6.
    """
    base = total(moments(df, columns, label))
    mean, scale = base.scaler()
    d = len(columns)
    start = quantiles(df.where(F.col(label).isNotNull()), label, qs, (), rows).first()
    betas = [np.concatenate([[start[f"q{i}"]], np.zeros(d)]) for i in range(len(qs))]
    free = [i for i, q in enumerate(qs) if strength < max(q, 1.0 - q)]
    centre = base.centre
    data = df.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        F.col(label).cast("double").alias("y"),
    ).where("y is not null")
    width = (d + 1) * (d + 2)
    for _ in range(rounds if free else 0):
        now = [b.copy() for b in betas]

        def partial(batches, now=now):
            sums = {}
            for pdf in batches:
                x = np.nan_to_num(pdf.iloc[:, :d].to_numpy(np.float64))
                v = np.column_stack([np.ones(len(x)), (x - centre - mean) / scale])
                y = pdf["y"].to_numpy(np.float64)
                for i in free:
                    r = y - v @ now[i]
                    w = np.where(r > 0, qs[i], 1.0 - qs[i]) / np.maximum(np.abs(r), 1e-6)
                    vw = v * w[:, None]
                    add = np.concatenate([(vw.T @ v).ravel(), vw.T @ y])
                    sums[i] = sums.get(i, 0.0) + add
            if sums:
                slot = hash(float(next(iter(sums.values()))[0])) % SLOTS
                yield pd.DataFrame(
                    {"g": list(sums), "slot": [slot] * len(sums), "m": list(sums.values())}
                )

        found = _collect_sums(data.mapInPandas(partial, "g long, slot int, m array<double>"), width)
        for i in free:
            m = found[i]
            a, b = m[: (d + 1) ** 2].reshape(d + 1, d + 1), m[(d + 1) ** 2 :]
            pull = strength * base.n / np.maximum(np.abs(betas[i][1:]), 1e-6)
            a = a + np.diag(np.concatenate([[0.0], pull]))
            betas[i] = np.linalg.pinv(a, rcond=1e-13, hermitian=True) @ b
    return [_model(base, columns, b) for b in betas]


def pinball(df, model, q, label="R"):
    r = F.col(label) - model.score()
    return df.agg(F.avg(F.when(r > 0, q * r).otherwise((q - 1.0) * r)).alias("v")).first()["v"]


# --- heads -------------------------------------------------------------------------------


def by_fold(models, fold="fold", build=lambda m: m.score()):
    """Column that applies the model of each row's fold."""
    out = F.lit(None).cast("double")
    for k, m in models.items():
        out = F.when(F.col(fold) == int(k), build(m)).otherwise(out)
    return out


def heteroskedastic_oof(df, columns, label="R", eps=1e-6, floor_quantile=0.05, rows=None):
    """Out-of-fold mean, then out-of-fold log squared residual, floored at a low quantile.

    ``df`` carries an integer ``fold``. The penalties are chosen inside each training side
    from the remaining folds.
    """
    folds = moments(df, columns, label, "fold")
    pick = lambda k, alphas: choose_ridge({j: m for j, m in folds.items() if j != k}, alphas)
    models = {k: fit_ridge(m, columns, pick(k, RIDGE_ALPHAS)) for k, m in without(folds).items()}
    scored = df.withColumn("mu", by_fold(models))
    residual = F.col(label) - F.col("mu")
    scored = scored.withColumn("log_e2", F.log(F.greatest(residual * residual, F.lit(eps))))
    spread = moments(scored, columns, "log_e2", "fold")
    pick_v = lambda k: choose_ridge({j: m for j, m in spread.items() if j != k}, VARIANCE_ALPHAS)
    var_models = {k: fit_ridge(m, columns, pick_v(k)) for k, m in without(spread).items()}
    scored = scored.withColumn("sigma2", F.exp(by_fold(var_models)))
    floor = quantiles(scored, "sigma2", (floor_quantile,), (), rows).first()["q0"]
    sigma2 = F.greatest("sigma2", F.lit(max(floor, 1e-12)))
    oof = scored.select(
        "session", label, "fold", "mu", sigma2.alias("sigma2"), F.sqrt(sigma2).alias("sigma")
    )
    heads = {
        "mean": fit_ridge(total(folds), columns, choose_ridge(folds)),
        "log_variance": fit_ridge(total(spread), columns, choose_ridge(spread, VARIANCE_ALPHAS)),
    }
    return oof, heads


def predict_heads(df, heads, floor):
    sigma2 = F.greatest(F.exp(heads["log_variance"].score()), F.lit(float(floor)))
    return df.select(
        "session", heads["mean"].score().alias("mu"), sigma2.alias("sigma2"), F.sqrt(sigma2).alias("sigma")
    )


def variance_floor(df, heads, q=0.05, rows=None):
    fitted = df.select(F.exp(heads["log_variance"].score()).alias("v"))
    return max(quantiles(fitted, "v", (q,), (), rows).first()["q0"], 1e-12)


def _three_heads(df, columns, label="R", ridge=1.0, strength=1.0, quantile_strength=0.01, rounds=8, rows=None):
    m = total(moments(df, columns, label))
    return (
        fit_ridge(m, columns, ridge),
        fit_logistic(df, columns, strength, label, m),
        fit_quantiles(df, columns, (0.1, 0.5, 0.9), quantile_strength, label, rounds, rows),
    )


def _head_columns(heads):
    mu, p, (low, mid, high) = heads
    return {
        "mu": mu.score(), "p_up": probability(p), "q_lower": low.score(), "q_median": mid.score(),
        "q_upper": high.score(),
    }


def _contract(df, extra=()):
    u = F.greatest(F.col("q_upper") - F.col("q_lower"), F.lit(1e-6))
    return df.select("session", "mu", "p_up", "q_lower", "q_median", "q_upper", u.alias("u"), *extra)


def linear_heads_oof(df, columns, label="R", rounds=8, rows=None):
    """Ridge, logistic and quantile heads, each session predicted by the fit without its fold."""
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())
    out = None
    for k in folds:
        heads = _three_heads(df.where(F.col("fold") != k), columns, label, rounds=rounds, rows=rows)
        part = df.where(F.col("fold") == k)
        part = part.select("session", label, "fold", *[c.alias(n) for n, c in _head_columns(heads).items()])
        out = part if out is None else out.unionByName(part)
    return _contract(out, (label, "fold"))


def linear_heads_fit_predict(train, test, columns, label="R", rounds=8, rows=None):
    heads = _three_heads(train, columns, label, rounds=rounds, rows=rows)
    return _contract(test.select("session", *[c.alias(n) for n, c in _head_columns(heads).items()]))


def attribution(df, model):
    """Mean and mean absolute contribution coef * (x - mean x) of every standardised column."""
    means = df.agg(*[F.avg(model.standardised(c)).alias(f"m{i}") for i, c in enumerate(model.columns)])
    wide = df.crossJoin(F.broadcast(means))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                ((model.standardised(c) - F.col(f"m{i}")) * float(model.coef[i])).alias("phi"),
            )
            for i, c in enumerate(model.columns)
        ]
    )
    return wide.select(F.inline(cells)).groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean")
    )


def policy_positions(fit, apply, columns, policy="prob_sign", strength=1.0, rows=None):
    """Monotone maps of a distributional target to positions f on ``apply``.

    prob_sign: 2p - 1; prob_sign_sharpe: tanh(a logit p) with a tuned on the fit rows;
    quantile_median: tanh(median / deviation); rank_score: 2 * percentile - 1 of a ridge score.
    """
    if policy in ("prob_sign", "prob_sign_sharpe"):
        model = fit_logistic(fit, columns, strength)
        p = probability(model)
        if policy == "prob_sign":
            return apply.withColumn("f", 2.0 * p - 1.0), model
        a = best_slope(fit.select(logit_clip(p).alias("z"), "R"))
        return apply.withColumn("f", F.tanh(a * logit_clip(p))), model
    if policy == "quantile_median":
        model = fit_quantiles(fit, columns, (0.5,), strength, rows=rows)[0]
        if not np.any(model.coef):
            std = EPS
        else:
            std = max(fit.agg(F.stddev_pop(model.score()).alias("s")).first()["s"], EPS)
        return apply.withColumn("f", F.tanh(model.score() / std)), model
    if policy == "rank_score":
        model = fit_ridge(total(moments(fit, columns)), columns, strength)
        ranked = percentile_against(
            apply.withColumn("_s", model.score()), fit.select(model.score().alias("_s")), "_s", "_p"
        )
        return ranked.withColumn("f", 2.0 * F.col("_p") - 1.0).drop("_s", "_p"), model
    raise ValueError(f"unknown policy: {policy}")
