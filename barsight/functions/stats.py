"""Aggregate expressions: Sharpe, guarded moments, correlations, entropy."""

from pyspark.sql import functions as F

from barsight.functions.scalars import EPS, col
from barsight.schemas import SHARPE_FACTOR


def sharpe_of(pnl):
    """Aggregate: 16 * mean / population std, 0 when empty or flat."""
    mean, std = F.avg(pnl), F.stddev_pop(pnl)
    return F.coalesce(F.when(std > 0, mean / std * SHARPE_FACTOR), F.lit(0.0))


def sharpe_from_sums(n, total, squares):
    mean = total / n
    var = F.greatest(squares / n - mean * mean, F.lit(0.0))
    return F.when(var > 1e-24, mean / F.sqrt(var) * SHARPE_FACTOR).otherwise(0.0)


def paired_t(diff):
    """Aggregate: t statistic of fold differences against zero (sample std)."""
    n, mean, std = F.count(diff), F.avg(diff), F.stddev_samp(diff)
    flat = F.signum(F.round(mean, 12)) * 1e6
    return F.when(n < 2, 0.0).when(std > EPS, mean / (std / F.sqrt(n))).otherwise(flat)


def guarded_corr(x, y, least=2, floor=1e-15, missing=0.0):
    """Aggregate: Pearson correlation with a row minimum and a flat-series guard."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    ok = (F.count(a) >= least) & (F.stddev_pop(a) >= floor) & (F.stddev_pop(b) >= floor)
    other = F.lit(missing).cast("double")
    return F.when(ok, F.corr(a, b)).otherwise(other)


def weighted_corr(x, y, w, least=3):
    """Aggregate: weighted Pearson from weighted moment sums."""
    x, y, w = col(x), col(y), col(w)
    both = x.isNotNull() & y.isNotNull() & w.isNotNull()
    a, b, c = (F.when(both, v) for v in (x, y, w))
    s = F.sum(c)
    mx, my = F.sum(c * a) / s, F.sum(c * b) / s
    vx = F.sum(c * a * a) / s - mx * mx
    vy = F.sum(c * b * b) / s - my * my
    cov = F.sum(c * a * b) / s - mx * my
    ok = (F.count(a) >= least) & (vx >= EPS) & (vy >= EPS)
    return F.when(ok, cov / F.sqrt(vx * vy))


def hit_rate(signal, ret, least=5):
    """Aggregate: share of equal signs where both sides are away from zero."""
    signal, ret = col(signal), col(ret)
    live = (F.abs(signal) > EPS) & (F.abs(ret) > EPS)
    hit = F.when(live, (F.signum(signal) == F.signum(ret)).cast("double"))
    return F.when(F.count(hit) >= least, F.avg(hit))


def entropy_of(share, floor=EPS):
    """Aggregate over category shares: -sum p ln(p + floor)."""
    p = col(share)
    return -F.sum(p * F.log(p + floor))


def entropy_clipped(share):
    p = col(share)
    return -F.sum(p * F.log(F.greatest(p, F.lit(EPS))))


def last_by(value, *order):
    return F.max_by(value, F.struct(*order))


def first_by(value, *order):
    return F.min_by(value, F.struct(*order))
