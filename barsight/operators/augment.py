"""Label-preserving copies of sessions: path noise, volatility scaling, time warp."""

from pyspark.sql import Window as W, functions as F

from barsight.functions.ranking import dense_ids
from barsight.functions.scalars import EPS, log_floor, seeded_gaussian, seeded_uniform

# Transform cycle and default strengths.
TRANSFORMS = ("path_noise", "path_noise_shape", "vol_scale", "time_warp")
DEFAULTS = {
    "close_noise": 0.015, "shape_noise": 0.08, "vol_low": 0.75, "vol_high": 1.35,
    "warp": 0.35, "smooth": 5, "start": 30_000,
}


def copy_plan(sessions, copies=4, transforms=TRANSFORMS, start=DEFAULTS["start"]):
    """Manifest: source session, copy, transform and the new dense id."""
    ids = dense_ids(sessions.select("session").distinct(), "session", 0, out="_ix")
    rows = ids.select("session", "_ix", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    cycle = F.array(*[F.lit(t) for t in transforms])
    return rows.select(
        "session",
        "copy",
        cycle[F.col("copy") % len(transforms)].alias("transform"),
        (F.col("_ix") * copies + F.col("copy") + start).cast("long").alias("augmented_session"),
    )


# Rows of copies in one task: windows hold them several times over, with the path of a segment on each.
ROWS_PER_TASK = 100_000


def _dealt(rows, bars, plan):
    """Rows of all copies dealt over as many tasks as their number needs.

    The bars are small before they are copied, so tasks cut by the size of the bars would hold too many.
    """
    n, sessions = plan.agg(F.count(F.lit(1)), F.count_distinct("session")).first()
    tasks = 1 + bars.count() * n // max(sessions, 1) // ROWS_PER_TASK
    return rows.repartition(int(tasks), "session", "copy")


def _by():
    return W.partitionBy("session", "copy", "phase")


def log_steps(bars, plan):
    """Bars of every copy with the log step into each bar.

    The first seen bar has no step; the first unseen bar steps from the last seen close,
    which no transform moves.
    """
    rows = _dealt(plan.join(bars, "session"), bars, plan)
    rows = rows.withColumn("phase", F.when(F.col("bar_ix") <= 49, "seen").otherwise("unseen"))
    order = W.partitionBy("session", "copy").orderBy("bar_ix")
    lc = log_floor("close")
    first = F.row_number().over(_by().orderBy("bar_ix")) == 1
    step = lc - F.lag(lc).over(order)
    anchored = F.when((F.col("phase") == "seen") & first, F.lit(None)).otherwise(step)
    rows = rows.withColumn("lc", lc).withColumn("step", anchored)
    start = F.first(lc - F.coalesce("step", F.lit(0.0))).over(_by().orderBy("bar_ix"))
    return rows.withColumn("start_log", start)


def _cumulate(rows, step):
    run = _by().orderBy("bar_ix").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_step", step)
    total = F.coalesce(F.sum("_step").over(run), F.lit(0.0))
    return rows.withColumn("new_close", F.exp(F.col("start_log") + total)).drop("_step")


def path_noise(rows, seed=0, sigma=DEFAULTS["close_noise"], smooth=DEFAULTS["smooth"]):
    """Smoothed zero-sum noise on the steps of a segment: its end close stays."""
    noise = F.when(F.col("step").isNotNull(), seeded_gaussian(seed, "session", "copy", "bar_ix") * sigma)
    after = (smooth - 1) // 2
    near = _by().orderBy("bar_ix").rowsBetween(-(smooth - 1 - after), after)
    rows = rows.withColumn("_n", noise)
    width = F.least(F.lit(smooth), F.count("_n").over(_by()))
    rows = rows.withColumn("_n", F.when(F.col("step").isNotNull(), F.sum("_n").over(near) / width))
    rows = rows.withColumn("_n", F.col("_n") - F.avg("_n").over(_by()))
    return _cumulate(rows, F.col("step") + F.col("_n")).drop("_n")


def vol_scale(rows, seed=0, low=DEFAULTS["vol_low"], high=DEFAULTS["vol_high"]):
    """Scale the steps around their mean; one factor per copy and segment."""
    scale = low + (high - low) * seeded_uniform(seed, "session", "copy", "phase")
    drift = F.avg("step").over(_by())
    rows = rows.withColumn("_d", drift)
    return _cumulate(rows, F.col("_d") + scale * (F.col("step") - F.col("_d"))).drop("_d")


def time_warp(rows, seed=0, strength=DEFAULTS["warp"]):
    """Read the segment at monotone random times that start and end with it."""
    pace = F.when(
        F.col("step").isNotNull(), F.exp(seeded_gaussian(f"{seed}w", "session", "copy", "bar_ix") * strength)
    )
    run = _by().orderBy("bar_ix").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_p", pace)
    at = F.coalesce(F.sum("_p").over(run), F.lit(0.0)) / F.sum("_p").over(_by())
    steps = F.count("_p").over(_by())
    # in the order of bars, so that no row sorts the path again
    whole = _by().orderBy("bar_ix", "lc").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select("*", F.collect_list(F.struct("lc")).over(whole).alias("_path"), (at * steps).alias("_at"), steps.alias("_m"))
    left = F.least(F.floor("_at"), F.col("_m") - 1).cast("int")
    rows = rows.withColumn("_left", left).withColumn("_share", F.col("_at") - left)
    anchored = F.col("_m") == F.size("_path")

    def at_step(i):
        """Path at a step: an anchored path has the start before its first bar."""
        own = F.when(anchored, i - 1).otherwise(i)
        return F.when(anchored & (i == 0), F.col("start_log")).otherwise(F.get("_path", own)["lc"])

    value = at_step(F.col("_left")) * (1.0 - F.col("_share")) + at_step(F.col("_left") + 1) * F.col("_share")
    short = F.col("_m") < 2
    new = F.when(short, F.exp("lc")).otherwise(F.exp(value))
    return rows.withColumn("new_close", new).drop("_p", "_path", "_at", "_m", "_left", "_share")


def rebuild_bars(rows, seed=0, shape_noise=0.0):
    """Open, high and low follow the new close by their old ratios; optional shape jitter.

    OHLC order is restored: the low is floored first, then open and close at the low.
    """
    base = F.greatest("close", F.lit(EPS))
    c = F.col("new_close")
    o, h, l = (F.col(x) for x in ("_o", "_h", "_l"))
    rows = rows.withColumns({f"_{x[0]}": c * F.col(x) / base for x in ("open", "high", "low")})
    shaped = F.col("transform") == "path_noise_shape"
    if shape_noise > 0.0:
        # columns of their own, so that no draw is made twice for a row
        jitter = lambda tag, s: F.when(shaped, F.exp(seeded_gaussian(f"{seed}{tag}", "session", "copy", "bar_ix") * s))
        rows = rows.withColumns({"_b": jitter("b", shape_noise), "_u": jitter("u", shape_noise / 2), "_w": jitter("l", shape_noise / 2)})
        rows = rows.withColumns({
            "_b": c + (o - c) * F.col("_b"),
            "_u": F.greatest(h - F.greatest(o, c), F.lit(0.0)) * F.col("_u"),
            "_w": F.greatest(F.least(o, c) - l, F.lit(0.0)) * F.col("_w"),
        })
        h2, l2 = F.greatest("_b", c) + F.col("_u"), F.least("_b", c) - F.col("_w")
        rows = rows.withColumns({x: F.when(shaped, a).otherwise(F.col(x)) for x, a in (("_o", F.col("_b")), ("_h", h2), ("_l", l2))})
    rows = rows.withColumn("_l", F.greatest(l, F.lit(EPS)))
    rows = rows.withColumn("_o", F.greatest("_o", "_l")).withColumn("_c", F.greatest(c, F.col("_l")))
    return rows.select(
        F.col("augmented_session").alias("session"), F.col("session").alias("source_session"),
        "copy", "transform", "bar_ix", F.col("_o").alias("open"),
        F.greatest("_h", "_o", "_c").alias("high"), F.col("_l").alias("low"), F.col("_c").alias("close"),
    )


def augment_bars(bars, plan, seed=0, **options):
    """Bars of all copies, each under the transform of its plan row."""
    o = {**DEFAULTS, **options}
    rows = log_steps(bars, plan)
    pick = lambda *names: rows.where(F.col("transform").isin(*names))
    out = path_noise(pick("path_noise", "path_noise_shape"), seed, o["close_noise"], o["smooth"])
    out = out.unionByName(vol_scale(pick("vol_scale"), seed, o["vol_low"], o["vol_high"]))
    out = out.unionByName(time_warp(pick("time_warp"), seed, o["warp"]))
    return rebuild_bars(out, seed, o["shape_noise"])


def duplicate_rows(table, plan):
    """News of the source sessions under the new ids, unchanged otherwise."""
    ids = plan.select("session", "augmented_session")
    return table.join(ids, "session").withColumn("session", F.col("augmented_session")).drop("augmented_session")
