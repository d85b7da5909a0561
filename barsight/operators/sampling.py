"""Reproducible splits, folds and samples from md5 order."""

from pyspark.sql import functions as F

from barsight.functions.ranking import hash_rank, ntile_of
from barsight.functions.scalars import seeded_key


def shuffled(sessions, seed=0):
    """Sessions with their 1-based place in the shuffled order and the pool size."""
    pool = sessions.select("session").distinct()
    return hash_rank(pool, seeded_key(seed, "session"), "session", "place", "pool")


def block_split(sessions, seed=0, draw=50, block=25):
    """Draw sessions without replacement, sort them and cut the draw into two blocks."""
    chosen = shuffled(sessions, seed).where(F.col("place") <= draw).select("session")
    from pyspark.sql import Window as W

    # the draw is a fixed 50 rows, so one task orders it
    rank = F.row_number().over(W.orderBy("session"))
    return chosen.withColumn("block", F.when(rank <= block, "first").otherwise("second"))


def holdout_split(sessions, fraction=0.2, seed=0):
    """Whole-session split into train and validation; each side keeps at least one session."""
    want = F.bround(fraction * F.col("pool"), 0)
    n_val = F.greatest(F.lit(1.0), F.least(F.col("pool") - 1.0, want))
    side = F.when(F.col("place") <= n_val, "validation").otherwise("train")
    return shuffled(sessions, seed).select("session", side.alias("side"))


def kfold(sessions, k=5, seed=0):
    return shuffled(sessions, seed).select("session", ntile_of("place", "pool", k).alias("fold"))


def repeated_kfold(sessions, k=5, seeds=(0, 1)):
    """Folds for several shuffles at once: (seed, session, fold)."""
    pool = sessions.select("session").distinct()
    rows = pool.select("session", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    key = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("session").cast("string")))
    ranked = hash_rank(rows, key, "session", "place", "pool", by=["seed"])
    return ranked.select("seed", "session", ntile_of("place", "pool", k).alias("fold"))


def sample_paths(sessions, k, seed=0):
    return shuffled(sessions, seed).where(F.col("place") <= k).select("session")


def first_headlines(headlines, per_session=None, sessions=None):
    """Keep each session's first headlines by bar, and the smallest session ids if asked."""
    from barsight.functions.ranking import bucket_rank

    out = headlines
    if sessions is not None:
        first = out.select("session").distinct().orderBy("session").limit(sessions)
        out = out.join(first, "session", "left_semi")
    if per_session is not None:
        out = bucket_rank(out, ["session"], F.col("bar_ix"), ["event_id"], "_k")
        out = out.where(F.col("_k") <= per_session).drop("_k")
    return out
