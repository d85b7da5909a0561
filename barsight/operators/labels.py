"""Return labels, session pools and feature-label assembly."""

from functools import reduce

from pyspark.sql import functions as F

from barsight.operators.bars import features_with_path
from barsight.operators.news import left_join_zero, sentiment_features
from barsight.schemas import DECISION_BAR, END_BAR, FIRST_HALF_LAST_BAR


def bar_pick(bars, ix, name="close_at"):
    """Close of one bar per session."""
    return bars.where(F.col("bar_ix") == ix).groupBy("session").agg(F.first("close").alias(name))


def last_bar_pick(bars, name="close_at"):
    """Close at the largest bar index of the whole table."""
    top = bars.agg(F.max("bar_ix").alias("_top"))
    picked = bars.join(F.broadcast(top), F.col("bar_ix") == F.col("_top"))
    return picked.groupBy("session").agg(F.first("close").alias(name))


def _with_return(df, end, start):
    return df.withColumn("R", F.col(end) / F.col(start) - 1.0)


def realized_returns(seen, unseen):
    """Half and end close, full outer: unmatched sessions keep a null return."""
    half = bar_pick(seen, DECISION_BAR, "close_half")
    end = bar_pick(unseen, END_BAR, "close_end")
    return _with_return(half.join(end, "session", "full"), "close_end", "close_half")


def realized_returns_inner(seen, unseen):
    """Same at the largest bars of both tables; incomplete sessions are left out."""
    half, end = last_bar_pick(seen, "close_half"), last_bar_pick(unseen, "close_end")
    return _with_return(
        half.join(end, "session").dropna(subset=["close_half", "close_end"]),
        "close_end",
        "close_half",
    )


def proxy_returns(seen):
    """Return from bar 24 to bar 49 of the seen window, by conditional pivot."""
    at = lambda k: F.max(F.when(F.col("bar_ix") == k, F.col("close")))
    df = (
        seen.where(F.col("bar_ix").isin(FIRST_HALF_LAST_BAR, DECISION_BAR))
        .groupBy("session")
        .agg(at(FIRST_HALF_LAST_BAR).alias("close_24"), at(DECISION_BAR).alias("close_49"))
    )
    return _with_return(df, "close_49", "close_24")


def seen_and_unseen_returns(bars):
    """Return through bar 49 from the open, and from bar 49 to bar 99."""
    at = lambda k, c: F.max(F.when(F.col("bar_ix") == k, F.col(c)))
    df = (
        bars.where(F.col("bar_ix").isin(0, DECISION_BAR, END_BAR))
        .groupBy("session")
        .agg(at(0, "open").alias("o"), at(49, "close").alias("h"), at(99, "close").alias("e"))
    )
    return df.select(
        "session",
        (F.col("h") / F.col("o") - 1.0).alias("seen_return"),
        (F.col("e") / F.col("h") - 1.0).alias("R"),
    )


def return_quadrant(returns):
    """(seen up?, R up?); with a missing side both are false."""
    known = F.col("seen_return").isNotNull() & F.col("R").isNotNull()
    up = lambda c: F.coalesce(known & (F.col(c) > 0), F.lit(False))
    return returns.select("session", up("seen_return").alias("seen_up"), up("R").alias("r_up"))


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def full_trajectories(seen, unseen):
    return seen.unionByName(unseen)


def tagged_trajectories(seen, unseen, session=None):
    """Seen and unseen rows with their phase, optionally of one session."""
    out = seen.withColumn("phase", F.lit("seen")).unionByName(
        unseen.withColumn("phase", F.lit("unseen"))
    )
    return out if session is None else out.where(F.col("session") == session)


def session_pool(*tables):
    return union_all([t.select("session") for t in tables]).distinct()


def shared_sessions(a, b):
    return a.select("session").intersect(b.select("session"))


def members(df, sessions):
    """Rows of the listed sessions; Spark broadcasts the list only while it is small."""
    return df.join(sessions.select("session").distinct(), "session", "left_semi")


def non_members(df, sessions):
    return df.join(sessions.select("session").distinct(), "session", "left_anti")


def join_labels(features, labels):
    """Inner join that fails the job if a labelled session has no feature row."""
    known = labels.where("R is not null").select("session", "R")
    both = known.join(features.withColumn("_hit", F.lit(True)), "session", "left")
    check = F.assert_true(F.coalesce("_hit", F.lit(False)), F.lit("label without features"))
    return both.withColumn("_m", check).where("_m is null").drop("_m", "_hit")


def require_labels(features, labels):
    """Left join that fails the job when a session has no label."""
    known = labels.select("session", "R", F.lit(True).alias("_hit"))
    joined = features.join(known, "session", "left")
    check = F.assert_true(F.coalesce("_hit", F.lit(False)), F.lit("training label missing"))
    return joined.withColumn("_m", check).where("_m is null").drop("_m", "_hit")


def sharpe_features(bars, headlines, events, first_half=False):
    """Baseline, path and sentiment columns plus a zero slot for an external score."""
    base = features_with_path(bars, headlines, first_half)
    last = FIRST_HALF_LAST_BAR if first_half else DECISION_BAR
    used = bars.where(F.col("bar_ix") <= last) if first_half else bars
    mood = sentiment_features(used, events, last)
    return left_join_zero(base, [mood]).withColumn("cnn_r_pred", F.lit(0.0))


def stack_score(features, scores, column="cnn_r_pred"):
    """Fill the external score column; sessions without a score get 0."""
    extra = scores.select("session", F.col("score").alias("_s"))
    return features.join(extra, "session", "left").withColumn(
        column, F.coalesce("_s", F.lit(0.0))
    ).drop("_s")


def training_table(train, test, within_session=False, augment=True):
    """(main, fit) tables. ``train`` and ``test`` hold seen, unseen, headlines, events.

    augment: train rows plus first-half test rows with the proxy return;
    within_session: first-half train rows with the proxy return; neither: train only.
    """
    if within_session and augment:
        raise ValueError("within_session and augment exclude each other")
    if within_session:
        features = sharpe_features(train["seen"], train["headlines"], train["events"], True)
        main = features.join(proxy_returns(train["seen"]).select("session", "R"), "session")
        return main, main
    features = sharpe_features(train["seen"], train["headlines"], train["events"])
    labels = realized_returns(train["seen"], train["unseen"])
    main = features.join(labels.select("session", "R"), "session")
    if not augment:
        return main, main
    extra = sharpe_features(test["seen"], test["headlines"], test["events"], True)
    extra = extra.join(proxy_returns(test["seen"]).select("session", "R"), "session")
    return main, main.unionByName(extra)
