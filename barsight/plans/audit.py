"""What augmentation rows add to cross-validated Sharpe: fits with and without them on the same folds."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from barsight.operators import linear as LN
from barsight.operators.augment import augment_bars, copy_plan, duplicate_rows
from barsight.operators.labels import proxy_returns, realized_returns, sharpe_features
from barsight.operators.sampling import repeated_kfold
from barsight.plans.sharpe import SHARPE_COLUMNS, model_sharpe
from barsight.session import cut_lineage

KINDS = ("none", "proxy", "copies")
SEEDS = (0, 1, 2, 3, 4)
MAIN, COPY = 0, 1
PROXY_GROUP = -1


def labelled(part, first_half=False):
    """Features with the realised return, or first-half features with the return up to the last seen bar."""
    returns = proxy_returns(part["seen"]) if first_half else realized_returns(part["seen"], part["unseen"])
    features = sharpe_features(part["seen"], part["headlines"], part["events"], first_half)
    return features.join(returns.select("session", "R"), "session").where("R is not null")


def copied(train, copies=4, seed=0):
    """Inputs of the transformed copies of the train sessions, and the manifest of the copies.

    A copy keeps the label and the news of its source, whose id the manifest holds.
    """
    bars = train["seen"].unionByName(train["unseen"])
    both = train["seen"].select("session").intersect(train["unseen"].select("session"))
    plan = cut_lineage(copy_plan(both, copies))
    made = cut_lineage(augment_bars(bars, plan, seed).select("session", "bar_ix", "open", "high", "low", "close"))
    part = {
        "seen": made.where("bar_ix <= 49"),
        "unseen": made.where("bar_ix >= 50"),
        "headlines": duplicate_rows(train["headlines"], plan),
        "events": duplicate_rows(train["events"], plan),
    }
    return part, plan


def audit_moments(train, test, seeds=SEEDS, k=5, copies=4):
    """{group: moments} of one pass over train, copy and proxy rows.

    Group 2 * (k * place of the seed + fold) holds a fold's train rows, the next group their copies,
    and PROXY_GROUP the first-half test rows, which belong to no fold. A row of train is counted once
    per seed; what is shuffled are the sums, whose number is fixed by ``seeds`` and ``k``.
    """
    main = cut_lineage(labelled(train))
    part, plan = copied(train, copies)
    folds = cut_lineage(repeated_kfold(main, k, seeds))
    place = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("seed")) - 1
    folds = folds.select("session", (2 * (k * place + F.col("fold"))).alias("group"))
    of_copy = plan.join(folds, "session").select(F.col("augmented_session").alias("session"), (F.col("group") + COPY).alias("group"))
    shape = lambda df: df.select("group", "R", *SHARPE_COLUMNS)
    rows = shape(main.join(folds, "session")).unionByName(shape(labelled(part).join(of_copy, "session")))
    rows = rows.unionByName(shape(labelled(test, True).withColumn("group", F.lit(PROXY_GROUP).cast("long"))))
    return LN.moments(cut_lineage(rows), SHARPE_COLUMNS, "R", "group")


def augmentation_grid(train, test, seeds=SEEDS, k=5, alphas=(0.5, 1.0, 2.0, 5.0), l1_ratios=(0.0,), anchors=(0.0,), kinds=KINDS, copies=4):
    """One row per seed, kind of augmentation and grid point: mean, deviation and list of fold Sharpes.

    none: train rows outside the fold; proxy: these and all proxy rows; copies: these and the copies
    of sessions outside the fold. A fold's own train rows, never copies, are scored. All fits read
    the sums of one pass (``audit_moments``). A fold without rows is left out.
    """
    rows = grid_points(audit_moments(train, test, seeds, k, copies), seeds, k, alphas, l1_ratios, anchors, kinds)
    schema = (
        "seed int, augment string, ridge_alpha double, l1_ratio double, anchor double, "
        "mean_sharpe double, std_sharpe double, fold_sharpes array<double>"
    )
    return train["seen"].sparkSession.createDataFrame(rows, schema)


def grid_points(found, seeds, k, alphas, l1_ratios, anchors, kinds=KINDS):
    """Rows of ``augmentation_grid`` from the sums of ``audit_moments``."""
    out = []
    for i, seed in enumerate(seeds):
        groups = {kind: {j: found[g] for j in range(k) if (g := 2 * (k * i + j) + kind) in found} for kind in (MAIN, COPY)}
        own = groups[MAIN]
        if len(own) < 2:
            continue
        for kind in kinds:
            rest = LN.without(own)
            if kind == "proxy" and PROXY_GROUP in found:
                rest = {j: m + found[PROXY_GROUP] for j, m in rest.items()}
            if kind == "copies" and groups[COPY]:
                every = LN.total(groups[COPY])
                rest = {j: m + (every - groups[COPY][j] if j in groups[COPY] else every) for j, m in rest.items()}
            for alpha, l1, anchor in product(alphas, l1_ratios, anchors):
                scores = [model_sharpe(own[j], LN.fit_sharpe_linear(rest[j], SHARPE_COLUMNS, alpha, l1, anchor)) for j in sorted(own)]
                out.append((seed, kind, alpha, l1, anchor, float(np.mean(scores)), float(np.std(scores)), [float(s) for s in scores]))
    return out


def best_points(grid):
    """Best grid point per seed and kind; ties go to the smaller deviation, then to the earlier point."""
    order = F.struct(F.col("mean_sharpe"), -F.col("std_sharpe"), -F.col("ridge_alpha"), -F.col("l1_ratio"), -F.col("anchor"))
    return grid.groupBy("seed", "augment").agg(F.max_by(F.struct(*[c for c in grid.columns if c not in ("seed", "augment")]), order).alias("best")).select("seed", "augment", "best.*")


def augmentation_deltas(best, base="none"):
    """Per seed and other kind: score with the augmentation, without it, and the verdict of the difference."""
    plain = best.where(F.col("augment") == base).select("seed", F.col("mean_sharpe").alias("plain"))
    rows = best.where(F.col("augment") != base).join(plain, "seed")
    delta = F.col("mean_sharpe") - F.col("plain")
    verdict = F.when(delta > 0, "higher with augmentation").when(delta < 0, "lower with augmentation").otherwise("equal")
    return rows.select("seed", "augment", "plain", F.col("mean_sharpe").alias("augmented"), delta.alias("delta"), verdict.alias("verdict"))
