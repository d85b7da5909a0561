"""Tree ensembles on session features: mean, sign and quantile heads, shift check."""

from statistics import median

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from barsight.functions.ranking import quantiles
from barsight.functions.scalars import economic_weight
from barsight.operators.boosting import Booster, Fit
from barsight.operators.sampling import holdout_split
from barsight.session import cut_lineage


def vectors(df, columns):
    safe = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{i}") for i, c in enumerate(columns)])
    names = [f"_f_{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(safe).drop(*names)


def with_holdout(df, fraction, seed):
    """Flag ``_val`` on a reproducible share of whole sessions, at least one on each side."""
    sides = holdout_split(df, fraction, seed)
    return df.join(sides, "session").withColumn("_val", F.col("side") == "validation").drop("side")


def mean_regressor(train, columns, label="R", rounds=400, rate=0.06, depth=5, seed=0, holdout=0.12):
    """Boosted mean of R; a hash-chosen holdout stops the rounds early."""
    rows = vectors(with_holdout(train.where(F.col(label).isNotNull()), holdout, seed), columns)
    return GBTRegressor(
        labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed,
        validationIndicatorCol="_val", predictionCol="prediction",
    ).fit(rows)


def predict_mean(model, df, columns, name="prediction"):
    return model.transform(vectors(df, columns)).drop("features").withColumnRenamed("prediction", name)


def _leaf_rows(model, rows, trees):
    leaves = model.transform(rows).select("session", "R", vector_to_array("leaves").alias("l"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.struct(i.alias("tree"), F.get("l", i).alias("leaf")))
    return leaves.select("session", "R", F.inline(cells))


class QuantileForest:
    """Forest whose leaves hold training quantiles; a prediction averages its leaves."""

    def __init__(self, columns, qs=(0.1, 0.5, 0.9), trees=20, depth=5, seed=0, rows=None, weight=None):
        self.columns, self.qs, self.trees, self.depth, self.seed, self.rows = columns, qs, trees, depth, seed, rows
        self.weight = weight

    def fit(self, train):
        rows = vectors(train.where("R is not null"), self.columns)
        self.model = RandomForestRegressor(
            labelCol="R", numTrees=self.trees, maxDepth=self.depth, seed=self.seed, leafCol="leaves",
            predictionCol="_forest", **({"weightCol": self.weight} if self.weight else {}),
        ).fit(rows)
        self.table = quantiles(
            _leaf_rows(self.model, rows, self.trees), "R", self.qs, ["tree", "leaf"], self.rows
        )
        return self

    def predict(self, df):
        rows = vectors(df if "R" in df.columns else df.withColumn("R", F.lit(None).cast("double")), self.columns)
        cells = _leaf_rows(self.model, rows, self.trees).join(self.table, ["tree", "leaf"], "left")
        return cells.groupBy("session").agg(*[F.avg(f"q{i}").alias(f"q{i}") for i in range(len(self.qs))])


QUANTILES = (0.1, 0.5, 0.9)
HEADS = {"mean": ("huber", "R", 0.5), "sign": ("log", "_up", 0.5), **{f"q{int(100 * q):02d}": ("pinball", "R", q) for q in QUANTILES}}


def head_fits(rounds, patience, hold, **shared):
    """Fits of the mean, sign and quantile heads; ``rounds`` is a number, or {head: number} without early stopping."""
    out = []
    for name, (loss, label, q) in HEADS.items():
        fixed = isinstance(rounds, dict)
        own = max(1, int(rounds[name])) if fixed else rounds
        out.append(Fit(loss, label, q=q, rounds=own, patience=0 if fixed else patience, hold=0.0 if fixed else hold, **shared))
    return out


def _with_sign(df):
    return df.where("R is not null").withColumn("_up", (F.col("R") > 0).cast("double"))


class TreeHeads:
    """Boosted mean (Huber loss), sign and quantile (pinball loss) heads with economic sample weights.

    All heads advance in the same passes. With ``trees`` the quantiles come from a forest instead.
    """

    def __init__(self, columns, rounds=1500, rate=0.02, depth=6, seed=0, min_u=1e-6, trees=None, rows=None,
                 holdout=0.12, patience=100, min_rows=30):
        self.columns, self.rounds, self.rate, self.depth = columns, rounds, rate, depth
        self.seed, self.min_u, self.trees, self.rows, self.holdout = seed, min_u, trees, rows, holdout
        self.patience, self.min_rows = patience, min_rows

    def fit(self, train, rounds=None):
        """Early stopping on a hash holdout, or exactly ``rounds`` ({head: number}) if given."""
        rows = _with_sign(train)
        std = rows.agg(F.stddev_pop("R").alias("s")).first()["s"] or 0.0
        rows = rows.withColumn("_w", economic_weight("R", F.lit(float(std)))).withColumn("folds", F.array(F.lit(-1)))
        fits = head_fits(rounds or self.rounds, self.patience, self.holdout, seed=self.seed, weight="_w")
        if self.trees:
            fits = fits[:2]
            self.forest = QuantileForest(self.columns, trees=self.trees, seed=self.seed, rows=self.rows, weight="_w").fit(rows)
        self.model = Booster(self.columns, fits, self.rate, self.depth, min_rows=self.min_rows).fit(rows)
        self.best_rounds = {name: m.best for name, m in zip(HEADS, self.model.models)}
        return self

    def predict(self, df):
        out = self.model.predict(df).select("session", F.col("p0").alias("mu"), F.col("p1").alias("p_up"), *([] if self.trees else [F.col(f"p{2 + i}").alias(f"q{i}") for i in range(3)]))
        if self.trees:
            out = out.join(self.forest.predict(df), "session")
        return ordered_quantiles(out, self.min_u)

    def importance(self, spark):
        return _importances(spark, self.columns, self.model.importance(0))


def ordered_quantiles(df, min_u=1e-6):
    low, high = F.least("q0", "q2"), F.greatest("q0", "q2")
    return df.select(
        "session", "mu", F.greatest(F.least("p_up", F.lit(1.0)), F.lit(0.0)).alias("p_up"),
        low.alias("q_lower"), F.col("q1").alias("q_median"), high.alias("q_upper"),
        F.greatest(high - low, F.lit(min_u)).alias("u"),
    )


def cross_validated_heads(df, columns, folds, rounds=1500, rate=0.02, depth=6, holdout=0.12, patience=100, min_rows=30, rows=None):
    """Out-of-fold predictions averaged over repeats; the fold id of the first repeat is kept.

    ``folds`` is (seed, session, fold). All repeats, folds and heads share every pass. Returns
    predictions with ``fold`` and the median number of rounds per head.
    """
    ids = sorted((r[0], r[1]) for r in folds.select("seed", "fold").distinct().collect())
    seeds = sorted({s for s, _ in ids})
    lists = folds.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "fold"))), lambda x: x["fold"]).alias("folds"))
    labelled = _with_sign(df).join(lists, "session")
    # the spread of the labels that a fit is grown on sets its weights
    cells = [(seeds.index(s), k) for s, k in ids]
    spread = labelled.agg(*[F.stddev_pop(F.when(F.col("folds")[s] != k, F.col("R"))).alias(f"s_{s}_{k}") for s, k in cells]).first()
    names = {(s, k): f"_w_{s}_{k}" for s, k in cells}
    labelled = labelled.withColumns({n: economic_weight("R", F.lit(float(spread[f"s_{s}_{k}"] or 0.0))) for (s, k), n in names.items()})
    fits = [f for s, k in cells for f in head_fits(rounds, patience, holdout, split=s, fold=k, seed=seeds[s], weight=names[s, k])]
    model = Booster(columns, fits, rate, depth, min_rows=min_rows).fit(labelled)
    scored = model.predict(labelled, ("session", "folds"))
    wide = len(HEADS)

    def own(head):
        """Mean over repeats of the head of the fit that left the row's fold out."""
        parts = []
        for s in range(len(seeds)):
            pick = None
            for c, (split, k) in enumerate(cells):
                if split == s:
                    here = F.col("folds")[s] == k
                    value = F.col(f"p{c * wide + head}")
                    pick = F.when(here, value) if pick is None else pick.when(here, value)
            parts.append(pick)
        return sum(parts[1:], parts[0]) / len(parts)

    table = scored.select("session", F.col("folds")[0].alias("fold"), own(0).alias("mu"), own(1).alias("p_up"), *[own(2 + i).alias(f"q{i}") for i in range(3)])
    best = {name: max(1, round(median(m.best for m in model.models[i::wide]))) for i, name in enumerate(HEADS)}
    return ordered_quantiles(table).join(table.select("session", "fold"), "session"), best


def _importances(spark, columns, values, k=None):
    df = spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df if k is None else df.limit(k)


def importance_table(spark, model, columns, k=None):
    """Feature importances of a fitted ensemble, largest first."""
    return _importances(spark, columns, model.featureImportances.toArray(), k)


def shift_check(train, test, columns, folds, rounds=400, depth=5, rate=0.03, top=15, seed=0, min_rows=30):
    """Train-versus-test classifier: out-of-fold AUC per fold and overall, and top features.

    The classifiers of all folds and the one on all rows, which gives the features, share every pass.
    """
    spark = train.sparkSession
    both = train.select("session", *columns, F.lit(0.0).alias("side")).unionByName(test.select("session", *columns, F.lit(1.0).alias("side")))
    rows = both.join(folds.select("session", "fold"), "session").withColumn("folds", F.array("fold"))
    ids = sorted(r[0] for r in folds.select("fold").distinct().collect())
    fits = [Fit("log", "side", fold=k, rounds=rounds, seed=seed) for k in [*ids, None]]
    model = Booster(columns, fits, rate, depth, min_rows=min_rows).fit(rows)
    scored = model.predict(rows, ("fold", "side"), range(len(ids)))
    own = F.coalesce(*[F.when(F.col("fold") == k, F.col(f"p{i}")) for i, k in enumerate(ids)])
    scored = cut_lineage(scored.select("fold", "side", own.alias("p")))
    auc = BinaryClassificationEvaluator(labelCol="side", rawPredictionCol="p")
    table = [(f"fold_{k}", float(auc.evaluate(scored.where(F.col("fold") == k)))) for k in ids]
    table.append(("overall", float(auc.evaluate(scored))))
    return spark.createDataFrame(table, "part string, auc double"), _importances(spark, columns, model.importance(len(ids)), top)
