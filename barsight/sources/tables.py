"""Readers and writers of the session data layout: one parquet or CSV set per split."""

import os

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from barsight import schemas
from barsight.functions.scalars import sentiment_sign
from barsight.operators.labels import union_all
from barsight.session import cut_lineage

# File names of the data layout.
BARS = {
    "seen_train": "bars_seen_train.parquet",
    "unseen_train": "bars_unseen_train.parquet",
    "seen_public_test": "bars_seen_public_test.parquet",
    "seen_private_test": "bars_seen_private_test.parquet",
}
HEADLINES = {k: v.replace("bars_", "headlines_") for k, v in BARS.items()}
SENTIMENTS = {
    k: v.replace("bars_", "sentiments_").replace(".parquet", ".csv") for k, v in BARS.items()
}
# Splits whose events may enter features; the future half is not among them.
FEATURE_SPLITS = ("seen_train", "seen_public_test", "seen_private_test")

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def missing_path(error):
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def read_bars(spark, folder, split, columns=None):
    df = spark.read.schema(schemas.BARS).parquet(os.path.join(folder, BARS[split]))
    return df if columns is None else df.select(*columns)


def read_optional_parquet(spark, path, schema):
    """The table, or an empty one of the same schema where the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if missing_path(error):
            return spark.createDataFrame([], schema)
        raise


def read_headlines(spark, folder, split):
    return read_optional_parquet(spark, os.path.join(folder, HEADLINES[split]), schemas.HEADLINES)


def read_sentiments(spark, folder, split):
    """Typed CSV scan with the side as +1 / -1."""
    path = os.path.join(folder, SENTIMENTS[split])
    df = spark.read.options(**CSV_OPTIONS).schema(schemas.SENTIMENTS).csv(path)
    return df.withColumn("sign", sentiment_sign("sentiment"))


def read_feature_sentiments(spark, folder, splits):
    """Union of allowed splits; missing texts become empty."""
    wrong = [s for s in splits if s not in FEATURE_SPLITS]
    if wrong:
        raise ValueError(f"splits not allowed in features: {wrong}; use {FEATURE_SPLITS}")
    df = union_all([read_sentiments(spark, folder, s) for s in splits])
    for c in ("headline", "company", "sector", "granular_sector"):
        df = df.withColumn(c, F.coalesce(c, F.lit("")) if c in df.columns else F.lit(""))
    return df


def read_bar_splits(spark, folder, splits):
    return union_all([read_bars(spark, folder, s) for s in splits])


def write_submission(positions, path, expected_rows=None):
    """One sorted CSV row per session; duplicates, nulls or a wrong count fail the job."""
    counts = positions.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("sessions"),
        F.count("target_position").alias("filled"),
    ).first()
    if not counts["rows"] == counts["sessions"] == counts["filled"]:
        raise ValueError(f"submission is not one position per session: {counts}")
    if expected_rows is not None and counts["rows"] != expected_rows:
        raise ValueError(f"expected {expected_rows} rows, got {counts['rows']}")
    positions.select("session", "target_position").orderBy("session").write.option(
        "header", True
    ).csv(path)
    return counts["rows"]


def read_submission(spark, path):
    return spark.read.option("header", True).schema(schemas.SUBMISSION).csv(path)


def write_table(df, path, fmt="csv", order=None):
    if order:
        df = df.orderBy(*order)
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    getattr(writer, fmt)(path)


def export_with_profile(df, path):
    """CSV export plus one profile row per column: type, rows, nulls, sample of three values."""
    df.write.options(header=True, quote='"', escape='"').csv(path)
    sample = [r.asDict() for r in df.limit(3).collect()]
    texts = {c: "; ".join(str(r[c]) for r in sample) for c in df.columns}
    types = dict(df.dtypes)
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col("_rows").alias("rows"),
                F.col(f"n_{i}").alias("non_null"), F.lit(texts[c]).alias("sample"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return wide.select(F.inline(cells))


def write_split_dataset(folder, sides, bars_seen, bars_unseen, headlines=None, sentiments=None):
    """Self-contained dataset in which the validation sessions play the public test split.

    ``sides`` is (session, side) with side train or validation. It is drawn once.
    """
    sides = cut_lineage(sides)

    def keep(df, side):
        return df.join(sides.where(F.col("side") == side).select("session"), "session", "left_semi")

    def parquet(df, name):
        df.write.parquet(os.path.join(folder, name))

    parquet(keep(bars_seen, "train"), BARS["seen_train"])
    parquet(keep(bars_unseen, "train"), BARS["unseen_train"])
    parquet(keep(bars_seen, "validation"), BARS["seen_public_test"])
    parquet(keep(bars_seen, "validation").limit(0), BARS["seen_private_test"])
    seen = F.col("bar_ix") <= schemas.DECISION_BAR
    for table, names, write in (
        (headlines, HEADLINES, parquet),
        (
            sentiments,
            SENTIMENTS,
            lambda df, name: df.write.options(**CSV_OPTIONS).csv(os.path.join(folder, name)),
        ),
    ):
        if table is None:
            continue
        write(keep(table.where(seen), "train"), names["seen_train"])
        write(keep(table.where(~seen), "train"), names["unseen_train"])
        write(keep(table.where(seen), "validation"), names["seen_public_test"])
    return folder


def pool_reference(sessions):
    """Smallest and largest id and number of sessions per split."""
    return sessions.groupBy("split").agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"),
        F.countDistinct("session").alias("sessions"),
    )
