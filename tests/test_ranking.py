"""Two-level ranks and quantiles against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsight.functions import ranking as K
from barsight.functions.scalars import seeded_key
from barsight.sources.market import ticks_to_bars


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    g = np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 20, 3000))
    v = np.round(rng.standard_normal(3000), 1)
    return pd.DataFrame({"g": g, "id": np.arange(3000), "v": v, "major": rng.integers(0, 40, 3000), "minor": rng.integers(0, 5, 3000)})


def test_bucket_rank(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = K.bucket_rank(df, ["g"], F.col("major"), ["minor", "id"], "k", "n").toPandas()
    want = skewed.sort_values(["g", "major", "minor", "id"])
    want["k"] = want.groupby("g").cumcount() + 1
    both = got.merge(want[["id", "k"]], on="id")
    assert (both.k_x == both.k_y).all()
    assert (got.groupby("g").n.first() == skewed.groupby("g").size()).all()


def test_hash_rank_is_md5_order(spark, skewed):
    df = spark.createDataFrame(skewed[["id"]])
    got = K.hash_rank(df, seeded_key(7, "id"), "id", "k").toPandas().sort_values("k")
    import hashlib

    want = sorted(skewed.id, key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
    assert got.id.tolist() == want


@pytest.mark.parametrize("rows", [None, 10_000])
def test_quantiles(spark, skewed, rows):
    df = spark.createDataFrame(skewed)
    got = K.quantiles(df, "v", (0.0, 0.1, 0.5, 0.999, 1.0), ["g"], rows).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        np.testing.assert_allclose(got.loc[g].to_numpy(float), np.quantile(part.v, [0.0, 0.1, 0.5, 0.999, 1.0]), atol=1e-12)


def test_quantiles_without_groups(spark, skewed):
    got = K.quantiles(spark.createDataFrame(skewed), "v", (0.25, 0.77)).first()
    np.testing.assert_allclose([got.q0, got.q1], np.quantile(skewed.v, [0.25, 0.77]), atol=1e-12)


def test_average_ranks(spark, skewed):
    got = K.average_ranks(spark.createDataFrame(skewed), [], "v", "r").toPandas().set_index("v").r
    want = skewed.assign(r=skewed.v.rank()).groupby("v").r.first()
    pd.testing.assert_series_equal(got.sort_index(), want, check_names=False)


def test_running_before(spark, skewed):
    got = K.running_before(
        spark.createDataFrame(skewed), ["g"], ("major", "minor"), 7, {"c": F.lit(1), "s": F.col("v")}
    ).toPandas()
    for r in got.sample(60, random_state=0).itertuples():
        before = skewed[(skewed.g == r.g) & ((skewed.major < r.major) | ((skewed.major == r.major) & (skewed.minor < r.minor)))]
        assert r.c == len(before)
        assert abs(r.s - before.v.sum()) < 1e-9


@pytest.mark.parametrize("n,total", [(5, 23), (100, 37), (100, 612), (3, 3)])
def test_ntile(spark, n, total):
    df = spark.range(1, total + 1).withColumn("t", F.lit(total))
    got = [r[0] for r in df.select(K.ntile_of("id", "t", n)).collect()]
    want = np.concatenate([np.full(len(a), i) for i, a in enumerate(np.array_split(np.arange(total), n))])
    assert got == want.tolist()


def test_dense_ids(spark):
    ids = [3, 900_000, 17, 65_536, 12]
    got = K.dense_ids(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 100).collect()
    assert {r.k: r.id for r in got} == {k: 100 + i for i, k in enumerate(sorted(ids))}


def test_hot_session_bars_equal_plain_bars(spark, market):
    cols = ["l_suppkey as session", "l_extendedprice as px", "l_shipdate as day", "l_orderkey as order_key", "l_linenumber as line", "l_partkey as part"]
    ticks = market.table("lineitem").selectExpr(*cols)
    # most rows moved to one session
    ticks = ticks.withColumn("session", F.when(F.col("session") < 7, 0).otherwise(F.col("session")))
    plain = ticks_to_bars(ticks).orderBy("session", "bar_ix").toPandas()
    split = ticks_to_bars(ticks, hot_rows=700).orderBy("session", "bar_ix").toPandas()
    pd.testing.assert_frame_equal(plain, split)
