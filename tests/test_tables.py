"""Readers, sinks, responses and incremental scoring."""

import os

import pytest

from barsight import schemas
from barsight.operators import scoring as Z
from barsight.session import new_path, shared_dir
from barsight.sources import tables as T
from barsight.streaming.incremental import pending, score_incrementally

HEADS = [(1, 0, "Alfa Retail Group reports record growth"), (1, 3, "Beta Bank CEO warns of loss\nand, \"risk\""), (2, 1, "")]


@pytest.fixture()
def heads(spark):
    return spark.createDataFrame(HEADS, schemas.HEADLINES)


def test_optional_table_only_swallows_a_missing_path(spark, tmp_path):
    assert T.read_optional_parquet(spark, str(tmp_path / "none"), schemas.HEADLINES).count() == 0
    bad = tmp_path / "bad.parquet"
    bad.write_text("not parquet")
    with pytest.raises(Exception):
        T.read_optional_parquet(spark, str(bad), schemas.HEADLINES).count()


def test_split_allow_list(spark, tmp_path):
    with pytest.raises(ValueError):
        T.read_feature_sentiments(spark, str(tmp_path), ["unseen_train"])


def test_sentiment_csv_round_trip(spark, tmp_path, heads):
    full = Z.score_headlines(heads)
    folder = str(tmp_path)
    cols = [f.name for f in schemas.SENTIMENTS.fields]
    full.select(*cols).write.options(**T.CSV_OPTIONS).csv(os.path.join(folder, T.SENTIMENTS["seen_train"]))
    got = T.read_sentiments(spark, folder, "seen_train").where("headline is not null").toPandas()
    assert set(got.headline) == {HEADS[0][2], HEADS[1][2]}
    assert set(got.sign) <= {1.0, -1.0}


def test_submission_checks(spark, tmp_path):
    good = spark.createDataFrame([(2, 0.5), (1, -0.5)], schemas.SUBMISSION)
    path = str(tmp_path / "sub")
    assert T.write_submission(good, path, 2) == 2
    assert [r.session for r in T.read_submission(spark, path).collect()] == [1, 2]
    with pytest.raises(ValueError):
        T.write_submission(good.unionByName(good), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        T.write_submission(good, str(tmp_path / "y"), 3)


def test_incremental_scoring(spark, heads):
    path = new_path(spark, "cache")
    first, fresh = score_incrementally(heads.limit(1), path)
    assert fresh.count() == 1
    scored, fresh = score_incrementally(heads, path)
    assert fresh.count() == 2 and scored.count() == 3
    _, fresh = score_incrementally(heads, path)
    assert fresh.count() == 0
    assert pending(heads, spark.read.schema(Z.RESULT_SCHEMA).parquet(path)).count() == 0


def test_scored_columns(heads):
    got = {r.bar_ix: r for r in Z.score_headlines(heads, batch_size=1).collect()}
    assert got[0].company == "Alfa" and got[0].granular_sector == "Retail Group"
    assert got[3].granular_sector == "Bank" and got[3].sentiment == "sell"
    assert got[1].company == "None" and got[1].granular_sector == "None"


def test_responses(spark):
    req = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "batch_id long, id int")
    text = 'ok {"results":[{"id":0,"company":"None","sentiment":"buy","confidence":0.7,"reasoning":"r"}]} bye'
    res = spark.createDataFrame([(1, text), (2, "no json")], "batch_id long, response string")
    got = {(r.batch_id, r.id): r for r in Z.apply_responses(req, res).collect()}
    assert got[1, 0].company is None and got[1, 0].sentiment == "buy"
    assert got[1, 1].sentiment is None
    assert "Failed to parse" in got[2, 0].reasoning


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir() or shared_dir(spark)
    assert new_path(spark, "a") != new_path(spark, "a")


def test_row_profile(spark, market, tmp_path):
    p = T.export_with_profile(market.bars(), str(tmp_path / "e")).toPandas().set_index("column")
    assert p.loc["close", "type"] == "double" and (p.rows == 1000).all()
