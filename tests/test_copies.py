"""Copies of sessions: noise is drawn once per row, and model inputs read events from files."""

from pyspark.sql import functions as F

from barsight.catalog import models_q as Q
from barsight.operators import augment as A


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_noise_is_drawn_once_per_row(spark):
    rows = [(7, "path_noise_shape", 1, 28, b, 1.0, 1.2, 0.8, 1.1 + b / 100, 1.0 + b / 100) for b in range(4)]
    names = "session long, transform string, copy int, augmented_session long, bar_ix int, open double, high double, low double, close double, new_close double"
    out = A.rebuild_bars(spark.createDataFrame(rows, names), 0, 0.08)
    # three normal draws of two keys each
    assert plan_of(out).count("md5(") == 6
    for r in out.collect():
        assert r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high


def test_warped_path_is_not_sorted_for_each_row(spark):
    bars = [(s, b, 1.0, 2.0, 0.5, 1.0 + (b * b % 7) / 10) for s in (1, 2) for b in (0, 1, 2, 48, 49, 50, 51, 99)]
    bars = spark.createDataFrame(bars, "session long, bar_ix int, open double, high double, low double, close double")
    plan = A.copy_plan(bars, 4).where("transform = 'time_warp'")
    out = A.time_warp(A.log_steps(bars, plan))
    assert "sort_array" not in plan_of(out)
    ends = {(r.session, r.phase): r for r in out.groupBy("session", "phase").agg(F.max_by("new_close", "bar_ix").alias("a"), F.max_by("close", "bar_ix").alias("b")).collect()}
    # a warped segment starts and ends with its source
    assert len(ends) == 4 and all(abs(r.a - r.b) < 1e-9 for r in ends.values())


def test_inputs_read_events_of_the_seen_bars_from_files(market):
    for texts in (False, True):
        for side in Q.parts(market, texts):
            for name in ("events", "headlines"):
                assert "get_json_object" not in plan_of(side[name])
    train, test = Q.parts(market, True)
    got = train["headlines"].unionByName(test["headlines"]).select("event_id").collect()
    want = market.headlines().where("bar_ix <= 49").select("event_id").collect()
    assert sorted(got) == sorted(want)
