"""Result store: aborted, concurrent and retried runs."""

import pytest

from barsight.operators import events as E
from barsight.operators.scoring import word_list_scorer
from barsight.streaming.incremental import score_incrementally
from barsight.streaming.store import ResultStore

SCHEMA = "id long, text string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_aborted_run_is_never_read(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), SCHEMA)
    assert store.version() == 0 and ids(store.read()) == []
    store.append(rows(spark, 1, 2))
    store.stage(rows(spark, 3))
    assert ids(store.read()) == [1, 2] and store.version() == 1


def test_concurrent_commits_both_stay(spark, tmp_path):
    a, b = (ResultStore(spark, str(tmp_path / "s"), SCHEMA) for _ in range(2))
    first, second = a.stage(rows(spark, 1)), b.stage(rows(spark, 2))
    seen = b.version
    # b looks before a commits and proposes the same number
    stale = [0]
    b.version = lambda: stale.pop() if stale else seen()
    assert a.commit(first) == 1
    assert b.commit(second) == 2
    assert ids(a.read()) == [1, 2] and ids(a.read(1)) == [1]


def test_retried_run_is_committed_once(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), SCHEMA)
    assert [store.append(rows(spark, 1), key="job"), store.append(rows(spark, 1), key="job")] == [1, 1]
    assert ids(store.read()) == [1]


def test_failed_scorer_leaves_the_store(spark, tmp_path):
    heads = spark.createDataFrame([(1, 2, "good win"), (1, 3, "bad loss")], "session long, bar_ix int, headline string")
    path = str(tmp_path / "s")
    score_incrementally(heads.limit(1), path)

    def broken(texts):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        score_incrementally(heads, path, broken)
    scored, fresh = score_incrementally(heads, path, word_list_scorer)
    assert scored.count() == 2 and fresh.count() == 1


def test_last_events_over_bucket_edges_and_full_cells(spark):
    # one busy company, a very full bar, sessions in several buckets
    data = [(i, "A" if i % 5 else None if i % 2 else "B", (i * 7) % 40, i % 3, i / 10) for i in range(300)]
    data += [(1000 + i, "A", 11, 1, 0.5) for i in range(200)]
    df = spark.createDataFrame(data, "event_id long, company string, session long, bar_ix int, sentiment_score double")
    for k, width in ((3, 4), (5, 1000)):
        got = {}
        for r in E.last_events(df, k, width, salts=4).collect():
            got.setdefault(r["event_id"], {})[r["back"]] = (r["prior_session"], r["prior_bar_ix"], r["prior_event_id"])
        for i, company, session, bar, _ in data:
            earlier = sorted(((s, b, e) for e, c, s, b, _ in data if c == company and company and (s, b) < (session, bar)), reverse=True)[:k]
            assert [got.get(i, {}).get(j + 1) for j in range(len(earlier))] == earlier and len(got.get(i, {})) == len(earlier)


def test_texts_are_not_keys_of_shuffles(spark):
    from barsight.operators.events import upsert_results
    from barsight.streaming.incremental import pending

    heads = spark.createDataFrame([(1, 2, "up", 0), (1, 2, "up", 1), (1, 3, "up", 2), (2, 2, "down", 3), (2, 2, None, 4)], "session long, bar_ix int, headline string, event_id long")
    stored = spark.createDataFrame([(1, 2, "up", "A", "buy"), (1, 2, "up", "B", "buy"), (2, 2, "down", None, None), (2, 2, None, "C", "buy")], "session long, bar_ix int, headline string, company string, sentiment string")
    open_ = pending(heads, stored)
    assert {tuple(r) for r in open_.collect()} == {(1, 3, "up"), (2, 2, "down"), (2, 2, None)} and open_.count() == 3
    out = upsert_results(heads, stored, ("company", "sentiment"))
    assert out.columns == ["session", "bar_ix", "headline", "event_id", "company", "sentiment"]
    assert {r["event_id"]: r["company"] for r in out.collect()} == {0: "B", 1: "B", 2: None, 3: None, 4: None}
    for df in (open_, out):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert joins and not any("headline" in line for line in joins)
