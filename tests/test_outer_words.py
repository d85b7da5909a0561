"""Outer words of long texts, gram hashing, scoring and split files against plain Python."""

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from barsight.functions import scalars as S
from barsight.operators import news as N, reports as P, scoring as Z

LONG = "x" * 3 * S.NEAR
TEXTS = [
    None, "", "   ", "one", "one two", " one\ttwo\nThree four", " " * 2 * S.NEAR + "one two Three four",
    f"{LONG} two Three four", f"one {LONG} three", f"a b {LONG}", "a " * S.NEAR, "word " * S.NEAR + LONG, f"{LONG}é", "Été à la Plage " * 40,
    "one two " + "." * 2 * S.NEAR, "." * 2 * S.NEAR + " last", "ab" + "c" * (S.NEAR - 2), "a" * (S.NEAR - 1) + " b c d", "\U0001d400" * S.NEAR + " bold two three",
]


def plain_words(text):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]


def test_leading_words_of_long_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for n in (1, 3):
        got = {r[0]: r[1] for r in df.select("id", S.leading_words("text", n)).collect()}
        assert got == {i: None if t is None else plain_words(t)[:n] for i, t in enumerate(TEXTS)}


def test_outer_tokens_of_long_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "id int, text string")
    for r in df.select("id", S.text_tokens("text").alias("t"), S.first_word("text").alias("a"), S.last_word("text").alias("b")).collect():
        assert (r.a, r.b) == ((r.t[0], r.t[-1]) if r.t else ("", "")), TEXTS[r.id][:40]


def test_words_are_looked_for_in_the_end_of_a_text(spark):
    """The part that is split or searched is short if the words are within it."""
    df = spark.createDataFrame([("one two three four " + LONG * 100,), ("one two" + LONG,)], "text string")
    start = S._enough(F.col("text"), F.substring("text", 1, S.NEAR), r"^\s*(?:\S+\s+){3}")
    assert [r[0] for r in df.select(F.length(start)).collect()] == [S.NEAR, 7 + len(LONG)]


def plain_hash(heads, buckets):
    counts = {}
    documents = {}
    for s, _, _, text in sorted((h for h in heads if h[3] is not None), key=lambda h: (h[0], h[1], h[2])):
        documents.setdefault(s, []).extend(re.findall(r"\w{2,}", text.lower()))
    for s, words in documents.items():
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        counts[s] = Counter(int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % buckets for g in grams)
    return counts


def test_hashed_parts_add_up(spark, monkeypatch):
    heads = [(1, 0, 0, "alpha beta alpha beta gamma"), (1, 0, 1, "beta"), (1, 3, 2, "alpha beta"), (2, 1, 3, None), (2, 1, 4, "delta " * 700 + LONG), (3, 0, 5, ". a ."), (4, 2, 6, "one two")]
    df = spark.createDataFrame(heads, "session long, bar_ix int, event_id long, headline string")
    for buckets in (32, 7):
        got = {r.session: list(r)[1:] for r in N.hashed_fingerprint(df, buckets).collect()}
        want = plain_hash(heads, buckets)
        assert set(got) == {s for s, c in want.items() if c}
        for s, values in got.items():
            norm = sum(c * c for c in want[s].values()) ** 0.5
            assert all(abs(v - want[s][i] / norm) < 1e-12 for i, v in enumerate(values))


def test_hashed_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(N, "CHUNK", 3)
    words = [["aa", "bb"], None, [], ["bb", "cc", "dd", "ee"], ["aa"], ["aa", "bb"]]
    batch = pa.record_batch({"session": pa.array([1, 1, 2, None, 1, 1]), "tok": pa.array(words, pa.list_(pa.string()))})
    total = Counter()
    for out in N._hashed([batch], 16, 2):
        for s, b, c in zip(*[x.to_pylist() for x in out.columns]):
            total[s, b] += c
    want = Counter()
    for s, w in zip([1, 1, 2, None, 1, 1], words):
        for g in [*(w or []), *[f"{a} {b}" for a, b in zip(w or [], (w or [])[1:])]]:
            want[s, int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 16] += 1
    assert total == want


def test_fingerprint_shuffles_counts_not_words(spark):
    df = spark.createDataFrame([(1, 0, 0, "alpha beta")], "session long, bar_ix int, event_id long, headline string")
    plan = N.hashed_fingerprint(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_scorer_gets_the_text_alone_in_batches(spark):
    texts = ["A record gain", "loss", "", "new news", "UP up up"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, headline string").repartition(1)
    out = Z.class_probabilities(df, batch_size=2)
    assert out.columns == ["id", "headline", "p_pos", "p_neg", "p_neu"]
    want = Z.word_list_scorer(pd.Series(texts))
    for r in out.collect():
        assert (r.headline, r.p_pos, r.p_neg, r.p_neu) == (texts[r.id], *want.loc[r.id])
    # the text does not come back from the scorer
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    sizes = []
    assert Z.class_probabilities(df, lambda t: Z.word_list_scorer(t) if len(t) <= 2 else sizes.append(1), batch_size=2).count() == len(texts)


def test_sides_and_tables_are_read_back(spark, tmp_path):
    """Split files and correlations start from written tables: the ticks are cut into bars once."""
    from barsight.catalog import QUERIES

    out = QUERIES["e30_correlation_block"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan()
    leaves = [x.toString() for x in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size()))]
    assert not any("l_suppkey" in x for x in leaves)
    assert P.correlation_block(out.withColumn("x", F.col("corr")), ["corr"], ["x"]).count() == 1


def test_copies_are_dealt_by_their_rows(spark, monkeypatch):
    """Tasks hold a bounded number of copied rows, however small the bars are before."""
    from barsight.operators import augment as A

    monkeypatch.setattr(A, "ROWS_PER_TASK", 100)
    bars = spark.range(5).withColumnRenamed("id", "session").crossJoin(spark.range(100).select(F.col("id").cast("int").alias("bar_ix")))
    bars = bars.select("*", *[(F.lit(1.0) + F.col("bar_ix") / 100 + F.col("session") / 7).alias(c) for c in ("open", "high", "low", "close")])
    rows = A.log_steps(bars, A.copy_plan(bars, 4))
    assert rows.rdd.getNumPartitions() == 21
    assert A.augment_bars(bars, A.copy_plan(bars, 4)).count() == 2000
