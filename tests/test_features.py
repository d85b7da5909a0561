"""Hand-made sessions: short, flat and silent ones, guards, text features."""

import collections
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsight import schemas
from barsight.operators import bars as B, emissions as M, events as E, labels as L, news as N, rich as R


def path(session, closes, spread=0.01):
    rows, prev = [], closes[0]
    for i, c in enumerate(closes):
        rows.append((session, i, prev, max(prev, c) + spread, min(prev, c) - spread, c))
        prev = c
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(0)
    rows = path(1, [1.0]) + path(2, [1.0, 1.1]) + path(3, [1.0, 0.9, 1.2]) + path(5, [1.0] * 5, 0.0)
    rows += path(7, np.exp(np.cumsum(rng.standard_normal(50) * 0.02)).tolist())
    return spark.createDataFrame([(s, i, float(o), float(h), float(l), float(c)) for s, i, o, h, l, c in rows], schemas.BARS)


def closes(bars, s):
    return bars.where(F.col("session") == s).orderBy("bar_ix").toPandas()


def test_rich_features_are_complete(bars):
    got = R.rich_features(bars).toPandas().set_index("session")
    assert len(got.columns) == 73
    assert got.notna().all().all()
    assert np.isfinite(got.to_numpy(float)).all()
    assert got.loc[1, "ret_std"] == 0 and got.loc[1, "ret_first_10"] == 0
    assert got.loc[5, "half_vol_ratio"] == 0 and got.loc[5, "close_pos_in_range"] == 0
    assert got.loc[3, "argmax_pos"] == 1.0 and got.loc[3, "argmin_pos"] == 0.5
    assert got.loc[3, "max_drawdown"] == pytest.approx(-0.1)


def test_rich_features_against_arrays(bars):
    g = closes(bars, 7)
    got = R.rich_features(bars.where("session = 7")).toPandas().iloc[0]
    c, lc = g.close.to_numpy(), np.log(g.close.to_numpy())
    r = np.diff(lc)
    assert got.ret_skew == pytest.approx(np.mean(((r - r.mean()) / r.std()) ** 3))
    assert got.ret_ac2 == pytest.approx(np.corrcoef(r[:-2], r[2:])[0, 1])
    w = (1 - 2 / 11) ** np.arange(len(r))[::-1]
    w = w / w.sum()
    assert got.ewm_vol_10 == pytest.approx(math.sqrt(np.sum(w * (r - np.sum(w * r)) ** 2)), rel=1e-6)
    # anchors use half-even rounding: 24.5 is bar 24
    assert got.path_ret_q50 == pytest.approx(c[24] / c[0] - 1)
    assert got.slope_q2 == pytest.approx(np.polyfit(np.arange(12, 25), lc[12:25], 1)[0] * 12)
    x = np.exp(np.linspace(-2, 0, len(r)))
    assert got.recency_weighted_ret == pytest.approx(np.dot(r, x) / x.sum())


def test_path_features(bars):
    got = B.path_features(bars).toPandas().set_index("session")
    assert got.notna().all().all()
    ret = closes(bars, 7).close.pct_change().dropna()
    assert got.loc[7, "ret_skew"] == pytest.approx(ret.skew())
    assert got.loc[7, "p95_abs_bar_ret"] == pytest.approx(np.percentile(ret.abs(), 95))
    assert got.loc[3, "max_drawdown"] == pytest.approx(0.1)
    assert got.loc[5, "log_close_r2"] == 0 and got.loc[5, "ret_skew"] == 0


def test_summary_and_sequences(bars):
    em = M.emission_table(bars)
    assert em.toPandas().notna().all().all()
    assert M.session_summary(em).toPandas().notna().all().all()
    assert M.emission_table(bars.where("session = 5")).where("range_pos <> 0.5").count() == 0
    seq = B.pad_sequences(bars, 50).toPandas().set_index("session")
    assert all(len(v) == 50 for v in seq.close)
    z = np.array(seq.close[3])
    padded = np.concatenate([[1.0, 0.9], np.full(48, 1.2)])
    np.testing.assert_allclose(z, (padded - padded.mean()) / (padded.std() + 1e-8), atol=1e-6)


def test_labels(spark, bars):
    r = L.realized_returns(bars.where("bar_ix <= 49"), bars.where("bar_ix >= 50")).toPandas()
    assert r.session.tolist() == [7] and r.R.isna().all()
    assert L.realized_returns_inner(bars, bars.where("session < 0")).count() == 0


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, 7, 0, "Alfa", "x_1", "tech", "buy", 0.5, 0.9, 1.0),
        (2, 7, 3, "Alfa", "x_1", None, "sell", -0.25, 0.6, -1.0),
        (3, 7, 40, "", "x_2", "tech", "buy", 0.75, 0.95, 1.0),
        (4, 3, 2, None, None, "", "buy", 0.1, 0.5, 1.0),
    ]
    schema = "event_id long, session long, bar_ix int, company string, granular_sector string, sector string, sentiment string, sentiment_score double, confidence double, sign double"
    return spark.createDataFrame(rows, schema)


def test_sentiment_features(bars, events):
    got = N.sentiment_features(bars, events).toPandas().set_index("session")
    assert (got.loc[1] == 0).all()
    assert got.loc[7, "sector_num_unique"] == 2  # a missing sector is a category
    assert got.loc[7, "sentiment_mean_early"] == pytest.approx(0.125)
    assert got.loc[3, "sentiment_ret_corr"] == 0


def test_entity_concentration(events):
    got = N.entity_concentration(events).toPandas().set_index("session")
    assert got.loc[7, "news_top_entity_share"] == 1.0  # the empty name does not count
    assert got.loc[3].eq(0).all()
    sectors = N.sector_concentration(events).toPandas().set_index("session")
    assert sectors.loc[3, "news_sector_num_unique"] == 1


def test_leakage_guard(spark, events):
    late = events.withColumn("bar_ix", F.col("bar_ix") + 30)
    assert N.assert_no_future(events).count() == 4
    with pytest.raises(Exception, match="after decision bar"):
        N.assert_no_future(late).count()
    with pytest.raises(Exception, match="after decision bar"):
        N.news_aggregates(N.assert_no_future(late)).collect()


def test_label_checks(spark, bars):
    f = B.baseline_features(bars)
    labels = spark.createDataFrame([(7, 0.1), (99, 0.2)], "session long, R double")
    with pytest.raises(Exception, match="label without features"):
        L.join_labels(f, labels).collect()
    with pytest.raises(Exception, match="label missing"):
        L.require_labels(f, labels.where("session = 7")).collect()
    assert L.join_labels(f, labels.where("session = 7")).count() == 1
    with pytest.raises(ValueError):
        L.training_table({}, {}, within_session=True, augment=True)


TEXTS = [
    (1, 7, 0, "Épée du roi, a Épée"),
    (2, 7, 0, "  ... !"),
    (3, 7, 0, "new_office 42 opens\nİx"),
    (4, 7, 12, "x"),
    (5, 7, 30, "Roi épée"),
    (6, 8, 1, "solo"),
]


def test_fingerprint_matches_the_joined_document(spark):
    heads = spark.createDataFrame(TEXTS, "event_id long, session long, bar_ix int, headline string")
    got = N.hashed_fingerprint(heads, 16).toPandas().set_index("session")
    import unicodedata

    for s in (7, 8):
        doc = " ".join(t for _, ses, _, t in TEXTS if ses == s).lower()
        doc = "".join(c for c in unicodedata.normalize("NFKD", doc) if not unicodedata.combining(c) or c == "̇")
        tok = re.findall(r"[^\W]{2,}", doc)
        grams = tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])]
        count = collections.Counter(int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 16 for g in grams)
        v = np.array([count.get(i, 0) for i in range(16)], float)
        np.testing.assert_allclose(got.loc[s].to_numpy(float), v / np.linalg.norm(v), atol=1e-12)


def test_disabled_news_is_zero(bars, events):
    got = N.news_features(bars, events, None, enabled=False).toPandas()
    assert len(got) == 5 and (got.drop(columns="session") == 0).all().all()


def test_forward_returns_need_the_exact_bar(spark, bars):
    holes = bars.where("not (session = 7 and bar_ix = 5)")
    ev = spark.createDataFrame([(1, 7, 3), (2, 7, 5), (3, 7, 49)], "event_id long, session long, bar_ix int")
    got = E.align_forward_returns(ev, holes, (1, 2, 3)).toPandas().set_index("event_id")
    c = closes(bars, 7).close
    assert np.isnan(got.loc[1, "fwd_ret_2"]) and not got.loc[1, "valid_2"]
    assert got.loc[1, "fwd_ret_3"] == pytest.approx(math.log(c[6] / c[3]))
    assert np.isnan(got.loc[2, "close_ref"]) and np.isnan(got.loc[3, "fwd_ret_1"])


def test_company_history(market):
    ev = market.events()
    totals = E.history_totals(ev, width=2).toPandas()
    for r in totals.sample(5, random_state=1).itertuples():
        assert E.company_history(ev, r.company, r.session, r.bar_ix).count() == r.n_prior
        assert E.company_history(ev, r.company, r.session, r.bar_ix, False).count() == r.n_prior_in_session


def test_results_do_not_depend_on_partitions(spark, market):
    f = R.rich_features(market.seen())
    a = f.orderBy("session").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = R.rich_features(market.seen()).orderBy("session").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
