"""Registry of queries and the shared parts of their reference SQL."""

from pyspark.sql import functions as F, types as T

from barsight.sources.market import Market

QUERIES = {}
ORACLE = {}

# Added before rounding on both sides so that halves never sit on the edge.
NUDGE = "3.7e-10"


def tidy(df, places=6):
    """Doubles rounded, integers and flags as 64-bit integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + float(NUDGE), places)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name, sql=None, places=6):
    """Register ``fn(market) -> DataFrame`` under a name, with optional reference SQL."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, path):
            return tidy(fn(Market(spark, path)), places)

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# Named sub-queries; each may use the ones listed before the text.
PARTS = {
    "ticks": ((), """
        SELECT l_suppkey AS session, l_extendedprice AS px, row_number() OVER w AS tick,
               ntile(100) OVER w - 1 AS bar_ix
        FROM lineitem WINDOW w AS (PARTITION BY l_suppkey
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"""),
    "base": (("ticks",), "SELECT session, min_by(px, tick) AS p0 FROM ticks GROUP BY session"),
    "bars": (("base",), """
        SELECT t.session, t.bar_ix, min_by(px, tick) / max(p0) AS open, max(px) / max(p0) AS high,
               min(px) / max(p0) AS low, max_by(px, tick) / max(p0) AS close
        FROM ticks t JOIN base b ON t.session = b.session GROUP BY t.session, t.bar_ix"""),
    "seen": (("bars",), "SELECT * FROM bars WHERE bar_ix <= 49"),
    "unseen": (("bars",), "SELECT * FROM bars WHERE bar_ix >= 50"),
    "sent": ((), """
        SELECT event_id, user_id % (SELECT count(*) FROM supplier) AS session,
               least(99, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6
                   / (30 * 86400) * 100) AS INT)) AS bar_ix,
               CASE WHEN event_type IN ('purchase','signup','click') THEN 'buy' ELSE 'sell' END AS sentiment,
               round((CASE WHEN event_type IN ('purchase','signup','click') THEN 1 ELSE -1 END)
                   * (1 - exp(-value / 50)), 4) AS sentiment_score,
               CAST(round(0.5 + (k % 50) / 100.0, 2) AS DOUBLE) AS confidence,
               'C' || (k % 12) AS company, event_type AS sector,
               event_type || '_' || (k % 3) AS granular_sector,
               CASE WHEN event_type IN ('purchase','signup','click') THEN 1.0 ELSE -1.0 END::DOUBLE AS sgn
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""),
    "head": (("sent",), """
        SELECT s.event_id, s.session, s.bar_ix, d.text AS headline
        FROM sent s JOIN documents d ON d.doc_id = s.event_id % (SELECT count(*) FROM documents)"""),
    "ev": (("sent",), """
        SELECT *, exp(-ln(2.0) * greatest(49 - bar_ix, 0) / 10.0) * confidence AS w,
               sentiment_score * exp(-ln(2.0) * greatest(49 - bar_ix, 0) / 10.0) * confidence AS sw,
               sgn * exp(-ln(2.0) * greatest(49 - bar_ix, 0) / 10.0) * confidence AS gw
        FROM sent WHERE bar_ix <= 49"""),
    "rets": (("seen",), """
        SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS ret,
               row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session) AS n,
               count(*) OVER (PARTITION BY session) - row_number() OVER w AS rev,
               max(close) OVER w AS run_max, min(close) OVER w AS run_min,
               ln(greatest(close, 1e-12)) AS lc,
               ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) OVER w AS lr
        FROM seen WINDOW w AS (PARTITION BY session ORDER BY bar_ix)"""),
    "base9": (("rets", "sent"), """
        SELECT r.session, min_by(open, bar_ix) AS open_first, max_by(close, bar_ix) AS close_last,
               max_by(close, bar_ix) / min_by(open, bar_ix) - 1 AS cum_ret, stddev_pop(ret) AS vol,
               max(high) - min(low) AS range_hl, max(high) AS max_high, min(low) AS min_low,
               avg(ret) AS mean_bar_ret, max(coalesce(h.c, 0)) AS headline_count
        FROM rets r LEFT JOIN (SELECT session, count(*) AS c FROM sent WHERE bar_ix <= 49 GROUP BY 1) h
          ON r.session = h.session GROUP BY r.session"""),
    "labels_all": (("bars",), """
        SELECT session, max(CASE WHEN bar_ix = 49 THEN close END) AS close_half,
               max(CASE WHEN bar_ix = 99 THEN close END) AS close_end,
               max(CASE WHEN bar_ix = 99 THEN close END) / max(CASE WHEN bar_ix = 49 THEN close END) - 1 AS R
        FROM bars WHERE bar_ix IN (49, 99) GROUP BY session"""),
    "train_labels": (("labels_all",), "SELECT * FROM labels_all WHERE session % 10 <= 5"),
    "preds": (("base9",), """
        SELECT session, mu, 1 / (1 + exp(-5 * mu)) AS p_up, mu - u / 2 AS q_lower, mu AS q_median,
               mu + u / 2 AS q_upper, u
        FROM (SELECT session, cum_ret / 10 AS mu, greatest(vol, 1e-4) AS u FROM base9)"""),
}


def with_parts(*names, **extra):
    """WITH clause of the named parts, dependencies first, then extra sub-queries in order."""
    order = []

    def visit(name):
        for need in PARTS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    texts = [f"{n} AS ({PARTS[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return "WITH " + ",\n".join(texts) + "\n" if texts else ""


def shaped(columns, body, *names, places=6, **extra):
    """Final SELECT. ``columns``: names with :i integer, :s text, or double by default."""
    out = []
    for c in columns.split() if isinstance(columns, str) else columns:
        name, _, kind = c.partition(":")
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "s":
            out.append(f'"{name}"')
        else:
            out.append(f'round(CAST("{name}" AS DOUBLE) + {NUDGE}, {places}) AS "{name}"')
    return with_parts(*names, **extra) + f"SELECT {', '.join(out)} FROM (\n{body}\n)"
