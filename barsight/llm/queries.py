"""Registered queries of the numbered operators, over their whole tables."""

import os

from pyspark.sql import functions as F

from barsight.llm import (
    class_lm,
    exact_dedup,
    html_main,
    imatch,
    near_dedup,
    packing,
    personal,
    pieces,
    quality,
    resampling,
    secret_scan,
    substring_dedup,
    vector_codes,
)

QUERIES, ORACLE = {}, {}


def table(spark, path, name):
    return spark.read.parquet(os.path.join(path, f"{name}.parquet"))


def query(name, sql=None):
    def put(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return put


@query("op9_near_dedup")
def op9(spark, path):
    return near_dedup.near_groups(table(spark, path, "documents"), k=2)


@query(
    "op10_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
      FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS kept,
           sha256(body) AS text_sha256
    FROM t
    """,
)
def op10(spark, path):
    return exact_dedup.exact_groups(table(spark, path, "documents"))


@query(
    "op1_substring_dedup",
    r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), t AS (
      SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
    ), g AS (
      SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + 12], ' ')) AS low FROM t
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM g WHERE low < doc_id
    ), per AS (
      SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
    )
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words ELSE
             [words[x] FOR x IN range(1, len(words) + 1) IF NOT list_contains(places, x)] END, ' '), ''))
             AS kept_sha256
    FROM w LEFT JOIN per USING (doc_id)
    """,
)
def op1(spark, path):
    return substring_dedup.remove_repeats(table(spark, path, "documents"))


@query("op2_pack")
def op2(spark, path):
    return packing.pack(table(spark, path, "documents")).drop("ids")


@query("op5_quality")
def op5(spark, path):
    return quality.quality_scores(table(spark, path, "documents"), table(spark, path, "labels"))


@query("op8_fingerprints")
def op8(spark, path):
    return imatch.fingerprints(table(spark, path, "documents"))


@query("op7_class_lm")
def op7(spark, path):
    return class_lm.text_scores(table(spark, path, "documents"))


@query("op4_html_main_text")
def op4(spark, path):
    return html_main.extract(table(spark, path, "pages"))


@query("op3_pieces")
def op3(spark, path):
    return pieces.encode(table(spark, path, "documents")).drop("ids")


@query("op6_secret_scan")
def op6(spark, path):
    found = secret_scan.scan(table(spark, path, "documents"))
    return found.select(
        "doc_id", "start", F.length("candidate").alias("length"), "occurrences", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret"
    )


@query(
    "op11_importance_sample",
    r"""
    WITH crc AS MATERIALIZED (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
        FROM range(256) r(i))
    ), texts AS (
      SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
    ), words AS (
      SELECT side, id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM texts
    ), runs AS (
      SELECT side, r, array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS n
      FROM (SELECT side, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) s(k))
      GROUP BY ALL
    ), hashed AS (
      SELECT f, xor(list_reduce(range(length(hex(encode(f))) // 2),
                    lambda c, j: xor(c // 256, t[1 + xor(c % 256, CAST('0x' || substr(hex(encode(f)), 2 * j + 1, 2) AS BIGINT))]),
                    4294967295), 4294967295) % 10000 AS b
      FROM (SELECT DISTINCT f FROM runs), crc
    ), per AS (
      SELECT side, r, b, CAST(sum(n) AS BIGINT) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL
    ), bucket AS (
      SELECT b, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM per GROUP BY b
    ), sums AS (
      SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM bucket
    ), gain AS (
      SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
      FROM bucket, sums
    ), weighed AS (
      SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight
      FROM per JOIN gain USING (b) WHERE side = 'd' GROUP BY r
    ), scored AS (
      SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM words LEFT JOIN weighed USING (r) WHERE side = 'd'
    ), drawn AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
    )
    SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
    FROM scored s LEFT JOIN drawn d ON s.doc_id = d.doc_id
    """,
)
def op11(spark, path):
    return resampling.importance_sample(table(spark, path, "documents"), table(spark, path, "benchmark"))


def _codebook_sql(rounds=2):
    """Rounds of assignment and floored means, one pair of expressions a round."""
    text = r"""
    WITH kept AS (
      SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), parts AS (
      SELECT vec_id, label, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS c FROM kept, range(16) r(p)
    ), book0 AS (
      SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, c FROM parts
      QUALIFY e < 64
    )"""
    for k in range(rounds + 1):
        text += f""", near{k} AS (
      SELECT vec_id, label, p, any_value(c) AS c, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
      FROM (SELECT a.vec_id, a.label, a.p, a.c, b.e, list_sum([power(a.c[i] - b.c[i], 2)::BIGINT FOR i IN range(1, len(a.c) + 1)])::BIGINT AS d
            FROM parts a JOIN book{k} b USING (p))
      GROUP BY vec_id, label, p
    )"""
        if k < rounds:
            text += f""", means{k} AS (
      SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
      FROM (SELECT p, e, i, CAST(sum(c[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS i FROM near{k}) GROUP BY ALL)
      GROUP BY p, e
    ), book{k + 1} AS (
      SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e)
    )"""
    return text + f""", coded AS (
      SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
    FROM coded
    """


@query("op12_vector_codes", _codebook_sql())
def op12(spark, path):
    return vector_codes.compress(table(spark, path, "embeddings"))


@query("op13_personal_data")
def op13(spark, path):
    return personal.summary(personal.find(table(spark, path, "documents")))
