"""The pipeline's stages against plain versions of what each decides."""

import os

import corpus_pipeline
from barsight.llm import queries, quality, secret_scan

from .test_dedup import exact, near
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = os.path.join(str(tmp_path), name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name == "pack":
            used, least = check(list(before.items()), after.collect())
            assert used <= least * 1.02 + 1
            break
        assert after.columns == columns
        left = {r["doc_id"]: r["text"] for r in after.collect()}
        rows = list(before.items())
        if name == "quality":
            scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
            assert set(left) == {r["doc_id"] for r in scores.collect()}
        elif name == "exact_dedup":
            assert set(left) == {i for i, _, _, kept, _ in exact(rows) if kept}
        elif name == "near_dedup":
            assert set(left) == {i for i, (_, root) in near(rows, 5).items() if i == root}
        elif name == "secrets":
            found = secret_scan.scan(docs).where("is_secret").collect()
            for r in sorted(found, key=lambda r: -len(r["candidate"])):
                before[r["doc_id"]] = before[r["doc_id"]].replace(r["candidate"], secret_scan.MASK)
            assert left == before
        docs = after


def test_stage_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "pack"]
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
