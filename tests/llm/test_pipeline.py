"""The pipeline's stages against brute force, and the queries against their SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import mixing, pii, queries, quality_model
from tests.comparing import oracle, rows
from tests.llm import brute
from tests.llm.test_near_stage import components


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, data, name):
    assert rows(queries.queries()[name](spark, data).toPandas()) == rows(oracle(queries.oracle_sql()[name], data))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    own = dict(corpus_pipeline.STAGES)
    kept = own["quality"](spark, docs, data)
    model = quality_model.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model).collect()}
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted(i for i, s in scores.items() if s >= 0.3) and kept.columns == docs.columns
    kept = kept.cache()
    one = own["near_duplicates"](spark, kept, data)
    plain = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, _, c in components(plain, 5, 80) if c == i) and one.columns == docs.columns
    clean = own["personal_data"](spark, one, data)
    text = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in clean.collect():
        assert r["text"] == pii.mask(text[r["doc_id"]], pii.spans(text[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    mixed = own["mix"](spark, clean, data)
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(clean).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v} and mixed.columns == docs.columns
    assert own["tokens"](spark, mixed, data).count() == mixed.count()


def test_run_is_the_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert rows(out.toPandas()) == rows(docs.toPandas())


def test_odd_rows(spark, data):
    docs = brute.documents(spark).withColumns({c: F.lit("clash") for c in ("_tag", "_tagn", "_place", "row", "rate", "_k", "words", "doc_id_", "_row")})
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, data)
            n = out.count()
            assert n <= 3 * df.count(), name
            if name != "tokens":
                assert out.columns == docs.columns
    one = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data)
    assert one.where("doc_id = 6").count() == 1 and one.where(F.col("doc_id").isNull()).count() == 2


def test_one_id_of_two_documents(spark, data):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, "another text altogether", "en", "a", 1), (1, text, "en", "b", 2), (None, text + " end", "en", "a", 1), (2, text + " end", "fr", "c", 1), (3, "", "en", "a", 1), (3, None, "en", "a", 1), (3, "", "en", "b", 1)]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, brute.SCHEMA), data).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], rows[1], rows[5], rows[6]]))
