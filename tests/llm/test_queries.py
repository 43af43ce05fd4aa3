"""The registered queries of this subpackage against their SQL twins and brute force."""

import re

import duckdb
import pytest

import corpus_pipeline
from check_oracle import TABLES, normal
from crawlspark.llm import segmentation
from crawlspark.llm.oracle import ORACLE
from crawlspark.llm.queries import QUERIES, SENTENCEPIECE_MODEL


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) < set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, db, name):
    found = QUERIES[name](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert normal(found.toPandas()) == normal(db.execute(ORACLE[name]).df())


def test_sharding_by_rows(spark, sf_dir, db):
    found = QUERIES["op3_sharding"](spark, sf_dir).toPandas()
    sizes = found.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert set(sizes.index) == set(range(8)) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all()
    assert (sizes["nunique"] == sizes["count"]).all()
    sizes = db.execute("SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents ORDER BY ALL").fetchall()
    assert sorted(map(tuple, found[["doc_id", "size"]].values.tolist())) == sizes


def test_classifier_on_documents_held_out(spark, sf_dir):
    found = QUERIES["op5_quality_classifier"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    seen = found[found.held_out].merge(labels, on="doc_id")
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    assert len(seen) > 20 and (seen.predicted == seen.quality).mean() > 0.95


def test_segmentations_hold_the_ids_of_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).cache()
    found = QUERIES["op6_sentencepiece"](spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi")
    vocabulary = segmentation.Vocabulary.load(SENTENCEPIECE_MODEL)
    spelled = {(r.doc_id, r.text) for r in segmentation.decoded(found, vocabulary).select("doc_id", "text").collect()}
    assert spelled == {(r.doc_id, r.text or "") for r in docs.collect()}


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks_are_the_passages_that_documents_hold(spark, sf_dir):
    found = QUERIES["op9_decontamination"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    texts = [(d, " ".join(plain(t))) for d, t in docs]
    held = {(d, i.item_id) for i in items for d, t in texts if " ".join(plain(i.text)) in t}
    assert held and set(zip(found.doc_id, found.item_id, strict=True)) == held


def test_pipeline_drops_what_its_stages_reject(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = left.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, left = left, stage(spark, left, sf_dir).cache()
        assert left.columns == names, name
        assert 0 < left.count() < before.count() or name == "benchmark decontamination"
        assert left.exceptAll(before).count() == 0
    sampled = corpus_pipeline.STAGES[4][1](spark, left, sf_dir).toPandas()
    assert set(sampled.doc_id) == {r.doc_id for r in left.select("doc_id").collect()}
    assert sampled.round_trip.all()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == len(sampled)
