import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sample
from crawlspark.sources import documents
from crawlspark.sources.config import read_config
from crawlspark.sources.messages import read_messages


def test_lenient_strict_and_malformed(spark):
    rows = spark.createDataFrame(
        [('{"k":1}',), ('{"k":1,"x":2}',), ('{"k":',), ('{"k":"n"}',), ("{}",)], "doc string"
    )
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    found = rows.select(
        documents.decode_status(F.col("doc"), schema),
        documents.decode_lenient(F.col("doc"), schema)["k"],
        documents.decode_strict(F.col("doc"), schema)["k"],
    ).collect()
    assert [tuple(r) for r in found] == [
        ("OK", 1, 1),
        ("UNKNOWN_FIELD", 1, None),
        ("MALFORMED", None, None),
        ("MALFORMED", None, None),
        ("OK", None, None),
    ]


def test_index_document_round_trip(spark):
    at = datetime.datetime(2024, 2, 29, 6, 7, 8, 90_000)
    doc = documents.crawled_content_document(
        F.lit("sha1:AB:c9"), F.lit("rec-4"), F.lit("https://shop.test/a?b=1"), F.lit(at)
    )
    text = spark.range(1).select(doc).first()[0]
    fields = {"date": at.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "digest": "sha1:AB:c9"}
    fields |= {"targetUri": "https://shop.test/a?b=1", "warcId": "rec-4"}
    assert json.loads(text) == fields
    back = documents.decode_lenient(F.lit(text), "digest string, targetUri string, warcId string, date timestamp")
    row = spark.range(1).select(back.alias("d")).select("d.*").first()
    assert (row.digest, row.warcId, row.date) == ("sha1:AB:c9", "rec-4", at)


def test_strict_reading_at_every_depth(spark):
    inner = T.StructType([T.StructField("k", T.IntegerType())])
    schema = T.StructType(
        [T.StructField("a", inner), T.StructField("l", T.ArrayType(inner)), T.StructField("m", T.MapType(T.StringType(), inner))]
    )
    cases = {
        '{"a":{"k":1},"l":[{"k":2}],"m":{"x":{"k":3}}}': "OK",
        '{"a":null,"l":[null],"m":null}': "OK",
        '{"a":{"k":1,"z":2}}': "UNKNOWN_FIELD",
        '{"l":[{"k":1},{"z":2}]}': "UNKNOWN_FIELD",
        '{"m":{"x":{"z":{}}}}': "UNKNOWN_FIELD",
        '{"a":{"k":"n"}}': "MALFORMED",
    }
    rows = spark.createDataFrame([(doc,) for doc in cases], "doc string")
    found = rows.select("doc", documents.decode_status(F.col("doc"), schema)).collect()
    assert dict(map(tuple, found)) == cases


def test_unset_fields_are_left_out(spark):
    doc = documents.encode(a=F.lit(None).cast("string"), b=F.lit("x"))
    assert spark.range(1).select(doc).first()[0] == '{"b":"x"}'


def test_config_defaults_and_files(spark, tmp_path):
    rows = {r.collection_id: r for r in sample.config(spark).collect()}
    assert (rows["c1"].dedup_policy, rows["c1"].rotation_policy, rows["c1"].compress) == ("HOURLY", "MONTHLY", False)
    assert rows["c2"].compress and rows["c1"].file_size == 0
    assert [rows[c].sufficient for c in ("c1", "c2", "c3")] == [True, True, False]
    (tmp_path / "config.json").write_text("\n".join(sample.CONFIG_DOCUMENTS))
    read = read_config(spark, str(tmp_path))
    assert read.schema == sample.config(spark).schema
    assert sorted(map(str, read.collect())) == sorted(map(str, rows.values()))


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_messages_are_stored_either_way(spark, tmp_path, form):
    rows = sample.messages(spark, sample.session())
    rows.write.format(form).save(str(tmp_path / form))
    read = read_messages(spark, str(tmp_path / form), form)
    assert read.select("seq", "kind", "data").exceptAll(rows.select("seq", "kind", "data")).count() == 0
    assert read.where(f"meta.record_meta[1].size = {sample.RESPONSE_SIZE}").count() == 1
