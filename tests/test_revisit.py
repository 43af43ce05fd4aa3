import datetime
import random

import pytest
from pyspark.sql import functions as F

import sample
from crawlspark.operators import revisit
from crawlspark.operators.skew import attach
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings
from crawlspark.sources import crawled_index
from crawlspark.workspace import shared_dir

KEYED = (
    "request_id long, record_num int, revisit_key string, warc_id string, target_uri string, "
    "fetch_ts timestamp, bucket string"
)
DAY = datetime.datetime(2024, 1, 1)


def keyed(spark, rows):
    full = [(r, n, key, f"id-{r}-{n}", f"http://x/{r}", DAY, "") for r, n, key in rows]
    return spark.createDataFrame(full, KEYED)


def decisions(frame):
    return {
        (r.request_id, r.record_num): (
            r.is_revisit,
            r.reference and (r.reference.request_id, r.reference.record_num),
            r.registers,
        )
        for r in frame.collect()
    }


SAME_SESSION = [
    (1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (3, 0, "b"), (3, 1, "a"), (4, 0, None), (5, 0, "b"),
]


@pytest.mark.parametrize("salts", [1, 3, 256])
def test_copies_within_a_session_stay_originals(spark, salts):
    found = decisions(revisit.detect_revisits(keyed(spark, SAME_SESSION), salts))
    assert found == {
        (1, 0): (False, None, True),
        (1, 1): (False, None, False),
        (2, 0): (True, (1, 0), False),
        (3, 0): (False, None, True),
        (3, 1): (True, (1, 0), False),
        (4, 0): (False, None, False),
        (5, 0): (True, (3, 0), False),
    }


def test_hot_key_equals_brute_force(spark):
    random.seed(7)
    rows = [(i // 2, i % 2, "hot" if random.random() < 0.4 else f"k{random.randrange(200)}") for i in range(3000)]
    first = {}
    for r, n, key in rows:
        first[key] = min(first.get(key, (r, n)), (r, n))
    found = decisions(revisit.detect_revisits(keyed(spark, rows), 16))
    assert len(found) == len(rows)
    for r, n, key in rows:
        duplicate = first[key][0] != r
        assert found[(r, n)] == (duplicate, first[key] if duplicate else None, first[key] == (r, n))
    firsts = revisit.first_writer(keyed(spark, rows), 16)
    assert {r.revisit_key: (r.request_id, r.record_num) for r in firsts.collect()} == first


def test_stored_rows_win_and_a_repeat_changes_nothing(spark):
    path = shared_dir(spark, "crawled")
    rows = keyed(spark, SAME_SESSION)
    for _ in range(2):
        known = crawled_index.read_index(spark, path, before_batch=0)
        decided = revisit.detect_revisits(rows, 4, known)
        crawled_index.append_batch(revisit.index_rows(decided), path, 0)
    stored = crawled_index.read_index(spark, path)
    assert sorted((r.digest, r.request_id, r.record_num) for r in stored.collect()) == [("a", 1, 0), ("b", 3, 0)]

    later = keyed(spark, [(0, 0, "a"), (9, 0, "c"), (9, 1, "c")])
    found = decisions(revisit.detect_revisits(later, 4, crawled_index.read_index(spark, path, before_batch=1)))
    assert found == {
        (0, 0): (True, (1, 0), False),
        (9, 0): (False, None, True),
        (9, 1): (False, None, False),
    }


def test_lookup_of_a_hot_key(spark):
    probes = keyed(spark, [(i, 0, "hot" if i % 3 else f"k{i}") for i in range(600)])
    index = spark.createDataFrame([("hot", "found")], "revisit_key string, answer string")
    joined = attach(probes, index, "revisit_key", 8)
    assert joined.count() == 600
    assert joined.where("answer = 'found'").count() == joined.where("revisit_key = 'hot'").count() == 400


def test_required_fields_in_order(spark):
    rows = [("", "", "", None), ("d", "", "", None), ("d", "w", "", None), ("d", "w", "u", None), ("d", "w", "u", DAY)]
    frame = spark.createDataFrame(rows, "digest string, warc_id string, target_uri string, date timestamp")
    errors = [r.error for r in crawled_index.with_required_error(frame).collect()]
    assert [e and e.split("'")[1] for e in errors] == ["digest", "warc_id", "target_uri", "date", None]


def test_index_pruned_by_bucket(spark):
    path = shared_dir(spark, "crawled")
    buckets = ["", "2023", "202312", "2024010100", "2024010223", "2024020100"]
    rows = [(f"d{i}", "w", "u", DAY, i, 0, bucket) for i, bucket in enumerate(buckets)]
    frame = spark.createDataFrame(
        rows,
        "digest string, warc_id string, target_uri string, date timestamp, request_id long, record_num int, bucket string",
    )
    crawled_index.append_batch(frame, path, 0)
    index = crawled_index.read_index(spark, path)
    assert sorted(r.bucket for r in index.collect()) == sorted(buckets)
    in_january = crawled_index.bucket_range(index, "2024010100", "2024013123")
    assert sorted(r.digest for r in in_january.collect()) == ["d3", "d4"]
    assert [r.digest for r in crawled_index.bucket_range(index, "", "").collect()] == ["d0"]
    plan = in_january._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_keys_are_matched_by_what_spark_measures(spark):
    index = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "digest string, n int")
    keys = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("x",)], "digest string")
    found = crawled_index.matching(index, keys)
    assert sorted(r.digest for r in found.collect()) == ["k1", "k2"]
    assert "strategy=broadcast" not in found._jdf.queryExecution().logical().toString()
    assert crawled_index.known_rows(spark, shared_dir(spark, "none"), keyed(spark, [(1, 0, None)])).count() == 0


def test_sample_session_as_a_revisit(spark, scratch):
    """The stored id passes through as it is, even if it is no valid UUID."""
    messages = sample.messages(spark, sample.session())
    settings = ArchiveSettings(salts=4)
    found = archive.read_sessions(messages, sample.config(spark), settings, scratch)
    keyed_rows = archive.key_records(found.accepted(), settings, scratch)
    key = f"{sample.RESPONSE_PAYLOAD}:c1_{sample.HOUR}"
    assert [r.revisit_key for r in keyed_rows.orderBy("record_num").collect()] == [None, key]
    stored_id = "fff232109-0d71-467f-b728-de86be386c6f"
    date = datetime.datetime(2021, 8, 27, 13, 52)
    index = spark.createDataFrame(
        [(key, stored_id, "http://www.example.com", date, 0, 0, sample.HOUR)],
        "digest string, warc_id string, target_uri string, date timestamp, request_id long, record_num int, bucket string",
    )
    decided = archive.decided_records(keyed_rows, settings, scratch, index)
    request, response = decided.orderBy("record_num").collect()
    assert (request.record_type, request.block_digest) == ("REQUEST", sample.REQUEST_BLOCK)
    assert response.record_type == "REVISIT"
    assert response.size == sample.REVISIT_SIZE
    assert response.block_digest == sample.REVISIT_BLOCK
    assert response.payload_digest == sample.RESPONSE_PAYLOAD
    assert response.refers_to == f"<urn:uuid:{stored_id}>"
    assert (response.refers_to_uri, response.refers_to_date) == ("http://www.example.com", "2021-08-27T13:52:00Z")
    assert revisit.index_rows(decided).count() == 0


def test_session_goes_where_its_first_record_goes(spark):
    rows = spark.createDataFrame(
        [(1, 0, "DNS"), (1, 1, "UNDEFINED"), (2, 0, ""), (2, 1, "DNS")],
        "request_id long, record_num int, sub_collection string",
    )
    found = revisit.route_sessions(rows).select("request_id", "sub_collection").distinct()
    assert sorted(map(tuple, found.collect())) == [(1, "DNS"), (2, "UNDEFINED")]


def test_missing_digests_are_computed(spark):
    rows = spark.createDataFrame(
        [(sample.RESPONSE_HEADER, sample.PAYLOAD, "", None), (b"", b"x", "sha1:declared", "sha1:block")],
        "header binary, payload binary, payload_digest string, block_digest string",
    )
    found = revisit.measure_records(rows).select("payload_digest", "block_digest", "size", F.col("header_size")).collect()
    assert tuple(found[0]) == (sample.RESPONSE_PAYLOAD, sample.RESPONSE_BLOCK, sample.RESPONSE_SIZE, sample.REVISIT_SIZE)
    assert tuple(found[1]) == ("sha1:declared", "sha1:block", 1, 0)


def test_one_row_per_digest_also_within_a_batch(spark):
    at = sample.FETCHED
    rows = [("d", "id2", "u", at, 2, 0, "b"), ("d", "id1", "u", at, 1, 1, "b"), ("e", "id3", "u", at, 3, 0, "b"), ("h", "id4", "u", at, 4, 0, "b")]
    names = "digest string, warc_id string, target_uri string, date timestamp, request_id long, record_num int, bucket string"
    candidates, path = spark.createDataFrame(rows, names), shared_dir(spark, "index")
    held = candidates.where("digest = 'h'")
    assert {(r.digest, r.warc_id) for r in crawled_index.new_rows(candidates, held).collect()} == {("d", "id1"), ("e", "id3")}
    crawled_index.append_batch(candidates, path, 0)
    stored = crawled_index.read_index(spark, path).collect()
    assert sorted((r.digest, r.warc_id) for r in stored) == [("d", "id1"), ("e", "id3"), ("h", "id4")]
