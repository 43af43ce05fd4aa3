"""Revisits by keyed state: purged buckets, late records, restarts, and a start from a stored index."""

from datetime import datetime
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from crawlspark.functions.calendar import bucket_end
from crawlspark.settings import ArchiveSettings
from crawlspark.sources import crawled_index
from crawlspark.streaming import first_writers
from crawlspark.workspace import shared_dir

HOUR_MS = 3600 * 1000
SETTINGS = ArchiveSettings(index_buckets=2, salts=4, order="arrived")
ROW = (
    "revisit_key string, request_id long, record_num int, warc_id string, target_uri string, fetch_ts timestamp, "
    "bucket string, arrived long, ingested timestamp"
)


def rows(spark, minute, *records):
    """Keyed records (key, request, number, bucket, arrived) that come in at 10:00 plus some minutes."""
    at = datetime(2024, 1, 1, 10 + minute // 60, minute % 60)
    found = [(k, r, n, f"w{r}-{n}", "u", datetime(2024, 1, 1, 10), bucket, arrived, at) for k, r, n, bucket, arrived in records]
    return spark.createDataFrame(found, ROW)


def test_bucket_ends(spark):
    buckets = ["2023", "202402", "20231231", "2024010123", "", None, "20"]
    frame = spark.createDataFrame([(b,) for b in buckets], "b string")
    found = [r[0] for r in frame.select(F.date_format(bucket_end(F.col("b")), "yyyy-MM-dd HH")).collect()]
    assert found == ["2024-01-01 00", "2024-03-01 00", "2024-01-01 00", "2024-01-02 00", None, None, None]
    oslo = frame.where("b = '2024010123'").select(F.date_format(bucket_end(F.col("b"), "Europe/Oslo"), "yyyy-MM-dd HH"))
    assert oslo.first()[0] == "2024-01-01 23"


class Kept:
    """The one state of a key; counts the calls to it."""

    def __init__(self):
        self.row, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.row is not None

    def get(self):
        self.calls += 1
        return self.row

    def update(self, row):
        self.calls += 1
        self.row = row


def test_keys_pass_as_rows_with_few_calls_to_the_state():
    made = first_writers.FirstWriters(HOUR_MS)
    made.first = Kept()
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)

    def give(*records):
        own = [Row(revisit_key="k", request_id=r, record_num=n, warc_id="w", target_uri=None, fetch_us=5, bucket="", arrived=a, ends_ms=first_writers.NEVER_MS) for r, n, a in records]
        out = made.handleInputRows(("k",), iter(own), watermark)
        return [(r.request_id, r.late, r.is_revisit, r.registers, r.ref_request_id) for r in out]

    # Null arrivals come last.
    assert give((1, 0, None), (2, 0, 7), (2, 1, 7)) == [(1, False, True, False, 2), (2, False, False, True, None), (2, False, False, False, None)]
    assert made.first.calls == 2
    assert give((3, 0, 1)) == [(3, False, True, False, 2)]
    assert made.first.calls == 4


def test_state_is_bounded_and_late_records_use_the_index(spark):
    path, source = shared_dir(spark, "path"), shared_dir(spark, "source")
    stored = rows(spark, 0, ("old", 0, 0, "", 0), ("x", 0, 1, "2024010110", 0)).withColumnsRenamed({"revisit_key": "digest", "fetch_ts": "date"})
    crawled_index.append_batch(stored.drop("arrived", "ingested"), f"{path}/crawled", 0, 2)
    known = crawled_index.read_index(spark, f"{path}/crawled")
    state = []

    def feed(frame):
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        query = first_writers.start(stream, path, SETTINGS, HOUR_MS, known, first_batch=1, availableNow=True)
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    hour = "2024010110"
    many = [(f"k{i}", 100 + i, 0, hour, i) for i in range(20)]
    # Of one micro-batch the earliest arrival is first; a session does not repeat itself.
    feed(rows(spark, 30, ("a", 3, 0, hour, 2), ("a", 4, 0, hour, 1), ("a", 4, 1, hour, 1), ("old", 5, 0, "", 3), ("x", 6, 0, hour, 4), *many))
    feed(rows(spark, 185, ("c", 7, 0, "2024010113", 5), ("old", 8, 0, "", 6)))
    feed(rows(spark, 186, ("a", 9, 0, hour, 7), ("k5", 10, 0, hour, 8), ("new", 11, 0, hour, 9), ("new", 12, 0, hour, 10), ("c", 13, 0, "2024010113", 11)))
    feed(rows(spark, 187, ("new", 14, 0, hour, 12)))
    found = {(r.request_id, r.record_num): (r.is_revisit, r.reference and r.reference.request_id) for r in first_writers.read_decided(spark, path).collect()}
    expected = {
        (3, 0): (True, 4), (4, 0): (False, None), (4, 1): (False, None), (5, 0): (True, 0), (6, 0): (True, 0), (7, 0): (False, None),
        (8, 0): (True, 0), (9, 0): (True, 4), (10, 0): (True, 105), (11, 0): (False, None), (12, 0): (True, 11), (13, 0): (True, 7),
        (14, 0): (True, 11),
    }
    assert {k: v for k, v in found.items() if k[0] < 100} == expected
    assert all(found[100 + i, 0] == (False, None) for i in range(20))
    # Two keys without an end and one of a bucket still open are left of 25.
    assert max(state[2:]) < state[0] / 2, state
    index = {r.digest: r.request_id for r in crawled_index.read_index(spark, f"{path}/crawled").collect()}
    assert {k: index[k] for k in ("old", "x", "a", "c", "new", "k5")} == {"old": 0, "x": 0, "a": 4, "c": 7, "new": 11, "k5": 105}
    assert len(index) == 25
