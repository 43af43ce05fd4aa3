"""Revisit detection with the first writer of each key in the engine's state store.

The low-latency form of ``streaming.revisit``: a micro-batch reads no index. The state begins with the rows of a stored
index. Keys of a calendar bucket are purged some time after its end, measured by the clock of ingestion, whose
watermark bounds the state; a record that comes later still is decided against the stored index instead, so none is dropped.
All rows of a key in a micro-batch meet in one task, so micro-batches are to be small; the other form spreads hot keys.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlspark.functions.calendar import bucket_end
from crawlspark.operators import revisit
from crawlspark.settings import ArchiveSettings
from crawlspark.sources import crawled_index
from crawlspark.streaming.sessions import state_store
from crawlspark.workspace import Scratch, delete_dir

_KNOWN = "revisit_key string, request_id long, record_num int, warc_id string, target_uri string, fetch_us long, bucket string"
_DECIDED = (
    f"{_KNOWN}, late boolean, is_revisit boolean, registers boolean, ref_request_id long, ref_record_num int, "
    "ref_warc_id string, ref_target_uri string, ref_us long"
)
_FIRST = ("request_id", "record_num", "warc_id", "target_uri", "fetch_us")
#: The end of a bucket that never ends.
NEVER_MS = (1 << 62) - 1


class FirstWriters(StatefulProcessor):
    """The first writer of a key: of its first micro-batch the record with the least (arrived, request, record)."""

    def __init__(self, lateness_ms: int):
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState(
            "first", "request_id long, record_num int, warc_id string, target_uri string, fetch_us long"
        )

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep(initialState, timerValues)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, registering = self.first.get() if self.first.exists() else None, None
        if known is None:
            rows = list(rows)
            if self._over(rows[0]["ends_ms"], timerValues):
                for row in rows:
                    yield _decided(row, True, None, None)
                return
            least = min(rows, key=_place)
            known, registering = tuple(least[name] for name in _FIRST), (least["request_id"], least["record_num"])
            self._keep(least, timerValues)
        for row in rows:
            yield _decided(row, False, known, registering)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _over(self, ends_ms: int, timerValues) -> bool:
        return ends_ms + self.lateness_ms <= timerValues.getCurrentWatermarkInMs()

    def _keep(self, row: Row, timerValues) -> None:
        ends_ms = row["ends_ms"]
        if self._over(ends_ms, timerValues):
            return
        self.first.update(tuple(row[name] for name in _FIRST))
        if ends_ms < NEVER_MS:
            self.handle.registerTimer(ends_ms + self.lateness_ms)


_KNOWN_NAMES = [part.split()[0] for part in _KNOWN.split(", ")]
_DECIDED_ROW = Row(*(part.split()[0] for part in _DECIDED.split(", ")))
_REFERENCE = ("ref_request_id", "ref_record_num", "ref_warc_id", "ref_target_uri", "ref_us")


def _place(row: Row) -> tuple:
    """By arrival, request and record; nulls are last."""
    return tuple((row[name] is None, row[name] or 0) for name in ("arrived", "request_id", "record_num"))


def _decided(row: Row, late: bool, known: tuple | None, registering: tuple | None) -> Row:
    """The row with its decision; rows, as most keys have too few in a micro-batch to make a frame of them."""
    again = known is not None and row["request_id"] != known[0]
    registers = (row["request_id"], row["record_num"]) == registering
    references = known if again else (None,) * len(_REFERENCE)
    return _DECIDED_ROW(*(row[name] for name in _KNOWN_NAMES), late, again, registers, *references)


def _narrow(rows: DataFrame, settings: ArchiveSettings) -> DataFrame:
    ends = F.unix_millis(bucket_end(F.col("bucket"), settings.time_zone))
    return rows.withColumns({"fetch_us": F.unix_micros("fetch_ts"), "ends_ms": F.coalesce(ends, F.lit(NEVER_MS))}).drop("fetch_ts")


def start(
    keyed: DataFrame,
    path: str,
    settings: ArchiveSettings,
    lateness_ms: int,
    known: DataFrame | None = None,
    first_batch: int = 0,
    **trigger,
) -> StreamingQuery:
    """Stream of keyed records -> decided records under ``path/decided`` and index rows under ``path/crawled``.

    ``keyed`` has the columns of ``revisit.with_revisit_key`` and ``ingested``, the clock of the watermark, which must
    grow with the stream. Records without a key are left out, as they are never revisits. ``known`` are the index rows to
    begin with; ``first_batch`` is the first batch number free in the index.
    """
    spark = keyed.sparkSession
    names = ["revisit_key", "request_id", "record_num", "warc_id", "target_uri", "fetch_ts", "bucket"]
    arrived = F.col(settings.order).cast("long") if settings.order else F.lit(0).cast("long")
    rows = keyed.where("revisit_key IS NOT NULL").select(*names, arrived.alias("arrived"), "ingested")
    initial = None
    if known is not None:
        first = known.withColumnsRenamed({"digest": "revisit_key", "date": "fetch_ts"}).select(*names)
        # Dealt anew, once: the state is not laid out as the buckets of the index are.
        initial = _narrow(first, settings).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).groupBy("revisit_key")
    decided = (
        _narrow(rows, settings)
        .withWatermark("ingested", "0 seconds")
        .groupBy("revisit_key")
        .transformWithState(FirstWriters(lateness_ms), _DECIDED, "append", "eventTime", initialState=initial)
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        own, number = batch.sparkSession, first_batch + batch_id
        scratch = Scratch(own, f"{path}/scratch/batch={batch_id}")
        found = scratch.keep(batch.withColumn("fetch_ts", F.timestamp_micros("fetch_us")), "found")
        late = found.where("late").select(*names)
        index = crawled_index.known_rows(own, f"{path}/crawled", late, before_batch=number)
        by_index = scratch.keep(revisit.detect_revisits(late, settings.salts, index), "late")
        whole = found.where("not late").select(
            *names, "is_revisit", "registers", F.when(F.col("is_revisit"), _reference()).alias("reference")
        ).unionByName(by_index.select(*names, "is_revisit", "registers", "reference"))
        whole.write.mode("overwrite").parquet(f"{path}/decided/batch={batch_id}")
        stored = own.read.schema(whole.schema).parquet(f"{path}/decided/batch={batch_id}")
        crawled_index.append_batch(revisit.index_rows(stored), f"{path}/crawled", number, settings.index_buckets)
        delete_dir(own, scratch.path)

    with state_store(spark):
        return (
            decided.writeStream.foreachBatch(handle)
            .outputMode("append")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(**trigger)
            .start()
        )


def _reference():
    return F.struct(
        F.col("ref_request_id").alias("request_id"),
        F.col("ref_record_num").alias("record_num"),
        F.col("ref_warc_id").alias("warc_id"),
        F.col("ref_target_uri").alias("target_uri"),
        F.timestamp_micros("ref_us").alias("date"),
    )


def read_decided(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/decided")
