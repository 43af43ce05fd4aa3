"""Write sessions on a stream: closed by the message that ends them, not by a gap.

Two queries follow each other. One appends the messages, bytes and all, to a log of files that the engine
commits exactly once. The other one takes the narrow columns of the log through a keyed state in the engine's
state store: for each record what tells a repeated header, the names of the log files that hold the
session's messages, and its end. Bytes never pass through the state. A session that has ended leaves a mark, so that what arrives
later does not count; timers remove marks, and end sessions that were abandoned.

A call to the state store takes far longer than the work on a session, so the sessions are dealt into shards by hash, and a
shard is one value of the state, read and written once in a micro-batch. Messages reach the state packed by shard and log file, as
the engine's way of a row to Python takes longer than the work on a message, too.
"""

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlspark.operators.sessions import CANCELLED, DATA_KINDS, EOF, HEADER_TWICE, INVALID_ARGUMENT, KNOWN_KINDS
from crawlspark.sources.messages import message_schema
from crawlspark.workspace import dir_exists, make_dir

ABANDONED = "ABANDONED"

_ENDED = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]
)
_ENDED_BY_BATCH = T.StructType([*_ENDED.fields, T.StructField("batch", T.LongType())])
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

#: How long after its end a session is remembered, and how far files of the log may be out of order.
FORGET_AFTER_MS, OUT_OF_ORDER = 7 * 24 * 3600 * 1000, "1 hour"
#: A sequence number that no message has.
NEVER = (1 << 63) - 1
#: Values of the state that hold all sessions. Best is about one for some thousand sessions that are open or remembered.
SHARDS = 1 << 12
ROWS_OUT = 4096


#: What is kept of an open session. ``woken`` is the time of its timer; the last three go by record.
_OPEN = (
    "twice long, invalid long, cancel long, eof long, ingested_ms long, woken long, files array<string>, "
    "numbers array<int>, first_bytes array<long>, last_headers array<long>"
)
_OPEN_FIELDS = 1 + _OPEN.count(", ")
#: A session that has ended has its status only.
_SESSION = f"status string, {_OPEN}"
_MESSAGE = ("seq", "record_num", "bytes", "header", "end", "file", "ingested_ms")


class _Seen:
    """What the messages of a session in one micro-batch say, added one by one."""

    __slots__ = ("files", "ingested", "ends", "first", "headers")

    def __init__(self):
        self.files, self.ingested, self.ends, self.first, self.headers = set(), 0, {}, {}, {}

    def add(self, seq: int, number: int, has_bytes: bool, header: bool, end: str, file: str, at: int) -> None:
        self.files.add(file)
        if at > self.ingested:
            self.ingested = at
        if end:
            self.ends[end] = min(self.ends.get(end, NEVER), seq)
        if has_bytes:
            self.first[number] = min(self.first.get(number, NEVER), seq)
        if header:
            self.headers.setdefault(number, []).append(seq)


class _Open:
    """Whether the state holds a session that is still open."""

    def __init__(self, session):
        self.session = session

    def exists(self) -> bool:
        return self.session.exists() and self.session.get()[0] is None


class SessionEnds(StatefulProcessor):
    """Ends a session at its first eof, cancel, unknown message or repeated header, or some time after its last message.

    The earliest of them gives the status, as ``operators.sessions.session_outcome`` does for a whole table. The
    order of messages within a micro-batch does not matter.
    """

    def __init__(self, abandoned_after_ms: int | None, forget_after_ms: int):
        self.abandoned_after_ms, self.forget_after_ms = abandoned_after_ms, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A call to the state store costs more than the work on a session, so all of it is a single value.
        self.handle = handle
        self.session = self.ended = handle.getValueState("session", _SESSION)
        self.ends = self.files = _Open(self.session)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = (row for frame in rows for row in zip(*(frame[name].tolist() for name in _MESSAGE), strict=True))
        for ended in self._take(key, found):
            yield pd.DataFrame({name: [value] for name, value in ended.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for ended in self._expire(key, expiredTimerInfo):
            yield pd.DataFrame({name: [value] for name, value in ended.items()})

    def close(self) -> None:
        pass

    def _take(self, key, rows: Iterator[tuple]) -> Iterator[dict]:
        """Messages as tuples of ``_MESSAGE``; the end of the session, if they end it."""
        seen = _Seen()
        for row in rows:
            seen.add(*row)
        return self._settle(key, seen)

    def _settle(self, key, seen: _Seen) -> Iterator[dict]:
        if self.session.exists():
            status, twice, invalid, cancel, eof, ingested, woken, held, numbers, firsts, lasts = self.session.get()
            if status is not None:
                return
            known, records = {*held, *seen.files}, {n: (f, h) for n, f, h in zip(numbers, firsts, lasts, strict=True)}
        else:
            twice, invalid, cancel, eof, ingested, woken, known, records = *(NEVER,) * 4, 0, NEVER, seen.files, {}
        first, headers, ingested = seen.first, seen.headers, max(ingested, seen.ingested)
        invalid, cancel, eof = (
            min(before, seen.ends.get(end, NEVER)) for end, before in (("invalid", invalid), ("cancel", cancel), ("eof", eof))
        )
        for number in {*first, *headers}:
            before, last = records.get(number, (NEVER, -NEVER))
            least = min(before, first.get(number, NEVER))
            own = headers.get(number, [])
            # Headers behind a byte of their record; of earlier batches, the last one stands for all.
            twice = min([twice, *(seq for seq in (*own, last) if seq > least)])
            records[number] = (least, max([last, *own]))
        end = min(twice, invalid, cancel)
        if end == NEVER and eof == NEVER:
            if self.abandoned_after_ms is not None:
                woken = self._wake(woken, ingested + self.abandoned_after_ms)
            numbers, places = list(records), list(records.values())
            firsts, lasts = [f for f, _ in places], [h for _, h in places]
            self.session.update((None, twice, invalid, cancel, eof, ingested, woken, sorted(known), numbers, firsts, lasts))
            return
        status = EOF if end == NEVER else HEADER_TWICE if end == twice else INVALID_ARGUMENT if end == invalid else CANCELLED
        yield self._close(key, status, sorted(known), ingested, woken)

    def _expire(self, key, expiredTimerInfo) -> Iterator[dict]:
        if self.session.exists() and self.session.get()[0] is not None:
            self.session.clear()
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        yield self._close(key, ABANDONED, [], at, at)

    def _close(self, key, status: str, files: list[str], now_ms: int, woken: int) -> dict:
        self.session.update((status, *(None,) * _OPEN_FIELDS))
        self._wake(woken, now_ms + self.forget_after_ms)
        return {"request_id": key[0], "status": status, "files": files}

    def _wake(self, woken: int, at_ms: int) -> int:
        """Sets the session's one timer, which was at ``woken``."""
        if woken != NEVER:
            self.handle.deleteTimer(woken)
        self.handle.registerTimer(at_ms)
        return at_ms


class RowSessionEnds(SessionEnds):
    """The same on rows: most sessions have a few messages in a micro-batch, too few to make a frame of them."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for ended in self._take(key, (tuple(row[name] for name in _MESSAGE) for row in rows)):
            yield Row(**ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for ended in self._expire(key, expiredTimerInfo):
            yield Row(**ended)


class _Shard:
    """The sessions of a shard. To ``SessionEnds`` it is the state and the timers of the session ``at`` it."""

    def __init__(self, stored: bytes | None):
        # Open sessions with their timers, and of ended ones when they are to be forgotten.
        self.open, self.ended = pickle.loads(stored) if stored else ({}, {})
        self.at = None

    def stored(self) -> bytes:
        return pickle.dumps((self.open, self.ended), protocol=5)

    def due(self, until_ms: int) -> list[tuple]:
        """(session, time) of the timers up to a time."""
        timers = [(at, woken) for at, (_, woken) in self.open.items() if woken <= until_ms]
        return timers + [(at, woken) for at, woken in self.ended.items() if woken <= until_ms]

    def next_timer(self) -> int:
        return min(min(self.ended.values(), default=NEVER), min((woken for _, woken in self.open.values()), default=NEVER))

    def exists(self) -> bool:
        return self.at in self.ended or self.at in self.open

    def get(self) -> tuple:
        return (EOF, *(None,) * _OPEN_FIELDS) if self.at in self.ended else self.open[self.at][0]

    def update(self, value: tuple) -> None:
        _, woken = self.open.pop(self.at, (None, NEVER))
        if value[0] is not None:
            self.ended[self.at] = NEVER
        else:
            self.open[self.at] = (value, woken if value[6] == NEVER else value[6])

    def clear(self) -> None:
        self.ended.pop(self.at, None)
        self.open.pop(self.at, None)

    def registerTimer(self, at_ms: int) -> None:  # noqa: N802 - as the engine names it
        if self.at in self.ended:
            self.ended[self.at] = at_ms

    def deleteTimer(self, at_ms: int) -> None:  # noqa: N802 - as the engine names it
        """A session has one timer, which the next one replaces."""


#: A message as it is packed, and what its ``flags`` say; the end is its place in ``_ENDS``.
_PACKED = np.dtype([("request_id", "<i8"), ("seq", "<i8"), ("record_num", "<i4"), ("flags", "<i4")])
_ENDS = ("", "eof", "cancel", "invalid")
_NO_REQUEST, _BYTES, _HEADER, _END_SHIFT = 1, 2, 4, 3
#: Messages that are packed together; the rows of a shard and file are as many fewer as it has messages among them.
PACK_ROWS = 1 << 20
_PACK = "shard int, file string, ingested_ms long, messages binary, ingested timestamp"


def pack_messages(narrow: DataFrame, shards: int) -> DataFrame:
    """Rows of ``narrow_messages`` as one row per shard and log file, or a few, with the messages as bytes."""
    flags = sum(
        (F.when(found, F.lit(bit)).otherwise(F.lit(0)) for found, bit in
         ((F.col("request_id").isNull(), _NO_REQUEST), (F.col("bytes"), _BYTES), (F.col("header"), _HEADER))),
        F.lit(0),
    )
    for place, end in enumerate(_ENDS):
        flags = flags + F.when(F.col("end") == end, F.lit(place << _END_SHIFT)).otherwise(F.lit(0))
    rows = narrow.select(
        F.pmod(F.xxhash64("request_id"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("request_id", F.lit(0)).alias("request_id"),
        F.col("seq").cast("long"),
        F.col("record_num").cast("int"),
        flags.cast("int").alias("flags"),
        "file",
        "ingested_ms",
    )
    packed = rows.mapInArrow(_pack, _PACK.removesuffix(", ingested timestamp"))
    return packed.withColumn("ingested", F.timestamp_millis("ingested_ms"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PACK_ROWS:
            yield from _by_shard(pa.Table.from_batches(held))
            held, count = [], 0
    if count:
        yield from _by_shard(pa.Table.from_batches(held))


def _by_shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    file = rows.column("file").combine_chunks().dictionary_encode()
    columns = {name: rows.column(name).to_numpy() for name in ("shard", "ingested_ms", *_PACKED.names)}
    keys = (columns["shard"], columns["ingested_ms"], file.indices.to_numpy())
    order = np.lexsort(keys[::-1])
    starts = np.flatnonzero(np.any([np.diff(key[order], prepend=key[order[0]] - 1) != 0 for key in keys], axis=0))
    messages = np.empty(len(order), _PACKED)
    for name in _PACKED.names:
        messages[name] = columns[name][order]
    ends = [*starts[1:], len(order)]
    first = pa.array(order[starts])
    for at in range(0, len(starts), ROWS_OUT):
        part = slice(at, at + ROWS_OUT)
        yield pa.RecordBatch.from_arrays(
            [
                *(rows.column(name).take(first[part]).combine_chunks() for name in ("shard", "file", "ingested_ms")),
                pa.array([messages[a:b].tobytes() for a, b in zip(starts[part], ends[part], strict=True)], pa.binary()),
            ],
            names=["shard", "file", "ingested_ms", "messages"],
        )


class ShardedSessionEnds(StatefulProcessor):
    """``SessionEnds`` for all sessions of a shard, on the rows of ``pack_messages``."""

    def __init__(self, abandoned_after_ms: int | None, forget_after_ms: int):
        self.rules = SessionEnds(abandoned_after_ms, forget_after_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("shard", "woken long, sessions binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: dict[int | None, _Seen] = {}
        for _, file, at, packed, *_ in rows:
            for request_id, seq, number, flags in np.frombuffer(packed, _PACKED).tolist():
                if flags & _NO_REQUEST:
                    request_id = None
                found = seen.get(request_id)
                if found is None:
                    found = seen[request_id] = _Seen()
                found.add(seq, number, flags & _BYTES, flags & _HEADER, _ENDS[flags >> _END_SHIFT], file, at)
        woken, shard = self._load()
        for request_id, messages in seen.items():
            shard.at = request_id
            for ended in self.rules._settle((request_id,), messages):
                yield Row(**ended)
        self._store(woken, shard)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_ms = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        woken, shard = self._load()
        while due := shard.due(now_ms):
            for request_id, at_ms in due:
                shard.at = request_id
                for ended in self.rules._expire((request_id,), _Expired(at_ms)):
                    yield Row(**ended)
        # The engine removes the timer that went off.
        self._store(woken if woken != expiredTimerInfo.getExpiryTimeInMs() else NEVER, shard)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int, _Shard]:
        woken, stored = self.shard.get() if self.shard.exists() else (NEVER, None)
        shard = _Shard(stored)
        self.rules.session = self.rules.handle = shard
        return woken, shard

    def _store(self, woken: int, shard: _Shard) -> None:
        """Keeps the shard, with a single timer for the first one of its sessions."""
        first = shard.next_timer()
        if not shard.open and not shard.ended:
            self.shard.clear()
        else:
            self.shard.update((first, shard.stored()))
        if first != woken:
            if woken != NEVER:
                self.handle.deleteTimer(woken)
            if first != NEVER:
                self.handle.registerTimer(first)


@dataclass(frozen=True)
class _Expired:
    """The timer of one session."""

    at_ms: int

    def getExpiryTimeInMs(self) -> int:  # noqa: N802 - as the engine names it
        return self.at_ms


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB; a query holds on to the settings of its start."""
    before = {name: spark.conf.get(name, None) for name in _STATE_STORE}
    try:
        for name, value in _STATE_STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def narrow_messages(log: DataFrame) -> DataFrame:
    """What the state needs to know of each message of the log; no bytes are read."""
    kind = F.coalesce("kind", F.lit(""))
    data = kind.isin(*DATA_KINDS)
    ingested = F.col("_metadata.file_modification_time")
    return log.select(
        "request_id",
        F.coalesce("seq", F.lit(0)).alias("seq"),
        F.coalesce("record_num", F.lit(-1)).alias("record_num"),
        F.coalesce(data & (F.col("size") > 0), F.lit(False)).alias("bytes"),
        (kind == "header").alias("header"),
        F.when(kind.isin("eof", "cancel"), kind).when(~kind.isin(*KNOWN_KINDS), "invalid").otherwise("").alias("end"),
        F.col("_metadata.file_name").alias("file"),
        F.unix_millis(ingested).alias("ingested_ms"),
        ingested.alias("ingested"),
    )


def log_messages(messages: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Stream of messages -> the log under ``path/messages``, with the size of each message's data."""
    sized = messages.withColumn("size", F.octet_length("data").cast("long"))
    return (
        sized.writeStream.format("parquet")
        .option("path", f"{path}/messages")
        .option("checkpointLocation", f"{path}/checkpoint/messages")
        .trigger(**trigger)
        .start()
    )


def end_sessions(
    spark: SparkSession,
    path: str,
    then: Callable[[SparkSession, int], None] | None = None,
    abandoned_after_ms: int | None = None,
    forget_after_ms: int = FORGET_AFTER_MS,
    ingested: str | None = None,
    shards: int = SHARDS,
    **trigger,
) -> StreamingQuery:
    """Stream of the log -> ended sessions under ``path/ended``, by micro-batch; ``then`` goes on with each of them.

    A micro-batch may be repeated with the same id: it writes the same rows again. A stream keeps the number of
    ``shards`` it began with.
    """
    make_dir(spark, f"{path}/messages")
    log = spark.readStream.schema(message_schema(ingested).add("size", "long")).parquet(f"{path}/messages")
    ended = (
        pack_messages(narrow_messages(log), shards)
        .withWatermark("ingested", OUT_OF_ORDER)
        .groupBy("shard")
        .transformWithState(ShardedSessionEnds(abandoned_after_ms, forget_after_ms), _ENDED, "append", "eventTime")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/ended/batch={batch_id}")
        if then is not None:
            then(batch.sparkSession, batch_id)

    with state_store(spark):
        return (
            ended.writeStream.foreachBatch(handle)
            .outputMode("append")
            .option("checkpointLocation", f"{path}/checkpoint/ended")
            .trigger(**trigger)
            .start()
        )


@dataclass
class Running:
    """The two queries of a stream of sessions."""

    log: StreamingQuery
    ended: StreamingQuery

    def awaitTermination(self) -> None:  # noqa: N802 - as the engine names it
        self.log.awaitTermination()
        self.ended.awaitTermination()

    def stop(self) -> None:
        self.ended.stop()
        self.log.stop()


def start(messages: DataFrame, path: str, ingested: str | None = None, **options) -> Running:
    """Stream of messages -> ended sessions, see ``read_sessions`` and ``read_ended``.

    ``options`` are those of ``end_sessions`` and a trigger. A trigger that ends with the data at hand first
    logs it, then follows the log.
    """
    trigger = {name: options[name] for name in ("availableNow", "once", "processingTime", "continuous") if name in options}
    log = log_messages(messages, path, **trigger)
    if trigger.get("availableNow") or trigger.get("once"):
        log.awaitTermination()
    return Running(log, end_sessions(messages.sparkSession, path, ingested=ingested, **options))


def read_ended(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """(request_id, status, files, batch) of every session that has ended, or of those that one batch ended."""
    if not dir_exists(spark, f"{path}/ended"):
        return spark.createDataFrame([], _ENDED_BY_BATCH)
    if batch_id is not None:
        ended = spark.read.schema(_ENDED).parquet(f"{path}/ended/batch={batch_id}")
        return ended.withColumn("batch", F.lit(batch_id).cast("long"))
    return spark.read.schema(_ENDED_BY_BATCH).parquet(f"{path}/ended")


def read_sessions(spark: SparkSession, path: str, batch_id: int | None = None, ingested: str | None = None) -> DataFrame:
    """Messages of the whole sessions that ended, all of them or those of one batch; abandoned ones are not released.

    Messages that arrive after the batch that ended their session are left out. One batch reads the log files
    of its own sessions only.
    """
    schema = message_schema(ingested)
    held = read_ended(spark, path, batch_id).select("request_id", F.explode("files").alias("file"))
    log = spark.read.schema(schema)
    if batch_id is None:
        rows = log.parquet(f"{path}/messages")
    else:
        files = [row.file for row in held.select("file").distinct().collect()]
        if not files:
            return spark.createDataFrame([], schema)
        rows = log.parquet(*[f"{path}/messages/{file}" for file in files])
    return rows.withColumn("file", F.col("_metadata.file_name")).join(held, ["request_id", "file"]).select(schema.names)
