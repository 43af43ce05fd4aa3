import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row

import sample
from crawlspark.schemas import MESSAGE
from crawlspark.sources.messages import read_messages, stream_messages
from crawlspark.streaming import config as stream_config
from crawlspark.streaming import sessions
from crawlspark.workspace import shared_dir


END = [None, None, None, None]


def test_sessions_are_released_whole_and_late(spark):
    source, path = shared_dir(spark, "source"), shared_dir(spark, "path")

    def feed(rows):
        # Each feed starts both queries again, from their checkpoints.
        sample.messages(spark, rows).write.mode("append").parquet(source)
        sessions.start(stream_messages(spark, source), path, availableNow=True).awaitTermination()
        released = sessions.read_sessions(spark, path)
        return sorted((r.request_id, r.seq) for r in released.collect())

    one, two, three = (sample.session(i) for i in (1, 2, 3))
    assert feed(one[:2] + two[:1] + three) == []
    first = [(1, s) for s in (0, 1, 2, 3, 9)]
    assert feed(one[2:] + [(1, 9, "eof", *END)]) == first
    # However long it takes, nothing of an open session is lost; what comes after an end does not count.
    assert feed(two[1:2] + [(1, 10, "eof", *END)]) == first
    second = first + [(2, 0), (2, 1), (2, 9)]
    assert feed([(2, 9, "cancel", *END), (3, 9, "eof", *END)]) == second + [(3, s) for s in (0, 1, 2, 3, 9)]
    assert read_messages(spark, source).schema == MESSAGE
    ended = sessions.read_ended(spark, path).collect()
    assert {(r.request_id, r.status) for r in ended} == {(1, "EOF"), (2, "CANCELLED"), (3, "EOF")}
    for batch in {r.batch for r in ended}:
        own = {r.request_id for r in ended if r.batch == batch}
        assert {r.request_id for r in sessions.read_sessions(spark, path, batch).collect()} == own


class Values:
    """State of one kind for one key, as the engine's handle gives it."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0] if self.single else iter(self.rows)

    single = True

    def update(self, row):
        self.rows = [row]

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_, **__):  # noqa: N802
        return Values()

    def getListState(self, *_, **__):  # noqa: N802
        found = Values()
        found.single = False
        return found

    def getMapState(self, *_, **__):  # noqa: N802
        class Map(dict):
            containsKey = dict.__contains__  # noqa: N815
            getValue = dict.__getitem__  # noqa: N815
            updateValue = dict.__setitem__  # noqa: N815

        return Map()

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def processor(abandoned_after_ms=None, forget_after_ms=1000):
    made, handle = sessions.SessionEnds(abandoned_after_ms, forget_after_ms), Handle()
    made.init(handle)
    return made, handle


def give(made, *rows, at=0, file="f"):
    """Rows (seq, kind, data) of record 0 in one micro-batch; the statuses that come out."""
    columns = ["seq", "record_num", "bytes", "header", "end", "file", "ingested_ms"]
    kinds = {"eof": "eof", "cancel": "cancel", "trailer": "invalid"}
    found = [(s, 0, k in ("header", "payload") and bool(d), k == "header", kinds.get(k, ""), file, at) for s, k, d in rows]
    return [r for out in made.handleInputRows((7,), iter([pd.DataFrame(found, columns=columns)]), None) for r in out.itertuples(index=False)]


@pytest.mark.parametrize(
    "rows, status",
    [
        ([(0, "header", b"H"), (1, "payload", b"P"), (9, "eof", None)], "EOF"),
        ([(0, "header", b""), (1, "header", b"H"), (9, "eof", None)], "EOF"),
        ([(0, "payload", b"P"), (1, "header", b"H")], "HEADER_TWICE"),
        ([(0, "header", b"H"), (2, "header", b"X"), (3, "cancel", None)], "HEADER_TWICE"),
        ([(0, "header", b"H"), (1, "cancel", None), (2, "header", b"X")], "CANCELLED"),
        ([(0, "trailer", None), (1, "cancel", None)], "INVALID_ARGUMENT"),
        ([(0, "header", b"H"), (1, "payload", b"P")], None),
    ],
)
def test_status_does_not_depend_on_how_messages_are_batched(rows, status):
    for cut in range(len(rows) + 1):
        for order in (1, -1):
            made, _ = processor()
            out = [r for part in (rows[:cut], rows[cut:]) if part for r in give(made, *part[::order])]
            assert [r.status for r in out] == ([status] if status else []), (cut, order)


def test_ends_are_remembered_for_a_while(spark):
    made, handle = processor(forget_after_ms=1000)
    assert [r.files for r in give(made, (0, "header", b"H"), file="a") + give(made, (9, "eof", None), at=5, file="b")] == [["a", "b"]]
    assert give(made, (10, "eof", None)) == [] and handle.timers == [1005]
    assert list(made.handleExpiredTimer((7,), None, Expired(1005))) == [] and not made.ended.exists()


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


def test_abandoned_sessions_end_after_their_last_message():
    made, handle = processor(abandoned_after_ms=100, forget_after_ms=1000)
    assert give(made, (0, "header", b"H"), at=10) == [] and handle.timers == [110]
    assert give(made, (1, "payload", b"P"), at=50) == [] and handle.timers == [150]
    (out,) = made.handleExpiredTimer((7,), None, Expired(150))
    assert out.status.tolist() == ["ABANDONED"] and out.files.tolist() == [[]] and handle.timers == [1150]
    assert give(made, (9, "eof", None)) == [] and not made.files.exists() and not made.ends.exists()


def test_session_within_a_micro_batch_takes_few_calls_to_the_state_store(monkeypatch):
    calls = []
    for kind, names in ((Values, ("exists", "get", "update", "appendValue", "clear")), (Handle, ("listTimers", "deleteTimer", "registerTimer"))):
        for name in names:
            plain = getattr(kind, name)
            monkeypatch.setattr(kind, name, lambda self, *a, plain=plain, name=name: (calls.append(name), plain(self, *a))[1])
    made, _ = processor()
    assert [r.status for r in give(made, (0, "header", b"H"), (1, "payload", b"P"), (9, "eof", None))] == ["EOF"]
    assert len(calls) <= 4, calls
    calls.clear()
    assert give(made, (10, "eof", None)) == []
    assert len(calls) <= 4, calls


def test_rows_and_frames_end_alike():
    rows = [Row(seq=s, record_num=0, bytes=True, header=k, end=e, file="f", ingested_ms=5) for s, k, e in ((0, True, ""), (1, False, ""), (9, False, "eof"))]
    made = sessions.RowSessionEnds(None, 1000)
    made.init(Handle())
    assert list(made.handleInputRows((7,), iter(rows), None)) == [Row(request_id=7, status="EOF", files=["f"])]


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def sharded(abandoned_after_ms=None, forget_after_ms=1000):
    made, handle = sessions.ShardedSessionEnds(abandoned_after_ms, forget_after_ms), Handle()
    made.init(handle)
    return made, handle


def hand(made, *messages, at=0):
    """Messages (request, seq, kind) of record 0 in one micro-batch; the (request, status) that come out, in order."""
    kinds = {"eof": "eof", "cancel": "cancel", "trailer": "invalid"}
    rows = {"shard": [3] * len(messages), "request_id": [r or 0 for r, *_ in messages], "seq": [s for _, s, _ in messages]}
    rows |= {"record_num": [0] * len(messages), "file": ["f"] * len(messages), "ingested_ms": [at] * len(messages)}
    rows["flags"] = [
        (r is None) + 2 * (k in ("header", "payload")) + 4 * (k == "header") + 8 * sessions._ENDS.index(kinds.get(k, ""))
        for r, _, k in messages
    ]
    packed = [tuple(row.values()) for batch in sessions._pack([pa.RecordBatch.from_pydict(rows)]) for row in batch.to_pylist()]
    assert len(packed) == 1
    return sorted(((e.request_id, e.status) for e in made.handleInputRows((3,), iter(packed), None)), key=repr)


def test_sessions_of_a_shard_end_as_single_ones_do():
    kinds = {"h": "header", "p": "payload", "c": "cancel", "t": "trailer", "e": "eof"}
    for cut in range(4):
        for number, text in enumerate(("hpe", "ph", "hhc", "hch", "tc", "hp", "hpeh")):
            rows = [(seq, kinds[letter], b"x") for seq, letter in enumerate(text)]
            single, (made, _) = processor()[0], sharded()
            alone = [r.status for part in (rows[:cut], rows[cut:]) if part for r in give(single, *part)]
            # Next to another session, which stays open.
            parts = [[(number, s, k) for s, k, _ in part] + [(99, cut + i, "header")] for i, part in enumerate((rows[:cut], rows[cut:]))]
            found = [status for part in parts for request, status in hand(made, *part) if request == number]
            assert found == alone, (text, cut)


def test_a_shard_takes_few_calls_to_the_state_store(monkeypatch):
    calls = []
    for kind, names in ((Values, ("exists", "get", "update", "clear")), (Handle, ("deleteTimer", "registerTimer"))):
        for name in names:
            plain = getattr(kind, name)
            monkeypatch.setattr(kind, name, lambda self, *a, plain=plain, name=name: (calls.append(name), plain(self, *a))[1])
    made, _ = sharded()
    assert len(hand(made, *((r, s, k) for r in range(500) for s, k in enumerate(("header", "payload", "eof"))))) == 500
    assert hand(made, *((r, 9, "cancel") for r in range(500))) == []
    assert len(calls) <= 8, calls


def test_timers_of_a_shard():
    made, handle = sharded(abandoned_after_ms=100, forget_after_ms=1000)
    assert hand(made, (1, 0, "header"), (None, 0, "header"), at=10) == [] and handle.timers == [110]
    assert hand(made, (1, 1, "payload"), (2, 0, "header"), (2, 1, "eof"), at=50) == [(2, "EOF")] and handle.timers == [110]

    def expire(at, watermark):
        handle.timers.remove(at)  # as the engine does
        return [(e.request_id, e.status) for e in made.handleExpiredTimer((3,), Watermark(watermark), Expired(at))]

    assert expire(110, 120) == [(None, "ABANDONED")] and handle.timers == [150]
    assert expire(150, 200) == [(1, "ABANDONED")] and handle.timers == [1050]
    assert hand(made, (1, 9, "eof"), (2, 9, "eof"), (None, 9, "eof")) == [] and handle.timers == [1050]
    # All three are forgotten, and nothing is left of the shard.
    assert expire(1050, 2000) == [] and handle.timers == [] and not made.shard.exists()
    assert hand(made, (2, 0, "header"), (2, 1, "eof")) == [(2, "EOF")]


def test_abandoned_sessions_of_a_stream(spark):
    source, path = shared_dir(spark, "source"), shared_dir(spark, "path")

    def feed(rows):
        sample.messages(spark, rows).write.mode("append").parquet(source)
        start = sessions.start(stream_messages(spark, source), path, abandoned_after_ms=0, shards=2, availableNow=True)
        start.awaitTermination()
        return sorted((r.request_id, r.status) for r in sessions.read_ended(spark, path).collect())

    assert feed(sample.session(1)) == []
    # The watermark is an hour behind the log.
    assert feed(sample.session(2) + [(2, 9, "eof", *END)]) == [(2, "EOF")]


def test_messages_are_packed_by_shard_and_file(spark):
    from pyspark.sql import functions as F

    rows = [(None if i % 50 == 0 else i % 50, i, i % 3, i % 2 == 0, i % 4 == 0, ("", "eof", "cancel", "invalid")[i % 4], "ab"[i % 2], i % 2) for i in range(400)]
    names = "request_id long, seq long, record_num int, bytes boolean, header boolean, end string, file string, ingested_ms long"
    narrow = spark.createDataFrame(rows, names)
    packed = sessions.pack_messages(narrow.coalesce(1), 4).collect()
    shards = {r.request_id: r.shard for r in narrow.select("request_id", F.expr("pmod(xxhash64(request_id), 4)").alias("shard")).collect()}
    assert len(packed) == len({(shards[r[0]], r[6]) for r in rows})
    back = []
    for row in packed:
        assert row.ingested.timestamp() * 1000 == row.ingested_ms
        for request, seq, number, flags in sessions.np.frombuffer(row.messages, sessions._PACKED).tolist():
            request = None if flags & 1 else request
            assert shards[request] == row.shard
            back.append((request, seq, number, bool(flags & 2), bool(flags & 4), sessions._ENDS[flags >> 3], row.file, row.ingested_ms))
    assert sorted(back, key=repr) == sorted(rows, key=repr)


def test_event_sessions_are_cut_in_two(spark, sf_dir):
    from pyspark.sql import functions as F

    from crawlspark import inputs, queries

    messages = inputs.event_messages(spark, sf_dir)
    late = queries.is_late_message(F.col("request_id"), F.col("seq"))
    parts = messages.groupBy("request_id").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("early"))
    cut = parts.where("late > 0 AND early > 0").count()
    assert cut > 0.9 * parts.count()


def test_config_outlives_its_files(spark):
    source = shared_dir(spark, "config")
    write = lambda name: spark.createDataFrame([(name,)], "id string").write.mode("overwrite").parquet(source)
    write("old")
    fresh = stream_config.FreshConfig(lambda: spark.read.parquet(source), ttl=100, clock=lambda: 0.0)
    assert fresh().first().id == "old"
    write("new")
    assert fresh().first().id == "old"


def test_config_is_read_again_after_its_time(spark):
    now, reads = [0.0], []

    def read():
        reads.append(now[0])
        return spark.range(1)

    fresh = stream_config.FreshConfig(read, ttl=100, clock=lambda: now[0])
    for at in (0, 50, 99, 100, 150, 230):
        now[0] = at
        fresh()
    assert reads == [0, 100, 230]
    always = stream_config.FreshConfig(read, ttl=0, clock=lambda: now[0])
    always(), always()
    assert len(reads) == 5


def test_stream_sees_changed_config(spark):
    source, path = shared_dir(spark, "source"), shared_dir(spark, "path")
    policies = iter(["HOURLY", "DAILY"])
    fresh = stream_config.FreshConfig(
        lambda: spark.createDataFrame([("c1", next(policies))], "collection_id string, dedup_policy string"), ttl=0
    )
    for request in (1, 2):
        rows = spark.createDataFrame([(request, "c1")], "request_id long, collection_id string")
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        stream_config.start_join(stream, fresh, path, availableNow=True).awaitTermination()
    joined = spark.read.parquet(f"{path}/joined").select("request_id", "dedup_policy")
    assert sorted(map(tuple, joined.collect())) == [(1, "HOURLY"), (2, "DAILY")]
