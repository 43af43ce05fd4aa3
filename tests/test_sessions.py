import hashlib
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import sample
from crawlspark.operators import assembly, metrics, sessions
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings


def message(request_id, seq, kind, num=None, data=None, meta=None):
    return (request_id, seq, kind, num, data, meta, None)


ORDERS = {
    1: [("header", 0, b"AB"), ("payload", 0, b"cd"), ("header", 0, b"X"), ("cancel", None, None)],
    2: [("payload", 0, b"p"), ("header", 0, b"H")],
    3: [("header", 0, b""), ("header", 0, b"H")],
    4: [("header", 0, b"H"), ("cancel", None, None), ("trailer", None, None)],
    5: [("trailer", None, None)],
    6: [("header", 0, b"H"), ("payload", 0, b"P")],
    7: [("header", 0, b"H"), (None, None, None)],
}
OUTCOMES = {
    1: "HEADER_TWICE",
    2: "HEADER_TWICE",
    3: "EOF",
    4: "CANCELLED",
    5: "INVALID_ARGUMENT",
    6: "EOF",
    7: "INVALID_ARGUMENT",
}


@pytest.fixture
def ordered(spark):
    rows = [
        message(request, seq, *fields) for request, order in ORDERS.items() for seq, fields in enumerate(order)
    ]
    return sample.messages(spark, rows)


def test_earliest_end_decides(ordered):
    outcomes = sessions.session_outcome(ordered, sessions.header_twice(ordered))
    assert {r.request_id: r.status for r in outcomes.collect()} == OUTCOMES


def test_assembly_finds_the_same_repeated_headers(ordered):
    repeats = sessions.header_twice(ordered).groupBy("request_id", "record_num").agg(F.min("seq").alias("seq"))
    records = assembly.assemble_records(ordered).where("twice_seq IS NOT NULL")
    assert sorted(map(tuple, repeats.collect())) == sorted(
        map(tuple, records.select("request_id", "record_num", "twice_seq").collect())
    )


def test_assembly_equals_plain_python(ordered):
    blocks = {}
    for row in sorted(ordered.where("kind IN ('header', 'payload')").collect(), key=lambda r: r.seq):
        blocks.setdefault((row.request_id, row.record_num), []).append((row.kind, bytes(row.data or b"")))
    found = {(r.request_id, r.record_num): r for r in assembly.assemble_records(ordered).collect()}
    assert set(found) == set(blocks)
    for key, chunks in blocks.items():
        row = found[key]
        block, header, payload = (
            b"".join(data for kind, data in chunks if kind in kinds)
            for kinds in (("header", "payload"), ("header",), ("payload",))
        )
        assert (row.n_chunks, row.size, row.header_size) == (len(chunks), len(block), len(header))
        assert row.block_digest == "sha1:" + hashlib.sha1(block).hexdigest().upper()
        assert row.payload_digest == "sha1:" + hashlib.sha1(payload).hexdigest().upper()
        assert row.header_sha1 == hashlib.sha1(header).hexdigest().upper()


RECORDS = {0: sample.REQUEST_META, 1: sample.record_meta(1)}
FAULTS = {
    1: (None, "missing metadata object"),
    2: (sample.meta(collection=None), "missing collection ref"),
    3: (sample.meta(ip=""), "missing IP-address"),
    4: (sample.meta(uri=""), "missing target URI"),
    5: (sample.meta(collection="c9"), "failed to get collection config: c9"),
    6: (sample.meta(collection="c3"), "collection with id 'c3' is missing or insufficient"),
    7: (sample.meta(records={0: sample.REQUEST_META}), "missing metadata for record num: 1"),
    8: (
        sample.meta(records={**RECORDS, 0: sample.record_meta(0, "OTHER", sample.REQUEST_SIZE, sample.REQUEST_BLOCK, "")}),
        "failed to build record number 0",
    ),
    9: (sample.meta(records={**RECORDS, 1: sample.record_meta(1, size=1)}), "failed to validate record number 1"),
    10: (sample.meta(ip="", uri=""), "missing IP-address"),
    11: (sample.meta(), None),
    12: (sample.meta(records={**RECORDS, 5: sample.record_meta(5)}), None),
    13: (
        sample.meta(records={0: sample.record_meta(0, "OTHER"), 1: sample.record_meta(1, size=1)}),
        "failed to build record number 0",
    ),
}


def faulty_messages(spark):
    rows = []
    for request, (meta, _) in FAULTS.items():
        rows += [row for row in sample.session(request, meta) if meta or row[2] != "meta"]
    gap = [(14, *row[1:]) for row in sample.session(14, sample.meta(records={0: sample.REQUEST_META, 2: sample.record_meta(2)}))]
    rows += [(r[0], r[1], r[2], 2 if r[3] == 1 else r[3], *r[4:]) for r in gap]
    return sample.messages(spark, rows)


def test_first_broken_rule_is_reported(spark, scratch):
    found = archive.read_sessions(
        faulty_messages(spark), sample.config(spark), ArchiveSettings(strict=True), scratch
    )
    errors = {r.request_id: r.error for r in found.validated.collect()}
    expected = {request: error for request, (_, error) in FAULTS.items()}
    assert errors == {**expected, 14: "non-contiguous record numbers"}
    accepted = {r.request_id for r in found.accepted().collect()}
    assert accepted == {11, 12}
    statuses = {(r.status, r.code): r.n for r in found.statuses().groupBy("status", "code").agg(F.count("*").alias("n")).collect()}
    assert statuses == {("OK", "OK"): 2, ("REJECTED", "Unknown"): 12}
    observation = Observation("sessions")
    metrics.observe_sessions(found.statuses(), observation).collect()
    assert observation.get == {"calls": 14, "errors": 12}


def test_lenient_validation_only_warns(spark, scratch):
    found = archive.read_sessions(faulty_messages(spark), sample.config(spark), ArchiveSettings(), scratch)
    errors = {r.request_id: r.error for r in found.validated.collect()}
    assert errors[9] is None
    audited = sessions.audit_warnings(sessions.audit(found.described)).where("request_id = 9 AND record_num = 1")
    assert audited.first().warnings == ["content length"]


def test_orphans_and_ignored_metadata(spark, scratch):
    found = archive.read_sessions(faulty_messages(spark), sample.config(spark), ArchiveSettings(), scratch)
    orphans = sessions.orphan_records(found.records, found.metas.where("request_id = 7"))
    assert (7, 1) in set(map(tuple, orphans.where("request_id = 7").collect()))
    assert found.described.where("request_id = 12").count() == 2


def test_last_metadata_counts(spark):
    rows = sample.session(1, sample.meta(uri="first")) + [message(1, 9, "meta", meta=sample.meta(uri="last"))]
    assert sessions.last_meta(sample.messages(spark, rows)).first().meta.target_uri == "last"
