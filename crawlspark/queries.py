"""One query per operator, over inputs derived from the driver's tables."""

from collections.abc import Callable
from dataclasses import replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlspark import inputs
from crawlspark.functions import calendar, digests, headers, ids
from crawlspark.operators import assembly, files, metrics, revisit, sessions
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings
from crawlspark.sources import crawled_index, documents, warc_sink
from crawlspark.sources.config import join_config
from crawlspark.sources.messages import stream_messages
from crawlspark.streaming import archive as stream_archives
from crawlspark.streaming import config as stream_config
from crawlspark.streaming import first_writers as stream_first_writers
from crawlspark.streaming import revisit as stream_revisits
from crawlspark.streaming import sessions as stream_session
from crawlspark.workspace import Scratch, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Two lanes show that lanes of one file group do not collide.
SETTINGS = ArchiveSettings(pool_size=2, index_buckets=4)
RECORD = ["request_id", "record_num"]
STREAM_SLICES = 4


def query(run: Query) -> Query:
    """Registers a query under its name without the prefix; all compute in UTC."""

    @wraps(run)
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, sf_dir)

    QUERIES[run.__name__.removeprefix("q_")] = in_utc
    return in_utc


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# Steps that several queries share.


def keyed_events(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    config = inputs.collection_config(spark, sf_dir)
    return archive.keyed_records(inputs.event_records(spark, sf_dir), config, SETTINGS, scratch)


def decided_events(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    return archive.decided_records(keyed_events(spark, sf_dir, scratch), SETTINGS, scratch)


def placed_events(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    return archive.placed_records(decided_events(spark, sf_dir, scratch), SETTINGS, scratch)


def recrawled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event records once more, fetched a day later by other sessions."""
    return inputs.event_records(spark, sf_dir).withColumns(
        {
            "request_id": F.col("request_id") + 1_000_000_000_000,
            "fetch_ts": F.col("fetch_ts") + F.expr("interval 1 day"),
        }
    )


def event_messages(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Write messages of all events, kept: several steps read them, and making them takes longer than that."""
    return scratch.keep(inputs.event_messages(spark, sf_dir), "messages")


def event_sessions(
    spark: SparkSession, sf_dir: str, scratch: Scratch, settings: ArchiveSettings
) -> archive.Sessions:
    messages = event_messages(spark, sf_dir, scratch)
    return archive.read_sessions(messages, inputs.collection_config(spark, sf_dir), settings, scratch)


# Sources and documents.


@query
def q_scan_messages(spark, sf_dir):
    return inputs.conversation_messages(spark, sf_dir).select(
        "request_id", "seq", "kind", "record_num", F.col("data").cast("string").alias("data")
    )


@query
def q_scan_config(spark, sf_dir):
    return inputs.collection_config(spark, sf_dir).drop("collection_id")


@query
def q_json_decode_lenient(spark, sf_dir):
    decoded = documents.decode_lenient(F.col("props"), "k int, missing string")
    events = inputs.table(spark, sf_dir, "events").select("event_id", decoded.alias("doc"))
    return events.select("event_id", "doc.k", "doc.missing")


@query
def q_json_decode_strict(spark, sf_dir):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    case = F.col("event_id") % 4
    doc = (
        F.when(case == 1, F.regexp_replace("props", r"\}$", ', "x": 2}'))
        .when(case == 2, F.regexp_replace("props", r"\}$", ""))
        .when(case == 3, F.regexp_replace("props", r": (\d+)", ': "n$1"'))
        .otherwise(F.col("props"))
    )
    docs = inputs.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), doc.alias("doc"))
    return docs.select(
        "doc_id",
        documents.decode_status(F.col("doc"), schema).alias("status"),
        documents.decode_strict(F.col("doc"), schema)["k"].alias("k"),
    )


@query
def q_json_decode_nested(spark, sf_dir):
    """Fields that the schema lacks, inside a struct, an array and a map."""
    inner = T.StructType([T.StructField("k", T.IntegerType())])
    fields = [("a", inner), ("l", T.ArrayType(inner)), ("m", T.MapType(T.StringType(), inner))]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    more = F.regexp_replace("props", r"\}$", ', "x": 2}')
    part = [F.when(F.col("event_id") % 4 == case, more).otherwise(F.col("props")) for case in (1, 2, 3)]
    doc = F.format_string('{"a": %s, "l": [%s], "m": {"any": %s}}', *part)
    docs = inputs.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), doc.alias("doc"))
    return docs.select(
        "doc_id",
        documents.decode_status(F.col("doc"), schema).alias("status"),
        documents.decode_strict(F.col("doc"), schema)["a"]["k"].alias("k"),
    )


@query
def q_json_encode(spark, sf_dir):
    keyed = keyed_events(spark, sf_dir, Scratch(spark))
    doc = documents.crawled_content_document(
        F.col("revisit_key"), F.col("warc_id"), F.col("target_uri"), F.col("fetch_ts")
    )
    return keyed.select(*RECORD, doc.alias("doc"))


@query
def q_date_coerce(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    case = F.col("event_id") % 8
    raw = (
        F.when(case == 0, ids.rfc3339(ts))
        .when(case == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789+02:00")))
        .when(case == 2, F.date_format(ts, "yyyy"))
        .when(case == 3, F.date_format(ts, "yyyyMMdd"))
        .when(case == 4, F.concat(F.lit("http://www.example.com/"), "user_id"))
        .when(case == 5, F.date_format(ts, "yyyy-'13'-dd'T'HH:mm:ss'Z'"))
        .when(case == 6, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.S'-05:30'"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    rows = inputs.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), raw.alias("raw"))
    return rows.select("id", "raw", text(ids.coerce_date(F.col("raw"))).alias("ts"))


# Sessions.


@query
def q_last_meta(spark, sf_dir):
    metas = sessions.last_meta(inputs.event_messages(spark, sf_dir))
    return metas.select("request_id", "meta.target_uri", "meta.execution_id")


@query
def q_header_twice(spark, sf_dir):
    messages = Scratch(spark).keep(inputs.event_messages(spark, sf_dir), "messages")
    return sessions.header_twice(messages).select("request_id", "record_num", "seq")


@query
def q_session_outcome(spark, sf_dir):
    messages = Scratch(spark).keep(inputs.event_messages(spark, sf_dir), "messages")
    return sessions.session_outcome(messages, sessions.header_twice(messages))


@query
def q_assemble_records(spark, sf_dir):
    return _assembled(inputs.conversation_messages(spark, sf_dir))


def _assembled(messages: DataFrame) -> DataFrame:
    # Kept whole, so that both ways of measuring share one shuffle of the bytes.
    records = assembly.assemble_records(messages)
    kept = Scratch(messages.sparkSession).keep(records, "assembled")
    return kept.select(*RECORD, "n_chunks", "size", F.col("block_digest").alias("digest"))


@query
def q_session_records(spark, sf_dir):
    messages = inputs.conversation_messages(spark, sf_dir)
    records = sessions.data_messages(messages).select(*RECORD).distinct()
    return sessions.session_records(records)


@query
def q_session_first_error(spark, sf_dir):
    found = event_sessions(spark, sf_dir, Scratch(spark), SETTINGS)
    return sessions.first_errors(sessions.record_errors(found.described, strict=True))


@query
def q_validate_sessions(spark, sf_dir):
    found = event_sessions(spark, sf_dir, Scratch(spark), ArchiveSettings(strict=True))
    return found.validated.select("request_id", "error")


@query
def q_session_counts(spark, sf_dir):
    found = event_sessions(spark, sf_dir, Scratch(spark), ArchiveSettings(strict=True))
    return metrics.session_counts(found.statuses())


@query
def q_join_config(spark, sf_dir):
    records = inputs.event_records(spark, sf_dir).select("request_id", "collection_id").distinct()
    joined = join_config(records, inputs.collection_config(spark, sf_dir))
    return joined.select("request_id", "collection", "dedup_policy", "rotation_policy")


@query
def q_join_record_meta(spark, sf_dir):
    messages = Scratch(spark).keep(inputs.event_messages(spark, sf_dir), "messages")
    records = sessions.data_messages(messages).select(*RECORD).distinct()
    joined = sessions.join_record_meta(records, sessions.last_meta(messages))
    return joined.select(*RECORD, "record_type", "has_meta")


@query
def q_orphan_records(spark, sf_dir):
    messages = Scratch(spark).keep(inputs.event_messages(spark, sf_dir), "messages")
    records = sessions.data_messages(messages).select(*RECORD).distinct()
    return sessions.orphan_records(records, sessions.last_meta(messages))


@query
def q_digest_audit(spark, sf_dir):
    """Declared digests alternate between hexadecimal, base32, wrong and missing."""
    measured = revisit.measure_records(inputs.event_records(spark, sf_dir))
    case = F.col("request_id") % 5

    def declared(digest: str, wrong: int) -> Column:
        base32 = digests.sha1_base32(F.substring(digest, 6, 40))
        return (
            F.when(case == wrong, digests.sha1_hex(F.lit("tampered").cast("binary")))
            .when(case == 2, base32)
            .when(case == 3, "")
            .otherwise(F.col(digest))
        )

    rows = measured.select(
        *RECORD,
        "size",
        "block_digest",
        "payload_digest",
        (F.col("size") + (case == 4).cast("int")).alias("declared_size"),
        declared("block_digest", 1).alias("declared_block_digest"),
        declared("payload_digest", 0).alias("declared_payload_digest"),
    )
    audited = sessions.audit_warnings(sessions.audit(rows))
    return audited.select(
        *RECORD, "payload_ok", "block_ok", "size_ok", F.array_join("warnings", ",").alias("warnings")
    )


# Scalar functions.


@query
def q_record_type_map(spark, sf_dir):
    declared = F.when(F.col("request_id") % 7 == 0, "OTHER").otherwise(F.col("record_type"))
    rows = inputs.event_records(spark, sf_dir).select(*RECORD, declared.alias("record_type"))
    code = ids.record_type_code(F.col("record_type"))
    return rows.select(*RECORD, "record_type", code.alias("code"), ids.record_type_name(code).alias("back"))


@query
def q_effective_rotation(spark, sf_dir):
    config = inputs.collection_config(spark, sf_dir)
    effective = calendar.effective_rotation(F.col("dedup_policy"), F.col("rotation_policy"))
    return config.select("collection_id", "dedup_policy", "rotation_policy", effective.alias("effective"))


def _with_policies(spark, sf_dir):
    policies = F.explode(F.array(*[F.lit(policy) for policy in calendar.POLICIES]))
    records = inputs.event_records(spark, sf_dir)
    return records.select(*RECORD, "fetch_ts", policies.alias("policy"))


@query
def q_rotation_key(spark, sf_dir):
    key = calendar.rotation_key(F.col("fetch_ts"), F.col("policy"))
    return _with_policies(spark, sf_dir).select(*RECORD, "policy", key.alias("rotation_key"))


@query
def q_next_rotation(spark, sf_dir):
    micros = calendar.micros_to_next_rotation(F.col("fetch_ts"), F.col("policy"))
    waits = _with_policies(spark, sf_dir).withColumn("micros", micros)
    seconds = F.expr(f"micros div {calendar.MICROS_PER_SECOND}")
    return waits.select(
        *RECORD, text(F.col("fetch_ts")).alias("ts"), "policy", "micros", seconds.alias("seconds")
    )


def _routed_dns(spark, sf_dir):
    records = inputs.with_dns_sessions(inputs.event_records(spark, sf_dir))
    measured = revisit.route_sessions(revisit.measure_records(records))
    return join_config(measured, inputs.collection_config(spark, sf_dir))


@query
def q_collection_final_name(spark, sf_dir):
    named = revisit.with_final_name(_routed_dns(spark, sf_dir), SETTINGS)
    name = F.col("collection_final_name")
    return named.select(*RECORD, name.alias("cfn"), calendar.file_prefix(name).alias("prefix"))


@query
def q_digests(spark, sf_dir):
    measured = [
        revisit.measure_records(records).select(
            F.lit(kind).alias("kind"), *RECORD, "payload_digest", "block_digest", "size"
        )
        for kind, records in (
            ("event", inputs.event_records(spark, sf_dir)),
            ("page", inputs.page_records(spark, sf_dir)),
        )
    ]
    return measured[0].unionByName(measured[1])


@query
def q_digest_base32(spark, sf_dir):
    measured = revisit.measure_records(inputs.event_records(spark, sf_dir))
    block_sha1 = F.substring("block_digest", 6, 40)
    base32 = digests.hex_to_base32(block_sha1)
    return measured.select(
        *RECORD,
        digests.sha1_base32(F.col("header_sha1")).alias("header_b32"),
        base32.alias("b32"),
        (digests.base32_to_hex(base32) == block_sha1).alias("round_trip"),
    )


@query
def q_parse_warc_id(spark, sf_dir):
    """Record ids in every accepted spelling, and two that are none."""
    plain = ids.record_uuid(F.col("request_id"), F.col("record_num"))
    case = F.col("request_id") % 7
    raw = (
        F.when(case == 1, F.concat(F.lit("f"), plain))
        .when(case == 2, plain)
        .when(case == 3, F.concat(F.lit("{"), plain, F.lit("}")))
        .when(case == 4, F.regexp_replace(plain, "-", ""))
        .when(case == 5, F.upper(ids.urn(plain)))
        .when(case == 6, "")
        .otherwise(ids.urn(plain))
    )
    rows = inputs.event_records(spark, sf_dir).select(*RECORD, raw.alias("raw"))
    parsed = ids.parse_warc_id(F.col("raw"))
    return rows.select(
        *RECORD,
        "raw",
        F.coalesce(parsed, F.lit(ids.ZERO_UUID)).alias("warc_id"),
        parsed.isNotNull().alias("ok"),
    )


# Revisits and the dedup index.


@query
def q_revisit_eligible(spark, sf_dir):
    return revisit.eligible_records(inputs.event_records(spark, sf_dir)).select(*RECORD)


@query
def q_revisit_key(spark, sf_dir):
    keyed = keyed_events(spark, sf_dir, Scratch(spark))
    return keyed.where("revisit_key IS NOT NULL").select(*RECORD, "revisit_key")


@query
def q_first_writer(spark, sf_dir):
    firsts = revisit.first_writer(keyed_events(spark, sf_dir, Scratch(spark)), SETTINGS.salts)
    return firsts.select("revisit_key", *RECORD, "target_uri")


@query
def q_first_writer_by_arrival(spark, sf_dir):
    """The same where request ids do not grow with time, with buckets of the time of ingestion."""
    records = inputs.event_records(spark, sf_dir).withColumns(
        {
            "arrived": F.col("request_id") * 7919 % 10007,
            "ingested": F.col("fetch_ts") + F.expr("INTERVAL 20 HOURS"),
        }
    )
    settings = replace(SETTINGS, clock="ingested", order="arrived")
    keyed = archive.keyed_records(records, inputs.collection_config(spark, sf_dir), settings, Scratch(spark))
    return revisit.first_writer(keyed, settings.salts, settings.order).select("revisit_key", *RECORD, "bucket")


@query
def q_crawled_required(spark, sf_dir):
    keyed = keyed_events(spark, sf_dir, Scratch(spark))
    case = F.col("request_id") % 6
    rows = keyed.select(
        *RECORD,
        F.when(case == 1, "").otherwise(F.col("revisit_key")).alias("digest"),
        F.when(case.isin(1, 2), F.lit(None)).otherwise(F.col("warc_id")).alias("warc_id"),
        F.when(case == 3, "").otherwise(F.col("target_uri")).alias("target_uri"),
        F.when(case != 4, F.col("fetch_ts")).alias("date"),
    )
    return crawled_index.with_required_error(rows).select(*RECORD, "error")


@query
def q_crawled_lookup(spark, sf_dir):
    """The recrawl of a day later looks up what the first crawl stored."""
    scratch = Scratch(spark)
    decided = decided_events(spark, sf_dir, scratch)
    config = inputs.collection_config(spark, sf_dir)
    probes = archive.keyed_records(recrawled_events(spark, sf_dir), config, SETTINGS, scratch)
    path, rows = shared_dir(spark, "crawled"), revisit.index_rows(decided)
    for batch in range(2):
        crawled_index.append_batch(rows.where(F.col("request_id") % 2 == batch), path, batch, SETTINGS.index_buckets)
    found = crawled_index.lookup(
        probes.where("revisit_key IS NOT NULL"), crawled_index.known_rows(spark, path, probes), SETTINGS.salts
    )
    return found.select(*RECORD, "revisit_key", F.col("found.warc_id").alias("warc_id"))


@query
def q_crawled_insert(spark, sf_dir):
    """Two batches into the index, then both once more."""
    scratch, path = Scratch(spark), shared_dir(spark, "crawled")
    config = inputs.collection_config(spark, sf_dir)
    first = revisit.index_rows(decided_events(spark, sf_dir, scratch))
    keyed = archive.keyed_records(recrawled_events(spark, sf_dir), config, SETTINGS, scratch)
    second = scratch.keep(revisit.index_rows(revisit.detect_revisits(keyed, SETTINGS.salts)), "second")
    for batch, rows in [(0, first), (1, second), (0, first), (1, second)]:
        known = crawled_index.read_index(spark, path, before_batch=batch)
        crawled_index.append_batch(crawled_index.new_rows(rows, known), path, batch, SETTINGS.index_buckets)
    return crawled_index.read_index(spark, path).select(
        "digest", "warc_id", "target_uri", text(F.col("date")).alias("date")
    )


@query
def q_crawled_merge(spark, sf_dir):
    """Twelve batches of candidate rows, two of them repeated; runs are merged in between."""
    path, candidates = shared_dir(spark, "crawled"), revisit.candidate_rows(keyed_events(spark, sf_dir, Scratch(spark)))
    for batch, rows in enumerate(_by_request(candidates, 12)):
        for _ in range(2 if batch in (3, 10) else 1):
            known = crawled_index.read_index(spark, path, before_batch=batch)
            crawled_index.append_batch(crawled_index.new_rows(rows, known), path, batch, SETTINGS.index_buckets)
    return crawled_index.read_index(spark, path).select(
        "digest", "warc_id", "target_uri", text(F.col("date")).alias("date")
    )


def _decisions(decided: DataFrame) -> DataFrame:
    return decided.select(
        *RECORD,
        "is_revisit",
        F.col("reference.request_id").alias("ref_request_id"),
        F.col("reference.record_num").alias("ref_record_num"),
    )


@query
def q_revisit_detect(spark, sf_dir):
    keyed = keyed_events(spark, sf_dir, Scratch(spark))
    return _decisions(revisit.detect_revisits(keyed, SETTINGS.salts))


@query
def q_revisit_documents(spark, sf_dir):
    """Large payloads: whole documents, one collection per language."""
    records = inputs.document_records(spark, sf_dir)
    config = (
        records.select(F.col("collection_id"), F.col("collection_id").alias("collection"))
        .distinct()
        .select(
            "*",
            F.lit("").alias("description"),
            F.lit("NONE").alias("dedup_policy"),
            F.lit("NONE").alias("rotation_policy"),
            F.lit(False).alias("compress"),
            F.lit(0).cast("long").alias("file_size"),
            F.lit(True).alias("sufficient"),
        )
    )
    keyed = archive.keyed_records(records, config, SETTINGS, Scratch(spark))
    decided = revisit.rewrite_revisits(revisit.detect_revisits(keyed, SETTINGS.salts), SETTINGS)
    return decided.select(*RECORD, "collection_final_name", "record_type", "size", "block_digest", "refers_to")


@query
def q_revisit_records(spark, sf_dir):
    return decided_events(spark, sf_dir, Scratch(spark)).select(
        *RECORD, "record_type", "size", "block_digest", "profile", "refers_to", "refers_to_uri", "refers_to_date"
    )


# Files.


@query
def q_concurrent_to(spark, sf_dir):
    keyed = keyed_events(spark, sf_dir, Scratch(spark))
    return keyed.select(*RECORD, F.explode("concurrent_to").alias("sibling"))


@query
def q_warc_headers(spark, sf_dir):
    decided = decided_events(spark, sf_dir, Scratch(spark))
    fields = headers.record_fields(F.col("concurrent_to"))
    rows = decided.select(*RECORD, F.posexplode(fields).alias("pos", "field"))
    return rows.select(*RECORD, "pos", "field.name", "field.value")


@query
def q_rotation_groups(spark, sf_dir):
    return metrics.group_load(decided_events(spark, sf_dir, Scratch(spark)))


@query
def q_file_offsets(spark, sf_dir):
    scratch = Scratch(spark)
    decided = decided_events(spark, sf_dir, scratch)
    placed = archive.file_offsets(decided, "size", SETTINGS, scratch)
    return placed.select("file_group", "lane", "serial", *RECORD, "offset", "size")


@query
def q_storage_ref(spark, sf_dir):
    placed = placed_events(spark, sf_dir, Scratch(spark))
    return archive.write_index(placed).select(*RECORD, "storage_ref")


@query
def q_warcinfo(spark, sf_dir):
    return files.file_info(placed_events(spark, sf_dir, Scratch(spark)), SETTINGS)


@query
def q_write_index(spark, sf_dir):
    return archive.write_index(placed_events(spark, sf_dir, Scratch(spark)))


@query
def q_reply_map(spark, sf_dir):
    replies = archive.reply_map(archive.write_index(placed_events(spark, sf_dir, Scratch(spark))))
    rows = replies.select("request_id", F.explode("reply").alias("record_num", "reply"))
    return rows.select(*RECORD, "reply.record_type", "reply.storage_ref")


@query
def q_message_index(spark, sf_dir):
    """The whole way from write messages to index rows."""
    scratch = Scratch(spark)
    accepted = event_sessions(spark, sf_dir, scratch, SETTINGS).accepted()
    decided = archive.decided_records(archive.key_records(accepted, SETTINGS, scratch), SETTINGS, scratch)
    return decided.select(
        *RECORD, "record_type", "warc_id", "target_uri", "size", "block_digest", "payload_digest",
        "refers_to", "collection_final_name", F.array_join("concurrent_to", ",").alias("concurrent_to"),
    )


@query
def q_archive_batches(spark, sf_dir):
    """Messages to files in two batches, the last one repeated, then read back by the stored positions.

    ``is_unique`` tells that no other record has the reference; ``intact`` that the block found there is as
    long as its header says and, in a revisit, has its digest. Others keep the digest that was declared for them.
    """
    messages, config = event_messages(spark, sf_dir, Scratch(spark)), inputs.collection_config(spark, sf_dir)
    path, late = shared_dir(spark, "archive"), F.col("request_id") % 3 == 2
    for batch, part in [(0, ~late), (1, late), (1, late)]:
        scratch, own = Scratch(spark), messages.where(part)
        accepted = archive.read_sessions(own, config, SETTINGS, scratch).accepted()
        keyed = archive.key_records(accepted, SETTINGS, scratch)
        archive.archive_batch(spark, keyed, assembly.record_chunks(own), path, batch, SETTINGS)
    return _read_back(spark, path, 2)


@query
def q_archive_ingest_clock(spark, sf_dir):
    """The same with buckets and file names by the time of ingestion, out of the order of request ids."""
    config, path = inputs.collection_config(spark, sf_dir), shared_dir(spark, "archive")
    settings, scratch = replace(SETTINGS, clock="received", order="arrived"), Scratch(spark)
    arrived = F.col("request_id") * 7919 % 10007
    messages = event_messages(spark, sf_dir, scratch).withColumns(
        {"arrived": arrived, "received": F.timestamp_seconds(F.lit(1_714_903_200) + arrived * 7 + F.coalesce("seq", F.lit(0)) % 2)}
    )
    accepted = archive.read_sessions(messages, config, settings, scratch).accepted()
    keyed = archive.key_records(accepted, settings, scratch)
    archive.archive_batch(spark, keyed, assembly.record_chunks(messages), path, 0, settings)
    return _read_back(spark, path, 1)


def _read_back(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """For each archived record whether its reference is its own, and whether what is stored there is whole."""
    back = [warc_sink.read_back(spark, f"{path}/warc/batch={batch}") for batch in range(batches)]
    index = spark.read.parquet(f"{path}/index").select(*RECORD, "storage_ref")
    same = digests.same_digest(F.concat(F.lit("sha1:"), "block_sha1"), F.col("block_digest"))
    twins = index.groupBy("storage_ref").agg((F.count("*") == 1).alias("is_unique"))
    return (
        reduce(DataFrame.unionByName, back)
        .join(index, RECORD)
        .join(twins, "storage_ref")
        .select(
            *RECORD,
            "is_unique",
            ((F.col("size") == F.col("content_length")) & (same | (F.col("record_type") != "REVISIT"))).alias("intact"),
        )
    )


@query
def q_warc_write(spark, sf_dir):
    """Written, then read back from the files by offset."""
    scratch, path = Scratch(spark), shared_dir(spark, "warc")
    placed = scratch.keep(placed_events(spark, sf_dir, scratch), "placed")
    chunks = assembly.block_chunks(inputs.event_records(spark, sf_dir))
    warc_sink.write_files(placed, chunks, path, SETTINGS)
    return warc_sink.read_back(spark, path)


@query
def q_warc_write_pages(spark, sf_dir):
    """Large blocks in files of a megabyte, plain and compressed."""
    scratch, path = Scratch(spark), shared_dir(spark, "warc")
    pages = inputs.page_records(spark, sf_dir)
    config = inputs.collection_config(spark, sf_dir)
    keyed = archive.keyed_records(pages, config, SETTINGS, scratch)
    decided = archive.decided_records(keyed, SETTINGS, scratch)
    placed = scratch.keep(archive.placed_records(decided, SETTINGS, scratch), "placed")
    warc_sink.write_files(placed, assembly.block_chunks(pages), path, SETTINGS)
    return warc_sink.read_back(spark, path)


# Counts.


@query
def q_writer_load(spark, sf_dir):
    return metrics.writer_load(_routed_dns(spark, sf_dir))


@query
def q_bucket_counts(spark, sf_dir):
    return metrics.bucket_counts(inputs.event_records(spark, sf_dir), "fetch_ts")


@query
def q_bucket_histogram(spark, sf_dir):
    return metrics.bucket_histogram(inputs.table(spark, sf_dir, "events"), F.col("value"))


def is_late_message(request_id: Column, seq: Column) -> Column:
    """Cuts event sessions in two: the sequence numbers of their messages go from 10 to 41."""
    return seq > 11 + F.coalesce(request_id, F.lit(0)) % 20


# Streams. A slice is appended to the source and taken in by one run over all
# that is new, so slices arrive in order and each run restarts from the log.


def _feed(slices: list[DataFrame], source: str, start: Callable) -> None:
    for rows in slices:
        rows.write.mode("append").parquet(source)
        start().awaitTermination()


def _by_request(rows: DataFrame, slices: int = STREAM_SLICES) -> list[DataFrame]:
    """All rows, cut into consecutive ranges of request ids."""
    last = rows.agg(F.max("request_id")).first()[0] or 0
    part = F.expr(f"request_id * {slices} div {last + 1}")
    return [rows.where(part == number) for number in range(slices)]


@query
def q_stream_sessions(spark, sf_dir):
    messages = inputs.conversation_messages(spark, sf_dir)
    ends = messages.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("kind", F.lit("eof"))
    late = F.col("seq") >= 3
    source, path = shared_dir(spark, "messages"), shared_dir(spark, "sessions")
    _feed(
        [messages.where(~late), messages.where(late).unionByName(ends, allowMissingColumns=True)],
        source,
        lambda: stream_session.start(stream_messages(spark, source), path, availableNow=True),
    )
    return _assembled(stream_session.read_sessions(spark, path))


@query
def q_stream_outcomes(spark, sf_dir):
    """How each session ends, with its messages in two micro-batches, cut at another place from session to session."""
    messages = event_messages(spark, sf_dir, Scratch(spark))
    ends = messages.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("kind", F.lit("eof"))
    source, path = shared_dir(spark, "messages"), shared_dir(spark, "sessions")
    late = is_late_message(F.col("request_id"), F.col("seq"))
    whole = messages.unionByName(ends, allowMissingColumns=True)
    _feed(
        [whole.where(~late), whole.where(late)],
        source,
        lambda: stream_session.start(stream_messages(spark, source), path, availableNow=True),
    )
    return stream_session.read_ended(spark, path).select("request_id", "status")


@query
def q_stream_archive(spark, sf_dir):
    """Messages in, index rows out, batch by batch; sessions end by any of their end messages."""
    messages = event_messages(spark, sf_dir, Scratch(spark))
    ends = messages.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("kind", F.lit("eof"))
    config = stream_config.FreshConfig(lambda: inputs.collection_config(spark, sf_dir), ttl=300)
    source, path = shared_dir(spark, "messages"), shared_dir(spark, "archive")

    def start():
        stream = stream_messages(spark, source)
        return stream_archives.start(stream, config, path, SETTINGS, availableNow=True)

    _feed(_by_request(messages.unionByName(ends, allowMissingColumns=True), 2), source, start)
    return spark.read.parquet(f"{path}/index").select(
        *RECORD, "record_type", "warc_id", "block_digest", "payload_digest", "collection_final_name"
    )


@query
def q_stream_revisit(spark, sf_dir):
    records = inputs.event_records(spark, sf_dir)
    config = stream_config.FreshConfig(lambda: inputs.collection_config(spark, sf_dir), ttl=300)
    source, path = shared_dir(spark, "records"), shared_dir(spark, "revisits")

    def start():
        stream = spark.readStream.schema(records.schema).parquet(source)
        return stream_revisits.start(stream, config, path, SETTINGS, availableNow=True)

    _feed(_by_request(records), source, start)
    return _decisions(stream_revisits.read_decided(spark, path))


@query
def q_stream_revisit_state(spark, sf_dir):
    """The first quarter is in the index already; the rest is decided by state, or if its bucket is long over by the index."""
    scratch, path, source = Scratch(spark), shared_dir(spark, "revisits"), shared_dir(spark, "keyed")
    keyed = keyed_events(spark, sf_dir, scratch)
    clock = keyed.agg(F.expr("percentile_approx(fetch_ts, 0.5)")).first()[0]
    # Ingestion takes place within minutes, in the middle of the span of fetch times.
    rows = keyed.withColumn("ingested", F.lit(clock) + F.make_dt_interval(secs=F.col("request_id") / 1000))
    first, *rest = _by_request(rows)
    begun = scratch.keep(revisit.detect_revisits(first, SETTINGS.salts), "begun")
    crawled_index.append_batch(revisit.index_rows(begun), f"{path}/crawled", 0, SETTINGS.index_buckets)
    known = crawled_index.read_index(spark, f"{path}/crawled")

    def start():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        day = 24 * 3600 * 1000
        return stream_first_writers.start(stream, path, SETTINGS, day, known, first_batch=1, availableNow=True)

    _feed([reduce(DataFrame.unionByName, rest[:2]), rest[2]], source, start)
    bare = [rows_.where("revisit_key IS NULL") for rows_ in rest]
    never = reduce(DataFrame.unionByName, bare).select(*RECORD).withColumns(
        {"is_revisit": F.lit(False), "ref_request_id": F.lit(None).cast("long"), "ref_record_num": F.lit(None).cast("int")}
    )
    return _decisions(begun).unionByName(_decisions(stream_first_writers.read_decided(spark, path))).unionByName(never)


@query
def q_stream_config_refresh(spark, sf_dir):
    found = inputs.event_records(spark, sf_dir).select("request_id", "collection_id").distinct()
    config = stream_config.FreshConfig(lambda: inputs.collection_config(spark, sf_dir), ttl=0)
    source, path = shared_dir(spark, "requests"), shared_dir(spark, "joined")

    def start():
        stream = spark.readStream.schema(found.schema).parquet(source)
        return stream_config.start_join(stream, config, path, availableNow=True)

    _feed(_by_request(found), source, start)
    joined = spark.read.parquet(f"{path}/joined")
    return joined.select("request_id", "collection", "dedup_policy", "rotation_policy")
