"""Archive inputs derived from the driver's tables, for queries and tests.

Everything is a projection of whole tables; edge cases are spread over all
rows by arithmetic on their ids.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlspark.functions.ids import record_uuid
from crawlspark.functions.text import CRLF
from crawlspark.schemas import MESSAGE, RECORD_META
from crawlspark.sources.config import decode_config

FILE_SIZE = 1024
LARGE_FILE_SIZE = 1024 * 1024
FAULTS = 23

RESPONSE_HEAD = f"HTTP/1.1 200 OK{CRLF}{CRLF}"
REQUEST_HEAD = f"GET / HTTP/1.1{CRLF}{CRLF}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection per supplier, as JSON text; the first 25 pair all policies.

    Every tenth document lacks the collection part. ``apiVersion`` is a field
    that the schema does not know.
    """
    k = F.col("s_suppkey")
    dedup = F.array(*[F.lit(p) for p in ("HOURLY", "DAILY", "NONE", "MONTHLY", "YEARLY")])
    rotation = F.array(*[F.lit(p) for p in ("MONTHLY", "HOURLY", "YEARLY", "NONE", "DAILY")])
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("c"), k).alias("id"),
            F.lit("v1").alias("apiVersion"),
            F.struct(
                F.concat(F.lit("c"), k).alias("name"), F.col("s_name").alias("description")
            ).alias("meta"),
            F.when(
                k % 10 != 7,
                F.struct(
                    F.get(dedup, k % 5).alias("collectionDedupPolicy"),
                    F.get(rotation, (k + F.expr("s_suppkey div 5")) % 5).alias("fileRotationPolicy"),
                    (k % 3 == 2).alias("compress"),
                    F.when(k < 3, FILE_SIZE).otherwise(LARGE_FILE_SIZE).alias("fileSize"),
                ),
            ).alias("collection"),
        )
    )
    return table(spark, sf_dir, "supplier").select(k.alias("config_id"), doc.alias("doc"))


def collection_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_config(config_documents(spark, sf_dir))


def _http_head(record_type: Column) -> Column:
    return (
        F.when(record_type == "RESPONSE", RESPONSE_HEAD)
        .when(record_type == "REQUEST", REQUEST_HEAD)
        .otherwise("")
    )


def _content_type(record_type: Column) -> Column:
    return (
        F.when(record_type == "RESPONSE", "application/http;msgtype=response")
        .when(record_type == "REQUEST", "application/http;msgtype=request")
        .otherwise("text/plain")
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two-record sessions, one per event; most payloads repeat."""
    event_type = F.col("event_type")
    session = Window.partitionBy("request_id")
    rows = (
        table(spark, sf_dir, "events")
        .withColumn("request_id", F.expr("event_id div 2"))
        .withColumn("record_num", (F.col("event_id") % 2).cast("int"))
        .withColumn("fetch_ts", F.min(F.col("ts").cast("timestamp")).over(session))
        .withColumn("first_user", F.min_by("user_id", "record_num").over(session))
    )
    record_type = (
        F.when(event_type == "click", "REQUEST")
        .when(event_type == "error", "METADATA")
        .when(event_type == "signup", "RESOURCE")
        .otherwise("RESPONSE")
    )
    return rows.withColumn("record_type", record_type).select(
        "request_id",
        "record_num",
        "record_type",
        F.concat(F.lit("http://example.com/u/"), "user_id").alias("target_uri"),
        F.concat(F.lit("10.0.0."), F.col("first_user") % 256).alias("ip_address"),
        _content_type(F.col("record_type")).alias("content_type"),
        _http_head(F.col("record_type")).cast("binary").alias("header"),
        F.concat("event_type", "props").cast("binary").alias("payload"),
        "fetch_ts",
        F.concat(F.lit("c"), F.col("first_user") % 3).alias("collection_id"),
        F.lit("UNDEFINED").alias("sub_collection"),
        F.lit("").alias("payload_digest"),
        F.lit("").alias("block_digest"),
        F.lit(None).cast("array<string>").alias("declared_concurrent_to"),
    )


def with_dns_sessions(records: DataFrame) -> DataFrame:
    """METADATA records declare the DNS sub-collection."""
    dns = F.when(F.col("record_type") == "METADATA", "DNS").otherwise("UNDEFINED")
    return records.withColumn("sub_collection", dns)


def single_records(
    spark: SparkSession, sf_dir: str, name: str, request_id: str, uri: Column, payload: str,
    record_type: str, collection_id: Column,
) -> DataFrame:
    """One-record sessions from a table with a large text column."""
    return table(spark, sf_dir, name).select(
        F.col(request_id).alias("request_id"),
        F.lit(0).alias("record_num"),
        F.lit(record_type).alias("record_type"),
        uri.alias("target_uri"),
        F.lit("10.0.0.1").alias("ip_address"),
        _content_type(F.lit(record_type)).alias("content_type"),
        _http_head(F.lit(record_type)).cast("binary").alias("header"),
        F.col(payload).cast("binary").alias("payload"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetch_ts"),
        collection_id.alias("collection_id"),
        F.lit("UNDEFINED").alias("sub_collection"),
        F.lit("").alias("payload_digest"),
        F.lit("").alias("block_digest"),
        F.lit(None).cast("array<string>").alias("declared_concurrent_to"),
    )


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as responses: large payloads, half of them for compressed files."""
    collection = F.when(F.col("page_id") % 2 == 0, "c3").otherwise("c5")
    return single_records(
        spark, sf_dir, "pages", "page_id", F.col("url"), "html", "RESPONSE", collection
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as resources, one collection per language."""
    uri = F.concat(F.lit("http://example.com/d/"), "doc_id")
    return single_records(
        spark, sf_dir, "documents", "doc_id", uri, "text", "RESOURCE", F.col("lang")
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write messages of two records per conversation."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("seq"),
        F.when(role == "system", "header").otherwise("payload").alias("kind"),
        (role == "assistant").cast("int").alias("record_num"),
        F.col("text").cast("binary").alias("data"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write messages of all event sessions, with every kind of fault mixed in.

    ``fault`` = request id modulo 23. Faults 0-11 spoil metadata or records,
    12-17 the message order, 18-22 are harmless variants.
    """
    records = event_records(spark, sf_dir)
    record = F.struct(
        "record_num", "record_type", "header", "payload", "target_uri", "content_type",
        "ip_address", "fetch_ts", "collection_id",
    )
    sessions = records.groupBy("request_id").agg(
        F.max(F.when(F.col("record_num") == 0, record)).alias("r0"),
        F.max(F.when(F.col("record_num") == 1, record)).alias("r1"),
    ).withColumn("fault", F.col("request_id") % FAULTS)
    fault = F.col("fault")
    empty = F.lit("").cast("binary")
    second = F.when(fault == 11, 2).otherwise(1)

    def declared(rec: Column, num: Column) -> Column:
        block = F.concat(rec["header"], rec["payload"])
        payload_sha1 = F.upper(F.sha1(rec["payload"]))
        wrong = (fault == 10) & (num > 0)
        payload_digest = F.when(fault == 21, "").otherwise(
            F.concat(F.lit("sha1:"), F.when(wrong, F.upper(F.sha1(F.lit("tampered").cast("binary"))))
                     .otherwise(payload_sha1))
        )
        return F.struct(
            num.alias("record_num"),
            F.when((fault == 7) & (num == 0), "OTHER").otherwise(rec["record_type"]).alias("type"),
            (F.octet_length(block) + ((fault == 8) & (num == 0)).cast("int")).cast("long").alias("size"),
            rec["content_type"].alias("record_content_type"),
            F.concat(F.lit("sha1:"), F.upper(F.sha1(block))).alias("block_digest"),
            payload_digest.alias("payload_digest"),
            F.when(
                fault == 20, F.array(record_uuid(F.col("request_id"), F.lit("extra")))
            ).alias("warc_concurrent_to"),
            F.lit("UNDEFINED").alias("sub_collection"),
        ).cast(RECORD_META)

    entries = F.filter(
        F.array(
            declared(F.col("r0"), F.lit(0)),
            F.when(F.col("r1").isNotNull() & (fault != 6), declared(F.col("r1"), second)),
            F.when(fault == 19, declared(F.col("r0"), F.lit(7))),
        ),
        lambda entry: entry.isNotNull(),
    )

    # One slot per message a session may send; the slot is its sequence number.
    has_second = F.col("r1").isNotNull()
    slots = {
        10: fault != 13,
        11: fault.isin(12, 16, 17),
        12: F.lit(True),
        13: fault == 13,
        20: has_second,
        21: has_second,
        22: fault == 14,
        23: fault.isin(14, 15),
        24: has_second,
        30: fault != 0,
        31: fault == 18,
        40: fault == 16,
    }
    sent = F.array_compact(F.array(*[F.when(when, F.lit(slot).cast("long")) for slot, when in slots.items()]))
    seq = F.col("seq")
    is_meta, is_cancel = seq.isin(30, 31), seq.isin(22, 40)
    header0, payload0 = F.col("r0.header"), F.col("r0.payload")
    data = (
        F.when((seq == 10) & (fault == 17), empty)
        .when((seq == 11) & (fault != 17), F.lit("X").cast("binary"))
        .when(seq.isin(10, 11, 13), header0)
        .when(seq == 12, payload0)
        .when(seq == 20, F.col("r1.header"))
        .when(seq == 21, F.substring(F.col("r1.payload"), 1, 6))
        .when(seq == 24, F.substr(F.col("r1.payload"), F.lit(7)))
    )
    target_uri = (
        F.when(fault.isin(3, 9), "")
        .when(seq == 31, F.concat(F.col("r0.target_uri"), F.lit("?v=2")))
        .otherwise(F.col("r0.target_uri"))
    )
    collection = (
        F.when(fault == 4, "nowhere").when(fault == 5, "c7").otherwise(F.col("r0.collection_id"))
    )
    meta = F.struct(
        F.concat(F.lit("e"), "request_id").alias("execution_id"),
        target_uri.alias("target_uri"),
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["record_num"].alias("k"), e.alias("v")))
        ).alias("record_meta"),
        F.col("r0.fetch_ts").alias("fetch_ts"),
        F.when(fault.isin(2, 9), "").otherwise(F.col("r0.ip_address")).alias("ip_address"),
        F.when(fault != 1, F.struct(F.lit("collection").alias("kind"), collection.alias("id"))).alias(
            "collection_ref"
        ),
    )
    return sessions.withColumn("seq", F.explode(sent)).select(
        "request_id",
        "seq",
        F.when(is_meta, "meta")
        .when(is_cancel, "cancel")
        .when(seq == 23, "trailer")
        .when(seq.isin(12, 21, 24), "payload")
        .otherwise("header")
        .alias("kind"),
        F.when(seq <= 13, 0).when(seq.isin(20, 21, 24), second).cast("int").alias("record_num"),
        data.alias("data"),
        F.when(is_meta, meta.cast(MESSAGE["meta"].dataType)).alias("meta"),
        F.when(is_cancel, "stopped").alias("cancel_reason"),
    )
