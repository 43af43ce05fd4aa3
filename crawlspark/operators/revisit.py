"""Who stored a payload first, and what becomes of later copies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlspark.functions import digests, ids
from crawlspark.functions.calendar import (
    collection_final_name,
    effective_rotation,
    local_clock,
    rotation_key,
)
from crawlspark.functions.text import present
from crawlspark.operators.skew import salt
from crawlspark.settings import ArchiveSettings

_FIRST = ("request_id", "record_num", "warc_id", "target_uri", "date")
_KNOWN = (*_FIRST, "bucket")


def route_sessions(records: DataFrame) -> DataFrame:
    """The sub-collection of a session's first record holds for all its records.

    A window by session is bounded: one metadata message describes all its
    records.
    """
    sub_collection = F.coalesce(present(F.col("sub_collection")), F.lit("UNDEFINED"))
    session = Window.partitionBy("request_id")
    return records.withColumn(
        "sub_collection", F.min_by(sub_collection, F.col("record_num")).over(session)
    )


def measure_records(records: DataFrame) -> DataFrame:
    """Narrow rows: sizes and digests take the place of header and payload.

    Computed where the bytes are read, so that no later shuffle carries them.
    Declared digests are kept, missing ones are computed.
    """
    header, payload = F.col("header"), F.col("payload")
    payload_digest = F.coalesce(present(F.col("payload_digest")), digests.sha1_hex(payload))
    block_digest = F.coalesce(present(F.col("block_digest")), digests.sha1_hex(F.concat(header, payload)))
    return (
        records.withColumn("payload_digest", payload_digest)
        .withColumn("block_digest", block_digest)
        .withColumn("header_size", F.octet_length(header).cast("long"))
        .withColumn("size", (F.octet_length(header) + F.octet_length(payload)).cast("long"))
        .withColumn("header_sha1", F.upper(F.sha1(header)))
        .drop("header", "payload")
    )


def with_final_name(records: DataFrame, settings: ArchiveSettings) -> DataFrame:
    """Adds the calendar columns: dedup bucket, collection final name, file group."""
    clock = local_clock(F.col(settings.clock), settings.time_zone)
    effective = effective_rotation(F.col("dedup_policy"), F.col("rotation_policy"))
    return (
        records.withColumn("bucket", rotation_key(clock, F.col("dedup_policy")))
        .withColumn(
            "collection_final_name",
            collection_final_name(F.col("collection"), F.col("sub_collection"), F.col("bucket")),
        )
        .withColumn(
            "file_group", F.concat_ws("@", "collection_final_name", rotation_key(clock, effective))
        )
    )


def with_revisit_key(records: DataFrame) -> DataFrame:
    """Adds ``revisit_key``: NULL for records that can never be a revisit."""
    digest = digests.revisit_digest(F.col("payload_digest"), F.col("block_digest"))
    key = digests.revisit_key(digest, F.col("collection_final_name"))
    return records.withColumn(
        "revisit_key", F.when(ids.is_revisitable(F.col("record_type")) & (digest != ""), key)
    )


def with_record_id(records: DataFrame) -> DataFrame:
    return records.withColumn("warc_id", ids.record_uuid(F.col("request_id"), F.col("record_num")))


def eligible_records(records: DataFrame) -> DataFrame:
    return records.where(ids.is_revisitable(F.col("record_type")))


def _first_struct(order: str | None) -> Column:
    # A struct compares field by field, so its minimum is the earliest record.
    return F.struct(
        (F.col(order) if order else F.lit(None).cast("long")).alias("arrived"),
        "request_id",
        "record_num",
        "warc_id",
        "target_uri",
        F.col("fetch_ts").alias("date"),
        "bucket",
    )


def first_writer(records: DataFrame, salts: int, order: str | None = None) -> DataFrame:
    """One row per revisit key: the record that stored it first.

    First is first by the column ``order``, then by request and record; without
    it request ids must grow with time.

    Two partial steps, by (key, salt) and by key, so that no task sees all
    copies of a hot payload.
    """
    salted = (
        records.where(F.col("revisit_key").isNotNull())
        .groupBy("revisit_key", salt(salts, "request_id", "record_num").alias("salt"))
        .agg(F.min(_first_struct(order)).alias("first"))
    )
    firsts = salted.groupBy("revisit_key").agg(F.min("first").alias("first"))
    return firsts.select("revisit_key", *[f"first.{name}" for name in _KNOWN])


def detect_revisits(
    records: DataFrame, salts: int, index: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """Adds ``is_revisit`` and ``reference`` (the first writer of a revisit).

    A record is a revisit if another session stored its key before: one found
    in ``index``, else the first one of this input. Copies within the storing
    session stay full records. ``registers`` marks the one record per new key
    whose row belongs into the index.
    """
    salted = records.withColumn("salt", salt(salts, "request_id", "record_num"))
    groups = (
        salted.where(F.col("revisit_key").isNotNull())
        .groupBy("revisit_key", "salt")
        .agg(F.min(_first_struct(order)).alias("local_first"))
    )
    # At most `salts` rows per key are left here.
    by_key = Window.partitionBy("revisit_key")
    groups = groups.withColumn("local_first", F.min("local_first").over(by_key)).select(
        "revisit_key", "salt", F.struct(*[F.col(f"local_first.{name}") for name in _KNOWN]).alias("first")
    )
    if index is None:
        groups = groups.withColumn("stored", F.lit(False))
    else:
        known = index.select(
            F.col("digest").alias("revisit_key"),
            F.struct(*_KNOWN).alias("known"),
        )
        groups = groups.join(known, "revisit_key", "left").select(
            "revisit_key",
            "salt",
            F.coalesce("known", "first").alias("first"),
            F.col("known").isNotNull().alias("stored"),
        )
    decided = salted.join(groups, ["revisit_key", "salt"], "left").drop("salt")
    first_request, first_record = F.col("first.request_id"), F.col("first.record_num")
    is_revisit = F.coalesce(first_request != F.col("request_id"), F.lit(False))
    registers = (first_request == F.col("request_id")) & (first_record == F.col("record_num"))
    return (
        decided.withColumn("is_revisit", is_revisit)
        .withColumn("registers", F.coalesce(registers & ~F.col("stored"), F.lit(False)))
        .withColumn("reference", F.when(is_revisit, F.struct(*[F.col(f"first.{c}") for c in _FIRST])))
        .drop("first", "stored")
    )


def rewrite_revisits(records: DataFrame, settings: ArchiveSettings) -> DataFrame:
    """Duplicates become REVISIT records whose block is the protocol header only."""
    revisit = F.col("is_revisit")
    return (
        records.withColumn("record_type", F.when(revisit, "REVISIT").otherwise(F.col("record_type")))
        .withColumn("size", F.when(revisit, F.col("header_size")).otherwise(F.col("size")))
        .withColumn(
            "block_digest",
            F.when(revisit, digests.sha1_base32(F.col("header_sha1"))).otherwise(F.col("block_digest")),
        )
        .withColumn("profile", F.when(revisit, F.lit(settings.revisit_profile)))
        .withColumn("refers_to", F.when(revisit, ids.urn(F.col("reference.warc_id"))))
        .withColumn("refers_to_uri", F.when(revisit, F.col("reference.target_uri")))
        .withColumn("refers_to_date", F.when(revisit, ids.rfc3339(F.col("reference.date"))))
    )


def index_rows(decided: DataFrame) -> DataFrame:
    """Dedup index rows that this input adds."""
    return candidate_rows(decided.where("registers"))


def candidate_rows(keyed: DataFrame) -> DataFrame:
    """The dedup index row that each record with a revisit key would have."""
    return keyed.where("revisit_key IS NOT NULL").select(
        F.col("revisit_key").alias("digest"),
        "warc_id",
        "target_uri",
        F.col("fetch_ts").alias("date"),
        "request_id",
        "record_num",
        "bucket",
    )
