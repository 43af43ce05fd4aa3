"""Write sessions: how they end, what they carry, whether they are valid."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.functions import digests, ids
from crawlspark.functions.text import is_missing, present
from crawlspark.sources.config import join_config

# Message kinds and the ways a session can end.
DATA_KINDS = ("header", "payload")
KNOWN_KINDS = ("meta", *DATA_KINDS, "cancel", "eof")
HEADER_TWICE, CANCELLED, INVALID_ARGUMENT, EOF = "HEADER_TWICE", "CANCELLED", "INVALID_ARGUMENT", "EOF"
STATUS_CODES = {
    "OK": "OK",
    CANCELLED: "OK",
    INVALID_ARGUMENT: "InvalidArgument",
    HEADER_TWICE: "Unknown",
    "REJECTED": "Unknown",
}

# Wording of the session errors; those ending in a colon or
# "number" are followed by the collection or record they are about.
NO_META = "missing metadata object"
NO_COLLECTION = "missing collection ref"
NO_ADDRESS = "missing IP-address"
NO_TARGET = "missing target URI"
NO_CONFIG = "failed to get collection config: "
POOR_CONFIG = "collection with id '%s' is missing or insufficient"
NO_RECORD_META = "missing metadata for record num: "
NOT_BUILT = "failed to build record number "
NOT_VALID = "failed to validate record number "
NOT_DENSE = "non-contiguous record numbers"


def data_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("kind").isin(*DATA_KINDS))


def last_meta(messages: DataFrame) -> DataFrame:
    """The metadata of each session: its last meta message counts."""
    return (
        messages.where("kind = 'meta'")
        .groupBy("request_id")
        .agg(F.max_by("meta", "seq").alias("meta"))
    )


def header_twice(messages: DataFrame) -> DataFrame:
    """Header messages that arrive after any byte of the same record."""
    record = ["request_id", "record_num"]
    first_byte = (
        data_messages(messages)
        .where(F.octet_length("data") > 0)
        .groupBy(*record)
        .agg(F.min("seq").alias("first_byte_seq"))
    )
    headers = messages.where("kind = 'header'").select(*record, "seq")
    return headers.join(first_byte, record).where("seq > first_byte_seq").drop("first_byte_seq")


def session_outcome(messages: DataFrame, repeats: DataFrame) -> DataFrame:
    """How the messages of each session end it; later messages do not count.

    The earliest of a repeated header, an unknown message and a cancel wins;
    without any of them the session ends at EOF and goes on to validation.
    ``repeats`` has the repeated headers, as ``header_twice`` gives them.
    """
    kind, seq = F.col("kind"), F.col("seq")
    ends = messages.groupBy("request_id").agg(
        F.min(F.when(kind == "cancel", seq)).alias("cancel_seq"),
        F.min(F.when(~F.coalesce(kind.isin(*KNOWN_KINDS), F.lit(False)), seq)).alias("invalid_seq"),
    )
    repeats = repeats.groupBy("request_id").agg(F.min("seq").alias("twice_seq"))
    end = F.least("twice_seq", "invalid_seq", "cancel_seq")
    return ends.join(repeats, "request_id", "left").select(
        "request_id",
        F.when(end.isNull(), EOF)
        .when(F.col("twice_seq") == end, HEADER_TWICE)
        .when(F.col("invalid_seq") == end, INVALID_ARGUMENT)
        .otherwise(CANCELLED)
        .alias("status"),
    )


def session_records(records: DataFrame) -> DataFrame:
    """Number of records per session and whether they count up from 0 without gaps."""
    counts = (
        records.groupBy("request_id")
        .agg(
            F.count("*").alias("n_records"),
            F.min("record_num").alias("lowest"),
            F.max("record_num").alias("highest"),
        )
    )
    dense = (F.col("lowest") == 0) & (F.col("highest") == F.col("n_records") - 1)
    return counts.select("request_id", "n_records", dense.alias("is_dense"))


def record_metas(metas: DataFrame) -> DataFrame:
    """One row per record the metadata describes."""
    rows = metas.select("request_id", F.explode("meta.record_meta").alias("record_num", "m"))
    return rows.select(
        "request_id",
        "record_num",
        F.col("m.type").alias("record_type"),
        F.col("m.size").alias("declared_size"),
        F.col("m.record_content_type").alias("content_type"),
        F.col("m.block_digest").alias("declared_block_digest"),
        F.col("m.payload_digest").alias("declared_payload_digest"),
        F.col("m.warc_concurrent_to").alias("declared_concurrent_to"),
        F.col("m.sub_collection").alias("sub_collection"),
        F.lit(True).alias("has_meta"),
    )


def join_record_meta(records: DataFrame, metas: DataFrame) -> DataFrame:
    """Records with their metadata; metadata without data is ignored."""
    return records.join(record_metas(metas), ["request_id", "record_num"], "left").withColumn(
        "has_meta", F.coalesce("has_meta", F.lit(False))
    )


def orphan_records(records: DataFrame, metas: DataFrame) -> DataFrame:
    """Records that no metadata describes."""
    described = record_metas(metas).select("request_id", "record_num")
    return records.join(described, ["request_id", "record_num"], "left_anti").select(
        "request_id", "record_num"
    )


def audit(records: DataFrame) -> DataFrame:
    """Compares declared sizes and digests with the computed ones.

    Adds ``size_ok``, ``block_ok`` and ``payload_ok``. Digests may be declared
    in hexadecimal or base32; one that is not declared cannot be wrong.
    """

    def digest_ok(declared: str, computed: str) -> Column:
        return is_missing(F.col(declared)) | digests.same_digest(F.col(declared), F.col(computed))

    return (
        records.withColumn("size_ok", F.coalesce(F.col("declared_size") == F.col("size"), F.lit(False)))
        .withColumn("block_ok", digest_ok("declared_block_digest", "block_digest"))
        .withColumn("payload_ok", digest_ok("declared_payload_digest", "payload_digest"))
    )


def audit_warnings(audited: DataFrame) -> DataFrame:
    """Adds ``warnings``: what lenient validation reports instead of failing."""
    checks = F.array(
        F.when(~F.col("size_ok"), "content length"),
        F.when(~F.col("block_ok"), "block digest"),
        F.when(~F.col("payload_ok"), "payload digest"),
    )
    return audited.withColumn("warnings", F.array_compact(checks))


def record_errors(described: DataFrame, strict: bool) -> DataFrame:
    """Records with ``error``: the first reason they cannot be written, else NULL."""
    audited = audit(described)
    number = F.col("record_num").cast("string")
    wrong = ~(F.col("size_ok") & F.col("block_ok") & F.col("payload_ok"))
    invalid = wrong if strict else F.lit(False)
    return audited.withColumn(
        "error",
        F.when(~F.col("has_meta"), F.concat(F.lit(NO_RECORD_META), number))
        .when(ids.record_type_code(F.col("record_type")) == 0, F.concat(F.lit(NOT_BUILT), number))
        .when(invalid, F.concat(F.lit(NOT_VALID), number)),
    )


def first_errors(errors: DataFrame) -> DataFrame:
    """Per session the error of its lowest-numbered faulty record."""
    return (
        errors.where("error IS NOT NULL")
        .groupBy("request_id")
        .agg(F.min_by("error", "record_num").alias("error"))
    )


def config_error(collection_id: Column, sufficient: Column) -> Column:
    """The error of a session whose collection config is missing or insufficient."""
    name = F.coalesce(collection_id, F.lit(""))
    return F.when(sufficient.isNull(), F.concat(F.lit(NO_CONFIG), name)).otherwise(F.format_string(POOR_CONFIG, name))


def validate_sessions(
    outcomes: DataFrame,
    metas: DataFrame,
    session_counts: DataFrame,
    record_faults: DataFrame,
    config: DataFrame,
) -> DataFrame:
    """Sessions that ended at EOF, with ``error``: the first rule they break.

    Carries the session's metadata and config columns for the next steps.
    """
    sessions = (
        outcomes.where(F.col("status") == EOF)
        .select("request_id")
        .join(metas, "request_id", "left")
        .join(session_counts, "request_id", "left")
        .join(record_faults.withColumnRenamed("error", "record_error"), "request_id", "left")
        .select(
            "request_id",
            F.col("meta").isNotNull().alias("has_meta"),
            F.col("meta.collection_ref").isNotNull().alias("has_ref"),
            F.col("meta.collection_ref.id").alias("collection_id"),
            F.col("meta.target_uri").alias("target_uri"),
            F.col("meta.ip_address").alias("ip_address"),
            F.col("meta.fetch_ts").alias("fetch_ts"),
            "is_dense",
            "record_error",
        )
    )
    error = (
        F.when(~F.col("has_meta"), NO_META)
        .when(~F.col("has_ref"), NO_COLLECTION)
        .when(is_missing(F.col("ip_address")), NO_ADDRESS)
        .when(is_missing(F.col("target_uri")), NO_TARGET)
        .when(
            ~F.coalesce("sufficient", F.lit(False)), config_error(F.col("collection_id"), F.col("sufficient"))
        )
        .when(F.col("record_error").isNotNull(), F.col("record_error"))
        .when(~F.col("is_dense"), NOT_DENSE)
    )
    return (
        join_config(sessions, config)
        .withColumn("error", error)
        .drop("has_meta", "has_ref", "is_dense", "record_error", "sufficient")
    )


def session_status(outcomes: DataFrame, validated: DataFrame) -> DataFrame:
    """Final status, reply code and error of every session."""
    errors = validated.select("request_id", "error")
    ended = outcomes.join(errors, "request_id", "left")
    status = (
        F.when(F.col("status") != EOF, F.col("status"))
        .when(F.col("error").isNotNull(), "REJECTED")
        .otherwise("OK")
    )
    codes = F.create_map(*[F.lit(part) for pair in STATUS_CODES.items() for part in pair])
    return ended.select(
        "request_id", status.alias("status"), F.element_at(codes, status).alias("code"), "error"
    )


def last_values(messages: DataFrame, names: list[str]) -> DataFrame:
    """Per session the values that its last message has in some columns; nulls don't count."""
    last = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name) for name in dict.fromkeys(names)]
    return messages.groupBy("request_id").agg(*last)


def accepted_records(described: DataFrame, validated: DataFrame, arrivals: DataFrame | None = None) -> DataFrame:
    """Records of valid sessions, ready for the revisit decision, with the columns of ``arrivals`` if there are any.

    Declared digests are kept; a missing one is replaced by the computed one.
    """
    sessions = validated.where("error IS NULL").drop("error")
    ingested = [name for name in arrivals.columns if name != "request_id"] if arrivals is not None else []
    if ingested:
        sessions = sessions.join(arrivals, "request_id")
    return described.join(sessions, "request_id").select(
        *ingested,
        "request_id",
        "record_num",
        "record_type",
        "target_uri",
        "ip_address",
        "content_type",
        "fetch_ts",
        "collection_id",
        F.coalesce(present(F.col("sub_collection")), F.lit("UNDEFINED")).alias("sub_collection"),
        F.coalesce(present(F.col("declared_payload_digest")), "payload_digest").alias("payload_digest"),
        F.coalesce(present(F.col("declared_block_digest")), "block_digest").alias("block_digest"),
        "header_size",
        "size",
        "header_sha1",
        "declared_concurrent_to",
        "collection",
        "description",
        "dedup_policy",
        "rotation_policy",
        "compress",
        "file_size",
    )
