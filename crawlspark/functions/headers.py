"""Named fields and text of archive records."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlspark.functions import ids
from crawlspark.functions.text import CRLF, present

INFO_CONTENT_TYPE = "application/warc-fields"


def _field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))


def _set_fields(*fields: Column) -> Column:
    return F.filter(F.array(*fields), lambda f: f["value"].isNotNull())


def record_fields(concurrent_to: Column) -> Column:
    """Ordered header fields of a record; fields without a value are left out.

    Reads the columns of a rewritten record. ``concurrent_to`` is an array of
    record ids, one header field each.
    """
    siblings = F.transform(
        F.coalesce(concurrent_to, F.array().cast("array<string>")),
        lambda warc_id: _field("WARC-Concurrent-To", ids.urn(warc_id)),
    )
    fixed = _set_fields(
        _field("WARC-Type", F.lower("record_type")),
        _field("WARC-Record-ID", ids.urn(F.col("warc_id"))),
        _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-IP-Address", F.col("ip_address")),
        _field("WARC-Date", ids.rfc3339(F.col("fetch_ts"))),
        _field("Content-Length", F.col("size")),
        _field("Content-Type", F.col("content_type")),
        _field("WARC-Block-Digest", F.col("block_digest")),
        _field("WARC-Payload-Digest", present(F.col("payload_digest"))),
        _field("WARC-Profile", F.col("profile")),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        _field("WARC-Refers-To-Date", F.col("refers_to_date")),
    )
    return F.concat(fixed, siblings)


def head_text(fields: Column, warc_version: str) -> Column:
    """Version line and header fields up to and including the blank line."""
    lines = F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit(CRLF)))
    return F.concat(F.lit(f"WARC/{warc_version}{CRLF}"), F.array_join(lines, ""), F.lit(CRLF))


def record_bytes(head: Column, block_size: Column) -> Column:
    """Bytes a record takes in its file, with the two line ends after the block."""
    return F.octet_length(head).cast("long") + block_size + F.lit(2 * len(CRLF))


def info_body(warc_version: str, host: str) -> Column:
    """Lines of a file's leading info record.

    The sub-collection line is present only if there is one.
    """
    sub = F.nullif(present(F.col("sub_collection")), F.lit("UNDEFINED"))
    fields = _set_fields(
        _field("format", F.lit(f"WARC File Format {warc_version}")),
        _field("collection", F.col("collection")),
        _field("description", F.coalesce("description", F.lit(""))),
        _field("subCollection", sub),
        _field("isPartOf", F.col("collection_final_name")),
        _field("host", F.lit(host)),
    )
    lines = F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit(CRLF)))
    return F.array_join(lines, "")


def info_record(body: Column, warc_version: str) -> Column:
    """The whole info record of a file as text."""
    fields = _set_fields(
        _field("WARC-Type", F.lit("warcinfo")),
        _field("WARC-Record-ID", ids.urn(ids.name_uuid(F.col("file_name")))),
        _field("WARC-Date", ids.rfc3339(F.col("opened"))),
        _field("WARC-Filename", F.col("file_name")),
        _field("Content-Length", F.octet_length(body)),
        _field("Content-Type", F.lit(INFO_CONTENT_TYPE)),
    )
    return F.concat(head_text(fields, warc_version), body, F.lit(2 * CRLF))
