"""Record ids, record types, RFC 3339 dates and storage references."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_UUID = "00000000-0000-0000-0000-000000000000"

# WARC record types and their bit codes; 0 stands for unknown.
RECORD_TYPE_CODES = {
    "WARCINFO": 1,
    "RESPONSE": 2,
    "RESOURCE": 4,
    "REQUEST": 8,
    "METADATA": 16,
    "REVISIT": 32,
    "CONVERSION": 64,
    "CONTINUATION": 128,
}
REVISITABLE_TYPES = ("RESPONSE", "RESOURCE")

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})$"

_HEX_GROUPS = (8, 4, 4, 4, 12)


def _uuid_text(hex_digits: Column) -> Column:
    parts, start = [], 1
    for width in _HEX_GROUPS:
        parts.append(F.substring(hex_digits, start, width))
        start += width
    return F.concat_ws("-", *parts)


def record_uuid(request_id: Column, record_num: Column) -> Column:
    """Record id that stays the same when a stage is recomputed."""
    return _uuid_text(F.sha1(F.concat_ws("|", request_id, record_num).cast("binary")))


def name_uuid(name: Column) -> Column:
    return _uuid_text(F.sha1(name.cast("binary")))


def urn(warc_id: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), warc_id, F.lit(">"))


def parse_warc_id(raw: Column) -> Column:
    """UUID of a record id header, NULL if it is none.

    Accepted are the plain, ``urn:uuid:``, braced and undashed spellings.
    """
    bare = F.regexp_replace(F.regexp_replace(raw, "^<", ""), ">$", "")
    dashed = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    valid = bare.rlike(rf"(?i)^((urn:uuid:)?{dashed}|\{{{dashed}\}}|[0-9a-f]{{32}})$")
    digits = F.regexp_replace(F.lower(bare), r"^urn:uuid:|[{}-]", "")
    return F.when(valid, _uuid_text(digits))


def _lookup(pairs, column: Column) -> Column:
    entries = reduce(list.__add__, [[F.lit(key), F.lit(value)] for key, value in pairs])
    return F.try_element_at(F.create_map(*entries), column)


def record_type_code(record_type: Column) -> Column:
    return F.coalesce(_lookup(RECORD_TYPE_CODES.items(), record_type), F.lit(0))


def record_type_name(code: Column) -> Column:
    return F.coalesce(_lookup([(c, n) for n, c in RECORD_TYPE_CODES.items()], code), F.lit(""))


def is_revisitable(record_type: Column) -> Column:
    return record_type.isin(*REVISITABLE_TYPES)


def coerce_date(raw: Column) -> Column:
    """Timestamp of an RFC 3339 string; NULL for any other string.

    The pattern is needed: a cast alone would accept ``2021`` as a date.
    """
    return F.when(raw.rlike(RFC3339), F.try_to_timestamp(raw))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def storage_ref(file_name: Column, offset: Column) -> Column:
    return F.concat_ws(":", F.lit("warcfile"), file_name, offset)
