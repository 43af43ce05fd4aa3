"""Calendar buckets: rotation keys, time to the next rotation, name prefixes."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlspark.functions.text import present

# Rotation policies from finest to coarsest after NONE, with the
# pattern of their bucket key and the calendar unit they follow.
POLICIES = ("NONE", "HOURLY", "DAILY", "MONTHLY", "YEARLY")
BUCKET_PATTERNS = {
    "HOURLY": "yyyyMMddHH",
    "DAILY": "yyyyMMdd",
    "MONTHLY": "yyyyMM",
    "YEARLY": "yyyy",
}
BUCKET_UNITS = {"HOURLY": "hour", "DAILY": "day", "MONTHLY": "month", "YEARLY": "year"}

MICROS_PER_SECOND = 1_000_000


def local_clock(ts: Column, time_zone: str) -> Column:
    """The wall clock of ``time_zone`` for an instant; the session zone is UTC."""
    return ts if time_zone == "UTC" else F.from_utc_timestamp(ts, time_zone)


def _by_policy(policy: Column, branches: dict) -> Column:
    chain = F
    for name, value in branches.items():
        chain = chain.when(policy == name, value)
    return chain


def rotation_key(ts: Column, policy: Column) -> Column:
    """Bucket key of ``ts``; empty for NONE and for anything unknown."""
    keys = {name: F.date_format(ts, pattern) for name, pattern in BUCKET_PATTERNS.items()}
    return _by_policy(policy, keys).otherwise(F.lit(""))


def micros_to_next_rotation(ts: Column, policy: Column) -> Column:
    """Microseconds until the next calendar boundary; NULL where none comes."""
    waits = {
        name: F.unix_micros(F.date_trunc(unit, ts) + F.expr(f"interval 1 {unit}")) - F.unix_micros(ts)
        for name, unit in BUCKET_UNITS.items()
    }
    return _by_policy(policy, waits)


def _rank(policy: Column) -> Column:
    ranks = reduce(list.__add__, [[F.lit(name), F.lit(rank)] for rank, name in enumerate(POLICIES)])
    return F.coalesce(F.try_element_at(F.create_map(*ranks), policy), F.lit(0))


def effective_rotation(dedup_policy: Column, rotation_policy: Column) -> Column:
    """The finer of both policies; a dedup policy of NONE never wins."""
    dedup, rotation = _rank(dedup_policy), _rank(rotation_policy)
    finer = (dedup > 0) & (dedup < rotation)
    return F.when(finer, dedup_policy).otherwise(F.coalesce(rotation_policy, F.lit("NONE")))


def collection_final_name(name: Column, sub_collection: Column, bucket: Column) -> Column:
    """``name[_SUB][_bucket]``; the file prefix is this plus a dash."""
    sub = F.nullif(present(sub_collection), F.lit("UNDEFINED"))
    return F.concat_ws("_", name, sub, present(bucket))


def file_prefix(final_name: Column) -> Column:
    return F.concat(final_name, F.lit("-"))


def file_name(final_name: Column, opened: Column, serial: Column, host: str, compress: Column) -> Column:
    """``<prefix><14 digits>-<serial>-<host>.warc[.gz]``; the serial has at least 4 digits."""
    return F.concat(
        file_prefix(final_name),
        F.date_format(opened, "yyyyMMddHHmmss"),
        F.lit("-"),
        F.format_string("%04d", serial),
        F.lit(f"-{host}.warc"),
        F.when(compress, F.lit(".gz")).otherwise(F.lit("")),
    )


def bucket_end(bucket: Column, time_zone: str = "UTC") -> Column:
    """The instant at which a calendar bucket ends, NULL for one that never does. The number of digits tells its grain."""
    grains = {4: ("0101", "1 YEAR"), 6: ("01", "1 MONTH"), 8: ("", "1 DAY"), 10: ("", "1 HOUR")}
    ends = F.lit(None).cast("timestamp")
    for digits, (rest, step) in grains.items():
        form = "yyyyMMddHH"[: digits + len(rest)]
        begin = F.try_to_timestamp(F.concat(bucket, F.lit(rest)), F.lit(form))
        ends = F.when(F.length(bucket) == digits, F.to_utc_timestamp(begin + F.expr(f"INTERVAL {step}"), time_zone)).otherwise(ends)
    return ends
