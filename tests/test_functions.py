import datetime
import itertools

import pytest
from pyspark.sql import functions as F

import sample
from crawlspark.functions import calendar, digests, ids
from crawlspark.settings import ArchiveSettings

#: A leap day, the last second of a leap February, the first second of a year, and a plain afternoon.
TIMES = [
    datetime.datetime(2024, 2, 29, 8, 15, 30),
    datetime.datetime(2020, 2, 29, 23, 59, 59),
    datetime.datetime(2023, 1, 1),
    datetime.datetime(2022, 7, 14, 16, 45, 1),
]
KEY_FORMATS = {"NONE": "", "HOURLY": "%Y%m%d%H", "DAILY": "%Y%m%d", "MONTHLY": "%Y%m", "YEARLY": "%Y"}


def next_bucket(at, policy):
    hour = at.replace(minute=0, second=0)
    if policy == "HOURLY":
        return hour + datetime.timedelta(hours=1)
    day = hour.replace(hour=0)
    if policy == "DAILY":
        return day + datetime.timedelta(days=1)
    if policy == "MONTHLY":
        return (day.replace(day=1) + datetime.timedelta(days=32)).replace(day=1)
    return day.replace(year=at.year + 1, month=1, day=1)


def test_rotation_of_every_policy(spark):
    rows = [(t, p) for p in KEY_FORMATS for t in TIMES]
    found = spark.createDataFrame(rows, "ts timestamp, policy string").select(
        "ts",
        "policy",
        calendar.rotation_key(F.col("ts"), F.col("policy")).alias("key"),
        calendar.micros_to_next_rotation(F.col("ts"), F.col("policy")).alias("micros"),
    ).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.key == row.ts.strftime(KEY_FORMATS[row.policy])
        wait = None if row.policy == "NONE" else next_bucket(row.ts, row.policy) - row.ts
        assert row.micros == (wait and wait // datetime.timedelta(microseconds=1))


def test_effective_rotation_is_the_finer_policy(spark):
    pairs = list(itertools.product(calendar.POLICIES, repeat=2))
    found = spark.createDataFrame(pairs, "d string, r string").select(
        "d", "r", calendar.effective_rotation(F.col("d"), F.col("r")).alias("e")
    )
    for d, r, effective in found.collect():
        finer = d != "NONE" and calendar.POLICIES.index(d) < calendar.POLICIES.index(r)
        assert effective == (d if finer else r)


@pytest.mark.parametrize(
    "sub, policy, serial, compress, pattern",
    [
        ("UNDEFINED", "NONE", 1, False, r"^news-\d{14}-0001-h\.warc$"),
        ("UNDEFINED", "YEARLY", 2, False, r"^news_\d{4}-\d{14}-0002-h\.warc$"),
        ("DNS", "MONTHLY", 1, False, r"^news_DNS_\d{6}-\d{14}-0001-h\.warc$"),
        ("DNS", "DAILY", 12345, True, r"^news_DNS_\d{8}-\d{14}-12345-h\.warc\.gz$"),
    ],
)
def test_file_names(spark, sub, policy, serial, compress, pattern):
    ts = F.lit("2024-02-29 08:15:30").cast("timestamp")
    key = calendar.rotation_key(ts, F.lit(policy))
    name = calendar.collection_final_name(F.lit("news"), F.lit(sub), key)
    full = calendar.file_name(name, ts, F.lit(serial), "h", F.lit(compress))
    assert spark.range(1).where(full.rlike(pattern)).count() == 1


def test_local_clock_moves_the_bucket(spark):
    ts = F.lit("2021-12-31 23:59:59").cast("timestamp")
    key = calendar.rotation_key(calendar.local_clock(ts, "Europe/Oslo"), F.lit("YEARLY"))
    assert spark.range(1).select(key).first()[0] == "2022"


def test_digests_of_the_sample_session(spark):
    parts = spark.createDataFrame(
        [(sample.REQUEST_HEADER, b""), (sample.RESPONSE_HEADER, sample.PAYLOAD)],
        "header binary, payload binary",
    )
    found = parts.select(
        digests.sha1_hex(F.concat("header", "payload")),
        digests.sha1_hex(F.col("payload")),
        digests.sha1_base32(F.sha1("header")),
    ).collect()
    assert found[0][:2] == (sample.REQUEST_BLOCK, sample.EMPTY_PAYLOAD)
    assert found[1] == (sample.RESPONSE_BLOCK, sample.RESPONSE_PAYLOAD, sample.REVISIT_BLOCK)


def test_both_spellings_of_a_digest_are_equal(spark):
    hex_digest = digests.sha1_hex(F.lit(sample.RESPONSE_HEADER))
    found = spark.range(1).select(
        digests.same_digest(hex_digest, F.lit(sample.REVISIT_BLOCK)),
        digests.same_digest(F.lower(hex_digest), F.lit(sample.REVISIT_BLOCK)),
        digests.same_digest(hex_digest, F.lit(sample.RESPONSE_BLOCK)),
        digests.same_digest(hex_digest, F.lit("sha1:short")),
    )
    assert found.first() == (True, True, False, False)


UUID = "0e2d9a51-7c44-4b1f-9a60-3f5b8c1d2e7a"


@pytest.mark.parametrize(
    "raw, parsed",
    [
        (f"<urn:uuid:{UUID}>", UUID),
        (f"urn:uuid:{UUID}", UUID),
        (UUID.upper(), UUID),
        ("{" + UUID + "}", UUID),
        (UUID.replace("-", ""), UUID),
        ("<urn:uuid:abc0e2d9a51-7c44-4b1f-9a60-3f5b8c1d2e7a>", None),
        ("<urn:uuid:>", None),
        ("", None),
    ],
)
def test_record_ids(spark, raw, parsed):
    assert spark.range(1).select(ids.parse_warc_id(F.lit(raw))).first()[0] == parsed


@pytest.mark.parametrize(
    "raw, parsed",
    [
        ("2024-02-29T06:07:08Z", datetime.datetime(2024, 2, 29, 6, 7, 8)),
        ("2024-02-29T06:07:08.987654321-03:30", datetime.datetime(2024, 2, 29, 9, 37, 8, 987654)),
        ("1999", None),
        ("19991231", None),
        ("2023-02-30T00:00:00Z", None),
        ("no date", None),
    ],
)
def test_dates(spark, raw, parsed):
    found = spark.range(1).select(F.date_format(ids.coerce_date(F.lit(raw)), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert found.first()[0] == (parsed and parsed.strftime("%Y-%m-%d %H:%M:%S.%f"))


def test_record_types_round_trip(spark):
    names = [*ids.RECORD_TYPE_CODES, "OTHER", None]
    found = spark.createDataFrame([(n,) for n in names], "t string").select(
        "t", ids.record_type_code(F.col("t")).alias("c"), ids.record_type_name(ids.record_type_code(F.col("t"))).alias("n")
    )
    for name, code, back in found.collect():
        assert (code, back) == ((ids.RECORD_TYPE_CODES[name], name) if name in ids.RECORD_TYPE_CODES else (0, ""))


def test_settings_reject_unknown_versions():
    assert ArchiveSettings(warc_version="1.0").revisit_profile.endswith("1.0/revisit/identical-payload-digest")
    with pytest.raises(ValueError):
        ArchiveSettings(warc_version="0.9")
