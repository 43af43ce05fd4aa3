"""From records to places in rotating archive files."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlspark.functions import headers
from crawlspark.functions.calendar import file_name
from crawlspark.operators.running import running_total
from crawlspark.settings import ArchiveSettings

LANE = ["file_group", "lane"]
DEFAULT_FILE_SIZE = 1 << 30


def with_concurrent_to(records: DataFrame) -> DataFrame:
    """Adds ``concurrent_to``: ids declared for the record, then its siblings.

    The session's first record is its hub: every other record names the hub
    and the hub names every other record. Two records, the usual request and
    response, thus name each other; n records make 2(n-1) references instead
    of n(n-1). The list of members is made once per session and reaches the hub
    only; both are in the partitioning that routes the session.
    """
    sessions = records.groupBy("request_id").agg(
        F.min(F.struct("record_num", "warc_id"))["warc_id"].alias("hub"),
        F.array_sort(F.collect_list(F.struct("record_num", "warc_id"))).alias("members"),
    )
    others = F.slice("members", 2, F.greatest(F.size("members"), F.lit(1)))
    hubs = sessions.select("request_id", "hub", F.transform(others, lambda m: m["warc_id"]).alias("others"))
    hub = Window.partitionBy("request_id")
    named = records.withColumn("hub", F.min(F.struct("record_num", "warc_id")).over(hub)["warc_id"])
    none = F.array().cast("array<string>")
    joined = named.join(
        hubs.select("request_id", F.col("hub").alias("warc_id"), "others"), ["request_id", "warc_id"], "left"
    )
    siblings = F.coalesce("others", F.array("hub"))
    return joined.withColumn(
        "concurrent_to", F.array_union(F.coalesce("declared_concurrent_to", none), siblings)
    ).drop("hub", "others", "declared_concurrent_to")


def head(settings: ArchiveSettings) -> Column:
    """Header text of a record."""
    return headers.head_text(headers.record_fields(F.col("concurrent_to")), settings.warc_version)


def info(settings: ArchiveSettings) -> Column:
    """Leading info record of a record's file."""
    return headers.info_record(
        headers.info_body(settings.warc_version, settings.host), settings.warc_version
    )


def with_stored_size(records: DataFrame, settings: ArchiveSettings) -> DataFrame:
    """Adds the bytes the record will take in a file.

    The texts are made again where a file is written; no shuffle before that
    carries them.
    """
    return records.withColumn("stored_size", headers.record_bytes(head(settings), F.col("size")))


def with_lane(records: DataFrame, pool_size: int) -> DataFrame:
    """A session stays in one lane; lanes of a group are written side by side."""
    return records.withColumn("lane", F.pmod(F.col("request_id"), F.lit(pool_size)).cast("int"))


def with_volume(records: DataFrame, size: str) -> DataFrame:
    """Adds ``start`` and ``volume``: place in the lane, and which file that falls into.

    Records of a (file group, lane) follow each other in order of request and
    record. A new file starts where the running size passes a multiple of
    ``file_size``, so a file exceeds the limit by less than one record. A
    collection that sets no size has files of ``DEFAULT_FILE_SIZE``, so that no
    task has to write an endless one.
    """
    placed = running_total(records, LANE, "request_id", size, "start", ties=("record_num",))
    limit = F.when(F.col("file_size") > 0, F.col("file_size")).otherwise(F.lit(DEFAULT_FILE_SIZE))
    volume = F.floor(F.col("start") / limit)
    return placed.withColumn("volume", volume.cast("long"))


def number_files(placed: DataFrame, clock: str = "fetch_ts") -> DataFrame:
    """Adds ``serial``, ``file_number`` and ``offset``: the file of a record and its place in it.

    Serials count the files of a lane from 1 without gaps. Numbers count those of a collection final name,
    over its rotation buckets and lanes, as the name of a file has to tell all of them apart. A file is ``opened`` at the least ``clock``
    of its records, which is also what its rotation bucket is taken from.
    """
    files = placed.groupBy(*LANE, "volume").agg(
        F.min("start").alias("file_start"),
        F.min(clock).alias("opened"),
        F.min("collection_final_name").alias("name"),
        F.lit(1).alias("one"),
    )
    # One level of pages is enough: a lane has fewer than 2^40 volumes.
    numbered = running_total(files, LANE, "volume", "one", "earlier", levels=1)
    # A window by name sees a narrow row per file.
    number = F.row_number().over(Window.partitionBy("name").orderBy("file_group", "volume", "lane"))
    numbered = numbered.select(
        *LANE, "volume", "file_start", "opened", (F.col("earlier") + 1).alias("serial"), number.cast("long").alias("file_number")
    )
    return (
        placed.join(numbered, [*LANE, "volume"])
        .withColumn("offset", F.col("start") - F.col("file_start"))
        .drop("start", "file_start", "volume")
    )


def with_file_name(records: DataFrame, settings: ArchiveSettings, used: DataFrame | None = None) -> DataFrame:
    """Adds ``file_name``; numbers start behind the ones ``used`` (collection_final_name, used) so far."""
    numbered = records
    if used is not None:
        number = F.col("file_number") + F.coalesce("used", F.lit(0))
        numbered = records.join(used, "collection_final_name", "left").withColumn("file_number", number).drop("used")
    return numbered.withColumn(
        "file_name",
        file_name(
            F.col("collection_final_name"), F.col("opened"), F.col("file_number"), settings.host, F.col("compress")
        ),
    )


def last_numbers(placed: DataFrame) -> DataFrame:
    """The highest file number of each collection final name."""
    return placed.groupBy("collection_final_name").agg(F.max("file_number").cast("long").alias("number"))


def file_info(placed: DataFrame, settings: ArchiveSettings) -> DataFrame:
    """One row per file with the body of its leading info record."""
    files = placed.select(
        "file_name", "opened", "collection", "description", "sub_collection", "collection_final_name"
    ).distinct()
    return files.select(
        "file_name", headers.info_body(settings.warc_version, settings.host).alias("body")
    )


def behind_info_record(placed: DataFrame, settings: ArchiveSettings) -> DataFrame:
    """Moves offsets behind the info record; ``opens_file`` marks each file's first record."""
    return placed.withColumn("opens_file", F.col("offset") == 0).withColumn(
        "offset", F.col("offset") + F.octet_length(info(settings))
    )
