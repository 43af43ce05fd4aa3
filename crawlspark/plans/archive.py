"""The archive pipeline: from records or messages to files and index rows."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.functions.ids import storage_ref
from crawlspark.operators import assembly, files, revisit, sessions
from crawlspark.settings import ArchiveSettings
from crawlspark.sources import crawled_index, warc_sink
from crawlspark.sources.config import join_config
from crawlspark.workspace import Scratch, delete_dir, dir_exists


def keyed_records(
    records: DataFrame, config: DataFrame, settings: ArchiveSettings, scratch: Scratch
) -> DataFrame:
    """Records measured, routed and keyed.

    The kept table is narrow: header and payload are read once, here, and
    once more by the writer. Records of a collection without a sufficient
    config are left out; ``rejected_sessions`` names them.
    """
    known = join_config(revisit.measure_records(records), config).where("sufficient")
    return key_records(known, settings, scratch)


def rejected_sessions(records: DataFrame, config: DataFrame) -> DataFrame:
    """(request_id, error) of sessions whose collection has no sufficient config."""
    found = records.select("request_id", "collection_id").distinct()
    return (
        join_config(found, config)
        .where(~F.coalesce("sufficient", F.lit(False)))
        .select("request_id", sessions.config_error(F.col("collection_id"), F.col("sufficient")).alias("error"))
    )


def key_records(measured: DataFrame, settings: ArchiveSettings, scratch: Scratch) -> DataFrame:
    routed = files.with_concurrent_to(revisit.route_sessions(revisit.with_record_id(measured)))
    named = revisit.with_final_name(routed, settings)
    return scratch.keep(revisit.with_revisit_key(named), "keyed")


def decided_records(
    keyed: DataFrame, settings: ArchiveSettings, scratch: Scratch, index: DataFrame | None = None
) -> DataFrame:
    """Keyed records after the revisit decision and its rewrite.

    Their sizes in a file are final from here on and are kept with them.
    """
    decided = revisit.detect_revisits(keyed, settings.salts, index, settings.order)
    rewritten = revisit.rewrite_revisits(decided, settings)
    return scratch.keep(files.with_stored_size(rewritten, settings), "decided")


def placed_records(
    decided: DataFrame, settings: ArchiveSettings, scratch: Scratch, used: DataFrame | None = None
) -> DataFrame:
    """Decided records with file name and offset in the file.

    Only narrow columns take part; the blocks join them in the writer. File
    numbers go on from those ``used`` by earlier batches.
    """
    offsets = file_offsets(decided, "stored_size", settings, scratch)
    return files.behind_info_record(files.with_file_name(offsets, settings, used), settings)


def file_offsets(
    decided: DataFrame, size: str, settings: ArchiveSettings, scratch: Scratch
) -> DataFrame:
    """Records with file serial and offset, counting ``size`` bytes per record."""
    laned = files.with_lane(decided, settings.pool_size)
    volumes = scratch.keep(files.with_volume(laned, size), "volumes")
    return files.number_files(volumes, settings.clock)


def write_index(placed: DataFrame, stored: bool = False) -> DataFrame:
    """The reply: one row per record.

    Planned offsets are positions in the uncompressed file, so records of
    compressed collections have no reference before they are written:
    ``write_archive`` gives the stored positions with ``stored`` set.
    """
    known = F.lit(True) if stored else ~F.col("compress")
    return placed.select(
        "request_id",
        "record_num",
        "record_type",
        "warc_id",
        F.when(known, storage_ref(F.col("file_name"), F.col("offset"))).alias("storage_ref"),
        "block_digest",
        "payload_digest",
        F.coalesce("refers_to", F.lit("")).alias("revisit_ref"),
        "collection_final_name",
    )


def reply_map(index: DataFrame) -> DataFrame:
    """One map per session from record number to its index row.

    A session is one write call whose metadata names all its records in one
    message, so the map is no larger than the metadata that came in.
    """
    entry = F.struct(
        "record_type", "warc_id", "storage_ref", "block_digest", "payload_digest", "revisit_ref",
        "collection_final_name",
    )
    entries = F.array_sort(F.collect_list(F.struct("record_num", entry.alias("reply"))))
    return index.groupBy("request_id").agg(F.map_from_entries(entries).alias("reply"))


@dataclass
class Sessions:
    """What the messages of a table amount to."""

    records: DataFrame
    metas: DataFrame
    described: DataFrame
    outcomes: DataFrame
    validated: DataFrame

    def statuses(self) -> DataFrame:
        return sessions.session_status(self.outcomes, self.validated)

    arrivals: DataFrame | None = None

    def accepted(self) -> DataFrame:
        return sessions.accepted_records(self.described, self.validated, self.arrivals)


def read_sessions(
    messages: DataFrame, config: DataFrame, settings: ArchiveSettings, scratch: Scratch
) -> Sessions:
    """Sessions assembled and validated.

    The message bytes are read once, by the assembly; all checks work on its
    narrow result. A clock or an order of arrival other than what the metadata has are
    columns of the messages; a session has those of its last message.
    """
    records = scratch.keep(assembly.assemble_records(messages), "assembled")
    metas = scratch.keep(sessions.last_meta(messages), "metas")
    described = sessions.join_record_meta(records, metas)
    repeats = records.where("twice_seq IS NOT NULL").select("request_id", F.col("twice_seq").alias("seq"))
    outcomes = sessions.session_outcome(messages, repeats)
    faults = sessions.first_errors(sessions.record_errors(described, settings.strict))
    validated = sessions.validate_sessions(
        outcomes, metas, sessions.session_records(records), faults, config
    )
    ingested = [name for name in (settings.clock, settings.order) if name not in (None, "fetch_ts", "request_id")]
    arrivals = sessions.last_values(messages, ingested) if ingested else None
    return Sessions(records, metas, described, outcomes, validated, arrivals)


def write_archive(
    placed: DataFrame, chunks: DataFrame, path: str, settings: ArchiveSettings
) -> DataFrame:
    """Write the WARC files and return the index with the stored positions."""
    warc_sink.write_files(placed, chunks, path, settings)
    stored = warc_sink.read_positions(placed.sparkSession, path)
    return write_index(
        placed.drop("file_name", "offset").join(stored, ["request_id", "record_num"]), stored=True
    )


def archive_batch(
    spark: SparkSession,
    keyed: DataFrame,
    chunks: DataFrame,
    path: str,
    batch: int,
    settings: ArchiveSettings,
) -> None:
    """One batch, repeatable: files, then index rows, then dedup rows.

    The decided and placed rows are written down first: every later step reads
    the same decision, and their lineage ends there. A repeated batch sees the
    dedup rows of earlier batches only and overwrites what it wrote before.
    """
    scratch = Scratch(spark, f"{path}/plan/batch={batch}")
    known = crawled_index.known_rows(spark, f"{path}/crawled", keyed, before_batch=batch)
    decided = decided_records(keyed, settings, scratch, known)
    used = read_numbers(spark, path, batch)
    placed = scratch.keep(placed_records(decided, settings, scratch, used), "placed")
    files.last_numbers(placed).write.mode("overwrite").parquet(f"{path}/numbers/batch={batch}")
    # Files of an earlier try of this batch may have other names.
    warc_sink.delete_files(spark, f"{path}/warc/batch={batch}")
    index = write_archive(placed, chunks, f"{path}/warc/batch={batch}", settings)
    index.write.mode("overwrite").parquet(f"{path}/index/batch={batch}")
    crawled_index.append_batch(revisit.index_rows(decided), f"{path}/crawled", batch, settings.index_buckets)
    delete_dir(spark, scratch.path)


def read_numbers(spark: SparkSession, path: str, before_batch: int) -> DataFrame | None:
    """The highest file number of each collection final name in earlier batches."""
    if not dir_exists(spark, f"{path}/numbers"):
        return None
    rows = spark.read.schema("collection_final_name string, number long, batch long").parquet(f"{path}/numbers")
    earlier = rows.where(F.col("batch") < before_batch)
    return earlier.groupBy("collection_final_name").agg(F.max("number").alias("used"))
