"""Revisit detection on a stream: the batch decision against a growing index."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crawlspark.operators import revisit
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings
from crawlspark.sources import crawled_index
from crawlspark.workspace import Scratch, delete_dir


def decide_batch(
    keyed: DataFrame, path: str, batch: int, settings: ArchiveSettings, scratch: Scratch
) -> DataFrame:
    """Decide one micro-batch and register its new keys; repeatable by batch id.

    Only index rows of earlier batches count, so a repeated batch decides the
    same, and it overwrites what it registered before.
    """
    spark = keyed.sparkSession
    known = crawled_index.known_rows(spark, f"{path}/crawled", keyed, before_batch=batch)
    decided = archive.decided_records(keyed, settings, scratch, known)
    crawled_index.append_batch(revisit.index_rows(decided), f"{path}/crawled", batch, settings.index_buckets)
    return decided


def start(
    records: DataFrame,
    config: Callable[[], DataFrame],
    path: str,
    settings: ArchiveSettings,
    **trigger,
) -> StreamingQuery:
    """Stream of records -> decided records under ``path/decided``, rejected sessions under ``path/rejected``.

    A session must not be split over micro-batches; ``streaming.sessions``
    emits whole ones. Late records join the bucket of their own clock, so no
    watermark drops them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        scratch, known = Scratch(batch.sparkSession, f"{path}/scratch/batch={batch_id}"), config()
        rejected = archive.rejected_sessions(batch, known)
        rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        keyed = archive.keyed_records(batch, known, settings, scratch)
        decided = decide_batch(keyed, path, batch_id, settings, scratch)
        decided.write.mode("overwrite").parquet(f"{path}/decided/batch={batch_id}")
        delete_dir(batch.sparkSession, scratch.path)

    return (
        records.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def read_decided(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/decided")
