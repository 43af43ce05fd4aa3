"""The whole archive on a stream: messages in, WARC files, index, statuses and dedup rows out."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlspark.operators.assembly import record_chunks
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings
from crawlspark.streaming import sessions
from crawlspark.workspace import Scratch, delete_dir


def run_batch(
    spark: SparkSession, config: DataFrame, path: str, batch_id: int, settings: ArchiveSettings, ingested: str | None = None
) -> None:
    """The sessions that one micro-batch ended are validated, decided and written; repeatable by its id."""
    if sessions.read_ended(spark, path, batch_id).isEmpty():
        return
    scratch = Scratch(spark, f"{path}/scratch/batch={batch_id}")
    # Joined with their sessions once, not by each step that reads them.
    messages = scratch.keep(sessions.read_sessions(spark, path, batch_id, ingested), "messages")
    found = archive.read_sessions(messages, config, settings, scratch)
    found.statuses().write.mode("overwrite").parquet(f"{path}/status/batch={batch_id}")
    keyed = archive.key_records(found.accepted(), settings, scratch)
    archive.archive_batch(spark, keyed, record_chunks(messages), path, batch_id, settings)
    delete_dir(spark, scratch.path)


def start(
    messages: DataFrame,
    config: Callable[[], DataFrame],
    path: str,
    settings: ArchiveSettings,
    ingested: str | None = None,
    **options,
) -> sessions.Running:
    """Stream of messages -> ``warc``, ``index``, ``status`` and ``crawled`` under ``path``."""

    def then(spark: SparkSession, batch_id: int) -> None:
        run_batch(spark, config(), path, batch_id, settings, ingested)

    return sessions.start(messages, path, ingested, then=then, **options)
