"""Config that may be at most a given age, for micro-batches."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from crawlspark.sources.config import join_config
from crawlspark.workspace import Scratch, delete_dir


class FreshConfig:
    """Config read again once it is older than ``ttl`` seconds; 0 reads always.

    It is asked once per micro-batch. What was read is written down in the
    shared folder, so it holds for its time even if the config files are
    replaced meanwhile; what is older than the last one is deleted.
    """

    def __init__(
        self, read: Callable[[], DataFrame], ttl: float, clock: Callable[[], float] = time.monotonic
    ):
        self.read, self.ttl, self.clock = read, ttl, clock
        self.frame: DataFrame | None = None
        self.kept: list[Scratch] = []
        self.expires = 0.0

    def __call__(self) -> DataFrame:
        if self.frame is None or self.ttl == 0 or self.clock() >= self.expires:
            found = self.read()
            self.kept.append(Scratch(found.sparkSession))
            self.frame = self.kept[-1].keep(found, "config")
            for old in self.kept[:-2]:
                delete_dir(old.spark, old.path)
            self.kept = self.kept[-2:]
            self.expires = self.clock() + self.ttl
        return self.frame


def start_join(sessions: DataFrame, config: FreshConfig, path: str, **trigger) -> StreamingQuery:
    """Stream of sessions joined with the config of its micro-batch, under ``path/joined``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        join_config(batch, config()).write.mode("overwrite").parquet(f"{path}/joined/batch={batch_id}")

    return (
        sessions.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger)
        .start()
    )
