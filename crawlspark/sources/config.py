"""Collection configuration: a dimension table of JSON documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.schemas import COLLECTION_CONFIG
from crawlspark.sources.documents import decode_lenient


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Config documents stored as JSON lines."""
    return flatten_config(spark.read.schema(COLLECTION_CONFIG).json(path))


def decode_config(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Config documents held as JSON text in ``column``."""
    decoded = decode_lenient(F.col(column), COLLECTION_CONFIG).alias("config")
    return flatten_config(documents.select(decoded).select("config.*"))


def flatten_config(documents: DataFrame) -> DataFrame:
    """One row per collection; ``sufficient`` marks those that can be written to."""
    return documents.select(
        F.col("id").alias("collection_id"),
        F.col("meta.name").alias("collection"),
        F.col("meta.description").alias("description"),
        F.coalesce("collection.collectionDedupPolicy", F.lit("NONE")).alias("dedup_policy"),
        F.coalesce("collection.fileRotationPolicy", F.lit("NONE")).alias("rotation_policy"),
        F.coalesce("collection.compress", F.lit(False)).alias("compress"),
        F.coalesce("collection.fileSize", F.lit(0)).cast("long").alias("file_size"),
        (F.col("meta").isNotNull() & F.col("collection").isNotNull()).alias("sufficient"),
    )


def join_config(sessions: DataFrame, config: DataFrame) -> DataFrame:
    """Sessions with the config of their collection; a miss leaves NULLs.

    No broadcast is forced: Spark broadcasts the config when its size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise joins by shuffle,
    where AQE splits the sessions of a hot collection.
    """
    return sessions.join(config, "collection_id", "left")
