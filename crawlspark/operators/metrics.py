"""Counts over sessions, writers, calendar buckets and values."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from crawlspark.functions.calendar import POLICIES, rotation_key

# Upper edges of the duration histograms, in seconds.
HISTOGRAM_EDGES = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10,
    20, 30, 40, 50, 60, 120, 180, 240,
)


def session_counts(statuses: DataFrame) -> DataFrame:
    """Write calls per outcome and reply code; their sum is the count of all calls."""
    return statuses.groupBy("status", "code").agg(F.count("*").alias("n"))


def observe_sessions(statuses: DataFrame, observation: Observation) -> DataFrame:
    """The same sessions, counted on the way: all calls, and those replied to with an error."""
    return statuses.observe(
        observation,
        F.count("*").alias("calls"),
        F.count_if(F.col("code") != "OK").alias("errors"),
    )


def writer_load(records: DataFrame) -> DataFrame:
    """Records and bytes that go to each writer, one per collection and sub-collection."""
    key = F.concat_ws("#", "collection", "sub_collection")
    return records.groupBy(key.alias("writer_key")).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes")
    )


def group_load(records: DataFrame) -> DataFrame:
    """Records and bytes of each file group."""
    return records.groupBy("file_group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def bucket_counts(records: DataFrame, ts: str) -> DataFrame:
    """Records per calendar bucket, at every grain.

    Counted by hour first; the coarser grains add up the hours.
    """
    hours = records.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count("*").alias("n"))
    policies = F.explode(F.array(*[F.lit(policy) for policy in POLICIES]))
    return (
        hours.select("hour", "n", policies.alias("policy"))
        .groupBy("policy", rotation_key(F.col("hour"), F.col("policy")).alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )


def bucket_histogram(rows: DataFrame, value: Column, edges: tuple = HISTOGRAM_EDGES) -> DataFrame:
    """Cumulative histogram: how many values are at most each edge, in one pass."""
    counts = rows.agg(
        *[F.count(F.when(value <= float(edge), True)).alias(f"le_{i}") for i, edge in enumerate(edges)],
        F.count(value).alias("le_inf"),
    )
    labels = [*map(str, edges), "+Inf"]
    entries = [
        F.struct(F.lit(label).alias("le"), F.col(name).alias("n"))
        for label, name in zip(labels, counts.columns)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("bin")).select("bin.*")
