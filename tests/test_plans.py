"""What must hold in the plans for the pipeline to scale."""

from pyspark.sql import functions as F

from crawlspark import inputs
from crawlspark.operators import assembly, metrics, revisit
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_no_shuffle_carries_blocks(spark, sf_dir):
    pages = inputs.page_records(spark, sf_dir)
    assert exchanges(executed(revisit.measure_records(pages))) == []
    narrow = revisit.route_sessions(revisit.measure_records(pages))
    plan = executed(narrow)
    below_shuffle = plan.split("Exchange hashpartitioning")[1]
    assert len(exchanges(plan)) == 1 and "sha1" in below_shuffle


def test_kept_tables_hold_no_blocks(spark, sf_dir, scratch):
    settings = ArchiveSettings()
    config = inputs.collection_config(spark, sf_dir)
    keyed = archive.keyed_records(inputs.event_records(spark, sf_dir), config, settings, scratch)
    decided = archive.decided_records(keyed, settings, scratch)
    assert not {"header", "payload", "data"} & set(keyed.columns + decided.columns)


def test_hot_keys_meet_only_by_salt(spark, sf_dir, scratch):
    config = inputs.collection_config(spark, sf_dir)
    keyed = archive.keyed_records(inputs.event_records(spark, sf_dir), config, ArchiveSettings(), scratch)
    plan = executed(revisit.detect_revisits(keyed, 256))
    wide = [line for line in exchanges(plan) if "salt" not in line]
    # The one exchange by key alone sees rows already reduced to (key, salt).
    assert len(wide) == 1
    assert "partial_min" in plan.split(wide[0])[1]
    # Spark may turn the join into a broadcast by size, but nothing forces it.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = executed(revisit.detect_revisits(keyed, 256))
        assert "Broadcast" not in shuffled and "SortMergeJoin" in shuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_read_only_what_they_need(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    plan = executed(metrics.bucket_histogram(events, F.col("value")))
    assert "ReadSchema: struct<value:double>" in plan
    counted = executed(metrics.bucket_counts(events.withColumn("at", F.col("ts").cast("timestamp")), "at"))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in counted
    assert "partial_count" in counted


def test_chunks_are_shuffled_once(spark, sf_dir):
    records = assembly.assemble_records(inputs.conversation_messages(spark, sf_dir))
    plan = executed(records)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "Window" not in plan and "listagg" not in plan
