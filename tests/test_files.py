import itertools
import random

from pyspark.sql import functions as F

from crawlspark.operators import files, running
from crawlspark.plans import archive
from crawlspark.settings import ArchiveSettings


def test_running_total_equals_brute_force(spark):
    random.seed(3)
    ids = [random.randrange(-(1 << 62), 1 << 62) for _ in range(200)]
    ids += [random.randrange(1 << 22) for _ in range(400)] + list(range(300))
    rows = [(random.choice("ab"), request, n, random.randrange(1000)) for request in set(ids) for n in range(2)]
    frame = spark.createDataFrame(rows, "g string, request_id long, n int, size long")
    for levels in (0, 1, 2):
        found = running.running_total(frame, ["g"], "request_id", "size", "start", ties=("n",), levels=levels)
        starts = {(r.request_id, r.n): r.start for r in found.collect()}
        assert len(starts) == len(rows)
        for group in "ab":
            total = 0
            for _, request, n, size in sorted(r for r in rows if r[0] == group):
                assert starts[(request, n)] == total
                total += size


def placed_rows(spark, scratch, rows, limit, pool_size=1):
    frame = spark.createDataFrame(
        [(r, n, f"g{g}", size, limit) for r, n, g, size in rows],
        "request_id long, record_num int, file_group string, size long, file_size long",
    ).withColumns({"fetch_ts": F.lit("2024-01-01").cast("timestamp"), "collection_final_name": F.col("file_group")})
    return archive.file_offsets(frame, "size", ArchiveSettings(pool_size=pool_size), scratch).collect()


def test_offsets_tile_every_file(spark, scratch):
    random.seed(5)
    rows = [(i // 2, i % 2, i % 3, random.choice([10, 50, 400])) for i in range(500)]
    found = placed_rows(spark, scratch, rows, limit=300, pool_size=2)
    assert len(found) == len(rows)
    by_file = itertools.groupby(
        sorted(found, key=lambda r: (r.file_group, r.lane, r.serial, r.offset)),
        key=lambda r: (r.file_group, r.lane, r.serial),
    )
    serials = {}
    for (group, lane, serial), members in by_file:
        end, keys = 0, []
        for row in members:
            assert row.offset == end
            assert end < 300
            end += row.size
            keys.append((row.request_id, row.record_num))
        assert keys == sorted(keys)
        serials.setdefault((group, lane), []).append(serial)
    # Records larger than the limit skip volumes, but no serial.
    assert all(numbers == list(range(1, len(numbers) + 1)) for numbers in serials.values())


def test_no_limit_makes_one_file(spark, scratch):
    found = placed_rows(spark, scratch, [(i, 0, 0, 10) for i in range(20)], limit=0)
    assert {r.serial for r in found} == {1}
    assert max(r.offset for r in found) == 190


def test_siblings_name_each_other(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d"), (2, 2, "e"), (3, 0, "f")]
    frame = spark.createDataFrame(rows, "request_id long, record_num int, warc_id string").withColumn(
        "declared_concurrent_to", F.when(F.col("warc_id") == "b", F.array(F.lit("z")))
    )
    found = {r.warc_id: r.concurrent_to for r in files.with_concurrent_to(frame).collect()}
    assert found == {"a": ["b"], "b": ["z", "a"], "c": ["d", "e"], "d": ["c"], "e": ["c"], "f": []}


def test_files_of_one_final_name_never_share_a_file_name(spark):
    hours = ["c@2024010110", "c@2024010111"]
    rows = spark.createDataFrame(
        [(group, lane, volume, 10 * volume) for group in hours for lane in range(3) for volume in (0, 1, 4, 9)],
        "file_group string, lane int, volume long, start long",
    ).selectExpr("*", "'c' AS collection_final_name", "timestamp'2024-01-01' AS fetch_ts", "false AS compress")
    used = spark.createDataFrame([("c", 7), ("d", 99)], "collection_final_name string, used long")
    for before, least in ((None, 1), (used, 8)):
        named = files.with_file_name(files.number_files(rows), ArchiveSettings(pool_size=3), before).collect()
        assert len({r.file_name for r in named}) == 24
        assert sorted(r.file_number for r in named) == list(range(least, least + 24))
        # Numbers go on with the rotation, whatever the second in which files are opened.
        assert max(r.file_number for r in named if r.file_group == hours[0]) == least + 11
        assert {r.serial for r in named} == {1, 2, 3, 4}
