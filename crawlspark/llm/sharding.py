"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Each partition's rows are permuted locally. How many of them go to each shard is
drawn from the multivariate hypergeometric law that a uniform shuffle of all rows has, so
shard sizes come out exact. Rows are exchanged by this matrix and permuted again in their shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlspark.workspace import Scratch

#: Rows of a shard that one task orders.
BLOCK_ROWS = 1 << 14
_PART_BITS = 33


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53) + F.lit(2.0**-54)


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` rows out of ``population`` are among the ``marked`` ones, from a uniform number.

    Outcomes are visited from the most likely one upwards and then downwards until their weights add up
    to the uniform share of all weights. Outcomes more than twelve deviations away have a
    weight below what double precision can tell from none.
    """
    given = F.struct(
        population.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("d"),
        uniform.alias("u"),
    )

    def bounds(v: Column) -> Column:
        mode = F.floor((v["d"] + 1) * (v["k"] + 1) / (v["n"] + 2))
        spread = F.sqrt(v["d"] * (v["k"] / v["n"]) * (1 - v["k"] / v["n"]) * (v["n"] - v["d"]) / F.greatest(v["n"] - 1, F.lit(1.0)))
        reach = F.ceil(spread * 12) + 12
        low, high = F.greatest(F.lit(0.0), v["d"] + v["k"] - v["n"]), F.least(v["d"], v["k"])
        return F.struct(
            v["n"].alias("n"), v["k"].alias("k"), v["d"].alias("d"), v["u"].alias("u"), mode.alias("mode"),
            F.greatest(low.cast("long"), mode - reach).alias("low"), F.least(high.cast("long"), mode + reach).alias("high"),
        )

    def draw(v: Column) -> Column:
        none = F.array().cast("array<bigint>")
        up = F.when(v["high"] > v["mode"], F.sequence(v["mode"] + 1, v["high"])).otherwise(none)
        down = F.when(v["low"] < v["mode"], F.sequence(v["mode"], v["low"] + 1, F.lit(-1).cast("long"))).otherwise(none)
        # Weights relative to the mode: of x from that of x - 1, and of x - 1 from that of x.
        rise = lambda x: (v["k"] - x + 1) * (v["d"] - x + 1) / (x * (v["n"] - v["k"] - v["d"] + x))

        def total(steps: Column, factor: Callable[[Column], Column]) -> Column:
            start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
            return F.aggregate(
                steps,
                start,
                lambda s, x: _let(
                    s["weight"] * factor(x), lambda w: F.struct(w.alias("weight"), (s["sum"] + w).alias("sum"))
                ),
                lambda s: s["sum"],
            )

        def walk(steps: Column, factor: Callable[[Column], Column], left: Column, shift: int) -> Column:
            start = F.struct(F.lit(1.0).alias("weight"), left.alias("left"), F.lit(None).cast("bigint").alias("found"))
            return F.aggregate(
                steps,
                start,
                lambda s, x: F.when(s["found"].isNotNull(), s).otherwise(
                    _let(
                        s["weight"] * factor(x),
                        lambda w: F.struct(
                            w.alias("weight"),
                            (s["left"] - w).alias("left"),
                            F.when(s["left"] - w <= 0, x + shift).alias("found"),
                        ),
                    )
                ),
                lambda s: s["found"],
            )

        def fall(x: Column) -> Column:
            return 1 / rise(x)

        return _let(
            F.struct(total(up, rise).alias("above"), total(down, fall).alias("below")),
            lambda t: _let(
                v["u"] * (t["above"] + t["below"] + 1) - 1,
                lambda left: F.when(left <= 0, v["mode"]).otherwise(
                    F.coalesce(walk(up, rise, left, 0), walk(down, fall, left - t["above"], -1), v["mode"])
                ),
            ),
        )

    drawn = _let(_let(given, bounds), draw)
    return F.when(marked >= population, draws).when((marked <= 0) | (draws <= 0), F.lit(0)).otherwise(drawn).cast("long")


def _split(items: Column, room: Column, shards: int, *salt: Column) -> Column:
    """For each item (key, n), in order, how many of its n rows go to each shard that has ``room`` for so many."""

    def row(state: Column, item: Column) -> Column:
        start = F.struct(
            item["n"].alias("left"),
            F.aggregate(state["room"], F.lit(0).cast("long"), lambda t, x: t + x).alias("rest"),
            F.array().cast("array<bigint>").alias("counts"),
        )

        def shard(s: Column, i: Column) -> Column:
            room_here = F.get(state["room"], i)
            drawn = hypergeometric(s["rest"], room_here, s["left"], _uniform(*salt, item["key"], i))
            return _let(
                drawn,
                lambda x: F.struct(
                    (s["left"] - x).alias("left"),
                    (s["rest"] - room_here).alias("rest"),
                    F.concat(s["counts"], F.array(x)).alias("counts"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, shard, lambda s: s["counts"])

    start = F.struct(
        room.alias("room"), F.array().cast("array<struct<key:bigint,counts:array<bigint>>>").alias("rows")
    )
    return F.aggregate(
        items,
        start,
        lambda state, item: _let(
            row(state, item),
            lambda counts: F.struct(
                F.zip_with(state["room"], counts, lambda a, b: a - b).alias("room"),
                F.concat(state["rows"], F.array(F.struct(item["key"].alias("key"), counts.alias("counts")))).alias("rows"),
            ),
        ),
        lambda state: state["rows"],
    )


def communication_matrix(parts: DataFrame, shards: int, scratch: Scratch, seed: int = 0) -> DataFrame:
    """(part, counts): exact numbers of rows from each partition (part, n) to each shard.

    Partitions are taken in groups of about the square root of their number: the first draw splits
    the groups over the shards, the second one each group's rows over its partitions. So no
    task handles more than that many partitions.
    """
    rows, count, top = parts.agg(F.sum("n"), F.count("*"), F.max("part")).first()
    if not rows:
        return parts.select("part", F.array().cast("array<bigint>").alias("counts"))
    width = max(1, math.isqrt(int(top)) + 1)
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    grouped = parts.select(F.floor(F.col("part") / width).alias("group"), "part", F.col("n").cast("long").alias("n"))
    groups = grouped.groupBy("group").agg(F.sum("n").alias("n"))
    item = lambda key: F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("n").alias("n"))))
    room = F.array(*[F.lit(s).cast("long") for s in sizes])
    first = scratch.keep(
        groups.agg(item("group").alias("items"))
        .select(F.explode(_split(F.col("items"), room, shards, F.lit(seed), F.lit(1))).alias("row"))
        .select(F.col("row.key").alias("group"), F.col("row.counts").alias("room")),
        "groups",
    )
    second = (
        grouped.groupBy("group")
        .agg(item("part").alias("items"))
        .join(first, "group")
        .select(F.explode(_split(F.col("items"), F.col("room"), shards, F.lit(seed), F.lit(2))).alias("row"))
    )
    return scratch.keep(second.select(F.col("row.key").alias("part"), F.col("row.counts").alias("counts")), "matrix")


def sharded(rows: DataFrame, shards: int, scratch: Scratch, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in a shard), uniformly shuffled.

    Shard sizes differ by one at most. The values don't matter, so equal rows, nulls and hot values are spread
    like any others. Partitions and local orders are written down first, so tasks that are run again place
    their rows alike. Columns of the input that are named like the new ones are replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot", "_part", "_rank", "_draw")]
    local = rows.select(*kept, F.rand(seed).alias("_draw")).sortWithinPartitions("_draw").drop("_draw")
    number = F.monotonically_increasing_id()
    stored = scratch.keep(
        local.withColumn("_id", number).select(
            *kept, F.shiftright("_id", _PART_BITS).alias("_part"), (F.col("_id") % (1 << _PART_BITS)).alias("_rank")
        ),
        "permuted",
    )
    parts = scratch.keep(stored.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n")), "parts")
    matrix = communication_matrix(parts, shards, scratch, seed).select(
        F.col("part").alias("_part"),
        F.aggregate(
            "counts",
            F.array(F.lit(0).cast("long")),
            lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)),
        ).alias("_bounds"),
    )
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (shards * block_rows)))
    key = F.xxhash64(F.lit(seed), F.lit("second"), "_part", "_rank")
    spot = F.shiftrightunsigned("_key", 11)
    placed = (
        stored.join(matrix, "_part")
        .withColumn("shard", (F.size(F.filter("_bounds", lambda b: b <= F.col("_rank"))) - 1).cast("int"))
        .withColumn("_key", key)
        .withColumn("_block", F.floor(spot * F.lit(blocks * 2.0**-53)))
        .drop("_bounds")
    )
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(
        placed.groupBy("shard", "_block").count().select(
            "shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
        ),
        "offsets",
    )
    inside = Window.partitionBy("shard", "_block").orderBy(spot, "_part", "_rank")
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, ["shard", "_block"])
        .select(*kept, "shard", (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"))
    )
