"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has ``CHUNKS * CHUNK_SYMBOLS`` symbols of 16 bits, one
per hash function. Two signatures at a distance (symbols that differ) of at
most ``GUARANTEED_DISTANCE`` have, by pigeonhole, a chunk with at most one error:
its symbols agree once the right one is left out. So each chunk is indexed
once per symbol left out, and every pair under the distance shares a key. At a
similarity of 0.8 a pair shares no key with probability below 4e-5. Candidates
are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.components import connected_components
from crawlspark.llm.membership import bitmap, may_contain
from crawlspark.llm.tokens import mix, random_table, slices, windows, words
from crawlspark.workspace import Scratch

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
CHUNKS, CHUNK_SYMBOLS = 12, 7
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: So many errors can't put two into every chunk.
GUARANTEED_DISTANCE = 2 * CHUNKS - 1
#: Candidates may differ in so many symbols, judged by four bits of each. 0.8 similar sets differ in
#: 15.8 of the 84 on average with a deviation of 3.6; more than 35 have a probability below 1e-6.
SIGNATURE_DISTANCE = 35
_LANES = -(-SYMBOLS // 16)
_SKETCH = [f"nibbles{k}" for k in range(_LANES)]

_FREQUENCY_SLOTS = 1 << 16


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)).astype(np.int64)


_FACTORS = random_table(SYMBOLS, 2)


def _shingles(part, size: int) -> Iterator[np.ndarray]:
    """The set of each text as sorted hashes."""
    found = words(part, lower=True)
    runs, bounds = windows(found.hashes, found.first, size)
    for i, count in enumerate(found.counts):
        if count >= size:
            yield np.unique(runs[bounds[i] : bounds[i + 1]])
        elif count:
            own = found.hashes[found.first[i] : found.first[i + 1]]
            yield windows(own, np.array([0, count]), int(count))[0]
        else:
            yield np.zeros(0, np.uint64)


def _sketch(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of each non-empty set: two sums that identify it, its symbols, and four more bits of each."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    least = mix(np.stack([np.minimum.reduceat(flat * factor, begin) for factor in _FACTORS], 1))
    nibbles = np.zeros((len(sets), 16 * _LANES), np.uint8)
    nibbles[:, :SYMBOLS] = (least >> np.uint64(40)).astype(np.uint8) & 15
    return {
        "set_a": np.add.reduceat(mix(flat), begin).view(np.int64),
        "set_b": np.add.reduceat(mix(flat ^ np.uint64(0x5DEECE66D)), begin).view(np.int64),
        "symbols": (least & np.uint64(0xFFFF)).astype(np.uint16),
        "nibbles": (nibbles[:, ::2] << 4 | nibbles[:, 1::2]).view(np.int64),
    }


_SIGNATURE = (
    "doc_id long, n_shingles long, set_a long, set_b long, symbols binary, "
    + ", ".join(f"{name} long" for name in _SKETCH)
)


def signatures(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: set size, set identity, signature. All null or 0 without words."""

    def sign(batches):
        for batch in batches:
            for lo, hi, part in slices(batch.column(1)):
                sets = list(_shingles(part, shingle_words))
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                found = _sketch([sets[i] for i in some]) if len(some) else None
                at = np.full(len(sets), -1)
                at[some] = np.arange(len(some))
                empty = pa.array(at < 0)
                take = pa.array(np.maximum(at, 0))

                def column(values, kind, empty=empty, take=take):
                    return pa.compute.if_else(empty, pa.scalar(None, kind), pa.array(values, kind).take(take))

                if found is None:
                    none = [pa.nulls(len(sets), t) for t in (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * _LANES)]
                else:
                    symbols = [row.tobytes() for row in found["symbols"]]
                    none = [
                        column(found["set_a"], pa.int64()),
                        column(found["set_b"], pa.int64()),
                        column(symbols, pa.binary()),
                        *[column(found["nibbles"][:, k], pa.int64()) for k in range(_LANES)],
                    ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), *none],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "symbols", *_SKETCH],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, _SIGNATURE)


def index_keys(rows: DataFrame) -> DataFrame:
    """(key, rep): each chunk of a signature, once per symbol left out."""
    begin = F.col("chunk") * (2 * CHUNK_SYMBOLS)
    kept = F.concat(
        F.substr("symbols", begin + 1, F.col("skip") * 2),
        F.substr("symbols", begin + F.col("skip") * 2 + 3, F.lit(2 * CHUNK_SYMBOLS - 2) - F.col("skip") * 2),
    )
    return (
        rows.select("rep", "symbols", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_SYMBOLS - 1))).alias("skip"))
        .select(F.xxhash64("chunk", "skip", kept).alias("key"), "rep")
    )


def _near(x: str, y: str) -> Column:
    """Whether the sketches and sizes of two rows allow the similarity."""
    distance = F.lit(0)
    for lane in _SKETCH:
        differ = F.col(f"{x}.{lane}").bitwiseXOR(F.col(f"{y}.{lane}"))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1))
        distance = distance + F.bit_count(differ.bitwiseAND(F.lit(0x1111111111111111)))
    small = F.least(f"{x}.n_shingles", f"{y}.n_shingles")
    large = F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    return (distance <= SIGNATURE_DISTANCE) & (small * 100 >= large * SIMILARITY_PERCENT)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def compare(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(100 * common >= SIMILARITY_PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(similar, pa.bool_())
            )

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def _shingle_sets(docs: DataFrame, wanted: np.ndarray, shingle_words: int) -> DataFrame:
    def gather(batches):
        for batch in batches:
            ids = batch.column(0)
            known = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
            hit = known & may_contain(wanted, ids.fill_null(0).to_numpy())
            batch = batch.filter(pa.array(hit))
            for lo, hi, part in slices(batch.column(1)):
                sets = [s.tobytes() for s in _shingles(part, shingle_words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "shingles"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(gather, "doc_id long, shingles binary")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(key, rep, left): so many of each set's rarest shingles that two similar sets share one.

    ``left`` counts the shingles from this one on in the order. If a fifth of a set plus one, taken
    in an order that all sets share, has nothing in common with that of another set, their
    similarity is below 0.8. Rare shingles first keeps passages that many documents quote out of it. Frequencies are counted by ``_FREQUENCY_SLOTS`` hash slots, so the
    table that the tasks need has a fixed size; it decides the order only.
    """

    def count(batches):
        totals = np.zeros(_FREQUENCY_SLOTS, np.int64)
        for batch in batches:
            for own in batch.column(0):
                totals += np.bincount(_slots(np.frombuffer(own.as_buffer(), np.uint64)), minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["slot", "n"])

    counts = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    seen = np.zeros(_FREQUENCY_SLOTS, np.int64)
    for slot, n in counts.collect():
        seen[slot] = n
    sent = sets.sparkSession.sparkContext.broadcast(seen)

    def pick(batches):
        for batch in batches:
            of, keys, left = [], [], []
            for i, own in enumerate(batch.column(1)):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                size = len(own) - -(-len(own) * SIMILARITY_PERCENT // 100) + 1
                keys.append(own[np.lexsort((own, sent.value[_slots(own)]))[:size]])
                left.append(np.arange(len(own), len(own) - size, -1))
                of += [i] * size
            keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
            left = np.concatenate([*left, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(of, pa.int64())), pa.array(left)],
                names=["key", "rep", "left"],
            )

    return sets.select("doc_id", "shingles").mapInArrow(pick, "key long, rep long, left long")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= 80 * union of their shingle
    sets; ``component_id`` is the least doc_id that links lead to and ``kept``
    marks it. Texts shorter than a shingle count as one shingle; null and empty
    texts are linked with nothing. A null doc_id can't stand for others: it takes
    the component of its equals, or null, and is kept only if it is alone in that. Rows that
    share a doc_id are one document. Other columns are ignored.

    Equal sets are one class from the start. A class is compared with the least
    member of each of its index keys, so a group of copies costs as many pairs as
    it has members. Documents under a key that stays apart then meet by their
    rare shingles, which loses no link.
    """
    signed = scratch.keep(signatures(docs, shingle_words), "signed")
    some = signed.where("n_shingles > 0")
    identity = ["set_a", "set_b", "n_shingles"]
    reps = scratch.keep(
        some.groupBy(*identity)
        .agg(
            F.min("doc_id").alias("rep"),
            *[F.first(c).alias(c) for c in ("symbols", *_SKETCH)],
        ),
        "classes",
    )
    known = reps.where("rep is not null")
    keys = index_keys(known)
    groups = scratch.keep(
        keys.groupBy("key")
        .agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("members"))
        .where("members > 1 and hub < last"),
        "keys",
    )
    large = groups.where("members > 2").select("key", "hub")
    members = scratch.keep(keys.join(large, "key"), "members")
    sketch = ["n_shingles", *_SKETCH]
    shown = known.select("rep", *sketch)

    spokes = (
        groups.where("members = 2")
        .select(F.col("last").alias("a"), F.col("hub").alias("b"))
        .union(members.where("rep <> hub").select("rep", "hub"))
        .distinct()
    )
    spokes = scratch.keep(
        spokes.join(shown.alias("x"), F.col("a") == F.col("x.rep"))
        .join(shown.alias("y"), F.col("b") == F.col("y.rep"))
        .where(_near("x", "y"))
        .select("a", "b"),
        "spokes",
    )
    # The copies and their hubs: each document's first hub joins most of a group.
    first = spokes.groupBy("a").agg(F.min("b").alias("b"))
    rest = spokes.join(first, ["a", "b"], "left_anti")
    wanted = bitmap(
        spokes.select("a").union(spokes.select("b")).union(members.select("rep")).distinct(), "a"
    )
    sets = scratch.keep(_shingle_sets(docs, wanted, shingle_words), "sets")
    links = scratch.keep(_confirmed(first, sets), "links")

    def joined(links: DataFrame) -> DataFrame:
        return scratch.keep(connected_components(links, scratch), "joined")

    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        x, y = (parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in "ab")
        return (
            pairs.join(x, "a", "left")
            .join(y, "b", "left")
            .where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b"))
            .select("a", "b")
        )

    more = scratch.keep(_confirmed(apart(rest, joined(links)), sets), "links")
    links = links.union(more)
    parts = joined(links)

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows (key, rep) of keys with more than one part, each with the part most of its key is in."""
        placed = scratch.keep(
            rows.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
                *rows.columns, F.coalesce("component", "rep").alias("part")
            ),
            "placed",
        )
        split = (
            placed.groupBy("key", "part")
            .count()
            .groupBy("key")
            .agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"))
            .where("parts > 1")
            .select("key", "main")
        )
        return placed.join(split, "key")

    # Documents under keys that are not all joined by now: pairs that share a rare shingle, those
    # outside a shingle's largest part against all of it.
    open_ = mixed(members).select(F.col("rep").alias("doc_id")).distinct()
    open_sets = scratch.keep(sets.join(open_, "doc_id"), "open")
    rare = mixed(_rare_shingles(open_sets)).join(shown, "rep")
    # The least overlap of two similar sets, from their sizes, must fit into what is left of both.
    needed = (F.col("x.n_shingles") + F.col("y.n_shingles")) * SIMILARITY_PERCENT
    fits = F.least("x.left", "y.left") * (100 + SIMILARITY_PERCENT) >= needed
    crossing = (
        rare.where("part <> main")
        .alias("x")
        .join(rare.alias("y"), F.col("x.key") == F.col("y.key"))
        .where((F.col("x.part") != F.col("y.part")) & fits & _near("x", "y"))
        .select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b"))
        .distinct()
        .join(spokes, ["a", "b"], "left_anti")
    )
    last = scratch.keep(_confirmed(crossing, sets), "links")
    parts = joined(links.union(last))

    # A doc_id that stands for several sets joins them.
    of_class = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        *identity, F.coalesce("component", "rep").alias("component_id")
    )
    some = some.select("doc_id", *identity).join(of_class, identity)
    none = signed.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return (
        some.select(columns)
        .union(none.select(columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
