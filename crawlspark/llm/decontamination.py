"""Benchmark leaks by canonical templates, also with other numbers, names or units.

Words become template tokens: letters and digits only, in lower case; numbers,
names and units become typed placeholders. Template windows of documents and
benchmark items are hash-joined. What stands in the slots must then agree: along
one alignment of document and item, equal slot values of the item
must meet equal values of the document. Windows of the words as they are find verbatim
copies, also of items that have hardly anything but numbers and names.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.membership import bitmap, may_contain
from crawlspark.llm.tokens import Texts, lower_ascii, mix, slices, texts, window_hashes, window_starts, words
from crawlspark.workspace import Scratch

WINDOW_WORDS = 5
CONTAINED_PERCENT = 80
#: A window is used if so many of its words (or half of them, if it is shorter) are no placeholders.
LITERAL_WORDS = 2

# Words that count as units behind a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs ton tons pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years c f k degrees percent usd eur gbp dollar dollars euro euros cent cents "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms kmh mph w kw "
    "v hz gb mb kb"
).split()

#: Readings of a text, whose windows meet only their own kind: template tokens, the same with names also where a
#: sentence begins, or the words as they are.
TEMPLATE, NAMED, LITERAL = 0, 1, 2

NUMBER, NAME, UNIT = (np.uint64(v) for v in (11, 12, 13))

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT, _UPPER, _STOP, _MINUS = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[[ord(c) for c in ".!?:;|"]] = True


def _whole(values: list[str]) -> Texts:
    data = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


_UNIT_HASHES = np.sort(words(_whole(UNITS), lower=True, keep=_LETTERS).hashes)


def lowered(column: pa.Array, part: Texts) -> np.ndarray:
    """The bytes of a slice in lower case: by Unicode, or A-Z only in a text whose length that would change."""
    low = texts(pc.utf8_lower(column))
    lengths, whole = np.diff(part.offsets), low.data[low.offsets[0] : low.offsets[-1]]
    same = lengths == np.diff(low.offsets)
    if same.all():
        return whole
    out = lower_ascii(part.data)
    for i in np.flatnonzero(same):
        out[part.offsets[i] : part.offsets[i + 1]] = low.data[low.offsets[i] : low.offsets[i + 1]]
    return out


def readings(part: Texts, low: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Readings of a slice, given also in lower case: by kind canonical hashes and which are slots; hashes of the words; bounds by text.

    A number begins with a digit (after signs and brackets). A unit stands behind
    a number, or is written together with it ("5km" is one number slot). A name is capitalised,
    goes on in lower case and does not begin a text, a line or a sentence; as ``NAMED``, it may. Only the latter
    depends on the word alone, not on what stands before it. Words without letters and digits are dropped.
    """
    data = part.data
    found = words(Texts(low, part.offsets), keep=_LETTERS)
    some = np.flatnonzero(found.hashes)
    starts, ends, values = found.starts[some], found.ends[some], found.hashes[some]
    first = np.searchsorted(some, found.first)
    if not len(some):
        return {k: (values, np.zeros(0, bool)) for k in (TEMPLATE, NAMED, LITERAL)}, values, first
    at = np.flatnonzero(_LETTERS[data])
    lead = at[np.searchsorted(at, starts)]
    tail = at[np.searchsorted(at, ends) - 1]
    number = _DIGIT[data[lead]]
    follows = np.zeros(len(some), bool)
    follows[1:] = True
    follows[first[:-1][np.diff(first) > 0]] = False
    before = np.maximum(np.arange(len(some)) - 1, 0)
    unit = follows & number[before] & (_UNIT_HASHES[np.searchsorted(_UNIT_HASHES, values) % len(_UNIT_HASHES)] == values)
    breaks = np.cumsum(_STOP[data] | (data == 10))
    within = breaks[starts] - breaks[tail[before]] == 0
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123) | (data >= 128))])
    large = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitalised = _UPPER[data[lead]] & (large[ends] - large[starts] == 1) & (small[ends] > small[starts])
    out = {LITERAL: (values, np.zeros(len(values), bool))}
    for kind, name in ((TEMPLATE, follows & within & capitalised), (NAMED, capitalised)):
        canonical = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, values)))
        out[kind] = canonical, number | unit | name
    return out, values, first


_WINDOW = "id long, kind int, key long, at long, size int, slots array<long>"


def template_windows(rows: DataFrame, sizes: list[int] | None, wanted: np.ndarray | None = None) -> DataFrame:
    """Usable windows of the texts of ``rows`` (id, text): kind, key, place of the first token, length, slot values.

    ``sizes`` are the window lengths; None stands for ``WINDOW_WORDS``, or all the words of a
    shorter text. With ``wanted`` only windows whose key the filter may contain are returned.
    """

    def cut(batches):
        for batch in batches:
            for lo, hi, part in slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                read, values, first = readings(part, lowered(batch.column(1).slice(lo, hi - lo), part))
                counts = np.diff(first)
                # Names where a sentence begins are all that tells the first two readings apart.
                renamed = np.concatenate([[0], np.cumsum(read[NAMED][0] != read[TEMPLATE][0])])
                for size, kind in product(sizes or range(1, WINDOW_WORDS + 1), (TEMPLATE, NAMED, LITERAL)):
                    tokens, slot = read[kind]
                    if kind == TEMPLATE:
                        begin, bounds = window_starts(first, size)
                        of = np.repeat(np.arange(hi - lo), np.diff(bounds))
                        place = begin - first[of]
                        runs = window_hashes(tokens, begin, size)
                    elif kind == NAMED:
                        other = np.flatnonzero(renamed[begin + size] > renamed[begin])
                        runs[other] = window_hashes(tokens, begin[other], size)
                    else:
                        runs = window_hashes(tokens, begin, size)
                    keys = mix(runs + np.uint64(kind))
                    slots = np.concatenate([[0], np.cumsum(slot)])
                    literal = size - (slots[begin + size] - slots[begin])
                    use = literal >= min(LITERAL_WORDS, (size + 1) // 2)
                    if not sizes and size < WINDOW_WORDS:
                        use &= counts[of] == size
                    if wanted is not None:
                        use &= may_contain(wanted, keys.view(np.int64))
                    use = np.flatnonzero(use)
                    listed = [
                        values[b : b + size][slot[b : b + size]].view(np.int64) for b in begin[use].tolist()
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(of[use])),
                            pa.array(np.full(len(use), kind), pa.int32()),
                            pa.array(keys[use].view(np.int64)),
                            pa.array(place[use], pa.int64()),
                            pa.array(np.full(len(use), size), pa.int32()),
                            pa.array(listed, pa.list_(pa.int64())),
                        ],
                        names=["id", "kind", "key", "at", "size", "slots"],
                    )

    return rows.mapInArrow(cut, _WINDOW)


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, matched, windows): documents that hold at least 80 % of an item's windows, or all its words in order.

    ``matched`` counts the item's places whose window the document has in an alignment with consistent slots.
    Template windows decide, and windows of the words as they are for verbatim copies: all of them in one alignment, or 80 %
    for an item without a usable template window. Null texts and items without a word match nothing. A repeated item_id stands for the
    union of its rows' places; rows that share a doc_id are one document. Rows without an id can't be named and are left out.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tests = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    items = scratch.keep(template_windows(tests, None), "items")
    wanted = bitmap(items.select("key").distinct(), "key")
    # Documents are cut at the lengths that windows of items have; these are at most WINDOW_WORDS values.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [WINDOW_WORDS]
    # Documents are cut once; the windows that items may have are read for slots and for places.
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = scratch.keep(template_windows(named, sizes, wanted), "found")
    place = ["doc_id", "item_id", "kind"]
    theirs = [F.col("id").alias("doc_id"), "kind", "key", F.col("at").alias("doc_at"), F.col("slots").alias("theirs")]
    matches = found.select(*theirs).join(
        items.select(F.col("id").alias("item_id"), "kind", "key", "at", "slots"), ["kind", "key"]
    )
    # One row per slot that an alignment pairs up; conflicts are item values that meet two values.
    paired = (
        matches.where(F.size("slots") > 0)
        .select(
            *place,
            (F.col("doc_at") - F.col("at")).alias("shift"),
            F.explode(F.arrays_zip("slots", "theirs")).alias("pair"),
        )
        .groupBy(*place, "shift", "pair.slots")
        .agg((F.min("pair.theirs") != F.max("pair.theirs")).alias("torn"))
        .where("torn")
        .select(*place, "shift")
        .distinct()
    )
    counts = items.groupBy(F.col("id").alias("item_id")).agg(
        *[F.count_distinct(F.when(F.col("kind") == k, F.col("at"))).alias(f"windows{k}") for k in (TEMPLATE, NAMED, LITERAL)]
    )
    windows_of = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"windows{k}")) for k in (TEMPLATE, NAMED, LITERAL)])
    aligned = (
        matches.select(*place, (F.col("doc_at") - F.col("at")).alias("shift"), "at")
        .join(paired, [*place, "shift"], "left_anti")
        .distinct()
    )
    # Places met under any alignment, and the most under one.
    most = aligned.groupBy(*place, "shift").count().groupBy(*place).agg(F.max("count").alias("most"))
    enough = F.col("matched") * 100 >= F.col("windows") * CONTAINED_PERCENT
    return (
        aligned.groupBy(*place)
        .agg(F.count_distinct("at").alias("matched"))
        .join(most, place)
        .join(counts, "item_id")
        .withColumn("windows", windows_of)
        .where(
            F.when((F.col("kind") == LITERAL) & (F.col(f"windows{TEMPLATE}") > 0), F.col("most") == F.col("windows"))
            .otherwise(enough)
        )
        .groupBy("doc_id", "item_id")
        .agg(F.min(F.struct("kind", "matched", "windows")).alias("found"))
        .select("doc_id", "item_id", "found.matched", "found.windows")
    )
