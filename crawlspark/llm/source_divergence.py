"""How the sources of a language differ in their terms, from one-hot level products.

Each source counts each term; a count is a level. Indicator columns of (source, level),
multiplied by their transpose, yield the joint table of any two sources: how many terms have one level here and
another there. The price of a pair of levels depends on the levels alone, so the tables give exact divergences.
Terms are dealt into bounded blocks, and the products are summed over blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlspark.llm.tokens import Texts, lower_ascii, slices
from crawlspark.workspace import Scratch

# A term's least documents, the scale of shares, and the ranks of the term part.
LEAST_DOCUMENTS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200

#: Counts (source, term) of a block, terms of one product, and columns of its panels.
BLOCK_COUNTS, PRODUCT_TERMS, PANEL = 200_000, 256, 1024
#: Bytes of text whose terms are counted together before the shuffle.
SLICE_BYTES = 4 << 20

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(part: Texts) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a slice in order, and the text each is from: runs of letters and of characters beyond ASCII, A-Z in lower case."""
    inside = _LETTERS[part.data]
    edges = np.zeros(len(part.data) + 1, bool)
    edges[part.offsets] = True
    starts = np.flatnonzero(inside & (edges[:-1] | ~np.concatenate([[False], inside])[:-1]))
    ends = np.flatnonzero(inside & (edges[1:] | ~np.concatenate([inside, [False]])[1:])) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = lower_ascii(part.data)[inside]
    values = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]
    )
    return values.dictionary_encode(), np.searchsorted(part.offsets, starts, "right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and rows of the group that hold it.

    ``docs`` has lang, source and text; nulls are empty. Each slice of text is summed up before the shuffle.
    """

    def count(batches):
        for batch in batches:
            groups = [batch.column(k).dictionary_encode() for k in (0, 1)]
            width = len(groups[1].dictionary)
            code = groups[0].indices.to_numpy().astype(np.int64) * width + groups[1].indices.to_numpy()
            for lo, hi, part in slices(batch.column(2), SLICE_BYTES):
                terms, doc = terms_of(part)
                if not len(terms):
                    continue
                size = len(terms.dictionary)
                held, times = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
                key = code[lo:hi][held // size] * size + held % size
                order = np.argsort(key, kind="stable")
                begins = np.flatnonzero(np.diff(key[order], prepend=-1))
                key = key[order][begins]
                group, term = pa.array(key // size // width), pa.array(key % size)
                yield pa.RecordBatch.from_arrays(
                    [
                        groups[0].dictionary.take(group),
                        groups[1].dictionary.take(pa.array(key // size % width)),
                        terms.dictionary.take(term).cast(pa.binary()).cast(pa.string()),
                        pa.array(np.add.reduceat(times[order], begins)),
                        pa.array(np.diff(np.append(begins, len(order)))),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(
        count, "lang string, source string, term string, n long, docs long"
    )
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), in two exact steps that stay below 2^63 for totals up to 2.9e14."""
    high = (counts + 1) * 32_000
    return 1 + high // total * 31_250 + high % total * 31_250 // total


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def priced_pairs(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The sum over terms of ``excess`` for every ordered pair of groups.

    ``counts`` is by term and group, ``totals`` by group. Terms of like frequency share a product, as they
    have few levels. A product is cut into panels of columns, so a block needs bounded memory whatever its levels.
    """
    groups = counts.shape[1]
    values = np.zeros((groups, groups), np.int64)
    order = np.argsort(counts.sum(axis=1), kind="stable")
    for lo in range(0, len(order), PRODUCT_TERMS):
        rows = counts[order[lo : lo + PRODUCT_TERMS]]
        levels = [np.unique(rows[:, g], return_inverse=True) for g in range(groups)]
        first = np.concatenate([[0], np.cumsum([len(u) for u, _ in levels])])
        column = np.stack([first[g] + inverse for g, (_, inverse) in enumerate(levels)], 1)
        owner = np.repeat(np.arange(groups), np.diff(first))
        price = np.concatenate([share(u, totals[g]) for g, (u, _) in enumerate(levels)])
        panels = [(a, min(a + PANEL, int(first[-1]))) for a in range(0, int(first[-1]), PANEL)]
        ones = [_indicators(column, a, b) for a, b in panels]
        for (a, b), x in zip(panels, ones, strict=True):
            for (c, d), y in zip(panels, ones, strict=True):
                # Exact, as no entry is above PRODUCT_TERMS.
                joint = (x.T @ y).astype(np.int64)
                worth = joint * excess(price[a:b, None], price[None, c:d])
                mine, theirs = np.unique(owner[a:b], return_index=True), np.unique(owner[c:d], return_index=True)
                sums = np.add.reduceat(np.add.reduceat(worth, mine[1], axis=0), theirs[1], axis=1)
                values[np.ix_(mine[0], theirs[0])] += sums
    return values


def _indicators(column: np.ndarray, begin: int, end: int) -> np.ndarray:
    out = np.zeros((len(column), end - begin), np.float32)
    row, group = np.nonzero((column >= begin) & (column < end))
    out[row, column[row, group] - begin] = 1
    return out


_FOUND = "lang string, source string, part string, item string, value long"


def _blocks(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Pairs and best terms of one block of one language."""
    if not terms.num_rows or not groups.num_rows:
        return _table([], [], [], [], [])
    sources = groups.column("source").combine_chunks()
    totals = groups.column("total").to_numpy()
    lang, lang_total = groups.column("lang")[0].as_py(), groups.column("lang_total")[0].as_py()
    lists = terms.column("counts").combine_chunks()
    at = pc.index_in(lists.flatten().field("source"), sources).to_numpy()
    times = lists.flatten().field("n").to_numpy()
    row = pc.list_parent_indices(lists).to_numpy()
    names = terms.column("term").combine_chunks()
    counts = np.zeros((len(names), len(sources)), np.int64)
    counts[row, at] = times
    values = priced_pairs(counts, totals)
    g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
    # The best terms of each group, by value and then by the bytes of the term.
    p, q = share(times, totals[at]), share(counts.sum(axis=1), lang_total)[row]
    alphabet = np.empty(len(names), np.int64)
    alphabet[pc.sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
    over = np.flatnonzero(p > q)
    worth = excess(p[over], q[over])
    order = over[np.lexsort((alphabet[row[over]], -worth, at[over]))]
    begin = np.searchsorted(at[order], np.arange(len(sources)))
    order = order[np.arange(len(order)) - begin[at[order]] < TOP_TERMS]
    worth = excess(p[order], q[order])
    pairs, best = _table(lang, sources.take(pa.array(g)), "pair", sources.take(pa.array(h)), values[g, h]), _table(
        lang, sources.take(pa.array(at[order])), "term", names.take(pa.array(row[order])), worth
    )
    return pa.concat_tables([pairs, best])


def _table(lang, source, part, item, value) -> pa.Table:
    size = len(value)
    columns = [pa.array([lang] * size, pa.string()), source, pa.array([part] * size, pa.string()), item, value]
    types = [pa.string()] * 4 + [pa.int64()]
    columns = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.table(columns, names=["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and the best terms of each source.

    A language keeps terms that at least ``LEAST_DOCUMENTS`` of its rows hold. Part ``pair`` has all other sources of the
    language, part ``term`` the ``TOP_TERMS`` best terms that the source has more of than its language. Nulls are empty
    strings; rows with equal ids are several documents; a language without kept terms has pairs of value 0, and one with a
    single source no pairs. Columns other than lang, source and text are ignored.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    everyone = docs.select(empty("lang"), empty("source")).distinct()
    terms = scratch.keep(
        counted(docs)
        .groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= LEAST_DOCUMENTS)
        .drop("docs"),
        "terms",
    )
    size = F.size("counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(size).alias("entries"))
    own = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("own"))
    by_lang = Window.partitionBy("lang")
    groups = scratch.keep(
        everyone.join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["own", "kept", "entries"])
        .withColumn("lang_total", F.sum("own").over(by_lang) + F.col("kept"))
        .withColumn("total", F.col("own") + F.col("kept"))
        .withColumn("blocks", F.ceil(F.col("entries") / BLOCK_COUNTS).cast("int")),
        "groups",
    )
    by_block = groups.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shares = groups.where("blocks > 0").select("lang", "blocks").distinct()
    dealt = terms.join(shares, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    found = scratch.keep(
        dealt.select("lang", "block", "term", "counts")
        .groupBy("lang", "block")
        .cogroup(by_block.select("lang", "block", "source", "total", "lang_total").groupBy("lang", "block"))
        .applyInArrow(_blocks, _FOUND),
        "found",
    )
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = everyone_pairs(groups).join(pairs, ["lang", "source", "item"], "left").fillna(0, ["value"])
    ranked = every.withColumn("rank", _rank()).withColumn("part", F.lit("pair"))
    best = found.where("part = 'term'").withColumn("rank", _rank()).where(F.col("rank") <= TOP_TERMS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(best.select(columns))


def everyone_pairs(groups: DataFrame) -> DataFrame:
    """Each source of a language with each other one, as the result has them."""
    others = groups.select("lang", F.col("source").alias("item"))
    return groups.select("lang", "source").join(others, "lang").where("source <> item")


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
