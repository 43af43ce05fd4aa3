"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

The corpus is cut into slices of consecutive rows. Each slice sends its distinct n-grams
with their counts to the count table, which is partitioned by n-gram hash; the table sums
them and sends the totals back to the slices that asked, where they are joined to the exploded
n-grams and summed per document. An n-gram crosses the network once per slice and not once
per document, however frequent it is, and no partition of the table depends on how often its n-grams occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.tokens import slices, windows, words

ORDER = 2
BACKOFF = 0.4
#: n-grams of two or more words that the corpus has less often are not in the table.
MIN_COUNT = 2
SLICE_ROWS = 2500


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest whole numbers that hold them, behind a byte with their width."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(data: pa.Scalar) -> np.ndarray:
    buffer = data.as_buffer()
    return np.frombuffer(buffer, f"<u{buffer[0]}", offset=1).astype(np.int64)


class _Grams:
    """The n-grams of a slice: of each token by length, as places in the sorted distinct ones."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, order: int):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        runs = {n: [] for n in range(1, order + 1)}
        counts = []
        for _, _, part in slices(column):
            found = words(part, lower=True)
            counts.append(found.counts)
            for n in runs:
                keys, bounds = windows(found.hashes, found.first, n)
                # The n-gram that ends at each token; tokens with fewer words before them have none.
                ends = np.full(len(found.hashes), 0, np.uint64)
                at = np.arange(len(keys)) + np.repeat(found.first[:-1] + n - 1 - bounds[:-1], np.diff(bounds))
                ends[at] = keys
                runs[n].append(ends)
        self.tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.tokens)])
        place = np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], self.tokens)
        flat, owners = [np.zeros(1, np.uint64)], []
        for n, parts in runs.items():
            flat.append(np.concatenate([*parts, np.zeros(0, np.uint64)])[place >= n - 1])
            owners.append(np.flatnonzero(place >= n - 1))
        keys, inverse, self.counts = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
        self.keys = keys
        # The empty n-gram, whose count is the number of tokens, has hash 0 and comes first.
        self.counts[0] += self.bounds[-1] - 1
        self.of = {0: np.zeros(self.bounds[-1], np.int64)}
        at = 1
        for n, owner in zip(runs, owners, strict=True):
            self.of[n] = np.full(self.bounds[-1], -1)
            self.of[n][owner] = inverse[at : at + len(owner)]
            at += len(owner)

    def scores(self, totals: np.ndarray, order: int, backoff: float, min_count: int) -> np.ndarray:
        """The sum of the tokens' log scores of each text."""
        count = {n: np.where(at >= 0, totals[at], 0).astype(np.float64) for n, at in self.of.items()}
        score = np.log(count[1] / count[0]) if self.bounds[-1] else np.zeros(0)
        for n in range(2, order + 1):
            # The context of a token's n-gram ends at the token before.
            context = np.concatenate([[1.0], count[n - 1][:-1]])[: len(score)]
            seen = count[n] >= min_count
            score = np.where(
                seen,
                np.log(np.where(seen, count[n], 1) / np.where(seen, context, 1)),
                np.where(self.of[n] >= 0, np.log(backoff), 0) + score,
            )
        sums = np.concatenate([[0.0], np.cumsum(score)])
        out = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        some = np.flatnonzero(self.tokens)
        if len(some):
            out[some] = np.add.reduceat(score, self.bounds[:-1][some])
        return out


def scored(
    docs: DataFrame, buckets: int, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(doc_id, n_tokens, log_score) for every row of ``docs`` (doc_id, text); other columns are ignored.

    A token scores count(n-gram) / count(context) if its n-gram of ``order`` words is in the table, else
    ``backoff`` times the score of the next shorter n-gram; a single word scores its share of all tokens. Words at
    the begin of a text have no longer n-grams and are not discounted for it. ``log_score`` sums the logarithms: 0 for
    null and empty texts. Words are runs between white space with A-Z in lower case. Every row counts,
    repeated ones too. ``buckets`` is the number of partitions of the count table: with one for every
    100 MB of text a task holds some 200 MB of it.
    """
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    shift = np.uint64(64 - buckets.bit_length() + 1)
    number = F.monotonically_increasing_id()
    cut = docs.select("doc_id", "text", number.alias("number")).select(
        "doc_id",
        "text",
        # Consecutive rows of a partition; the partition is in the upper bits.
        (F.shiftright("number", 33) * (1 << 33) + F.floor((F.col("number") % (1 << 33)) / slice_rows)).alias("slice"),
    )

    def ask(table: pa.Table) -> pa.Table:
        grams = _Grams(table.column("text"), order)
        bucket = (grams.keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(grams.keys), np.int64)
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = np.flatnonzero(np.diff(bounds))
        keys = grams.keys.tobytes()
        return pa.table(
            {
                "bucket": pa.array(rows, pa.int32()),
                "slice": pa.array(np.full(len(rows), table.column("slice")[0].as_py()), pa.int64()),
                "keys": pa.array([keys[8 * bounds[b] : 8 * bounds[b + 1]] for b in rows], pa.binary()),
                "counts": pa.array([_packed(grams.counts[bounds[b] : bounds[b + 1]]) for b in rows], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("keys")])
        counts = np.concatenate([_unpacked(v) for v in table.column("counts")])
        _, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=counts)[inverse].astype(np.int64)
        ends = np.cumsum(pc.binary_length(table.column("keys").combine_chunks()).to_numpy() // 8)
        parts = np.split(totals, ends[:-1])
        return pa.table(
            {
                "slice": table.column("slice"),
                "bucket": table.column("bucket"),
                "totals": pa.array([_packed(p) for p in parts], pa.binary()),
            }
        )

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        grams = _Grams(texts.column("text"), order)
        totals = totals.sort_by("bucket")
        found = np.concatenate([_unpacked(v) for v in totals.column("totals")])
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_tokens": pa.array(grams.tokens, pa.int64()),
                "log_score": pa.array(grams.scores(found, order, backoff, min_count), pa.float64()),
            }
        )

    asked = cut.groupBy("slice").applyInArrow(ask, "bucket int, slice long, keys binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket int, totals binary")
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("log_score", "double")
    return cut.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(score, schema)
