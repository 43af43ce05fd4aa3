"""Document quality by naive Bayes support vectors.

Features are n-gram indicators of the whole text: byte trigrams, hashed to
``HASHED`` slots, and echoes (runs of 2 to 5 equal words). Each indicator is
scaled by the log ratio of its counts in the two classes; a linear hinge-loss
model is fitted to the scaled indicators by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.membership import bitmap, may_contain
from crawlspark.llm.tokens import Texts, slices, words
from crawlspark.workspace import Scratch

HASHED = 1 << 16
ECHOES = (2, 3, 4, 5)
FEATURES = HASHED + len(ECHOES)

#: The hinge-loss fit uses at most so many labelled rows, taken by the hash of their id.
#: The class counts cover all of them.
FIT_ROWS = 6000
EPOCHS, COST, SMOOTHING, TINY = 12, 1.0, 1.0, 1e-12


def features(part: Texts) -> list[np.ndarray]:
    """Of each text, the sorted numbers of the features it has."""
    data = part.data.astype(np.uint32)
    grams = np.zeros(max(len(data) - 2, 0), np.uint32)
    if len(grams):
        grams = (data[:-2] * 65599 + data[1:-1]) * 65599 + data[2:]
        grams = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    found = words(part)
    same = np.zeros(len(found.hashes), bool)
    same[1:] = found.hashes[1:] == found.hashes[:-1]
    same[found.first[:-1][found.counts > 0]] = False
    # The length of the run of equal words that ends at each word.
    at = np.arange(len(same))
    run = at - np.maximum.accumulate(np.where(same, 0, at)) + 1
    flags, out = np.zeros(HASHED, bool), []
    for i in range(len(part)):
        flags[:] = False
        flags[grams[part.offsets[i] : max(part.offsets[i + 1] - 2, part.offsets[i])]] = True
        longest = run[found.first[i] : found.first[i + 1]].max(initial=1)
        echoes = [HASHED + k for k, n in enumerate(ECHOES) if longest >= n]
        out.append(np.concatenate([np.flatnonzero(flags), echoes]).astype(np.int32))
    return out


@dataclass
class QualityModel:
    """Weights of the features (the class ratios are in them), their squared ratios, and a bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Logistic margins: half is the border between the classes."""
        margins = [self.weights[r].sum() / np.sqrt(self.squares[r].sum() + TINY) for r in rows]
        return 1 / (1 + np.exp(-np.clip(2 * (np.array(margins) + self.bias), -500, 500)))


def class_ratios(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed counts (feature, with label 1, with label 0)."""
    p, q = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    for feature, ones, zeros in counts:
        p[feature] += ones
        q[feature] += zeros
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> QualityModel:
    """The L2-regularised hinge-loss model of rows of scaled indicators, each scaled to length 1.

    Both classes weigh the same. The bias is the weight of a feature that every row has.
    """
    squares = ratios**2
    values = [ratios[r] / np.sqrt(squares[r].sum() + TINY) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(y == v).sum() for v in (-1.0, 1.0)])
    upper = COST * len(y) / (2 * share[(y > 0).astype(int)])
    alpha, w, bias = np.zeros(len(y)), np.zeros(FEATURES), 0.0
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return QualityModel(w * ratios, squares, bias)


def fit_quality(
    labelled: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS
) -> QualityModel:
    """Learn from the texts of ``labelled`` (doc_id, text) that ``labels`` (doc_id, quality) marks.

    Features are written down once. Counts are summed by task and then by feature; the rows
    of the fit are those with an id hash below a cutoff, so no task returns many more than its share. Labels that are null are no
    labels; a doc_id with both labels counts as both. Without labels of both
    kinds every text scores as good.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")
    ).distinct()
    wanted = bitmap(marks, "doc_id")

    def extract(batches):
        for batch in batches:
            ids = batch.column(0)
            known = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(known & may_contain(wanted, ids.fill_null(0).to_numpy())))
            for lo, hi, part in slices(batch.column(1)):
                found = [r.tobytes() for r in features(part)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(found, pa.binary())], names=["doc_id", "features"]
                )

    found = labelled.select(F.col("doc_id").cast("long"), "text").mapInArrow(extract, "doc_id long, features binary")
    rows = scratch.keep(found.join(marks, "doc_id"), "features")

    def count(batches):
        totals = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for found, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                totals[label][np.frombuffer(found.as_buffer(), np.int32)] += 1
        some = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(totals[1][some]), pa.array(totals[0][some])], names=["feature", "ones", "zeros"]
        )

    counts = (
        rows.select("features", "label")
        .mapInArrow(count, "feature long, ones long, zeros long")
        .groupBy("feature")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    )
    ratios = class_ratios([tuple(r) for r in counts.collect()])
    share = min(1.0, fit_rows / max(1, rows.count()))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) * F.lit(2.0**-53)
    sample = sorted(rows.where(hashed <= share).select("doc_id", "label", "features").collect())[:fit_rows]
    y = np.array([r["label"] for r in sample])
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 1.0)
    found = [np.frombuffer(r["features"], np.int32) for r in sample]
    return dual_coordinate_descent(found, y, ratios)


def with_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of the column ``text``; null texts count as empty.

    ``keep`` names the columns to return, by default all; a column ``score`` of the input is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or docs.columns if c.lower() != "score"]

    def score(batches):
        for batch in batches:
            scores = [sent.value.scores(features(part)) for _, _, part in slices(batch.column(0))]
            found = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=[*keep, "score"])

    read = docs.select(F.col("text").alias("_text"), *keep)
    return read.mapInArrow(score, docs.select(keep).schema.add("score", "double"))
