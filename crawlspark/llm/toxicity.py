"""Toxicity by maximum-scoring segments of token log-odds.

A token is a word, known by its hash and by those of its first bytes. Its log-odds of being
toxic come from a chain of Dirichlet priors: each longer prefix starts from the estimate of the
shorter one. Less a constant, they are mostly negative; a linear scan finds every maximal scoring segment. Under the null
of clean texts, segment scores follow an extreme-value law, whose rate and scale are fitted to clean documents.
It turns scores into E-values, and the sum statistic of the best segments aggregates them for a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from crawlspark.llm.membership import bitmap, may_contain
from crawlspark.llm.tokens import Texts, lower_ascii, mix, slices, span_hashes
from crawlspark.workspace import Scratch

#: Bytes of the prefixes that stand for a word, the last one for the whole word; slots for the hashes of each.
PREFIXES = (4, 6, 8, 1 << 30)
SLOTS = 1 << 18
#: Weight of a prior, in words, and what is taken off the log-odds of each token.
CONCENTRATION, SHIFT = 4.0, 0.7
#: Segments with a larger E-value are no passages.
SIGNIFICANT = 0.05
#: Steps of token scores in their histogram, and of the evidence in its calibration.
STEPS = 32
FOLDS = 2
#: Learning uses about so many labelled documents at most, taken by the hash of their id.
FIT_ROWS = 40_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Tokens:
    """Tokens of a slice: byte bounds, slots by prefix, and the first token by text."""

    starts: np.ndarray
    ends: np.ndarray
    slots: np.ndarray
    first: np.ndarray


def tokens(part: Texts) -> Tokens:
    """Runs of ASCII letters and bytes of other characters, A-Z in lower case."""
    inside = _LETTERS[part.data]
    edges = np.zeros(len(part.data) + 1, bool)
    edges[part.offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (edges[:-1] | ~before[: len(inside)]))
    ends = np.flatnonzero(inside & (edges[1:] | ~after[: len(inside)])) + 1
    low, at = lower_ascii(part.data), np.flatnonzero(inside)
    place = at - np.repeat(starts, ends - starts)
    found = []
    for size in PREFIXES:
        begun = np.zeros(len(inside), bool)
        begun[at[place < size]] = True
        found.append(span_hashes(low, begun, starts, ends))
    slots = np.array([mix(h + np.uint64(k)) >> np.uint64(46) for k, h in enumerate(found)], np.int64)
    return Tokens(starts, ends, slots.reshape(len(PREFIXES), len(starts)), np.searchsorted(starts, part.offsets))


@dataclass
class ToxicityModel:
    """Toxic and all words by prefix and slot, the law of clean segments, and the calibration of the evidence."""

    toxic: np.ndarray
    known: np.ndarray
    base: float
    rate: float = 1.0
    scale: float = 1.0
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def token_scores(self, found: Tokens) -> np.ndarray:
        """Log-odds of each token against all tokens, less ``SHIFT``."""
        share = np.full(found.slots.shape[1], self.base)
        for k in range(len(PREFIXES)):
            at = found.slots[k]
            share = (self.toxic[k][at] + CONCENTRATION * share) / (self.known[k][at] + CONCENTRATION)
        share = np.clip(share, 1e-9, 1 - 1e-9)
        return np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)) - SHIFT

    def normal(self, score: float, length: int) -> float:
        """The score in units of the extreme-value law: minus the logarithm of its E-value."""
        return self.rate * score - math.log(max(self.scale * length, 1e-300))

    def evidence(self, scores: list[float], length: int) -> float:
        """Minus the logarithm of the chance that a clean text has so high a sum of its r best segments, for the best r."""
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            value = self.normal(score, length)
            if value <= 0:
                break
            total += value
            # The chance of a sum t of r normalised scores is about exp(-t) t^(r-1) / (r! (r-1)!).
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def probability(self, evidence: float) -> float:
        return float(np.interp(math.log1p(evidence), self.knots, self.shares))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by a single scan over runs of one sign."""
    if not len(scores):
        return []
    positive = scores > 0
    begins = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums = np.add.reduceat(scores, begins).tolist()
    ends, begins = np.append(begins[1:], len(scores)).tolist(), begins.tolist()
    # Candidates: (begin, end, sum before it, sum up to its end); left[i] is the last one before i with a lesser sum before.
    found: list[tuple[int, int, float, float]] = []
    left: list[int] = []
    total = 0.0
    for begin, end, value in zip(begins, ends, sums, strict=True):
        low, total = total, total + value
        if value <= 0:
            continue
        candidate = (begin, end, low, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= candidate[2]:
                j = left[j]
            if j < 0 or found[j][3] >= candidate[3]:
                found.append(candidate)
                left.append(j)
                break
            candidate = (found[j][0], candidate[1], found[j][2], candidate[3])
            del found[j:], left[j:]
    return [(b, e, high - low) for b, e, low, high in found]


# --- learning ----------------------------------------------------------------------------


def _tables(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and all words by prefix and slot, from rows of (slot, toxic, known)."""
    out = []
    for name in ("toxic", "known"):
        table = np.zeros(len(PREFIXES) * SLOTS)
        table[counts["slot"].to_numpy()] = counts[name].to_numpy()
        out.append(table.reshape(-1, SLOTS))
    return out[0], out[1]


def _model(toxic: np.ndarray, known: np.ndarray) -> ToxicityModel:
    words = known[-1].sum()
    base = (toxic[-1].sum() + 1) / (words + 2)
    return ToxicityModel(toxic.astype(np.float32), known.astype(np.float32), float(base))


def extreme_value_rate(histogram: dict[float, int]) -> float:
    """The positive root of E[exp(rate * score)] = 1; 1 where scores are never positive or don't fall on average."""
    values = np.array(sorted(histogram))
    shares = np.array([histogram[v] for v in sorted(histogram)], float)
    if not len(values) or values[-1] <= 0 or (values * shares).sum() >= 0:
        return 1.0
    shares /= shares.sum()
    low, high = 0.0, 1.0
    excess = lambda r: (shares * np.exp(np.minimum(r * values, 700))).sum() - 1
    while excess(high) < 0 and high < 1e6:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def monotone_shares(counts: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising share of label 1 by a value, from (value, with label 1, with label 0): pool adjacent violators."""
    pools: list[list[float]] = []  # ones, rows, sum of the values
    for value, ones, zeros in sorted(counts):
        pools.append([ones, ones + zeros, value * (ones + zeros)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    shares = np.array([(ones + 0.5) / (rows + 1) for ones, rows, _ in pools])
    return np.array([total / rows for _, rows, total in pools]), np.maximum.accumulate(shares)


def fit_toxicity(
    labelled: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS
) -> ToxicityModel:
    """Learn from the texts of ``labelled`` (doc_id, text) that ``labels`` (doc_id, toxic) marks, or a sample of about ``fit_rows``.

    Each distinct word of a document counts once for each of its prefixes. The law of clean segments and the calibration are fitted to
    documents scored by the words of the other fold; folds go by a hash of the text, so that exact copies share one. Tables,
    histograms and sums have a fixed size. Null labels are none; a doc_id with both labels counts as both. Without
    labels of both kinds no text is toxic.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")
    ).distinct()
    share = min(1.0, fit_rows / max(1, labelled.select(F.col("doc_id").cast("long")).join(marks, "doc_id").count()))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) * F.lit(2.0**-53)
    marks = marks.where(hashed <= share)
    wanted = bitmap(marks, "doc_id")

    def chosen(batches):
        for batch in batches:
            ids = batch.column(0)
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(known & may_contain(wanted, ids.fill_null(0).to_numpy())))

    read = labelled.select(F.col("doc_id").cast("long"), "text").mapInArrow(chosen, "doc_id long, text string")
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    rows = scratch.keep(read.join(marks, "doc_id").select("text", "label", fold), "labelled")

    def count(batches):
        totals = np.zeros((FOLDS, 2, len(PREFIXES) * SLOTS), np.int64)
        for batch in batches:
            label, part_fold = (batch.column(k).to_numpy() for k in (1, 2))
            for lo, hi, part in slices(batch.column(0)):
                found = tokens(part)
                doc = np.repeat(np.arange(lo, hi), np.diff(found.first))
                _, once = np.unique(doc * SLOTS + found.slots[-1], return_index=True)
                for k in range(len(PREFIXES)):
                    np.add.at(totals, (part_fold[doc[once]], label[doc[once]], k * SLOTS + found.slots[k][once]), 1)
        both = totals.sum(axis=1)
        f, slot = np.nonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(f), pa.array(slot), pa.array(totals[f, 1, slot]), pa.array(both[f, slot])],
            names=["fold", "slot", "toxic", "known"],
        )

    counts = (
        rows.select("text", "label", "fold")
        .mapInArrow(count, "fold long, slot long, toxic long, known long")
        .groupBy("fold", "slot")
        .agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("known").cast("int").alias("known"))
        .select(F.col("fold").cast("int"), F.col("slot").cast("int"), "toxic", "known")
        .toArrow()
    )
    parts = [_tables(counts.filter(pc.equal(counts["fold"], f))) for f in range(FOLDS)]
    toxic, known = (sum(p[k] for p in parts) for k in (0, 1))
    model = _model(toxic, known)
    if not toxic[-1].any() or (toxic[-1] == known[-1]).all():
        return replace(model, toxic=np.zeros_like(model.toxic))
    others = [_model(toxic - a, known - b) for a, b in parts]
    sent = labelled.sparkSession.sparkContext.broadcast(others)

    def tested(batches):
        for batch in batches:
            label, part_fold = (batch.column(k).to_numpy() for k in (1, 2))
            for lo, hi, part in slices(batch.column(0)):
                found = tokens(part)
                doc = np.repeat(np.arange(lo, hi), np.diff(found.first))
                scores = np.zeros(len(doc))
                for f, other in enumerate(sent.value):
                    mine = np.flatnonzero(part_fold[doc] == f)
                    scores[mine] = other.token_scores(Tokens(found.starts, found.ends, found.slots[:, mine], found.first))
                for i in range(hi - lo):
                    own = scores[found.first[i] : found.first[i + 1]]
                    clean = label[lo + i] == 0
                    steps, times = np.unique(np.round(own * STEPS).astype(int), return_counts=True) if clean else ([], [])
                    yield {
                        "label": int(label[lo + i]),
                        "words": len(own),
                        "scores": [s for _, _, s in segments(own)],
                        "steps": [{"step": int(a), "n": int(b)} for a, b in zip(steps, times, strict=True)],
                    }

    out = "label int, words long, scores array<double>, steps array<struct<step:int,n:long>>"
    schema = pa.schema(
        [
            ("label", pa.int32()),
            ("words", pa.int64()),
            ("scores", pa.list_(pa.float64())),
            ("steps", pa.list_(pa.struct([("step", pa.int32()), ("n", pa.int64())]))),
        ]
    )

    def batched(batches):
        held = []
        for row in tested(batches):
            held.append(row)
            if len(held) == 512:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    scored = scratch.keep(rows.mapInArrow(batched, out), "segments")
    clean = scored.where("label = 0")
    histogram = clean.select(F.explode("steps").alias("s")).groupBy("s.step").agg(F.sum("s.n").alias("n")).collect()
    rate = extreme_value_rate({r["step"] / STEPS: r["n"] for r in histogram})
    # The likeliest scale of a Gumbel law with that rate, of the best segment of each clean document.
    fall = F.sum(F.col("words") * F.exp(-F.lit(rate) * F.coalesce(F.array_max("scores"), F.lit(0.0))))
    total = clean.where("words > 0").agg(F.count("*").alias("docs"), fall.alias("fall")).first()
    scale = total["docs"] / total["fall"] if total["fall"] else 1.0
    law = ToxicityModel(np.zeros(0), np.zeros(0), 0.5, rate, scale)

    def weigh(batches):
        for batch in batches:
            value = [law.evidence(s, n) for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            steps = np.round(np.log1p(value) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps, pa.int64())], names=["label", "step"])

    weighed = scored.select("label", "scores", "words").mapInArrow(weigh, "label int, step long")
    bins = weighed.groupBy("step").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")).collect()
    knots, shares = monotone_shares([(r["step"] / STEPS, r["ones"], r["zeros"]) for r in bins])
    return replace(model, rate=rate, scale=scale, knots=knots, shares=shares)


# --- scoring -----------------------------------------------------------------------------

_PASSAGES = pa.list_(pa.struct([("begin", pa.int64()), ("words", pa.int64()), ("e_value", pa.float64()), ("text", pa.string())]))


def with_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, passages: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of the column ``text``, and its significant ``passages`` in order.

    A passage has the number of its first word, its words, its E-value and its text. Null and empty texts have no
    evidence, as clean ones. ``keep`` names the columns to return, by default all; columns ``score`` and ``passages`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = ["score", *["passages"] * passages]
    keep = [c for c in keep or docs.columns if c.lower() not in added]

    def score(batches):
        for batch in batches:
            scores, listed, own = [], [], sent.value
            for _, _, part in slices(batch.column(0)):
                found = tokens(part)
                values = own.token_scores(found)
                for i in range(len(part)):
                    a, b = found.first[i], found.first[i + 1]
                    hits = segments(values[a:b])
                    scores.append(own.probability(own.evidence([s for *_, s in hits], b - a)))
                    if passages:
                        listed.append(_significant(own, part, found, int(a), int(b), hits))
            columns = [*batch.columns[1:], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(listed, _PASSAGES)] * passages, names=[*keep, *added])

    schema = docs.select(keep).schema.add("score", "double")
    if passages:
        schema = schema.add("passages", ArrayType(StructType.fromDDL("begin long, words long, e_value double, text string")))
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(score, schema)


def _significant(model: ToxicityModel, part: Texts, found: Tokens, first: int, last: int, hits: list) -> list[dict]:
    out = []
    for begin, end, value in hits:
        normal = model.normal(value, last - first)
        if normal >= -math.log(SIGNIFICANT):
            text = part.data[found.starts[first + begin] : found.ends[first + end - 1]].tobytes()
            e_value = math.exp(-min(normal, 700.0))
            out.append({"begin": begin, "words": end - begin, "e_value": e_value, "text": text.decode(errors="replace")})
    return out
