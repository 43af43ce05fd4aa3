"""Sampled SentencePiece segmentations: Gumbel top-k without replacement.

The segmentations of a text are the paths of a lattice of vocabulary pieces. A
path has probability in proportion to the product of its pieces' weights. A
perturbed A-star search finds the ``k`` paths with the largest Gumbel-perturbed
log probabilities, which is a sample without replacement: the agenda holds
sets of unexplored siblings with their perturbed bound, and exploring the best one
yields the next path, from the end of the text to its start.

No piece crosses from a letter to a space or a line end, so the lattice is a chain
of small lattices, one per chunk of text; equal chunks share one.

The vocabulary gives merge ranks and no probabilities. Weights follow Zipf's law of
the rank; byte pieces stand in for characters without a piece, as the rarest ones.
"""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.tokens import Texts, mix, slices, span_hashes

SAMPLES = 2
SPACE = "▁".encode()
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = np.uint64(0xD1342543DE82EF95)
_FILTER_BITS = 16
#: Texts that share one table of lattices. A worker needs some 200 MB per MB of them.
SLICE_BYTES = 1 << 19


def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Vocabulary:
    """Pieces as bytes with a plain space for the space mark, and their log weights."""

    pieces: list[bytes]
    weights: np.ndarray
    byte_ids: np.ndarray
    lookup: dict = field(default=None)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ranks, pieces, byte_ids = np.full(size, size, np.float64), [b""] * size, np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[3:5], 16)
                byte_ids[byte], pieces[i] = i, bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i] = model.id_to_piece(i).encode().replace(SPACE, b" ")
                ranks[i] = min(max(-model.get_score(i), 0), size)
        weights = -np.log(ranks + 2)
        return cls(pieces, weights - np.log(np.exp(weights).sum()), byte_ids)

    def prepare(self) -> None:
        """Tables for vectorised look-ups, built once per worker."""
        if self.lookup is not None:
            return
        bytes_of = set(self.byte_ids.tolist())
        real = [i for i, p in enumerate(self.pieces) if p and i not in bytes_of]
        lengths = np.array([len(self.pieces[i]) for i in real])
        flat = np.frombuffer(b"".join(self.pieces[i] for i in real), np.uint8).astype(np.uint64) + np.uint64(1)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        powers = _powers(_BASE, int(lengths.max()))
        place = np.arange(len(flat)) - np.repeat(begin, lengths)
        keys = np.add.reduceat(flat * powers[place], begin) * _SPREAD
        order = np.argsort(keys)
        # By length, which upper bits of a key occur: most substrings are told to be no pieces by that.
        seen = {int(n): np.zeros(1 << _FILTER_BITS, bool) for n in set(lengths.tolist())}
        for n, table in seen.items():
            table[keys[lengths == n] >> np.uint64(64 - _FILTER_BITS)] = True
        surface = [p for p in self.pieces]
        self.lookup = {
            "keys": keys[order],
            "ids": np.array(real, np.int32)[order],
            "seen": seen,
            "surface": np.frombuffer(b"".join(surface), np.uint8),
            "surface_at": np.concatenate([[0], np.cumsum([len(p) for p in surface])]),
        }

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a sequence of pieces, without the space in front."""
        self.prepare()
        at = self.lookup["surface_at"]
        begin, lengths = at[ids], at[ids + 1] - at[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(begin - (ends - lengths), lengths)
        return self.lookup["surface"][source].tobytes()[1:]


def chunks(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a space in front of each that is not empty, chunk starts, and first chunk by text.

    A chunk is a run of spaces and what follows up to the next space or line end, or a line end.
    """
    lengths = np.diff(part.offsets)
    some = lengths > 0
    data = np.insert(part.data, part.offsets[:-1][some], 32)
    offsets = np.concatenate([[0], np.cumsum(lengths + some)])
    space, line = data == 32, data == 10
    start = np.zeros(len(data), bool)
    start[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    start[offsets[:-1][some]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.searchsorted(starts, offsets)


@dataclass
class Lattices:
    """Lattices of distinct chunks. Nodes are byte places; edges are sorted by the node they end in."""

    first_edge: np.ndarray
    origin: np.ndarray
    piece: np.ndarray
    share: np.ndarray
    log_share: np.ndarray
    steps: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def build(vocabulary: Vocabulary, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Lattices:
    """``share`` is the probability of an edge among those of its end node; ``steps`` sums it up, plus the node."""
    look = vocabulary.lookup
    lengths = end - begin
    node_begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bytes_ = data[place + np.repeat(begin, lengths)]
    node = place + np.repeat(node_begin[:-1], lengths)
    left = np.repeat(lengths, lengths) - place
    total = int(node_begin[-1])
    powers, inverses = _powers(_BASE, int(lengths.max()) + 1), _powers(_INVERSE, int(lengths.max()) + 1)
    terms = np.zeros(total, np.uint64)
    terms[node] = (bytes_.astype(np.uint64) + np.uint64(1)) * powers[place]
    longest = max(look["seen"])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms), np.zeros(longest, np.uint64)])
    heads = np.flatnonzero((bytes_ & 0xC0) != 0x80)
    at, room = node[heads].astype(np.int32), left[heads].astype(np.int32)
    low, scale = sums[at], inverses[place[heads]] * _SPREAD
    origin, target, ids = [], [], []
    for length in sorted(look["seen"]):
        fits = room >= length
        count = int(fits.sum())
        if not count:
            break
        if count < 0.7 * len(at):
            at, room, low, scale = at[fits], room[fits], low[fits], scale[fits]
        key = (sums[at + length] - low) * scale
        maybe = np.flatnonzero(look["seen"][length][key >> np.uint64(64 - _FILTER_BITS)])
        slot = np.minimum(np.searchsorted(look["keys"], key[maybe]), len(look["keys"]) - 1)
        hit = (look["keys"][slot] == key[maybe]) & (room[maybe] >= length)
        origin.append(at[maybe[hit]])
        target.append(origin[-1] + np.int32(length))
        ids.append(look["ids"][slot[hit]])
    origin, target, ids = np.concatenate(origin), np.concatenate(target), np.concatenate(ids)
    # Characters that no piece stands for are spelt by their bytes.
    size = 1 + (bytes_ >= 0xC0).astype(int) + (bytes_ >= 0xE0) + (bytes_ >= 0xF0)
    width = np.zeros(total + 1, np.int64)
    width[node] = size
    spelt = np.ones(total + 1, bool)
    spelt[origin[target - origin == width[origin]]] = False
    lead = np.maximum.accumulate(np.where((bytes_ & 0xC0) != 0x80, np.arange(len(bytes_)), 0))
    own = np.flatnonzero(spelt[node[lead]])
    origin = np.concatenate([origin, node[own].astype(np.int32)])
    target = np.concatenate([target, node[own].astype(np.int32) + np.int32(1)])
    ids = np.concatenate([ids, vocabulary.byte_ids[bytes_[own]].astype(np.int32)])
    order = np.argsort(target, kind="stable")
    origin, target, ids = origin[order], target[order], ids[order]
    first_edge = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=total))])

    weight = vocabulary.weights[ids]
    depth = np.zeros(total, np.int64)
    depth[node + 1] = place + 1
    edge_depth = depth[target]
    if lengths.max() < 1 << 16:
        edge_depth = edge_depth.astype(np.uint16)  # whose sort takes linear time
    by_depth = np.argsort(edge_depth, kind="stable")
    bounds = np.searchsorted(edge_depth[by_depth], np.arange(1, int(lengths.max()) + 2))
    mass = np.zeros(total)
    mass[node[place > 0]] = -np.inf
    mass[node_begin[1:] - 1] = -np.inf
    value = np.empty(len(ids))
    for d in range(len(bounds) - 1):
        edges = by_depth[bounds[d] : bounds[d + 1]]
        if not len(edges):
            continue
        v = mass[origin[edges]] + weight[edges]
        ends_in = target[edges]
        group = np.flatnonzero(np.concatenate([[True], ends_in[1:] != ends_in[:-1]]))
        high = np.maximum.reduceat(v, group)
        spread = np.repeat(high, np.diff(np.append(group, len(v))))
        mass[ends_in[group]] = high + np.log(np.add.reduceat(np.exp(v - spread), group))
        value[edges] = v
    log_share = value - mass[target]
    log_share[np.diff(first_edge)[target] == 1] = 0.0
    share = np.exp(log_share)
    running = np.cumsum(share)
    before = np.concatenate([[0.0], running])[first_edge[target]]
    steps = target + np.minimum(running - before, 1.0)
    return Lattices(first_edge, origin, ids, share, log_share, steps, node_begin[:-1], node_begin[1:] - 1)


#: Bytes of distinct chunks whose lattices a task keeps from slice to slice.
KEPT_BYTES = 3 << 19


class KeptLattices:
    """The lattices of the chunks a task has met, so that only new chunks are built.

    Node and edge numbers of later chunks go on from earlier ones. When the kept chunks would pass ``limit`` bytes, all are
    let go, so memory is bounded by ``limit`` and one slice.
    """

    def __init__(self, limit: int = KEPT_BYTES):
        self.limit, self.parts = limit, {}
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.parts = {}

    def of(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold all given chunks, and the number of each chunk's own in them."""
        hashes = span_hashes(data, np.ones(len(data), bool), starts, ends)
        keys, index, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._missing(keys)
        size = int((ends - starts)[index[new]].sum())
        if self.size and self.size + size > self.limit:
            self.clear()
            new = self._missing(keys)
            size = int((ends - starts)[index[new]].sum())
        if len(new):
            self._add(build(vocabulary, data, starts[index[new]], ends[index[new]]))
            slots = len(self.slots) + np.arange(len(new))
            order = np.searchsorted(self.keys, keys[new])
            self.keys, self.slots = np.insert(self.keys, order, keys[new]), np.insert(self.slots, order, slots)
            self.size += size
        return Lattices(**self.parts), self.slots[np.searchsorted(self.keys, keys)][which]

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))

    def _add(self, lat: Lattices) -> None:
        if not self.parts:
            self.parts = dict(vars(lat))
            return
        nodes, edges = len(self.parts["first_edge"]) - 1, len(self.parts["origin"])
        moved = {
            "first_edge": lat.first_edge[1:] + edges,
            "origin": lat.origin + np.int32(nodes),
            "steps": lat.steps + nodes,
            "begin": lat.begin + nodes,
            "end": lat.end + nodes,
        }
        for name, kept in self.parts.items():
            self.parts[name] = np.concatenate([kept, moved.get(name, getattr(lat, name))])


def _uniform(streams: np.ndarray, step: int, kind: int) -> np.ndarray:
    """Numbers in (0, 1), a function of their arguments alone."""
    x = mix(streams + np.uint64((2 * step + kind + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(location, bound, uniform):
    """A Gumbel variable at ``location``, given that it is at most ``bound``."""
    return location - np.logaddexp(location - bound, np.log(-np.log(uniform)))


@dataclass
class _Sample:
    ids: np.ndarray
    log_prob: float
    perturbed: float


def _descend(lat: Lattices, order, node, stop, streams, doc, docs, phi, bound, wanted):
    """Walk every chunk from ``node`` down to ``stop``, choosing edges by their share.

    Rows come by document, each in text order; ``order`` is the order that is kind to memory. ``phi`` and
    ``bound`` are the log probability and perturbed value at which each document's walk starts, which is
    its last row. Returns the piece ids with their bounds by row, the log probability of each document, and for each
    document the sibling sets that can be among its best ``wanted``: (bound, row, steps in the row, node, phi, edge).
    """
    rows = len(node)
    at, active, streams_at = node[order], order, streams[order]
    counts, inner = np.zeros(rows, np.int64), np.zeros(rows)
    log, step = [], 0
    alive = at > stop[active]
    at, active, streams_at = at[alive], active[alive], streams_at[alive]
    while len(active):
        edge = lat.first_edge[at]
        many = np.flatnonzero(lat.first_edge[at + 1] - edge > 1)
        draw = at[many] + _uniform(streams_at[many], step, 0)
        edge[many] = np.minimum(np.searchsorted(lat.steps, draw, "right"), lat.first_edge[at[many] + 1] - 1)
        log.append((active, at, edge, inner[active], many))
        inner[active] += lat.log_share[edge]
        counts[active] += 1
        at = lat.origin[edge]
        alive = at > stop[active]
        if not alive.all():
            at, active, streams_at = at[alive], active[alive], streams_at[alive]
        step += 1
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]) if rows else 0, np.int32)
    for step, (active, _, edge, _, _) in enumerate(log):
        ids[ends[active] - 1 - step] = lat.piece[edge]
    # Rows are walked from the last of a document to the first.
    total = np.concatenate([[0.0], np.cumsum(inner)])
    last = np.searchsorted(doc, np.arange(docs), "right")
    first = np.searchsorted(doc, np.arange(docs), "left")
    base = phi[doc] + total[last[doc]] - total[np.arange(rows) + 1]
    end_phi = phi + total[last] - total[first]

    # A sibling set is at most LARGEST_GUMBEL above its location, so most of a long text can't matter.
    reach = np.full(docs, REACH)
    while True:
        floor = phi - reach
        found, cut = _siblings(lat, log, base, doc, first, last, streams, bound, floor, wanted)
        short = (cut - LARGEST_GUMBEL < floor) & (end_phi < floor)
        if not short.any():
            return ids, ends, end_phi, found
        reach[short] = np.inf


#: Largest value of -log(-log(u)) for the numbers u that _uniform returns, rounded up.
LARGEST_GUMBEL = 38.0
#: How far below the start of a walk sibling sets are looked for at first.
REACH = 60.0


def _siblings(lat, log, base, doc, first, last, streams, bound, floor, wanted):
    """The sibling sets located above ``floor`` that are among the best ``wanted`` rows' bests of a document."""
    docs, best, values = len(floor), np.full(len(base), -np.inf), []
    near = base >= floor[doc]
    for step, (active, _, edge, before, many) in enumerate(log):
        many = many[near[active[many]]]
        row = active[many]
        location = base[row] + before[many] + np.log(np.maximum(1 - lat.share[edge[many]], 1e-18))
        value = _truncated(location, bound[doc[row]], _uniform(streams[row], step, 1))
        best[row] = np.maximum(best[row], value)
        values.append((value, many))
    cut = np.full(docs, -np.inf)
    some = np.flatnonzero(last > first)
    if len(some):
        work = best.copy()
        for _ in range(wanted):
            high = np.maximum.reduceat(work, first[some])
            cut[some] = high
            full = np.full(docs, np.inf)
            full[some] = high
            work[work == full[doc]] = -np.inf
    found = [[] for _ in range(docs)]
    for step, ((active, at, edge, before, _), (value, many)) in enumerate(zip(log, values, strict=True)):
        row = active[many]
        for k in np.flatnonzero((value >= cut[doc[row]]) & (value > -np.inf)):
            r, e = int(row[k]), int(many[k])
            found[doc[r]].append((float(value[k]), r, step, int(at[e]), float(base[r] + before[e]), int(edge[e])))
    return found, cut


def sample(
    vocabulary: Vocabulary, part: Texts, seeds: np.ndarray, samples: int, kept: KeptLattices | None = None
) -> list[tuple[list[_Sample], float]]:
    """For each text its samples, best first, and the perturbed value of the next one (-inf if there is none)."""
    vocabulary.prepare()
    data, starts, first = chunks(part)
    docs = len(part)
    if not len(starts):
        return [([_Sample(np.zeros(0, np.int32), 0.0, 0.0)], -np.inf)] * docs
    ends = np.append(starts[1:], len(data))
    lat, which = (kept or KeptLattices()).of(vocabulary, data, starts, ends)
    begin, end = lat.begin[which], lat.end[which]
    own = np.repeat(np.arange(docs), np.diff(first))
    place = (np.arange(len(starts)) - first[own]).astype(np.uint64)
    by_chunk = np.argsort(which.astype(np.int32), kind="stable")
    agendas, out = [[] for _ in range(docs)], [[] for _ in range(docs)]
    root = -np.log(-np.log(_uniform(mix(seeds), 0, 0)))
    # A job continues a path: (document, chunk, node, phi, perturbed bound, pieces behind the node).
    tail = np.zeros(0, np.int32)
    ends_at = [int(end[first[d + 1] - 1]) if first[d + 1] > first[d] else 0 for d in range(docs)]
    jobs = [(d, int(first[d + 1]) - 1, ends_at[d], 0.0, float(root[d]), tail) for d in range(docs)]
    for number in range(samples):
        rows = [np.arange(first[d], c + 1) for d, c, *_ in jobs]
        doc = np.repeat(np.arange(len(jobs)), [len(r) for r in rows])
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        node = end[rows]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(jobs)))])
        for j, job in enumerate(jobs):
            if bounds[j + 1] > bounds[j]:
                node[bounds[j + 1] - 1] = job[2]
        streams = mix(seeds[own[rows]] + np.uint64(number + 1)) + place[rows] * np.uint64(0xD1342543DE82EF95)
        row_of = np.full(len(starts), -1)
        row_of[rows] = np.arange(len(rows))
        order = row_of[by_chunk]
        ids, ids_end, phi, found = _descend(
            lat, order[order >= 0], node, begin[rows], mix(streams), doc, len(jobs), np.array([j[3] for j in jobs]),
            np.array([j[4] for j in jobs]), samples - number,
        )
        ids_end = np.concatenate([[0], ids_end])
        for j, (d, _, _, _, bound, behind) in enumerate(jobs):
            mine = np.concatenate([ids[ids_end[bounds[j]] : ids_end[bounds[j + 1]]], behind])
            out[d].append(_Sample(mine, float(phi[j]), bound))
            for value, r, step, at, before, edge in found[j]:
                depth = len(behind) + int(ids_end[bounds[j + 1]] - ids_end[r + 1]) + step
                heapq.heappush(agendas[d], (-value, int(rows[r]), at, before, (edge,), mine[len(mine) - depth :]))
        if number + 1 == samples:
            break
        jobs = []
        for d in range(docs):
            if agendas[d]:
                jobs.append((d, *_branch(lat, agendas[d], int(seeds[d]), number)))
        if not jobs:
            break
    return [(out[d], -agendas[d][0][0] if agendas[d] else -np.inf) for d in range(docs)]


def _branch(lat: Lattices, agenda: list, seed: int, number: int) -> tuple:
    """Take the best sibling set off the agenda, split its best child off and put the others back."""
    value, chunk, at, phi, taken, behind = heapq.heappop(agenda)
    edges = [e for e in range(int(lat.first_edge[at]), int(lat.first_edge[at + 1])) if e not in taken]
    shares = [max(float(lat.share[e]), 1e-300) for e in edges]
    choice, spread = _pair(seed, number)
    left, pick = choice * sum(shares), 0
    while pick < len(edges) - 1 and left >= shares[pick]:
        left -= shares[pick]
        pick += 1
    edge, others = edges[pick], sum(shares[:pick] + shares[pick + 1 :])
    if others:
        location = phi + math.log(others)
        low = -math.log(math.exp(min(location + value, 700.0)) - math.log(spread))
        heapq.heappush(agenda, (-(location + low), chunk, at, phi, (*taken, edge), behind))
    piece = np.array([lat.piece[edge]], np.int32)
    return chunk, int(lat.origin[edge]), phi + math.log(shares[pick]), -value, np.concatenate([piece, behind])


def _pair(seed: int, number: int) -> tuple[float, float]:
    """Two numbers in (0, 1) from a seed and the number of a branch."""
    draw = random.Random(seed * 1_000_003 + number)
    return draw.random() or 0.5, draw.random() or 0.5


def sampled_segmentations(
    docs: DataFrame, vocabulary: Vocabulary, samples: int = SAMPLES, seed: int = 0, with_ids: bool = True
) -> DataFrame:
    """Up to ``samples`` distinct segmentations of each text, one row each.

    ``docs`` has doc_id and text; other columns are ignored. Columns: doc_id, sample (from 1, best
    first), ids, n_pieces, log_prob, perturbed, log_inclusion (of the probability that the segmentation is among
    the samples, given the perturbed value of the next one) and round_trip (whether the ids
    decode to the text). A text with fewer segmentations has fewer rows; an empty or null one has the empty
    segmentation. Draws depend on the seed, doc_id and text alone, so
    repeated rows have equal samples. ``with_ids=False`` leaves ids out, for callers that only need the scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    salt = mix(np.array([seed], np.uint64))

    def encode(batches):
        kept = KeptLattices()
        for batch in batches:
            ids = batch.column(0)
            known = mix(ids.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64) ^ salt)
            for lo, hi, part in slices(batch.column(1), SLICE_BYTES):
                found = sample(sent.value, part, known[lo:hi], samples, kept)
                flat = [(d, k, s, after) for d, (own, after) in enumerate(found) for k, s in enumerate(own)]
                whole = part.data.tobytes()
                sizes = [len(s.ids) for _, _, s, _ in flat]
                listed = np.concatenate([s.ids for _, _, s, _ in flat]) if with_ids else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]) if with_ids else np.zeros(len(flat) + 1)
                gap = np.minimum([s.log_prob - after for _, _, s, after in flat], 700.0)
                # log(1 - exp(-exp(gap))), which is the gap itself where that is far below 0.
                included = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.maximum(gap, -30)))))
                same = [
                    sent.value.decode(s.ids) == whole[part.offsets[d] : part.offsets[d + 1]] for d, _, s, _ in flat
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array([d for d, *_ in flat], pa.int64())),
                        pa.array([k + 1 for _, k, _, _ in flat], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(listed, pa.int32())),
                        pa.array(sizes, pa.int32()),
                        pa.array([s.log_prob for _, _, s, _ in flat], pa.float64()),
                        pa.array([s.perturbed for _, _, s, _ in flat], pa.float64()),
                        pa.array(included, pa.float64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )

    schema = (
        "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, "
        "log_inclusion double, round_trip boolean"
    )
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)
    return found if with_ids else found.drop("ids")


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` with the column ``text`` that their ``ids`` spell; null ids have null text."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in rows.columns if c.lower() != "text"]

    def decode(batches):
        for batch in batches:
            lists = batch.column(0).to_pylist()
            texts = [None if v is None else sent.value.decode(np.array(v, np.int64)).decode() for v in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.select(F.col("ids").alias("_ids"), *kept).mapInArrow(
        decode, rows.select(kept).schema.add("text", "string")
    )
