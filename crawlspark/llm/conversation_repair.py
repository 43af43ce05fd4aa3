"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, role state); an edge keeps, reroles, deletes or
inserts one message and spells one letter of the audit. A forward and a reverse heap
meet; all crossings of equal cost are finished, and the least concatenated audit wins.

Messages are sorted by range over (conversation, turn), so a conversation of any length is
cut into bounded pieces. Pieces are searched from every state to every state, and joined by least
(cost, audit): of two audits between the same nodes at the same cost none is a prefix of the other, so least parts
make the least whole. Equal role patterns share one search.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.workspace import Scratch

#: Rows and characters of a piece, and rows of one lattice.
PIECE_ROWS, PIECE_CHARS, LATTICE_ROWS = 4096, 1 << 20, 48

# Costs of the edits, white space, and what ends a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"

#: What has been said so far: nothing, the system's message, or last the user or the assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENTER = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
SPOKEN = {**dict.fromkeys(ENTER["u"], "user"), USER: "assistant"}
LEGAL = {"su", "ua", "au"}

FAULTS = ("blank", "duplicate", "truncated")
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_MESSAGES = "array<struct<role:string,text:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Messages with planted faults and how many copies of each there are: by the checksum of ``conv_id:turn`` modulo 20.

    0 drops the message, 1 empties its text, 2 takes its stops away, 3 doubles it, 4 gives it to the user. A
    null counts as one space in the checksum, role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), STOPS, "")).otherwise(space("text"))
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


# --- the lattice -------------------------------------------------------------------------


def _row_edges(code: str) -> list[tuple[int, int, int, str]]:
    """Edges over a row: (state before, state after, cost, letter).

    ``x`` must go; other codes are initials of roles, in upper case for a truncated text.
    """
    edges = [(s, s, DELETE, "D") for s in range(4)]
    if code != "x":
        extra, initial = TRUNCATED * code.isupper(), code.lower()
        edges += [(f, t, extra, "K") for f, t in ENTER.get(initial, {}).items()]
        edges += [(f, t, REROLE + extra, "R") for r in "ua" if r != initial for f, t in ENTER[r].items()]
    return edges


_INSERTS = [(f, t, INSERT, "I") for r in "ua" for f, t in ENTER[r].items()]


def _steps(code: str | None, forward: bool) -> list[list[tuple[int, int, str]]]:
    """By state, the edges of a row (or of an insertion, for None) that leave it, or enter it: (other state, cost, letter)."""
    edges = _INSERTS if code is None else _row_edges(code)
    ends = [(f, t, c, x) if forward else (t, f, c, x) for f, t, c, x in edges]
    return [[(t, c, x) for f, t, c, x in ends if f == s] for s in range(4)]


_STEPS = {(code, forward): _steps(code, forward) for code in (None, *"suaoSUAOx") for forward in (True, False)}


def _neighbours(codes: str, at: int, forward: bool):
    """Nodes one edge after (or before) a node: (node, cost, letter). Node ``4 * i + s`` has read ``i`` rows."""
    row, state = divmod(at, 4)
    for other, cost, letter in _STEPS[None, forward][state]:
        yield 4 * row + other, cost, letter
    if forward and row < len(codes):
        for other, cost, letter in _STEPS[codes[row], True][state]:
            yield 4 * row + 4 + other, cost, letter
    if not forward and row:
        for other, cost, letter in _STEPS[codes[row - 1], False][state]:
            yield 4 * row - 4 + other, cost, letter


def search(codes: str, source: int, targets: tuple[int, ...]) -> tuple[int, str, int] | None:
    """The least (cost, audit) from state ``source`` to one of ``targets`` over the rows, and that target.

    Free edges read a row, so among equal costs nodes come off a heap in the order of rows read: a label is least, in cost
    and audit, when its node is taken. The search goes on until the two heaps' least costs sum to more
    than the best crossing; then every crossing of that cost is between taken nodes.
    """
    n = len(codes)
    starts = ([source], [4 * n + t for t in targets])
    label = [{at: (0, "") for at in side} for side in starts]
    taken = [set(side) for side in starts]
    open_, heaps, best, side = [set(), set()], [[], []], None, 1
    for k in (0, 1):
        for at in starts[k]:
            heappush(heaps[k], (0, (at if k == 0 else -at), at))
    while heaps[0] or heaps[1]:
        if best is not None and (not heaps[0] or not heaps[1] or heaps[0][0][0] + heaps[1][0][0] > best):
            break
        side = 1 - side if heaps[1 - side] else side
        cost, _, at = heappop(heaps[side])
        if at in open_[side]:
            continue
        open_[side].add(at)
        taken[side].add(at)
        audit = label[side][at][1]
        other = label[1 - side]
        if at in other and (best is None or cost + other[at][0] < best):
            best = cost + other[at][0]
        for to, step, letter in _neighbours(codes, at, side == 0):
            found = (cost + step, audit + letter if side == 0 else letter + audit)
            if to in open_[side] or (to in label[side] and label[side][to] <= found):
                continue
            label[side][to] = found
            heappush(heaps[side], (found[0], (to if side == 0 else -to), to))
            if to in other and (best is None or found[0] + other[to][0] < best):
                best = found[0] + other[to][0]
    if best is None:
        return None
    crossings = []
    for at in taken[0]:
        cost, audit = label[0][at]
        for to, step, letter in [(at, 0, ""), *_neighbours(codes, at, True)]:
            if to in taken[1] and cost + step + label[1][to][0] == best:
                crossings.append(audit + letter + label[1][to][1])
    audit = min(crossings)
    return best, audit, _end(codes, audit, source)


def _end(codes: str, audit: str, state: int) -> int:
    """The state that an audit ends in."""
    row = 0
    for letter in audit:
        if letter == "K":
            state = ENTER[codes[row].lower()][state]
        elif letter != "D":
            state = ENTER[SPOKEN[state][0]][state]
        row += letter != "I"
    return state


def remembered():
    """``search`` with its last answers, for one task: patterns of roles and faults recur."""
    return lru_cache(1 << 15)(search)


def repaired_codes(codes: str, find=search) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    if len(codes) <= LATTICE_ROWS:
        return find(codes, NOTHING, (NOTHING, ASSISTANT))[:2]
    ways = transitions(codes, find)
    return min(way for (f, t), way in ways.items() if f == NOTHING and t in (NOTHING, ASSISTANT))


def transitions(codes: str, find=search) -> dict[tuple[int, int], tuple[int, str]]:
    """The least (cost, audit) from every state to every state that rows lead to."""
    ways = {(s, s): (0, "") for s in range(4)}
    for lo in range(0, len(codes), LATTICE_ROWS):
        block = codes[lo : lo + LATTICE_ROWS]
        found = {(f, t): find(block, f, (t,)) for f in range(4) for t in range(4)}
        joined = {}
        for (f, via), (cost, audit) in ways.items():
            for t in range(4):
                if found[via, t]:
                    way = cost + found[via, t][0], audit + found[via, t][1]
                    joined[f, t] = min(joined.get((f, t), way), way)
        ways = joined
    return ways


# --- rows --------------------------------------------------------------------------------


def _coded(roles: list, texts: list, seen: set) -> tuple[str, list[int]]:
    """The code of each row, and counts of blank, duplicate and truncated rows. ``seen`` grows."""
    codes, faults = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        bare = text.rstrip(SPACE)
        again = (role, text) in seen
        seen.add((role, text))
        initial = role[:1] if role[:1] in ENTER else "o"
        if not bare:
            faults[0] += 1
            codes.append("x")
        elif again:
            faults[1] += 1
            codes.append("x")
        elif bare[-1] not in STOPS:
            faults[2] += 1
            codes.append(initial.upper())
        else:
            codes.append(initial)
    return "".join(codes), faults


def _illegal(roles: list) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0


def _messages(roles: list, texts: list, audit: str, state: int) -> list[dict]:
    """What an audit makes of rows, from a state on."""
    out, row = [], 0
    for letter in audit:
        if letter in "KRI":
            role = roles[row] if letter == "K" else SPOKEN[state]
            out.append({"role": role, "text": "" if letter == "I" else texts[row]})
            state = ENTER[role[0]][state]
        row += letter != "I"
    return out


_OUT = f"conv_id long, part int, number int, whole boolean, {SUMMARY}, messages {_MESSAGES}"
_PIECE = f"{_OUT}, turns array<long>, roles array<string>, texts array<string>"


def _batches(rows, schema: pa.Schema, size: int = 2048):
    """Record batches of dictionaries."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _pieces(batches):
    """Pieces of conversations in sorted rows: (conv_id, turns, roles, texts, first and last of the conversation)."""
    held, size, conv, first = [], 0, None, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != conv:
                yield conv, held, first, True
                held, size, first = [], 0, True
            elif held and (len(held) >= PIECE_ROWS or size >= PIECE_CHARS):
                yield conv, held, first, False
                held, size, first = [], 0, False
            conv = row[0]
            held.append(row)
            size += len(row[3])
    if held:
        yield conv, held, first, True


def pieces(messages: DataFrame) -> DataFrame:
    """Whole conversations with their repair, and pieces of those that are longer or that a partition's border may cut.

    ``messages`` has conv_id, turn, role, text, copies. Equal turns follow a hash of role and text; equal rows are alike.
    """
    order = ["conv_id", "turn", "tie"]
    rows = messages.withColumn("tie", F.xxhash64("role", "text"))
    # Rows that are alike in all of this may still go to several partitions.
    spread = rows.withColumn("lot", F.monotonically_increasing_id() % 4096).repartitionByRange(*order, "lot")
    schema = _arrow(_PIECE)

    def cut(batches):
        part, number, previous, search_ = TaskContext.get().partitionId(), 0, None, remembered()

        def made(found, last_of_all):
            conv, held, first, last = found
            kept = [r for r in held for _ in range(r[4])]
            turns, roles, texts = ([r[k] for r in kept] for k in (1, 2, 3))
            out = {"conv_id": conv, "part": part, "number": number, "whole": False}
            if not (first and last) or number == 0 or last_of_all:
                return out | {"turns": turns, "roles": roles, "texts": texts}
            codes, faults = _coded(roles, texts, set())
            cost, audit = repaired_codes(codes, search_)
            summary = {"gaps": _gaps(turns), "illegal": _illegal(roles), "cost": cost, "audit": audit}
            summary |= dict(zip(FAULTS, faults, strict=True))
            return out | summary | {"whole": True, "messages": _messages(roles, texts, audit, NOTHING)}

        def all_made():
            nonlocal number, previous
            for found in _pieces(batches):
                if previous is not None:
                    yield made(previous, False)
                    number += 1
                previous = found
            if previous is not None:
                yield made(previous, True)

        yield from _batches(all_made(), schema)

    read = spread.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    return read.mapInArrow(cut, _PIECE)


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


_WAY = "struct<f:int,t:int,cost:long,audit:string>"
_NARROW = (
    f"conv_id long, part int, number int, turns array<long>, distinct long, ends array<string>, illegal long, faults array<long>, "
    f"ways array<{_WAY}>"
)


def _with_earlier(parts: DataFrame) -> DataFrame:
    """Pieces with ``known``, digests of messages that an earlier piece of their conversation has."""
    digests = F.zip_with("roles", "texts", _digest)
    place = F.struct("part", "number").alias("place")
    said = parts.select("conv_id", place, F.explode(F.array_distinct(digests)).alias("digest"))
    first = said.groupBy("conv_id", "digest").agg(F.min("place").alias("first"))
    earlier = (
        said.alias("s")
        .join(first.alias("f"), F.expr("s.conv_id <=> f.conv_id and s.digest = f.digest"))
        .where("place > first")
        .groupBy("place.part", "place.number")
        .agg(F.collect_set("s.digest").alias("known"))
    )
    return parts.withColumn("digests", digests).join(earlier, ["part", "number"], "left")


def _searched(parts: DataFrame) -> DataFrame:
    """A narrow row for each piece: its counts and its ways from state to state."""
    schema = _arrow(_NARROW)

    def find(batches):
        search_ = remembered()

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    known = set(r["known"] or [])
                    seen = {(a, b) for a, b, d in zip(r["roles"], r["texts"], r["digests"], strict=True) if d in known}
                    codes, faults = _coded(r["roles"], r["texts"], seen)
                    turns = [t for t in r["turns"] if t is not None]
                    yield {
                        "conv_id": r["conv_id"], "part": r["part"], "number": r["number"], "faults": faults,
                        "turns": [turns[0], turns[-1]] if turns else [], "distinct": len(set(turns)),
                        "ends": [x[:1] for x in r["roles"][:1] + r["roles"][-1:]], "illegal": _illegal(r["roles"]),
                        "ways": [{"f": f, "t": t, "cost": c, "audit": a} for (f, t), (c, a) in transitions(codes, search_).items()],
                    }

        yield from _batches(rows(), schema, 64)

    read = parts.select("conv_id", "part", "number", "turns", "roles", "texts", "digests", "known")
    return read.mapInArrow(find, _NARROW)


def _audit(way, until) -> str:
    """The letters of a chain of pieces behind the link ``until``."""
    out = []
    while way is not until:
        out.append(way[3])
        way = way[0]
    return "".join(reversed(out))


def _less(a, b) -> bool:
    """Whether chain ``a`` has a lesser audit than ``b``, which has as many links."""
    x, y = a, b
    while x is not y:
        x, y = x[0], y[0]
    return _audit(a, x) < _audit(b, x)


_CHOSEN = f"part int, number int, entry int, own string, {SUMMARY}"


def _joined(narrow: DataFrame) -> DataFrame:
    """For each piece its part of the best audit; the last piece of a conversation carries the summary.

    A conversation's pieces pass through one task in order, as counts and audits: its result is one audit.
    """
    schema = _arrow(_CHOSEN)

    def choose(batches):
        def finished(conv):
            best = None
            for s in (NOTHING, ASSISTANT):
                if s in conv["ways"]:
                    cost, chain = conv["ways"][s]
                    if best is None or cost < best[0] or (cost == best[0] and _less(chain, best[1])):
                        best = cost, chain
            cost, chain = best
            gaps = conv["high"] - conv["low"] + 1 - conv["distinct"] if conv["low"] is not None else 0
            summary = {"gaps": min(gaps, (1 << 63) - 1), "illegal": conv["illegal"], "cost": cost, "audit": _audit(chain, None)}
            summary |= dict(zip(FAULTS, conv["faults"], strict=True))
            while chain is not None:
                chain, place, entry, own = chain
                yield {"part": place[0], "number": place[1], "entry": entry, "own": own} | summary
                summary = {}

        def rows():
            conv = None
            for batch in batches:
                for r in batch.to_pylist():
                    if conv is None or conv["id"] != r["conv_id"]:
                        if conv is not None:
                            yield from finished(conv)
                        conv = {"id": r["conv_id"], "ways": {NOTHING: (0, None)}, "low": None, "high": None, "distinct": 0}
                        conv |= {"illegal": 0, "faults": [0, 0, 0], "last": None}
                    ways = {}
                    for w in r["ways"]:
                        if w["f"] in conv["ways"]:
                            cost, chain = conv["ways"][w["f"]]
                            new = cost + w["cost"], (chain, (r["part"], r["number"]), w["f"], w["audit"])
                            old = ways.get(w["t"])
                            if old is None or new[0] < old[0] or (new[0] == old[0] and _less(new[1], old[1])):
                                ways[w["t"]] = new
                    conv["ways"] = ways
                    if r["turns"]:
                        conv["distinct"] += r["distinct"] - (conv["high"] == r["turns"][0])
                        conv["low"] = r["turns"][0] if conv["low"] is None else conv["low"]
                        conv["high"] = r["turns"][1]
                    conv["faults"] = [a + b for a, b in zip(conv["faults"], r["faults"], strict=True)]
                    conv["illegal"] += r["illegal"]
                    if r["ends"]:
                        conv["illegal"] += conv["last"] is not None and conv["last"] + r["ends"][0] not in LEGAL
                        conv["last"] = r["ends"][1]
            if conv is not None:
                yield from finished(conv)

        yield from _batches(rows(), schema)

    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(choose, _CHOSEN)


def _rendered(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The messages of pieces, each by its part of the audit."""
    schema = _arrow(_OUT)
    names = [f.name for f in schema]

    def render(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    made = _messages(r["roles"], r["texts"], r["own"], r["entry"])
                    yield {k: r.get(k) for k in names} | {"whole": False, "messages": made}

        yield from _batches(rows(), schema, 64)

    columns = [c.split()[0] for c in SUMMARY.split(", ")]
    read = parts.select("conv_id", "part", "number", "roles", "texts").join(chosen, ["part", "number"])
    return read.select("conv_id", "part", "number", "roles", "texts", "entry", "own", *columns).mapInArrow(render, _OUT)


def repaired(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """Repaired conversations: conv_id, part, number, the summary, and ``messages`` (role, text).

    A long conversation has several rows, in the order of part and number; its last one carries the
    summary (gaps, blank, duplicate, truncated, illegal, cost, audit), which is null in the others.
    ``messages`` has conv_id, turn, role, text and copies, as ``damaged`` returns them; other columns are ignored. Null ids are one
    conversation, null turns come first, and a conversation without messages has an empty audit. No role or text may be null.
    """
    found = scratch.keep(pieces(messages), "pieces")
    parts = found.where("not whole")
    columns = [c.name for c in _arrow(_OUT)]
    chosen = scratch.keep(_joined(_searched(_with_earlier(parts))), "chosen")
    return found.where("whole").select(columns).unionByName(_rendered(parts, chosen))


def digested(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: its summary and the SHA-256 of its ``role:text`` lines.

    A digest is a chain, so the parts of a long conversation pass through one task, one at a time.
    """
    columns = [c.split()[0] for c in SUMMARY.split(", ")]
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    lines = conversations.withColumn("lines", F.array_join(line, "\n"))
    out = f"conv_id long, {SUMMARY}, repaired_sha256 string"
    schema = _arrow(out)

    def chain(batches):
        def rows():
            digest, begun = hashlib.sha256(), False
            for batch in batches:
                for r in batch.to_pylist():
                    if r["n"]:
                        digest.update(("\n" if begun else "").encode() + r["lines"].encode())
                        begun = True
                    if r["audit"] is not None:
                        yield {k: r[k] for k in ("conv_id", *columns)} | {"repaired_sha256": digest.hexdigest()}
                        digest, begun = hashlib.sha256(), False

        yield from _batches(rows(), schema)

    parts = lines.where("not whole").select("conv_id", "part", "number", *columns, "lines", F.size("messages").alias("n"))
    chained = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(chain, out)
    whole = lines.where("whole").select("conv_id", *columns, F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    return whole.unionByName(chained)
