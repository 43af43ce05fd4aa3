"""Conversation repair against exhaustive edits, over borders of pieces, and on awkward messages."""

import hashlib
import re
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlspark.llm import conversation_repair as repair

GOOD = re.compile(r"(s?(ua)+)?")


@lru_cache(None)
def roles_after(codes):
    """Every (cost, audit, roles) with at most one insertion before each row and two at the end."""
    if not codes:
        return [(3 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au")]
    code, initial = codes[0], codes[0].lower()
    own = [(4, "D", "")]
    if code != "x":
        extra = 3 * code.isupper()
        own += [(extra, "K", initial), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
    out = []
    for cost, audit, roles in roles_after(codes[1:]):
        for c, a, r in own:
            for added in ("", "u", "a", "ua", "au"):
                out.append((3 * len(added) + c + cost, "I" * len(added) + a + audit, added + r + roles))
    return out


def least(codes):
    return min((c, a) for c, a, r in roles_after(codes) if GOOD.fullmatch(r))


@settings(max_examples=150, deadline=None)
@given(st.text("suaoSUAOx", max_size=3))
def test_search_equals_every_edit(codes):
    assert repair.repaired_codes(codes) == least(codes)


@settings(max_examples=60, deadline=None)
@given(st.text("suaoSUAx", max_size=24))
def test_joined_pieces_equal_one_search(codes):
    whole = repair.search(codes, repair.NOTHING, (repair.NOTHING, repair.ASSISTANT))[:2]
    size, repair.LATTICE_ROWS = repair.LATTICE_ROWS, 5
    try:
        assert repair.repaired_codes(codes) == whole
    finally:
        repair.LATTICE_ROWS = size


def plain(rows):
    """The result for one conversation's rows (turn, role, text), in order."""
    codes, seen, faults = "", set(), [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(repair.SPACE)
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if kind < 2 else initial.upper() if kind == 2 else initial
        if kind < 3:
            faults[kind] += 1
    turns = {t for t, *_ in rows if t is not None}
    cost, audit = repair.search(codes, repair.NOTHING, (repair.NOTHING, repair.ASSISTANT))[:2]
    lines, row, last = [], 0, None
    for letter in audit:
        if letter != "D":
            role = rows[row][1] if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if letter == 'I' else rows[row][2]}")
            last = role[0]
        row += letter != "I"
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest


def results(spark, scratch, rows):
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int, gaps string")
    return {r[0]: tuple(r[1:]) for r in repair.digested(repair.repaired(messages, scratch)).collect()}


@pytest.mark.parametrize("piece", [3, 4096])
def test_long_conversations_are_repaired_over_pieces(spark, scratch, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    monkeypatch.setattr(repair, "LATTICE_ROWS", 4)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["One.", "Two", " ", "Three!", "", "Four"]
    rows = [
        (conv, turn + turn // 9, roles[(turn * turn + conv) % (2 + conv % 4)], texts[turn * (conv + 3) % 6] + "." * (turn % 7))
        for conv in range(9)
        for turn in range(1 + 11 * conv % 40)
    ]
    found = results(spark, scratch, [(*r, 1, "x") for r in rows])
    for conv in range(9):
        assert found[conv] == plain([r[1:] for r in rows if r[0] == conv]), conv


def test_awkward_messages(spark, scratch):
    long = "word " * 300_000 + "end."
    rows = [
        (None, None, "user", "Hi.", 1, "x"), (None, 4, "assistant", "Yes.", 2, "x"),
        (1, 0, "user", "gone", 0, None), (2, 0, "user", long, 1, "x"), (2, 1, "assistant", "ok.", 1, "x"),
        (3, -(1 << 63), "system", "a.", 1, "x"), (3, (1 << 63) - 1, " ", " ", 1, "x"), (4, 1, "assistant", "No.", 3, ""),
    ]
    found = results(spark, scratch, rows)
    assert found[None] == plain([(None, "user", "Hi."), (4, "assistant", "Yes."), (4, "assistant", "Yes.")])
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2] == plain([(0, "user", long), (1, "assistant", "ok.")])
    assert found[3][0] == (1 << 63) - 1 and found[3][5:7] == (8, "DD")
    assert found[4] == plain([(1, "assistant", "No.")] * 3)
    assert results(spark, scratch, rows[:0]) == {}


def test_damage_reads_nulls_as_a_space(spark):
    rows = [(None, None, None, None), (1, None, "user", "a.b!"), (7, 3, None, "x")]
    found = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib

    for r, conv, turn in zip(found, (" ", "1", "7"), (" ", " ", "3"), strict=True):
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(kind, 1) and r.role is not None and r.text is not None
