"""The source divergence audit against plain arithmetic, over blocks and on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlspark.llm import source_divergence as audit
from crawlspark.llm.tokens import Texts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """The result of (lang, source, text) rows by the definition."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall(low(text or ""))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (own[t] + 1) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        cost = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(cost(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            best = [(cost(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, listed, most in (("pair", pairs, None), ("term", best, 200)):
                ordered = sorted(listed, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)}
    return out


def found(spark, scratch, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {c: F.lit("x") for c in ("term", "n", "docs", "counts", "block", "total", "value", "doc_id")}
    )
    listed = audit.divergences(docs, scratch).collect()
    assert len(set(listed)) == len(listed)
    return {tuple(r) for r in listed}


def sample_rows():
    random = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    for i in range(160):
        size = int(random.integers(1, 60))
        yield "ab"[i % 3 % 2], f"s{i % 7}", " ".join(words[int(k)] for k in random.zipf(1.4, size) % 300)


def test_divergences_by_the_definition(spark, scratch):
    rows = list(sample_rows())
    assert found(spark, scratch, rows) == plain(rows)


def test_small_blocks_and_panels_change_nothing(spark, scratch, monkeypatch):
    for name, value in (("BLOCK_COUNTS", 100), ("PRODUCT_TERMS", 16), ("PANEL", 5), ("SLICE_BYTES", 300)):
        monkeypatch.setattr(audit, name, value)
    rows = list(sample_rows())
    assert found(spark, scratch, rows) == plain(rows)


def test_awkward_documents(spark, scratch):
    long = "Ünï ünï Zebra " * 40_000
    rows = [
        (None, None, "a b a"), ("", "", "a B"), ("", "x", "A b c"), ("en", "x", None), ("en", "y", " 12 _ "), ("en", "z", ""),
        ("de", "x", long), ("de", "x", long), ("de", "y", "ünï\x7fzebra"), ("de", "y", "Ünï é"), ("de", None, "é é é"), ("fr", "x", "un"),
    ]
    got = found(spark, scratch, rows)
    assert got == plain(rows)
    assert {r[2:5:2] for r in got if r[0] == "en"} == {("pair", 0)} and not any(r[0] == "fr" for r in got)
    assert found(spark, scratch, rows[:0]) == set()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2 * 10**14), min_size=1, max_size=9), st.integers(0, 10**13))
def test_shares_are_exact(counts, more):
    total = sum(counts) // len(counts) + len(counts) + more
    counts = [min(c, total - 1) for c in counts]
    assert audit.share(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aB é\x00_9Ü\n", max_size=9), max_size=5))
def test_terms_are_runs_of_letters(texts):
    data = [t.encode() for t in texts]
    part = Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    terms, doc = audit.terms_of(part)
    listed = [(int(d), t.decode()) for d, t in zip(doc, terms.to_pylist(), strict=True)]
    assert listed == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(low(t))]
