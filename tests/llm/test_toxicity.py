"""Toxic passages: the scan against its definition, the extreme-value law, held-out accuracy, and awkward rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlspark.llm import toxicity
from crawlspark.llm.queries import QUERIES


def maximal(scores, offset=0):
    """By definition: the best segment (the shortest of equals), then the same to its left and right."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            value = sum(scores[a:b])
            if value > 0 and (best is None or (value, a - b) > (best[2], best[0] - best[1])):
                best = (a, b, value)
    if best is None:
        return []
    a, b, value = best
    return maximal(scores[:a], offset) + [(offset + a, offset + b, value)] + maximal(scores[b:], offset + b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-6, 6).filter(bool), max_size=14), st.randoms())
def test_scan_finds_the_maximal_segments(values, random):
    # Distinct powers apart, so that no two segments tie.
    scores = [v + random.random() / 64 for v in values]
    found = toxicity.segments(np.array(scores))
    wanted = maximal(scores)
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert np.allclose([x[2] for x in found], [x[2] for x in wanted])


def test_rate_is_the_root_of_the_moment_equation():
    histogram = {-1.0: 70, -0.25: 20, 1.0: 8, 2.0: 2}
    rate = toxicity.extreme_value_rate(histogram)
    assert rate > 0 and sum(n * math.exp(rate * s) for s, n in histogram.items()) == pytest.approx(100)
    assert toxicity.extreme_value_rate({}) == toxicity.extreme_value_rate({-1.0: 5}) == 1.0


def test_shares_rise_with_the_evidence():
    knots, shares = toxicity.monotone_shares([(0.0, 2, 50), (1.0, 1, 9), (2.0, 0, 3), (3.0, 4, 1), (4.0, 9, 0)])
    assert (np.diff(knots) > 0).all() and (np.diff(shares) >= 0).all() and shares[0] < 0.1 and shares[-1] > 0.9


WORDS = "der wind ging uber das land und kam von weit her".split()


def corpus(spark):
    random, rows, marks = np.random.default_rng(3), [], []
    for i in range(400):
        text = [WORDS[k] for k in random.integers(0, len(WORDS), 60)]
        if i % 4 == 0:
            at = int(random.integers(0, 50))
            text[at : at + 6] = ["schurke" + "xyz"[int(k)] if k < 3 else "und" for k in random.integers(0, 4, 6)]
        rows.append((i, " ".join(text), "x", "x"))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label string")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_passages_of_texts_not_learned_from(spark, scratch):
    docs, marks = corpus(spark)
    model = toxicity.fit_toxicity(docs.where("doc_id < 300"), marks, scratch)
    found = toxicity.with_toxicity(docs.where("doc_id >= 300"), model).collect()
    assert len(found) == 100 and found[0].asDict().keys() == {"doc_id", "text", "label", "score", "passages"}
    for r in found:
        assert (r.score >= 0.7) == (r.doc_id % 4 == 0), r
        held = [w for w in r.text.split() if w.startswith("schurke")]
        inside = " ".join(p.text for p in r.passages).split()
        assert (len(held) > 1) <= (bool(r.passages)) and set(inside) <= set(r.text.split())
        for p in r.passages:
            assert p.text == " ".join(r.text.split()[p.begin : p.begin + p.words]) and p.e_value <= toxicity.SIGNIFICANT


def test_awkward_documents(spark, scratch, awkward, no_docs):
    labels = spark.createDataFrame(
        [(1, 0), (2, 0), (3, 0), (4, 1), (6, 1), (7, 0), (8, 1), (8, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int"
    )
    model = toxicity.fit_toxicity(awkward, labels, scratch)
    found = toxicity.with_toxicity(awkward, model)
    assert found.columns == [c for c in awkward.columns if c != "score"] + ["score", "passages"]
    rows = found.collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    alike = [r.score for r in rows if not (r.text or "").strip()]
    assert len(set(alike)) == 1
    assert toxicity.with_toxicity(no_docs, model).count() == 0
    for some in (no_docs, awkward):
        none = toxicity.fit_toxicity(some, labels.where("toxic = 0"), scratch)
        assert {r.score for r in toxicity.with_toxicity(awkward, none, ["doc_id"], passages=False).collect()} == {0.0}


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    found = QUERIES["op13_toxicity"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    seen = found[found.held_out].merge(labels, on="doc_id")
    assert found.score.between(0, 1).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()
    assert (seen.predicted == seen.toxic).mean() > 0.9 and seen[seen.toxic == 0].predicted.mean() < 0.05
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.count("*")).first()[0] == len(found)
