import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from crawlspark.llm import near_dedup
from crawlspark.llm.components import connected_components
from crawlspark.llm.membership import bitmap, may_contain
from crawlspark.llm.tokens import slices, texts, windows, words


def test_words_are_cut_like_the_pattern():
    column = pa.array(["a b  c", None, "", " \x0bAB\tc\n", "é x", "b"]).slice(1)
    (_, _, part), = slices(column)
    found = words(part, lower=True)
    assert found.counts.tolist() == [0, 0, 2, 2, 1]
    same = words(texts(pa.array(["ab", "c"])))
    assert found.hashes[:2].tolist() == same.hashes.tolist()
    runs, bounds = windows(found.hashes, found.first, 2)
    assert bounds.tolist() == [0, 0, 0, 1, 2, 2] and len(set(runs.tolist())) == 2


def test_membership_loses_nothing(spark):
    ids = [0, 5, -3, 2**40 + 1, 32768]
    found = bitmap(spark.createDataFrame([(i,) for i in [*ids, None]], "id long"), "id")
    assert may_contain(found, np.array(ids)).all() and not may_contain(found, np.array([6, 7])).any()


def test_components_of_paths_stars_and_loops(spark, scratch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (500, None)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()))
    groups = defaultdict(set)
    for a, b in edges:
        if b is not None and a != b:
            joined = groups[a] | groups[b] | {a, b}
            for x in joined:
                groups[x] = joined
    assert found == {x: min(g) for x, g in groups.items() if g}
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def brute(rows, size):
    """Components by comparing all pairs; equal ids are one document."""
    sets = defaultdict(list)
    for doc, text in rows:
        own = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).split()]
        runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} or ({tuple(own)} if own else set())
        sets[doc].append(runs)
    group = {d: {d} for d in sets}
    for x in sets:
        for y in sets:
            if x < y and any(
                a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[x] for b in sets[y]
            ):
                joined = group[x] | group[y]
                for z in joined:
                    group[z] = joined
    return {d: min(g) for d, g in group.items()}


def test_links_equal_brute_force(spark, scratch):
    rng = random.Random(2)
    base = [[f"v{rng.randrange(4000)}" for _ in range(rng.randrange(3, 120))] for _ in range(25)]
    rows = []
    for i in range(260):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        rows.append((i, (" " if i % 3 else "\n").join(own)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 4).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_large_family_with_a_common_passage(spark, scratch):
    """Many documents quote one passage and stay apart; copies of it with few edits are joined."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(40)])) for i in range(150)]
    for i in range(150, 230):
        own = list(passage)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(own)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 4).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 4)


def test_awkward_documents(awkward, no_docs, scratch):
    found = near_dedup.near_duplicates(awkward, scratch).collect()
    assert len(found) == 10
    by_id = Counter((r.doc_id, r.component_id, r.kept) for r in found)
    assert by_id[(1, 1, True)] == 2 and by_id[(2, 1, False)] == 1 and by_id[(None, None, True)] == 1
    assert {r.doc_id: r.n_shingles for r in found}[4] == 0
    assert all(by_id[(d, d, True)] == 1 for d in (3, 4, 5, 6, 7, 8))
    assert near_dedup.near_duplicates(no_docs, scratch).count() == 0
