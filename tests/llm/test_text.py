import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlspark.llm import html_extraction, lm_scoring, segmentation, sharding, zstd_warc
from crawlspark.llm.queries import SENTENCEPIECE_MODEL
from crawlspark.llm.tokens import mix, texts
from crawlspark.workspace import shared_dir


def brute_scores(rows, order, backoff, least):
    grams, cut = Counter(), []
    for _, text in rows:
        own = (text or "").lower().split()
        cut.append(own)
        for n in range(order + 1):
            grams.update(tuple(own[i : i + n]) for i in range(len(own) - n + (n > 0)))

    def score(own, i, n):
        gram = tuple(own[i - n + 1 : i + 1])
        if n == 1:
            return grams[gram] / grams[()]
        if grams[gram] >= least:
            return grams[gram] / grams[gram[:-1]]
        return backoff * score(own, i, n - 1)

    return [sum(math.log(score(own, i, min(order, i + 1))) for i in range(len(own))) for own in cut]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 40) % 30)) for i in range(60)] + [(99, None), (98, ""), (97, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    found = {r.doc_id: r for r in lm_scoring.scored(docs, 4, order, slice_rows=7).collect()}
    for (doc, text), expected in zip(rows, brute_scores(rows, order, 0.4, 2), strict=True):
        assert found[doc].log_score == pytest.approx(expected, abs=1e-9)
        assert found[doc].n_tokens == len((text or "").split())


def test_scores_of_awkward_rows(awkward, no_docs):
    assert lm_scoring.scored(awkward, 1).count() == 10
    assert lm_scoring.scored(no_docs, 2).count() == 0


@pytest.mark.parametrize("n, k, d", [(50, 20, 10), (300, 299, 7), (10, 5, 5), (12, 3, 11)])
def test_hypergeometric_law(spark, n, k, d):
    drawn = sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(d), sharding._uniform(F.lit(1), "id"))
    seen = Counter(r[0] for r in spark.range(5000).select(drawn).collect())
    for x in range(d + 1):
        law = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) if d - x <= n - k else 0
        assert seen[x] / 5000 == pytest.approx(law, abs=0.03) and (law > 0 or seen[x] == 0)


def test_matrix_has_exact_sums(spark, scratch):
    parts = spark.createDataFrame([(i, 37 * i % 101) for i in range(40)], "part long, n long")
    rows = {r.part: r.counts for r in sharding.communication_matrix(parts, 3, scratch).collect()}
    assert all(sum(rows[i]) == 37 * i % 101 for i in range(40))
    sums = [sum(r[s] for r in rows.values()) for s in range(3)]
    assert max(sums) - min(sums) <= 1


def test_shuffle_is_even_over_rows(spark, scratch):
    """Each row is as likely in each shard and slot, and neighbours part."""
    where = Counter()
    for seed in range(12):
        rows = spark.range(0, 60, 1, 3).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
        for r in sharding.sharded(rows, 4, scratch, seed=seed, block_rows=5).collect():
            where[(r.doc_id // 20, r.shard)] += 1
    assert all(where[(p, s)] == pytest.approx(60, abs=25) for p in range(3) for s in range(4))


def test_shards_of_awkward_rows(awkward, no_docs, scratch):
    found = sharding.sharded(awkward, 3, scratch).collect()
    assert sorted(Counter(r.shard for r in found).values()) == [3, 3, 4]
    assert {"shard", "slot", "text", "doc_id"} <= set(found[0].asDict()) and len(found) == 10
    assert sharding.sharded(no_docs, 3, scratch).count() == 0


PAGES = [
    (1, "http://a.test/\n1", "same"),
    (2, None, "same"),
    (2, None, "same"),
    (None, "u", "same"),
    (3, "u", None),
    (4, "u", ""),
    (5, "u", "ü" * 300_000),
]


def test_archives_round_trip(spark, scratch):
    pages = spark.createDataFrame(PAGES + [(100 + i, "u", f"<p>page {i} of many</p>" * 20) for i in range(300)], "page_id long, url string, html string")
    pages = pages.withColumns({n: F.lit("x") for n in ("key", "bytes", "first", "payload", "path")})
    records = zstd_warc.with_record_types(pages, scratch)
    files = zstd_warc.write_archives(records, shared_dir(spark, "archives"), scratch, max_bytes=4000)
    assert files.count() > 8 and zstd_warc.read_archives(files).rdd.getNumPartitions() == files.count()
    assert files.count() > 1
    read = zstd_warc.read_archives(files)
    assert read.where("error is not null").count() == 0
    html = {p: (h or "") for p, _, h in PAGES}
    rows = zstd_warc.resolved(read).collect()
    assert len(rows) == 307
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in rows if (r.page_id or 0) < 100)
    assert kinds == Counter(
        {(2, "response", None): 2, (1, "revisit", 2): 1, (None, "revisit", 2): 1, (3, "revisit", 4): 1, (4, "response", None): 1, (5, "response", None): 1}
    )
    for r in rows:
        if (r.page_id or 100) < 100:
            assert r.payload_bytes == len(html[r.page_id].encode())
            assert r.payload_digest == zstd_warc.digest_text(html[r.page_id].encode())
    none = zstd_warc.write_archives(records.where("false"), shared_dir(spark, "archives"), scratch)
    assert none.count() == 0 and zstd_warc.read_archives(none).count() == 0


def test_damaged_archives_are_reported(spark, tmp_path):
    import struct

    import zstandard

    good = zstd_warc.record_bytes(1, "u", b"x", "response", None, "2024-01-01T00:00:00Z")
    squeeze = zstandard.ZstdCompressor().compress
    cases = {
        "length": squeeze(re.sub(rb"Content-Length: \d", b"Content-Length: 1", good, count=1)) + squeeze(good),
        "cut": squeeze(good)[:-5],
        "two": squeeze(good + good),
        "digest": squeeze(good[:-5] + b"y" + good[-4:]),
        "missing": squeeze(good.replace(b"WARC-Date", b"WARC-Dat")),
        "dictionary": struct.pack("<II", zstd_warc.DICTIONARY_MAGIC, 900) + b"short",
        "empty": b"",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in cases], "path string")
    found = Counter((r.path.rpartition("/")[2], r.error is None) for r in zstd_warc.read_archives(files).collect())
    assert found == Counter({("length", False): 1, ("length", True): 1, **{(n, False): 1 for n in ("cut", "two", "digest", "missing", "dictionary")}})


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>
 text&nbsp;here.<p>Two<br>lines<script>var x = "</p>"</script><aside>Read more</aside><ul><li>first<li>second</ul>
<form>Name <input></form><div class="share-links">Share</div><section id="comments"><p>A reader said</section></article>
<footer>&copy; 2024</footer></body></html>"""


def test_article_without_what_surrounds_it():
    blocks = html_extraction.page_blocks(ARTICLE)
    assert html_extraction.main_blocks(blocks) == ["Head & line", "One bold text\xa0here.", "Two lines", "first", "second"]
    assert html_extraction.main_blocks(html_extraction.page_blocks("<p>a")) is None
    assert html_extraction.page_blocks(None) == []
    marked = "<article><p>A<div class='relatedPosts'>B</div><ol id=commentlist><li>C</ol><p class=no-ads>D</article>"
    assert html_extraction.main_blocks(html_extraction.page_blocks(marked)) == ["A", "D"]


def test_copies_of_a_page_keep_their_text(spark, scratch):
    menu = "<p>home news sport weather about us contact imprint privacy terms</p>"
    story = " ".join(f"story{i}" for i in range(60))
    rows = [
        (1, "http://h.test/a", f"{menu}<p>{story}</p>"),
        (2, "http://h.test/a?utm_source=x", f"{menu}<p>{story}</p>"),
        (3, "http://h.test/mirror/a", f"{menu}<p>{story} today</p>"),
        (4, "http://h.test/b", f"{menu}<p>{' '.join(f'other{i}' for i in range(60))}</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extraction.main_text(pages, scratch).collect()}
    assert found[1] == found[2] == story and found[3] == f"{story} today"
    assert found[4].startswith("other0 ") and "menu" not in found[4] and "imprint" not in found[4]


def test_repeated_runs_go_and_unique_runs_stay(spark, scratch):
    chrome = "<div>home news sport weather video audio about us contact imprint</div>"
    rows = [(i, f"http://h.test/{i}", f"{chrome}<p>story{i} that nobody else tells in this way</p>") for i in range(6)]
    rows += [(50, "http://other.test/", chrome), (60, None, chrome), (60, None, chrome), (70, "http://h.test/x", ""), (71, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("x") for n in ("page", "host_key", "text", "key", "at")})
    found = html_extraction.main_text(pages, scratch).collect()
    by_id = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and by_id[70] == by_id[71] == ""
    assert by_id[3] == "story3 that nobody else tells in this way"
    assert by_id[50].startswith("home news") and by_id[60].startswith("home news")
    assert html_extraction.main_text(pages.where("false"), scratch).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    found = segmentation.Vocabulary.load(SENTENCEPIECE_MODEL)
    found.prepare()
    return found


def all_paths(vocabulary, text):
    own = set(vocabulary.byte_ids.tolist())
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if p and i not in own}

    def go(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                for tail in go(rest[n:]):
                    yield (ids[rest[:n]], *tail)

    return list(go(b" " + text.encode()))


def test_samples_follow_the_law_without_replacement(vocabulary):
    paths = all_paths(vocabulary, "thes an")
    law = np.exp([vocabulary.weights[list(p)].sum() for p in paths])
    law = dict(zip(paths, law / law.sum(), strict=True))
    count = 8000
    found = segmentation.sample(vocabulary, texts(pa.array(["thes an"] * count)), mix(np.arange(count, dtype=np.uint64)), 3)
    first, second, estimate = Counter(), Counter(), Counter()
    for own, after in found:
        keys = [tuple(s.ids.tolist()) for s in own]
        assert len(set(keys)) == 3 and own[0].perturbed >= own[1].perturbed >= own[2].perturbed >= after
        first[keys[0]] += 1
        second[keys[0], keys[1]] += 1
        for key, s in zip(keys, own, strict=True):
            assert s.log_prob == pytest.approx(math.log(law[key]), abs=1e-9)
            estimate[key] += law[key] / -math.expm1(-math.exp(s.log_prob - after))
    for a, p in law.items():
        assert first[a] / count == pytest.approx(p, abs=0.02)
        # Weighted by their inclusion, samples stand for the whole law.
        assert estimate[a] / count == pytest.approx(p, abs=0.03)
        for b, q in law.items():
            if a != b:
                assert second[a, b] / count == pytest.approx(p * q / (1 - p), abs=0.02)


def test_few_segmentations_come_out_whole(vocabulary):
    paths = all_paths(vocabulary, "abcd")
    (own, after), = segmentation.sample(vocabulary, texts(pa.array(["abcd"])), mix(np.arange(1, dtype=np.uint64)), 50)
    assert {tuple(s.ids.tolist()) for s in own} == set(paths) and len(own) == len(paths) and after == -math.inf


def test_segmentations_of_awkward_rows(spark, awkward, no_docs, vocabulary):
    found = segmentation.sampled_segmentations(awkward, vocabulary, samples=3)
    rows = found.collect()
    assert all(r.round_trip and r.log_inclusion <= 0 and r.n_pieces == len(r.ids) for r in rows)
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    twice = Counter((r.doc_id, tuple(r.ids)) for r in rows if r.doc_id == 1)
    assert set(twice.values()) == {2}
    again = segmentation.sampled_segmentations(awkward.repartition(5), vocabulary, samples=3).collect()
    assert Counter((r.doc_id, r.sample, tuple(r.ids)) for r in again) == Counter((r.doc_id, r.sample, tuple(r.ids)) for r in rows)
    texts_back = {r.doc_id: r.text for r in segmentation.decoded(found, vocabulary).collect()}
    assert texts_back[6] == "Ünïcode ☃ one" and texts_back[4] == texts_back[3] == ""
    assert segmentation.sampled_segmentations(no_docs, vocabulary).count() == 0
