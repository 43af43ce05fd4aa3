import math

import pytest
from pyspark.sql import functions as F

from crawlspark.llm import decontamination, quality_classifier, quality_rules, url_filters


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_classifier_learns_and_survives_awkward_rows(spark, awkward, no_docs, scratch):
    good = [(100 + i, "plain words in a sentence number " + "abcdefgh"[i % 8] * 3) for i in range(40)]
    bad = [(200 + i, "### *** ### *** " * 5 + "abcdefgh"[i % 8]) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = labels(spark, [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (100, None), (9999, 1)])
    model = quality_classifier.fit_quality(docs, marks, scratch)
    scores = quality_classifier.with_quality(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id < 200) for r in scores)
    found = quality_classifier.with_quality(awkward, model)
    assert set(found.columns) == set(awkward.columns) and found.count() == 10
    assert found.where("score between 0 and 1").count() == 10
    assert quality_classifier.with_quality(no_docs, model).count() == 0
    none = quality_classifier.fit_quality(docs, marks.where("false"), scratch)
    assert quality_classifier.with_quality(docs, none).where("score < 0.5").count() == 0


def test_measures_by_hand(spark):
    text = "a b c a b c d\n\nx & y\nx & y\n  \n"
    row = quality_rules.measured(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), "lang").first()
    assert (row.n_words, row.word_chars, row.n_symbols) == (13, 13, 2)
    assert (row.n_lines, row.n_dup_lines) == (3, 1)
    # a b c twice and x & y twice.
    assert row.n_repeat_words == 12


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("k, n, p", [(0, 50, 0.02), (3, 400, 0.02), (40, 4000, 0.02), (1, 10, 0.5)])
def test_exact_binomial_tail(spark, k, n, p):
    tail = quality_rules._tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)
    assert spark.range(1).select(tail).first()[0] == pytest.approx(binomial_tail(k, n, p), rel=1e-9)


def test_cutoffs_keep_their_promise(spark, scratch):
    """1 % of the good documents of one language have many symbols: the cutoff stays above them."""
    rows = [(i, "xx", 100, 600, 300 if i % 50 == 0 else 1, 10, 0, 0, 1) for i in range(3000)]
    rows += [(i, "yy", 100, 600, 1, 10, 0, 0, 1) for i in range(3000)] + [(1, "zz", 100, 600, 0, 10, 0, 0, 1)]
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, quality int"
    found = {r.stratum: r for r in quality_rules.controlled_cutoffs(spark.createDataFrame(rows, names), scratch).collect()}
    assert found["xx"].symbols == 800 and found["yy"].symbols == 25 and found["zz"].symbols is None


def test_rules_on_awkward_rows(spark, awkward, no_docs, scratch):
    marks = labels(spark, [(1, 1), (1, 0), (None, 1), (8, None)])
    found = {r.doc_id: r for r in quality_rules.judged(awkward, marks, scratch).collect()}
    assert found[3].n_words == found[4].n_words == 0 and found[3].base_failed
    assert found[8].n_repeat_words == 160 and found[8].base_failed and not found[8].kept
    assert found[1].kept and found[7].n_words == 30_000
    assert quality_rules.judged(no_docs, marks, scratch).count() == 0
    assert quality_rules.judged(awkward, marks.where("false"), scratch).count() == 10


ITEM = "Mary has 12 apples and gives 5 kg of them to Tom before 12 more arrive at her old house"


def leaks(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "short one")], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}


def test_templates_find_changed_numbers_and_names(spark):
    other = ITEM.replace("Tom", "Jim").replace("12", "7").replace("5 kg", "9 lb")
    torn = ITEM.replace("12 more", "13 more")
    clean = "some other text about apples that Tom gives to nobody at all, before 12 more come to see her old house"
    found = leaks(spark, [f"x y z {ITEM} end", f"x {other} y", f"x {torn} y", clean, ITEM.upper(), "a short one b", None, ""])
    # The torn text gives one slot of the item two values.
    assert found == {(0, 1), (1, 1), (5, 4)} | ({(4, 1)} & found)


def found_leaks(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}


def test_items_shorter_in_tokens_than_in_words_are_found(spark):
    assert found_leaks(spark, ["we know x + y = z by now", "nothing"], ["x + y = z", "f(x) - g(x) = zero ?"]) == {(0, 0)}


def test_verbatim_copies_of_numbers_and_names_are_found(spark):
    items = ["Compute 12 + 34 * 56 - 78", "Is Tom Ann Bob or Eve Max Joe here", "1, 2, 3, 4, 5, 6, 7"]
    docs = [f"it says {item} there" for item in items] + ["Compute 12 + 34 * 56 - 79", "7 6 5 4 3 2 1"]
    assert found_leaks(spark, docs, items) == {(0, 0), (1, 1), (2, 2)}


def test_names_are_found_where_sentences_begin(spark):
    item = "Tom has 5 apples. Tom eats 2. How many are left?"
    copy = "Seven blue whales swim north today"
    docs = [item.replace("Tom", "Ann"), f"so ({item.replace('Tom', 'Jim')})", "Ann has 5 apples. Jim eats 2. How many are left?"]
    # The last one gives one name of the item two values.
    assert found_leaks(spark, [*docs, f'he said "{copy}" once'], [item, copy]) == {(0, 0), (1, 0), (3, 1)}


def test_leaks_of_awkward_rows(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 50)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(awkward, items).collect()} == {(1, 1), (2, 1)}
    assert decontamination.leaks(no_docs, items).count() == 0
    assert decontamination.leaks(awkward, items.where("false")).count() == 0


def test_blocks_reach_aliases_but_not_allowed_ones(spark, scratch):
    pages = spark.createDataFrame(
        [
            (1, "http://bad.test/x", None),
            (2, "http://alias.test/", '<link rel="canonical" href="http://middle.test/a">'),
            (3, "http://middle.test/a", '<META http-equiv=refresh content="0; url=http://bad.test/x">'),
            (4, "https://www.good.test/", '<link href="//alias.test" rel=canonical>'),
            (5, "http://far.test/", "<p>nothing</p>"),
            (6, None, "x"),
            (7, "no scheme", ""),
            (7, "http://Alias.TEST?utm_source=a#b", None),
        ],
        "page_id long, url string, html string",
    ).withColumns({n: F.lit("x") for n in ("a", "b", "node", "component", "normal", "verdict", "host")})
    rules = spark.createDataFrame([("bad.test", "/", "block"), ("good.test", "/", "allow")], "host string, path string, verdict string")
    links = url_filters.page_links(pages)
    found = {(r.page_id, r.url_host): (r.rule, r.verdict) for r in url_filters.judged(pages, links, rules, scratch).withColumnRenamed("host", "url_host").collect()}
    assert found[(1, "bad.test")] == ("bad.test/", "block")
    assert found[(2, "alias.test")] == found[(3, "middle.test")] == found[(7, "alias.test")] == (None, "block")
    assert found[(4, "www.good.test")] == ("good.test/", "allow")
    assert found[(5, "far.test")] == found[(6, "")] == found[(7, "")] == (None, "allow")
    assert url_filters.judged(pages.where("false"), links.where("false"), rules, scratch).count() == 0


def test_links_are_resolved_against_their_page(spark):
    html = {
        '<link rel=canonical href="page.html">': "http://h.test/a/page.html",
        '<link href="../x?q=1&amp;r=2" rel="canonical">': "http://h.test/x?q=1&r=2",
        '<link rel="alternate canonical" href="?id=1">': "http://h.test/a/b?id=1",
        '<link rel="canonical" href="/out?u=https://x/">': "http://h.test/out?u=https://x/",
        '<link rel="canonical" href="//o.test/&#x7e;a&#45;b">': "http://o.test/~a-b",
        '<meta http-equiv="refresh" content="0; url=./c/../d">': "http://h.test/a/d",
        '<link rel="canonical" href="mailto:a@b"><link rel="canonical" href="#top">': None,
    }
    rows = [("http://h.test/a/b?z=1", text) for text in html] + [("http://h.test/a/b", "".join(html)), ("none", "".join(html))]
    for (url, text), expected in zip(rows, html.values()):
        found = url_filters.page_links(spark.createDataFrame([(url, text)], "url string, html string")).collect()
        assert [r.target for r in found] == ([expected] if expected else []), text
    found = url_filters.page_links(spark.createDataFrame(rows[-2:-1], "url string, html string")).collect()
    assert {r.target for r in found} == {v for v in html.values() if v}
    assert url_filters.page_links(spark.createDataFrame(rows[-1:], "url string, html string")).count() == 0


def test_the_longest_rule_wins(spark):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("x.org", "/a/", "block"), ("x.org", "/a/", "allow"), ("y.org", "/", "block")],
        "host string, path string, verdict string",
    )
    urls = spark.createDataFrame([("http://x.org/a/b",), ("http://ax.org/a/",), ("http://s.y.org/",), ("http://org",)], "url string")
    found = {r.url: (r.rule, r.rule_verdict) for r in url_filters.ruled(urls, rules).collect()}
    assert found == {
        "http://x.org/a/b": ("x.org/a/", "allow"),
        "http://ax.org/a/": ("org/", "allow"),
        "http://s.y.org/": ("y.org/", "block"),
        "http://org": (None, None),
    }
