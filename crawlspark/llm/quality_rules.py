"""Quality rules whose cutoffs have a proven bound on the false rejection of good documents.

A rule rejects a document if one of its measures, in thousandths, is above a
cutoff. Cutoffs are chosen by stratum from labelled documents: the cutoff is
accepted while the exact (Clopper-Pearson) upper bound of the share of good
documents that the rule rejects stays within the rule's budget. The budgets
of all rules add up to ``FALSE_REJECTION`` for each stratum. The confidence
is shared between all strata and rules (Bonferroni); within one rule the nested
cutoffs are tested from the loosest down to the first that fails (fixed
sequence), which needs no further correction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.workspace import Scratch

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FALSE_REJECTION, ERROR = 0.02, 0.05

#: Each rule's measure in thousandths, and the cutoffs that are tested, loosest first.
RULES = {
    "symbols": ("1000 * n_symbols > {cutoff} * word_chars", [800, 400, 200, 100, 50, 25]),
    "dup_lines": ("1000 * n_dup_lines > {cutoff} * n_lines", [800, 600, 400, 300, 200, 100]),
    "repeats": ("1000 * n_repeat_words > {cutoff} * n_words", [450, 400, 350, 300, 250, 200]),
    "long_words": ("1000 * word_chars > {cutoff} * n_words", [20000, 15000, 12000, 10000, 9000, 8000]),
}


def _count(text: Column, character: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Null texts have no words. ``n_repeat_words`` counts the words that lie in
    a three-word window found twice or more in the text. A null stratum is
    one of its own.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    words = F.array_remove(F.split("text", SEPARATORS), "")
    triples = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        )
    )
    read = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text.alias("text"))
    cut = read.select("*", words.alias("words"), lines.alias("lines")).select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        sum((_count(F.col("text"), c) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        triples.alias("triples"),
    )
    # Windows in the order of their hashes; those equal to a neighbour are repeated.
    ordered = F.when(
        F.size(F.array_distinct("triples")) < F.size("triples"),
        F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("hash"), i.alias("at")))),
    )
    repeated = F.sort_array(
        F.transform(
            F.filter(
                F.transform(
                    "ordered",
                    lambda x, k: F.struct(
                        x["at"].alias("at"),
                        (
                            F.coalesce(F.get("ordered", k + 1)["hash"] == x["hash"], F.lit(False))
                            | F.coalesce(F.get("ordered", k - 1)["hash"] == x["hash"], F.lit(False))
                        ).alias("twice"),
                    ),
                ),
                lambda x: x["twice"],
            ),
            lambda x: x["at"],
        )
    )
    covered = F.aggregate(
        F.transform("repeated", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("repeated", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return (
        cut.withColumn("ordered", ordered)
        .drop("triples")
        .withColumn("repeated", repeated)
        .drop("ordered")
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("repeated")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _tail(rejected: Column, good: Column, share: float) -> Column:
    """P(X <= rejected) of a binomial X over ``good`` trials with ``share``, summed in logarithms.

    The exact upper bound of the rejected share is at most ``share`` if and only if this
    probability is at most the error. Only asked for if rejected < share * good.
    """
    odds = F.log(F.lit(share / (1 - share)))
    start = F.struct((good * F.log(F.lit(1 - share))).alias("term"), (good * F.log(F.lit(1 - share))).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((good - i + 1) / i) + odds
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, add, lambda state: state["total"]))


def controlled_cutoffs(
    holdout: DataFrame, scratch: Scratch, false_rejection: float = FALSE_REJECTION, error: float = ERROR
) -> DataFrame:
    """(stratum, one column per rule) with the strictest accepted cutoff, or null for none.

    ``holdout`` has the measures of documents whose ``quality`` is known; those with quality 1
    that the base rules keep count. A stratum without enough of these gets no cutoff.
    """
    counts = scratch.keep(
        holdout.where("quality = 1")
        .where(~base_failed())
        .groupBy("stratum")
        .agg(
            F.count("*").alias("good"),
            *[
                F.count_if(F.expr(rule.format(cutoff=cutoff))).alias(f"{name}_{cutoff}")
                for name, (rule, cutoffs) in RULES.items()
                for cutoff in cutoffs
            ],
        ),
        "holdout",
    )
    share = false_rejection / len(RULES)
    level = error / (len(RULES) * max(1, counts.count()))
    chosen = []
    for name, (_, cutoffs) in RULES.items():
        strictest, accepted = F.lit(None).cast("int"), F.lit(True)
        for cutoff in cutoffs:
            rejected = F.col(f"{name}_{cutoff}")
            within = F.when(rejected < F.lit(share) * F.col("good"), _tail(rejected, F.col("good"), share) <= level)
            accepted = accepted & F.coalesce(within, F.lit(False))
            strictest = F.when(accepted, cutoff).otherwise(strictest)
        chosen.append(strictest.alias(name))
    return scratch.keep(counts.select("stratum", *chosen), "cutoffs")


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, stratum: str = "lang") -> DataFrame:
    """The measures of every document, ``base_failed`` and ``kept``.

    ``labels`` (doc_id, quality) marks the holdout; a doc_id that is labelled twice
    counts twice. Rows that repeat are judged alike; empty texts fail the base rules.
    """
    measures = scratch.keep(measured(docs, stratum), "measures")
    holdout = measures.join(labels.select("doc_id", "quality").where("quality = 1"), "doc_id")
    cutoffs = controlled_cutoffs(holdout, scratch).withColumnRenamed("stratum", "of_stratum")
    exceeded = F.lit(False)
    for name, (rule, _) in RULES.items():
        exceeded = exceeded | F.coalesce(F.expr(rule.format(cutoff=name)), F.lit(False))
    return (
        measures.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~exceeded)
        .drop("of_stratum", *RULES)
    )
