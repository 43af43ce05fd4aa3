import pytest

from crawlspark.workspace import Scratch

#: Columns that clash with names the operators use themselves.
CLASHES = ["score", "shard", "slot", "key", "a", "b", "node", "component", "stratum", "words", "kept", "ids", "_part", "n_words", "Rule"]


def words(count, offset=0):
    return " ".join(f"w{offset + i}" for i in range(count))


#: Ordinary, repeated, null, empty, blank and very long texts; ids that repeat or are null.
ROWS = [
    (1, words(80), "en"),
    (1, words(80), "en"),
    (2, words(80) + " end", None),
    (3, None, "en"),
    (4, "", "de"),
    (5, " \n\t ", "de"),
    (6, "Ünïcode ☃ one", "fr"),
    (None, words(60, 1000), "en"),
    (7, words(30_000, 5000) + "x" * 50_000, "en"),
    (8, "same same same same " * 40, None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return docs.withColumns({name: F.lit("x") for name in CLASHES})


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.where("false")


@pytest.fixture
def scratch(spark):
    return Scratch(spark)
