"""Many-to-one joins that stay balanced when one key holds most of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salt(salts: int, *columns: str) -> Column:
    """A stable salt of a row, in ``[0, salts)``."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def attach(rows: DataFrame, lookup: DataFrame, key: str, salts: int) -> DataFrame:
    """Left join of ``rows`` with ``lookup``, which has at most one row per key.

    ``rows`` must carry ``request_id`` and ``record_num``. The keys are first
    reduced to (key, salt) pairs, at most ``salts`` per key; only these meet
    the lookup table. The rows then join the answers by (key, salt), so a hot
    key spreads over ``salts`` tasks.
    """
    salted = rows.withColumn("salt", salt(salts, "request_id", "record_num"))
    pairs = salted.where(F.col(key).isNotNull()).select(key, "salt").distinct()
    answers = pairs.join(lookup, key)
    return salted.join(answers, [key, "salt"], "left").drop("salt")
