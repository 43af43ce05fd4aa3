"""A fixed-size filter of ids, for dropping most rows before a shuffle.

The filter is a bitmap of ``id modulo BITS``. It never loses an id; a row that
passes by chance is dropped by the exact join behind it. Its size is bounded by
``BITS`` whatever the number of ids, so it may go through the driver.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_PAGE_BITS = 1 << 15


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of integers: at most ``BITS`` / 8 bytes."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    pages = (
        ids.where(F.col(column).isNotNull())
        .select(F.floor(bit / _PAGE_BITS).cast("int").alias("page"), (bit % _PAGE_BITS).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    found = np.zeros(BITS // 8, np.uint8)
    for page, bits in pages.collect():
        found[page * _PAGE_BITS // 8 :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return found


def may_contain(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.asarray(ids).astype(np.int64) % BITS
    return (found[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
