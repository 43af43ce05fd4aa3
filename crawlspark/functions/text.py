"""Helpers shared by all column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CRLF = "\r\n"


def present(column: Column) -> Column:
    """NULL for a missing value; an empty string counts as missing."""
    return F.nullif(column, F.lit(""))


def is_missing(column: Column) -> Column:
    return present(column).isNull()
