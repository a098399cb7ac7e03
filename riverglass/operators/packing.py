"""Packing of candidates (qid, ord, ..): one for each value of a key, then as many as fit a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import whole


def renumbered(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("ord")).cast("int"))


def distinct_by(candidates: DataFrame, field: str) -> DataFrame:
    """The first of each value; rows without a value all stay."""
    first = F.row_number().over(Window.partitionBy("qid", field).orderBy("ord")) == 1
    return renumbered(candidates.withColumn("__first", first).where(F.col("__first") | F.col(field).isNull()).drop("__first"))


def within(candidates: DataFrame, max_chars: int, text: str = "text", chars: str | None = None) -> DataFrame:
    """The longest beginning whose texts have at most max_chars characters; the first row always stays.

    chars: a column that holds the texts' lengths already, for candidates too many to move with their texts.
    """
    whole("max_chars", max_chars, 1)
    so_far = F.sum(F.col(chars) if chars else F.char_length(F.col(text))).over(Window.partitionBy("qid").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return candidates.withColumn("__n", so_far).where((F.col("ord") == 1) | (F.col("__n") <= max_chars)).drop("__n")
