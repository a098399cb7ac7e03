"""Fusion of ranked lists. A list is rows (qid, source, source_ord, rank, id, score, raw); rank starts at 1."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..model import whole

NORMALISATIONS = ("min-max", "max", "sum", "z-score")


def stacked(lists: Sequence[DataFrame]) -> DataFrame:
    """One table of several lists (qid, source, rank, id, score, raw); their order becomes source_ord."""
    rows = None
    for k, one in enumerate(lists):
        part = one.select("qid", "source", F.lit(k).alias("source_ord"), "rank", "id", "score", "raw")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no lists")
    return rows


def check_lists(lists: DataFrame) -> None:
    """Raises unless every list has unique ids and finite scores, best first by (score desc, id), and sources are unique."""
    order = Window.partitionBy("qid", "source_ord").orderBy("rank")
    same = Window.partitionBy("qid", "source_ord", "id")
    before, id_before = F.lag("score").over(order), F.lag("id").over(order)
    bad = lists.select(
        F.when(~finite(F.col("score")) | ~finite(F.col("raw")), "a score isn't finite")
        .when(F.count(F.lit(1)).over(same) > 1, "an id is repeated")
        .when((before < F.col("score")) | ((before == F.col("score")) & (id_before > F.col("id"))), "a list isn't best first")
        .alias("what")
    ).where("what is not null")
    if found := bad.limit(1).collect():
        raise ValueError(found[0].what)
    if lists.groupBy("source").agg(F.count_distinct("source_ord").alias("n")).where("n > 1").limit(1).collect():
        raise ValueError("source names must be unique")


def _weight(weights: Mapping[str, float] | None) -> Column:
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        if isinstance(w, bool) or not isinstance(w, int | float) or not math.isfinite(w) or w < 0:
            raise ValueError(f"weight of {name!r} must be finite and at least 0")
        out = F.when(F.col("source") == name, F.lit(float(w))).otherwise(out)
    return out


def _ordered(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).select("qid", "rank", "id", "score")


def rrf(lists: DataFrame, *, k: int = 60, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(qid, rank, id, score): reciprocal rank fusion, the sum of weight / (k + rank). Weight 0 leaves a list out."""
    whole("k", k)
    rows = lists.withColumn("w", _weight(weights)).where("w > 0")
    return _ordered(rows.groupBy("qid", "id").agg(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))).alias("score")))


def normalise(score: Column, how: str, list_of: tuple[str, ...] = ("qid", "source_ord")) -> Column:
    """Scores of each list on one scale.

    Values are divided by the largest absolute one first, so sums don't overflow. min-max: all equal is 1;
    max, sum and z-score (population deviation): 0 where the scale is 0.
    """
    w = Window.partitionBy(*list_of)
    largest = F.max(F.abs(score)).over(w)
    v = F.when(largest == 0, score).otherwise(score / F.when(largest != 0, largest))
    low, high = F.min(v).over(w), F.max(v).over(w)

    def over(scale: Column, top: Column, if_none: float) -> Column:
        return F.when(scale == 0, F.lit(if_none)).otherwise(top / F.when(scale != 0, scale))

    match how:
        case "min-max":
            equal = F.min(score).over(w) == F.max(score).over(w)
            return F.when(equal, F.lit(1.0)).otherwise(over(high - low, v - low, 1.0))
        case "max":
            return over(F.max(F.abs(v)).over(w), v, 0.0)
        case "sum":
            return over(F.sum(F.abs(v)).over(w), v, 0.0)
        case "z-score":
            equal = F.min(score).over(w) == F.max(score).over(w)
            return F.when(equal, F.lit(0.0)).otherwise(over(F.stddev_pop(v).over(w), v - F.avg(v).over(w), 0.0))
    raise ValueError(f"normalise must be one of {NORMALISATIONS}")


def blend(lists: DataFrame, *, weights: Mapping[str, float] | None = None, normalise_by: str = "min-max") -> DataFrame:
    """(qid, rank, id, score): the weighted sum of normalised scores. Weight 0 leaves a list out."""
    rows = lists.withColumn("w", _weight(weights)).where("w > 0").withColumn("v", normalise(F.col("score").cast("double"), normalise_by))
    return _ordered(rows.groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("v")).alias("score")))


def first(lists: DataFrame) -> DataFrame:
    """(qid, rank, id, score): each query's first list that has rows, as it is."""
    lead = Window.partitionBy("qid")
    return _ordered(lists.withColumn("lead", F.min("source_ord").over(lead)).where("source_ord = lead").select("qid", "id", "score"))


def with_evidence(fused: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds evidence: (source, rank, score, raw) of every list that holds the id, in the lists' order, of those the fuser left out too."""
    told = lists.join(fused.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("source_ord", "source", "rank", "score", "raw"))).alias("e"))
    out = fused.join(told, ["qid", "id"], "left")
    return out.withColumn("evidence", F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["rank"].alias("rank"), x["score"].alias("score"), x["raw"].alias("raw")))).drop("e")


def check_fused(fused: DataFrame, lists: DataFrame) -> None:
    """Raises unless a fuser's rows are unique, finite, best first, and of ids that a list holds."""
    order = Window.partitionBy("qid").orderBy("rank")
    before, id_before = F.lag("score").over(order), F.lag("id").over(order)
    bad = fused.select(
        F.when(F.count(F.lit(1)).over(Window.partitionBy("qid", "id")) > 1, "the fuser repeated an id")
        .when(~finite(F.col("score")), "the fuser gave a score that isn't finite")
        .when((before < F.col("score")) | ((before == F.col("score")) & (id_before > F.col("id"))), "the fuser's rows aren't best first")
        .alias("what")
    ).where("what is not null")
    if found := bad.limit(1).collect():
        raise ValueError(found[0].what)
    if fused.join(lists, ["qid", "id"], "left_anti").limit(1).collect():
        raise ValueError("the fuser added ids that no list holds")
