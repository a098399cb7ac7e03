"""Quality of rankings: Hit@k, MRR and NDCG@k; replayed fusion; a split by hash; the choice among options.

Runs are rows (qid, rank, key), judgements (qid, key, grade), run sets (qid, source, source_ord, key, score, raw).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import whole


def check_ranking(run: DataFrame) -> None:
    if run.groupBy("qid", "key").count().where("count > 1").limit(1).collect():
        raise ValueError("ranked keys must be unique")


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, answered, hit, mrr, ndcg, returned) of each judged query; a query that the run lacks has zeros."""
    whole("k", k)
    graded = run.join(qrels, ["qid", "key"], "left").withColumn("gain", F.greatest(F.coalesce("grade", F.lit(0)), F.lit(0)))
    found = graded.groupBy("qid").agg(
        F.max(F.when((F.col("rank") <= k) & (F.col("gain") > 0), 1.0).otherwise(0.0)).alias("hit"),
        F.coalesce(1.0 / F.min(F.when(F.col("gain") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.count(F.lit(1)).alias("returned"),
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "key"))
    ideal = qrels.withColumn("place", place).groupBy("qid").agg(
        F.sum(F.when((F.col("grade") > 0) & (F.col("place") <= k), F.col("grade") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("best"),
        F.coalesce(F.max("grade") > 0, F.lit(False)).alias("answered"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ndcg = F.when(F.col("best") > 0, zero("dcg") / F.when(F.col("best") > 0, F.col("best"))).otherwise(0.0)
    return ideal.join(found, "qid", "left").select("qid", "answered", zero("hit").alias("hit"), zero("mrr").alias("mrr"), ndcg.alias("ndcg"), F.coalesce("returned", F.lit(0)).cast("bigint").alias("returned"))


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: means over queries with an answer; queries without one are counted apart, with what the run returned for them."""
    yes, no = F.col("answered"), ~F.col("answered")
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    return per_query(run, qrels, k).agg(
        mean("hit", yes).alias("hit"),
        mean("mrr", yes).alias("mrr"),
        mean("ndcg", yes).alias("ndcg"),
        F.count_if(yes).alias("queries"),
        F.count_if(no).alias("no_answer_queries"),
        mean("returned", no).alias("no_answer_returned"),
    )


def replay(runs: DataFrame, fuser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, rank, key): a fusion over recorded lists; ties go by key, as keys are numbered in their order."""
    numbered = runs.withColumn("id", F.dense_rank().over(Window.partitionBy("qid").orderBy("key")).cast("bigint"))
    lists = numbered.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "source_ord").orderBy(F.desc("score"), "key")).cast("int"))
    return fuser(lists.drop("key")).join(numbered.select("qid", "id", "key").distinct(), ["qid", "id"]).select("qid", "rank", "key")


def collect(lists: DataFrame, keys: DataFrame) -> DataFrame:
    """A run set of sources' lists (qid, source, source_ord, rank, id, score, raw), with the durable keys (id, key)."""
    out = lists.join(keys, "id").select("qid", "source", "source_ord", "key", "score", "raw")
    if out.groupBy("qid", "source", "key").count().where("count > 1").limit(1).collect():
        raise ValueError("a durable key appears twice")
    return out


def source_run(runs: DataFrame, source: str) -> DataFrame:
    """(qid, rank, key) of one source."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    return runs.where(F.col("source") == source).select("qid", F.row_number().over(order).cast("int").alias("rank"), "key")


def in_test(ids: str, test_share: float = 0.3, seed: str = "split"):
    """Whether an id is in the test part: the first 64 bits of BLAKE2b of seed:id, as a fraction, below test_share."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must be between 0 and 1")

    @F.pandas_udf("boolean")
    def drawn(x: pd.Series) -> pd.Series:
        return x.map(lambda i: int.from_bytes(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest(), "big") / 2**64 < test_share)

    return drawn(F.col(ids).cast("string"))


def split(queries: DataFrame, *, test_share: float = 0.3, seed: str = "split") -> tuple[DataFrame, DataFrame]:
    """Train and test ids, in order; the same ids and seed give the same parts."""
    if queries.groupBy("qid").count().where("count > 1").limit(1).collect():
        raise ValueError("query ids must be unique")
    drawn = queries.select("qid", in_test("qid", test_share, seed).alias("test"))
    return tuple(drawn.where(F.col("test") == t).select("qid").orderBy("qid") for t in (False, True))


@dataclass(frozen=True)
class Tuned:
    best: str
    train: Mapping[str, float]
    test: Mapping[str, float]


def option_scores(runs: DataFrame, qrels: DataFrame, options: Mapping[str, Callable[[DataFrame], DataFrame]], parts: DataFrame, k: int = 10) -> DataFrame:
    """(option, option_ord, part, hit, mrr, ndcg): each option's means over each part (qid, part) of the queries with an answer."""
    out = None
    for n, (name, fuser) in enumerate(options.items()):
        means = per_query(replay(runs, fuser), qrels, k).join(parts, "qid").where("answered").groupBy("part").agg(F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
        one = means.select(F.lit(name).alias("option"), F.lit(n).alias("option_ord"), "part", "hit", "mrr", "ndcg")
        out = one if out is None else out.unionByName(one)
    return out


def tune(runs: DataFrame, qrels: DataFrame, options: Mapping[str, Callable], *, train: Sequence, test: Sequence, metric: str = "mrr", k: int = 10) -> Tuned:
    """The option with the best metric on train; ties go to the one named first. Both parts' figures are told."""
    whole("k", k)
    if set(train) & set(test):
        raise ValueError("train and test queries overlap")
    if not train or not test:
        raise ValueError("train and test must have queries")
    columns = {"mrr": "mrr", f"hit@{k}": "hit", f"ndcg@{k}": "ndcg"}
    if metric not in columns:
        raise ValueError(f"metric must be one of {sorted(columns)}")
    kind = dict(qrels.dtypes)["qid"]
    parts = runs.sparkSession.createDataFrame([(q, "train") for q in train] + [(q, "test") for q in test], f"qid {kind}, part string")
    rows = option_scores(runs, qrels, options, parts, k).collect()
    told = {p: {o: next((float(r[columns[metric]]) for r in rows if r.option == o and r.part == p), 0.0) for o in options} for p in ("train", "test")}
    return Tuned(max(options, key=lambda o: told["train"][o]), told["train"], told["test"])
