"""Run files: JSON lines, first the metadata, then each query's lists; and a corpus file of documents, queries and judgements."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Storage

SCHEMA = "qid string, source string, source_ord int, key string, score double, raw double"


def check_meta(meta: Mapping) -> None:
    missing = {"generation", "space"} - set(meta)
    if missing:
        raise ValueError(f"run metadata lacks {sorted(missing)}")


def write_runs(path: str, runs: DataFrame, meta: Mapping) -> None:
    """One file for interchange; its lines are made by Spark and come to the driver one at a time. An existing file is replaced."""
    check_meta(meta)
    if runs.where(~(F.col("score").isNotNull() & F.col("raw").isNotNull()) | F.isnan("score") | F.isnan("raw") | (F.abs("score") == math.inf) | (F.abs("raw") == math.inf)).limit(1).collect():
        raise ValueError("a score isn't finite")
    place = F.row_number().over(Window.partitionBy("qid", "source").orderBy(F.desc("score"), "key"))
    lists = runs.withColumn("place", place).groupBy("qid", "source", "source_ord").agg(F.array_sort(F.collect_list(F.struct("place", "key", "score", "raw"))).alias("items"))
    lines = lists.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("source_ord", "source", "items"))).alias("lists")).orderBy("qid")
    out = [json.dumps({"meta": dict(meta)}, allow_nan=False)]
    for r in lines.toLocalIterator():
        out.append(json.dumps({"query": r.qid, "lists": {x.source: [[i.key, i.score, i.raw] for i in x["items"]] for x in r.lists}}, allow_nan=False))
    storage = Storage(runs.sparkSession)
    storage.delete(path)
    storage.create(path, "\n".join(out) + "\n")


def _strict(line: str):
    def refuse(number: str):
        raise ValueError(f"{number} is no JSON number")

    return json.loads(line, parse_constant=refuse)


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows of SCHEMA, metadata); refuses an empty file, a query on two lines, and numbers that JSON hasn't."""
    lines = Storage(spark).read(path).splitlines()
    if not lines:
        raise ValueError("the run file is empty")
    meta = _strict(lines[0])["meta"]
    check_meta(meta)
    rows, seen = [], set()
    for line in lines[1:]:
        row = _strict(line)
        if row["query"] in seen:
            raise ValueError(f"query {row['query']!r} has two lines")
        seen.add(row["query"])
        rows += [(row["query"], source, n, str(k), float(s), float(r)) for n, (source, items) in enumerate(row["lists"].items()) for k, s, r in items]
    return spark.createDataFrame(rows, SCHEMA), meta


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents (key, text), queries (qid, query), judgements (qid, key, grade)) of a labelled corpus file."""
    raw = json.loads(Storage(spark).read(path))
    documents = spark.createDataFrame(sorted(raw["documents"].items()), "key string, text string")
    queries = spark.createDataFrame([(q, x["text"]) for q, x in raw["queries"].items()], "qid string, query string")
    qrels = spark.createDataFrame([(q, k, int(g)) for q, x in raw["queries"].items() for k, g in x["relevant"].items()], "qid string, key string, grade int")
    return documents, queries, qrels
