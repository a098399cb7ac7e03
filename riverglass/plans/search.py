"""Hybrid search: sources, fusion, hydration, reranking and packing of a batch of queries as one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..model import FilterError, whole
from ..operators import fusion, packing
from ..operators.predicates import Filter, and_, compile_filter
from ..operators.reranking import Reranker
from ..sources.store import Store


class Source(Protocol):
    name: str

    def search(self, queries: DataFrame, k: int, flt: Filter | None, warnings: list[str]) -> DataFrame: ...


class VectorSource:
    def __init__(self, store: Store, name: str = "vector"):
        self.store, self.name = store, name

    def search(self, queries: DataFrame, k: int, flt: Filter | None, warnings: list[str]) -> DataFrame:
        return self.store.search_vector(queries, k, flt, warnings).withColumn("source", F.lit(self.name))


class KeywordSource:
    def __init__(self, store: Store, name: str = "keyword"):
        self.store, self.name = store, name

    def search(self, queries: DataFrame, k: int, flt: Filter | None, warnings: list[str]) -> DataFrame:
        return self.store.search_keyword(queries, k, flt).withColumn("source", F.lit(self.name))


@dataclass
class Result:
    """hits: (qid, ord, id, score, text, declared fields, extra, citation, evidence)."""

    hits: DataFrame
    warnings: list[str] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Lets go of the lists and candidates that are kept for hits; they are made again if it is read later."""
        while self.held:
            self.held.pop().unpersist()


class Search:
    """The composed query. depth: candidates of each source and of the fused list, 4 * k unless set.

    A source that fails is left out with a warning, unless its filter or the store failed or all fail; so
    each source's list is materialised on its own. Lists, fused rows and candidates have at most depth rows
    a query, whatever the store holds.
    """

    def __init__(self, store: Store, *, sources: Sequence[Source], fuser: Callable[[DataFrame], DataFrame] = fusion.rrf, rerankers: Sequence[Reranker] = (), depth: int | None = None, base_filter: Filter | None = None, citation: Sequence[str] = (), distinct_by: str | None = None, max_chars: int | None = None):
        if depth is not None:
            whole("depth", depth)
        unknown = set(citation) | ({distinct_by} if distinct_by else set())
        if unknown := unknown - set(store.kinds):
            raise ValueError(f"fields {sorted(unknown)} aren't declared")
        if max_chars is not None:
            whole("max_chars", max_chars, 1)
        self.store, self.sources, self.fuser, self.rerankers, self.depth = store, tuple(sources), fuser, tuple(rerankers), depth
        self.base_filter, self.citation, self.distinct_by, self.max_chars = base_filter, tuple(citation), distinct_by, max_chars

    def run(self, queries: DataFrame | str, k: int, flt: Filter | None = None) -> Result:
        whole("k", k)
        spark: SparkSession = self.store.spark
        if isinstance(queries, str):
            queries = spark.createDataFrame([("q", queries)], "qid string, query string")
        parts = [f for f in (self.base_filter, flt) if f is not None]
        scope = and_(*parts) if parts else None
        compiled = compile_filter(scope, self.store.kinds)
        depth, warnings, self._held = 4 * k if self.depth is None else self.depth, [], []
        lists = self._lists(queries, depth, scope, warnings)
        fused = self._hold(self.fuser(lists))
        fusion.check_fused(fused, lists)
        told = fusion.with_evidence(fused.where(F.col("rank") <= depth), lists)
        candidates, hydrated = self._hydrated(told, compiled, warnings)
        for r in self.rerankers:
            candidates = self._reranked(r, candidates, queries)
        if self.rerankers:
            left = candidates.groupBy("qid").count()
            for row in hydrated.join(left.withColumnRenamed("count", "left"), "qid", "left").where((F.col("count") >= k) & (F.coalesce("left", F.lit(0)) < k)).orderBy("qid").collect():
                warnings.append(f"reranking left {row.left or 0} of {k} hits of {row.qid}")
        candidates = self._packed(candidates, k, warnings)
        hits = candidates.where(F.col("ord") <= k)
        cited = F.struct(*(F.col(c) for c in self.citation)) if self.citation else F.lit(None)
        return Result(hits.select("qid", "ord", "id", "score", "text", *self.store.kinds, "extra", cited.alias("citation"), "evidence"), warnings, self._held)

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist())
        return df

    def _lists(self, queries: DataFrame, depth: int, scope: Filter | None, warnings: list[str]) -> DataFrame:
        lists, errors = [], []
        for source in self.sources:
            try:
                own: list[str] = []
                found = self._hold(source.search(queries, depth, scope, own))
                found.count()
                lists.append(found)
                warnings += own
            except (FilterError, AnalysisException, Py4JError):
                raise
            except Exception as e:  # noqa: BLE001  one source's failure is told, not raised
                errors.append(e)
                warnings.append(f"source {source.name!r} failed and was left out: {e}")
        if errors and not lists:
            raise errors[0]
        if not lists:
            raise ValueError("no sources")
        stacked = fusion.stacked(lists)
        fusion.check_lists(stacked)
        return stacked

    def _hydrated(self, fused: DataFrame, compiled, warnings: list[str]) -> tuple[DataFrame, DataFrame]:
        """The fused rows that are in the store and the filter, with what the rerankers need; both from one generation."""
        needs = {"text", "metadata"}.union(*(r.needs for r in self.rerankers))
        ids = fused.select("id").distinct()
        allowed = compiled.apply(self.store.items.join(ids, "id", "left_semi")).select("id")
        rows = self._hold(fused.withColumnRenamed("rank", "ord").join(self.store.fetch(allowed, needs), "id"))
        dropped = fused.count() - rows.count()
        if dropped:
            warnings.append(f"{dropped} candidates were outside the filter or not in the store and were dropped")
        return packing.renumbered(rows), rows.groupBy("qid").count()

    def _reranked(self, reranker: Reranker, before: DataFrame, queries: DataFrame) -> DataFrame:
        """The reranker's order and scores; all other columns stay those of the candidates."""
        name = type(reranker).__name__
        after = self._hold(reranker.rerank(before, queries).select("qid", "id", "ord", "score"))
        if after.groupBy("qid", "id").count().where("count > 1").limit(1).collect() or after.join(before, ["qid", "id"], "left_anti").limit(1).collect():
            raise ValueError(f"{name} added or repeated ids")
        if after.where(~finite(F.col("score"))).limit(1).collect():
            raise ValueError(f"{name} gave a score that isn't finite")
        return packing.renumbered(before.drop("ord", "score").join(after, ["qid", "id"]))

    def _packed(self, candidates: DataFrame, k: int, warnings: list[str]) -> DataFrame:
        if self.distinct_by is not None:
            candidates = packing.distinct_by(candidates, self.distinct_by)
        if self.max_chars is not None and k:
            candidates = self._hold(packing.within(candidates, self.max_chars))
            for r in candidates.where((F.col("ord") == 1) & (F.char_length("text") > self.max_chars)).select("qid", F.char_length("text").alias("n")).orderBy("qid").collect():
                warnings.append(f"the first hit of {r.qid} alone has {r.n} characters, over max_chars {self.max_chars}")
        return candidates
