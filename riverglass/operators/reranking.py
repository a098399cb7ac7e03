"""Rerankers of candidates (qid, ord, id, score, and text, metadata columns or vec). ord is the incoming order; ties keep it."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite, sigmoid
from ..model import whole
from .predicates import Filter, IdSet, compile_filter


class Reranker(Protocol):
    #: Of text, metadata and vector, what the candidates must carry.
    needs: frozenset[str]

    def rerank(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame: ...


def by_score(candidates: DataFrame) -> DataFrame:
    """ord anew: by score, ties in the incoming order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return candidates.withColumn("ord", F.row_number().over(order).cast("int"))


def positive(name: str, value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and above 0")
    return float(value)


class Recency:
    """score * 0.5 ** (age / half_life) of an epoch field; a time to come has age 0, a missing one the factor missing."""

    needs = frozenset({"metadata"})

    def __init__(self, field: str, *, half_life: float, missing: float = 1.0, clock: Callable[[], float] = time.time):
        self.field, self.half_life, self.missing, self.clock = field, positive("half_life", half_life), positive("missing", missing), clock

    def rerank(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        age = F.greatest(F.lit(0.0), F.lit(float(self.clock())) - F.col(self.field).cast("double"))
        factor = F.when(F.col(self.field).isNull(), F.lit(self.missing)).otherwise(F.pow(F.lit(0.5), age / self.half_life))
        return by_score(candidates.withColumn("score", F.col("score") * factor))


@dataclass(frozen=True)
class Rule:
    when: Filter
    factor: float

    def __post_init__(self):
        positive("factor", self.factor)


class Rules:
    """score times the factor of every rule whose filter is true of the metadata; unknown isn't true."""

    needs = frozenset({"metadata"})

    def __init__(self, rules: Sequence[Rule], kinds: Mapping[str, str]):
        self.factors = []
        for r in rules:
            if isinstance(r.when, IdSet):
                raise ValueError("a rule can't hold an id set")
            self.factors.append((compile_filter(r.when, kinds).column(), float(r.factor)))

    def rerank(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        score = F.col("score")
        for test, factor in self.factors:
            score = score * F.when(F.coalesce(test, F.lit(False)), F.lit(factor)).otherwise(F.lit(1.0))
        return by_score(candidates.withColumn("score", score))


class Multiply:
    """score times a column, which must be finite and above 0 for every candidate."""

    def __init__(self, factor: Column, needs: frozenset[str] = frozenset()):
        self.factor, self.needs = factor, needs

    def rerank(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        ok = finite(self.factor.cast("double")) & (self.factor > 0)
        checked = F.when(ok, self.factor.cast("double")).otherwise(F.raise_error(F.lit("a factor must be finite and above 0")).cast("double"))
        return by_score(candidates.withColumn("score", F.col("score") * checked))


def _min_max(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x)) if x.max() == x.min() else (x - x.min()) / (x.max() - x.min())


def _diverse_order(score: np.ndarray, vectors: np.ndarray, balance: float) -> list[int]:
    """Places in the order of picking: each time the best balance * relevance - (1 - balance) * nearness to what is picked."""
    relevance = _min_max(score)
    open_ = np.ones(len(score), bool)
    near, order = np.zeros(len(score)), []
    for _ in range(len(score)):
        value = np.where(open_, balance * relevance - (1 - balance) * near, -np.inf)
        pick = int(value.argmax())
        alike = vectors @ vectors[pick]
        near = alike if not order else np.maximum(near, alike)
        open_[pick] = False
        order.append(pick)
    return order


class MMR:
    """Maximal marginal relevance: candidates in an order of relevance and novelty; their scores stay.

    A query's candidates are at most as many as the search's depth, so one task holds them all.
    """

    needs = frozenset({"vector"})

    def __init__(self, balance: float = 0.5):
        if not 0 <= balance <= 1:
            raise ValueError("balance must be between 0 and 1")
        self.balance = balance

    def rerank(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        balance = self.balance
        kind = dict(candidates.dtypes)["qid"]

        def pick(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("ord")
            if group["vec"].isna().any():
                raise ValueError("MMR needs a vector of every candidate")
            m = np.array(group["vec"].tolist(), np.float64)
            size = np.sqrt((m * m).sum(1, keepdims=True))
            order = _diverse_order(group["score"].to_numpy(np.float64), m / np.where(size == 0, 1, size), balance)
            out = group[["qid", "id"]].iloc[order].copy()
            out["ord"] = np.arange(1, len(out) + 1, dtype=np.int32)
            return out

        placed = candidates.select("qid", "id", "ord", "score", "vec").groupBy("qid").applyInPandas(pick, f"qid {kind}, id bigint, ord int")
        return candidates.drop("ord").join(placed, ["qid", "id"])


class CrossEncoder:
    """The best candidates scored with their query by a model of pairs; the others are dropped.

    New score: weight * sigmoid(logit) + (1 - weight) * the min-max of the old scores. scorer takes a list of
    (query, passage) pairs and returns a logit each; a pair that occurs twice is scored once.
    """

    needs = frozenset({"text"})

    def __init__(self, scorer: Callable[[list[tuple[str, str]]], Sequence[float]], *, top: int = 30, weight: float = 1.0):
        whole("top", top, 1)
        if not 0 <= weight <= 1:
            raise ValueError("weight must be between 0 and 1")
        self.scorer, self.top, self.weight = scorer, top, float(weight)

    def logits(self, pairs: DataFrame) -> DataFrame:
        """(query, text, logit) of the distinct pairs."""
        scorer = self.scorer

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [float(x) for x in scorer(list(zip(b["query"], b["text"], strict=True)))]
                if len(got) != len(b):
                    raise ValueError(f"{len(got)} scores for {len(b)} pairs")
                yield b.assign(logit=got)

        return pairs.select("query", "text").distinct().mapInPandas(run, "query string, text string, logit double")

    def rerank(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        if queries is None:
            raise ValueError("a cross encoder needs the queries")
        kept = candidates.where(F.col("ord") <= self.top)
        text = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("a cross encoder needs text")).cast("string"))
        asked = kept.withColumn("text", text).join(queries.select("qid", "query"), "qid")
        scored = asked.join(self.logits(asked), ["query", "text"]).drop("query")
        w = Window.partitionBy("qid")
        low, high = F.min("score").over(w), F.max("score").over(w)
        old = F.when(low == high, F.lit(1.0)).otherwise((F.col("score") - low) / F.when(low != high, high - low))
        return by_score(scored.withColumn("score", self.weight * sigmoid(F.col("logit")) + (1.0 - self.weight) * old).drop("logit"))


class OnnxPairs:
    """A scorer of pairs by an ONNX cross encoder and its tokenizers file, loaded once in each worker."""

    BATCH, LENGTH = 32, 512

    def __init__(self, model: str, tokenizer: str, providers: str = "best"):
        self.model, self.tokenizer, self.providers, self.loaded = model, tokenizer, providers, None

    def __getstate__(self):
        return self.__dict__ | {"loaded": None}

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        if self.loaded is None:
            from tokenizers import Tokenizer

            from ..sources.encoders import open_session

            tok = Tokenizer.from_file(self.tokenizer)
            tok.enable_truncation(self.LENGTH)
            tok.enable_padding()
            self.loaded = open_session(self.model, self.providers), tok
        session, tok = self.loaded
        names, out = {i.name for i in session.get_inputs()}, []
        for at in range(0, len(pairs), self.BATCH):
            enc = tok.encode_batch(pairs[at : at + self.BATCH])
            feed = {"input_ids": [e.ids for e in enc], "attention_mask": [e.attention_mask for e in enc], "token_type_ids": [e.type_ids for e in enc]}
            got = session.run(None, {k: np.array(v, np.int64) for k, v in feed.items() if k in names})[0]
            out += np.asarray(got, np.float64).reshape(len(enc), -1)[:, 0].tolist()
        return out
