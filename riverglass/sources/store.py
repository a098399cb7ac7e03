"""A store of items, vectors and a keyword index in immutable generations.

root/prefix/declaration.json   fields, layout and tokenizer, fixed at creation
root/prefix/gen-N/items        id, text, keywords, keyword_override, declared fields, extra (JSON)
root/prefix/gen-N/vectors      id, vec (unit length, half precision)
root/prefix/gen-N/postings, lengths, meta.json   (an item without tokens has one posting without a term)
root/prefix/commit-N.json      created once: generation N counts from then on

A reader keeps the generation it opened; a writer that lost the race for commit-N starts anew.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import keyword_text
from ..functions.vectors import finite, normalised, packed, unpacked
from ..model import CANARY_TEXTS, KINDS, MAX_ID, MIN_ID, TOKENIZERS, Field, Health, Item, StaleKeywords, StaleVectors, VectorSpace, check_fields, typed
from ..operators import keyword, knn
from ..operators.predicates import Filter, compile_filter
from .encoders import Encoder, with_vectors
from .storage import Storage

LAYOUT = 2
_BASE = [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("keywords", T.StringType()), T.StructField("keyword_override", T.StringType())]


@dataclass(frozen=True)
class Meta:
    generation: int = 0
    space: VectorSpace | None = None
    canary: tuple[tuple[float, ...], ...] | None = None
    embedded_at: float | None = None
    keywords_stale: bool = False

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"space": self.space and self.space.__dict__}, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> Meta:
        raw = json.loads(text)
        return cls(raw["generation"], raw["space"] and VectorSpace(**raw["space"]), raw["canary"] and tuple(map(tuple, raw["canary"])), raw["embedded_at"], raw["keywords_stale"])


@dataclass(frozen=True)
class Vectors:
    """Rows (id, vec) with their space, and the canaries' vectors if the store has none yet."""

    space: VectorSpace
    rows: DataFrame
    canary: tuple[tuple[float, ...], ...] | None = None


@dataclass(frozen=True)
class Reembedding:
    generation: int
    vectors: Vectors


def _cosine(a: Sequence[float], b: Sequence[float]) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / size) if size else 0.0


class _Draft:
    """What a transaction has changed so far."""

    def __init__(self, meta: Meta, items: DataFrame, vectors: DataFrame):
        self.meta, self.items, self.vectors, self.touched = meta, items, vectors, False
        self.held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        """df, kept until the transaction ends."""
        self.held.append(df.persist())
        return df


class Store:
    """See the module. Writes need an open transaction; reads inside one see what it wrote."""

    def __init__(self, spark: SparkSession, root: str, prefix: str, fields: Sequence[Field] = (), *, encoder: Encoder | None = None, tokenizer: str = "unicode61", backend: knn.Backend = knn.exhaustive, cache: knn.IndexCache | None = None, drift_warn: float = 0.9999, drift_stale: float = 0.99, clock=time.time):
        if not re.fullmatch("[a-z][a-z0-9_]*", prefix):
            raise ValueError(f"prefix {prefix!r}")
        if tokenizer not in TOKENIZERS:
            raise ValueError(f"tokenizer must be one of {TOKENIZERS}")
        if not 0 <= drift_stale <= drift_warn <= 1:
            raise ValueError("thresholds must be 0 <= drift_stale <= drift_warn <= 1")
        self.kinds = check_fields(list(fields))
        self.spark, self.fields, self.encoder, self.tokenizer, self.backend = spark, tuple(fields), encoder, tokenizer, backend
        self.cache, self.drift_warn, self.drift_stale, self.clock = cache or knn.IndexCache(), drift_warn, drift_stale, clock
        self.path, self.storage, self.draft = f"{root.rstrip('/')}/{prefix}", Storage(spark), None
        self.schema = T.StructType([*_BASE, *(T.StructField(f.name, KINDS[f.kind]) for f in fields), T.StructField("extra", T.StringType())])
        declaration = json.dumps({"layout": LAYOUT, "fields": [[f.name, f.kind, f.indexed] for f in fields], "tokenizer": tokenizer})
        if not self.storage.create(f"{self.path}/declaration.json", declaration) and self.storage.read(f"{self.path}/declaration.json") != declaration:
            raise ValueError(f"{self.path} was created with another declaration")
        self.refresh()

    # -- generations ------------------------------------------------------------------

    def refresh(self) -> None:
        """Opens the latest generation."""
        done = [int(m[1]) for n in self.storage.names(self.path) if (m := re.fullmatch(r"commit-(\d+)\.json", n))]
        if done:
            folder = json.loads(self.storage.read(f"{self.path}/commit-{max(done)}.json"))["folder"]
            self.meta = Meta.from_json(self.storage.read(f"{self.path}/{folder}/meta.json"))
            self.folder = f"{self.path}/{folder}"
        else:
            self.meta, self.folder = Meta(), None
        self.cache.clear()

    def _table(self, name: str, schema: str | T.StructType) -> DataFrame:
        if self.folder is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def now(self) -> Meta:
        return self.draft.meta if self.draft else self.meta

    @property
    def items(self) -> DataFrame:
        return self.draft.items if self.draft else self._table("items", self.schema)

    @property
    def vectors(self) -> DataFrame:
        """(id, vec)"""
        return self.draft.vectors if self.draft else self._table("vectors", "id bigint, vec binary").select("id", unpacked("vec").alias("vec"))

    @property
    def space(self) -> VectorSpace | None:
        return self.now.space

    @property
    def keywords_stale(self) -> bool:
        return self.now.keywords_stale

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Store]:
        """Writes inside count all or not at all; an exception takes them back."""
        if self.draft:
            raise RuntimeError("a transaction is open")
        self.draft = _Draft(self.meta, self.items, self.vectors)
        draft = self.draft
        try:
            try:
                yield self
            finally:
                self.draft = None
            if draft.touched:
                self._commit(draft)
        finally:
            for df in draft.held:
                df.unpersist()

    def _commit(self, draft: _Draft) -> None:
        n = self.meta.generation + 1
        folder = f"gen-{n}-{uuid.uuid4().hex[:12]}"
        at, meta = f"{self.path}/{folder}", replace(draft.meta, generation=n)
        order = [f.name for f in self.fields if f.indexed]
        items = draft.items.select(*self.schema.fieldNames())
        (items.sortWithinPartitions(*order) if order else items).write.parquet(f"{at}/items")
        draft.vectors.select("id", packed("vec").alias("vec")).write.parquet(f"{at}/vectors")
        if not meta.keywords_stale:
            rows = self.spark.read.schema(self.schema).parquet(f"{at}/items")
            keyword.posted(self._keyword_rows(rows), self.tokenizer).write.parquet(f"{at}/postings")
            self.spark.read.schema("id bigint, dl int").parquet(f"{at}/postings").distinct().write.parquet(f"{at}/lengths")
        self.storage.create(f"{at}/meta.json", meta.to_json())
        if not self.storage.create(f"{self.path}/commit-{n}.json", json.dumps({"folder": folder})):
            self.storage.delete(at)
            raise RuntimeError(f"generation {n} was written by another writer")
        self.refresh()

    def _draft(self) -> _Draft:
        if not self.draft:
            raise RuntimeError("writes need an open transaction")
        return self.draft

    @staticmethod
    def _keyword_rows(items: DataFrame) -> DataFrame:
        return items.select("id", keyword_text(F.col("text"), F.col("keywords"), F.col("keyword_override")).alias("text"))

    def _check_space(self) -> None:
        if self.encoder and self.space and self.encoder.space != self.space:
            raise ValueError(f"the encoder's space {self.encoder.space} isn't the store's {self.space}")

    # -- writes -----------------------------------------------------------------------

    def _rows(self, items: DataFrame | Iterable[Item]) -> DataFrame:
        """Items as rows of the schema, one for each id: of several in a batch the last counts."""
        rows = self._typed(items)
        return self._last(rows) if isinstance(items, DataFrame) else rows

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        names = rows.columns
        last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in names)), "__at").alias("__row")
        return rows.withColumn("__at", F.monotonically_increasing_id()).groupBy(F.col("id").alias("__id")).agg(last).select("__row.*").select(*(f"`{c}`" for c in names))

    def _typed(self, items: DataFrame | Iterable[Item]) -> DataFrame:
        if isinstance(items, DataFrame):
            missing = {"id", "text"} - set(items.columns)
            if missing:
                raise ValueError(f"items lack {sorted(missing)}")
            return items.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in items.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        made = {item.id: self._row(item) for item in items}
        return self.spark.createDataFrame(list(made.values()), self.schema)

    def _row(self, item: Item) -> tuple:
        if type(item.id) is not int or not MIN_ID <= item.id <= MAX_ID:
            raise ValueError(f"id {item.id!r}")
        for name in ("text", "keyword_text", "keywords"):
            value = getattr(item, name)
            if type(value) is not str and (name == "text" or value is not None):
                raise TypeError(f"{name} of {item.id} must be a string")
        if any(type(k) is not str for k in item.metadata):
            raise TypeError("metadata keys must be strings")
        known = [None if item.metadata.get(f.name) is None else typed(f.kind, f.name, item.metadata[f.name], ValueError) for f in self.fields]
        rest = {k: v for k, v in item.metadata.items() if k not in self.kinds}
        return (item.id, item.text, item.keywords, item.keyword_text, *known, json.dumps(rest, sort_keys=True, allow_nan=False) if rest else None)

    def _canary(self) -> tuple[tuple[float, ...], ...]:
        return tuple(tuple(map(float, self.encoder.encode([t])[0])) for t in CANARY_TEXTS)

    def embed(self, items: DataFrame | Iterable[Item]) -> Vectors:
        """The items' vectors; no table is touched."""
        if self.encoder is None:
            raise RuntimeError("the store has no encoder")
        self._check_space()
        rows = with_vectors(self._rows(items).select("id", "text"), self.encoder).select("id", "vec")
        return Vectors(self.encoder.space, rows, None if self.space else self._canary())

    def _checked(self, vectors: Vectors, ids: DataFrame) -> DataFrame:
        """Unit vectors of exactly these ids; raises before anything is written."""
        space = self.space or (self.encoder.space if self.encoder else vectors.space)
        if vectors.space != space:
            raise ValueError(f"vectors of space {vectors.space}, not {space}")
        if vectors.canary is not None and len(vectors.canary) != len(CANARY_TEXTS):
            raise ValueError(f"{len(vectors.canary)} canary vectors for {len(CANARY_TEXTS)} texts")
        rows = vectors.rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        bad = F.size("vec") != vectors.space.dims if vectors.space.dims else F.size("vec") == 0
        wrong = rows.where(F.col("vec").isNull() | bad | F.exists("vec", lambda x: ~finite(x)))
        if found := wrong.limit(1).collect():
            raise ValueError(f"the vector of {found[0].id} has another width than {vectors.space.dims} or a number that isn't finite")
        if ids.join(rows, "id", "left_anti").limit(1).collect() or rows.join(ids, "id", "left_anti").limit(1).collect():
            raise ValueError("vectors and items must have the same ids")
        return rows.dropDuplicates(["id"]).select("id", normalised("vec").cast("array<float>").alias("vec"))

    def _bump(self, draft: _Draft, items: DataFrame, vectors: DataFrame, vectors_of: Vectors | None) -> None:
        items, vectors = draft.hold(items), draft.hold(vectors)
        meta = draft.meta
        if vectors.isEmpty():
            meta = replace(meta, space=None, canary=None, embedded_at=None)
        elif vectors_of is not None and meta.space is None:
            meta = replace(meta, space=vectors_of.space, canary=vectors_of.canary, embedded_at=self.clock())
        draft.items, draft.vectors, draft.meta, draft.touched = items, vectors, meta, True

    def upsert(self, items: DataFrame | Iterable[Item], vectors: Vectors | None = None) -> None:
        """Inserts or replaces by id. Without vectors the items' old ones go. An empty batch changes nothing."""
        draft = self._draft()
        self._check_space()
        rows = draft.hold(self._typed(items))
        if rows.groupBy("id").count().where("count > 1").limit(1).collect():  # else no row has to move
            rows = draft.hold(self._last(rows))
        if rows.where("id is null or text is null").limit(1).collect():
            raise ValueError("items need an id and a text")
        if rows.isEmpty():
            return
        if vectors is None and self.encoder is not None:
            raise ValueError("a store with an encoder needs vectors")
        new = self._checked(vectors, rows.select("id")) if vectors is not None else None
        kept = draft.vectors.join(rows.select("id"), "id", "left_anti")
        self._bump(draft, draft.items.join(rows.select("id"), "id", "left_anti").unionByName(rows), kept if new is None else kept.unionByName(new), vectors)

    def add_vectors(self, vectors: Vectors) -> None:
        """Vectors for items that are there."""
        draft = self._draft()
        self._check_space()
        unknown = [r.id for r in vectors.rows.join(draft.items, "id", "left_anti").select("id").distinct().orderBy("id").limit(5).collect()]
        if unknown:
            raise ValueError(f"no items {unknown}")
        new = self._checked(vectors, vectors.rows.select("id").distinct())
        self._bump(draft, draft.items, draft.vectors.join(new.select("id"), "id", "left_anti").unionByName(new), vectors)

    def missing_vectors(self) -> DataFrame:
        """Ids of items without a vector, in order."""
        return self.items.join(self.vectors, "id", "left_anti").select("id").orderBy("id")

    def remove(self, ids: DataFrame | Iterable[int]) -> None:
        draft = self._draft()
        gone = ids.toDF("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        self._bump(draft, draft.items.join(gone, "id", "left_anti"), draft.vectors.join(gone, "id", "left_anti"), None)

    def clear(self) -> None:
        draft = self._draft()
        self._bump(draft, self.spark.createDataFrame([], self.schema), self.spark.createDataFrame([], "id bigint, vec array<float>"), None)

    def defer_keywords(self) -> None:
        """Leaves the keyword index as it is until sync_keywords()."""
        draft = self._draft()
        draft.meta, draft.touched = replace(draft.meta, keywords_stale=True), True

    def sync_keywords(self) -> None:
        draft = self._draft()
        draft.meta, draft.touched = replace(draft.meta, keywords_stale=False), True

    def prepare_reembed(self) -> Reembedding:
        """New vectors of all items by the encoder there is now; nothing is written."""
        if self.encoder is None:
            raise RuntimeError("the store has no encoder")
        rows = with_vectors(self.items.select("id", "text"), self.encoder).select("id", "vec")
        return Reembedding(self.meta.generation, Vectors(self.encoder.space, rows, self._canary()))

    def apply_reembed(self, plan: Reembedding) -> None:
        """Replaces all vectors; refuses a plan of another generation or without some item."""
        draft = self._draft()
        if plan.generation != self.meta.generation or draft.touched:
            raise RuntimeError("the store has changed since the plan was made")
        rows = plan.vectors.rows
        if draft.items.join(rows, "id", "left_anti").limit(1).collect() or rows.join(draft.items, "id", "left_anti").limit(1).collect():
            raise RuntimeError("the plan doesn't hold every item")
        draft.meta = replace(draft.meta, space=None, canary=None, embedded_at=None)
        held, self.draft.vectors = draft.vectors, draft.vectors.limit(0)
        try:
            new = self._checked(plan.vectors, draft.items.select("id"))
        finally:
            self.draft.vectors = held
        self._bump(draft, draft.items, new, plan.vectors)

    # -- health -----------------------------------------------------------------------

    def _state(self, canary: Sequence[Sequence[float]] | None) -> Health:
        meta = self.now
        if meta.space is None:
            return Health("empty")
        if canary is None or meta.canary is None:
            return Health("unchecked", None, meta.embedded_at)
        least = min(_cosine(a, b) for a, b in zip(canary, meta.canary, strict=True))
        state = "ok" if least >= self.drift_warn else "drifted" if least >= self.drift_stale else "stale"
        return Health(state, least, meta.embedded_at)

    def health(self) -> Health:
        """How near the encoder's vectors of the canary texts are to those kept."""
        self._check_space()
        return self._state(self._canary() if self.encoder and self.now.canary else None)

    # -- reads ------------------------------------------------------------------------

    def select_ids(self, flt: Filter | None = None) -> DataFrame:
        return compile_filter(flt, self.kinds).apply(self.items).select("id")

    def fetch(self, ids: DataFrame, fields: Iterable[str] = ("text", "metadata")) -> DataFrame:
        """The items of these ids with what is asked for of text, metadata (declared fields and extra) and vector."""
        wanted = set(fields)
        unknown = wanted - {"text", "metadata", "vector"}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        columns = ["id", *(["text"] if "text" in wanted else []), *([*self.kinds, "extra"] if "metadata" in wanted else [])]
        out = self.items.select(*columns).join(ids.select("id").distinct(), "id", "left_semi")
        return out.join(self.vectors, "id", "left") if "vector" in wanted else out

    def index(self) -> keyword.Index:
        if self.keywords_stale:
            raise StaleKeywords("keywords were deferred; call sync_keywords()")
        if self.draft or self.folder is None:
            return keyword.build_index(self._keyword_rows(self.items), self.tokenizer)
        postings = self._table("postings", "term string, id bigint, dl int, tf bigint, positions array<int>")
        return keyword.Index(postings.where("term is not null"), self._table("lengths", "id bigint, dl int"), self.tokenizer)

    def search_keyword(self, queries: DataFrame, k: int, flt: Filter | None = None) -> DataFrame:
        """Ranked lists of (qid, query) by BM25."""
        self._check_space()
        index, compiled = self.index(), compile_filter(flt, self.kinds)
        return keyword.search(queries, index, max(k, 0), None if flt is None else compiled.apply(self.items).select("id"))

    def search_vector(self, queries: DataFrame, k: int, flt: Filter | None = None, warnings: list[str] | None = None) -> DataFrame:
        """Ranked lists of (qid, query) by cosine; raw is the score. Stale vectors raise, drifted ones warn."""
        if self.encoder is None:
            raise RuntimeError("the store has no encoder")
        self._check_space()
        compiled = compile_filter(flt, self.kinds)
        empty = self.spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, source string, rank int, id bigint, score double, raw double")
        if self.space is None:
            return empty
        with ThreadPoolExecutor(2) as pool:  # the canaries and the queries at once
            canary = pool.submit(self._canary) if self.now.canary else None
            asked = with_vectors(queries, self.encoder, "query", query=True).select("qid", "vec").persist()
            asked.count()
            health = self._state(canary and canary.result())
        if health.state == "stale":
            raise StaleVectors(f"canary cosine {health.similarity:.6f} is below {self.drift_stale}")
        if health.state == "drifted" and warnings is not None:
            warnings.append(f"the encoder has drifted: canary cosine {health.similarity:.6f}")
        if k <= 0:
            return empty
        knn.check_width(self.vectors.limit(1), asked)
        found = self.backend(self._filtered(flt, compiled), asked, k)
        return found.select("qid", F.lit("vector").alias("source"), "rank", "id", "score", F.col("score").alias("raw"))

    def _filtered(self, flt: Filter | None, compiled) -> DataFrame:
        def make() -> DataFrame:
            return self.vectors if flt is None else self.vectors.join(compiled.apply(self.items).select("id"), "id", "left_semi")

        if self.draft or not compiled.cacheable:
            return make()
        size = lambda df: df.count() * (4 * (self.space.dims or 64) + 8)
        return self.cache.get((self.path, repr(flt), self.meta.generation), make, size)

