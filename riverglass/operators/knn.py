"""Nearest neighbours by cosine: exact, by inverted lists, and by random hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalised
from .best import Best

#: Queries that go to the workers at once, as one matrix.
QUERY_BLOCK = 2048
#: Vectors of a task that are scored first, pairs that are looked at at once, and how far a matrix product may be from its sum from the left.
FIRST_ROWS, PAIRS, SLACK = 256, 1 << 18, 1e-9
#: Vectors that an approximate index is fitted on at most.
FIT_SAMPLE = 20_000

#: (vectors (id, vec), queries (qid, vec), k) -> (qid, rank, id, score)
Backend = Callable[[DataFrame, DataFrame, int], DataFrame]


def unit_rows(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    size = np.sqrt((m * m).sum(1, keepdims=True)) if m.size else m
    return m / np.where(size == 0, 1, size) if m.size else m


def check_width(vectors: DataFrame, queries: DataFrame) -> None:
    """Raises if the vectors and queries haven't one width. One pass over sizes."""
    sizes = lambda df: {r[0] for r in df.select(F.size("vec")).distinct().limit(3).collect()}
    found = sizes(queries.where("vec is not null")) | sizes(vectors.where("vec is not null"))
    if len(found) > 1:
        raise ValueError(f"vectors of widths {sorted(found)}")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of QUERY_BLOCK, one block on the driver at a time."""
    rows: list = []
    for r in queries.select("qid", "vec").where("vec is not null").orderBy("qid").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            yield [x.qid for x in rows], unit_rows([x.vec for x in rows])
            rows = []
    if rows:
        yield [x.qid for x in rows], unit_rows([x.vec for x in rows])


def _kept(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each query by (score desc, id), of those kept (a row of ids for each query) and a block of more vectors."""
    both = np.concatenate((scores, more), 1)
    cut = np.partition(both, both.shape[1] - k, 1)[:, both.shape[1] - k]
    row, col = np.nonzero(both >= cut[:, None])  # k of each row, and what ties with the last of them
    found, own = both[row, col], col < k
    names = np.where(own, ids[row, np.minimum(col, k - 1)], more_ids[np.maximum(col - k, 0)])
    order = np.lexsort((names, -found, row))
    starts = np.searchsorted(row, np.arange(len(both)))
    best = order[(starts[:, None] + np.arange(k)).ravel()]
    return names[best].reshape(-1, k), found[best].reshape(-1, k)


def exhaustive(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact: each block of queries against every vector; tasks keep k for each query, then these meet.

    Rows without a vector are left out; a zero vector has cosine 0 with all. k <= 0 gives no rows.
    """
    kind = dict(queries.dtypes)["qid"]
    schema = f"qid {kind}, id bigint, score double"
    out = None
    for qids, matrix in _blocks(queries) if k > 0 else ():
        found = vectors.select(F.col("id").cast("bigint").alias("id"), "vec").where("vec is not null").mapInArrow(_against(qids, matrix, k), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema)
    return ranked(out, k)


def _against(qids: list, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(qids), k), np.int64), np.full((len(qids), k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                rows = unit_rows(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1))
                if rows.shape[1] != matrix.shape[1]:
                    raise ValueError(f"vectors of width {rows.shape[1]}, queries of {matrix.shape[1]}")
                ids, scores = _kept(ids, scores, b.column(0).to_numpy(), matrix @ rows.T, k)
        query, place = np.nonzero(scores > -np.inf)
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array([qids[q] for q in query.tolist()]), pa.array(ids[query, place]), pa.array(scores[query, place])], ["qid", "id", "score"])

    return run


def _among(vectors: DataFrame, queries: DataFrame, k: int, index) -> DataFrame:
    """The best k of each query among the vectors that the index lets it meet: as exhaustive(), each task keeps k for each query."""
    kind = dict(queries.dtypes)["qid"]
    schema, out = f"qid {kind}, id bigint, score double", None
    for qids, matrix in _blocks(queries):
        found = vectors.select(F.col("id").cast("bigint").alias("id"), "vec").where("vec is not null").mapInArrow(_meeting(qids, matrix, k, index), schema)
        out = found if out is None else out.unionByName(found)
    return ranked(queries.sparkSession.createDataFrame([], schema) if out is None else out, k)


def _meeting(qids: list, matrix: np.ndarray, k: int, index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, asked, width = Best(len(qids), k), index.asked(matrix), FIRST_ROWS
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                b = batch.slice(at, width)
                at, width = at + width, 4096
                rows = unit_rows(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1))
                if rows.shape[1] != matrix.shape[1]:
                    raise ValueError(f"vectors of width {rows.shape[1]}, queries of {matrix.shape[1]}")
                ids, held = b.column(0).to_numpy(), index.held(rows)
                query, row = np.nonzero(matrix @ rows.T >= (best.cut - SLACK)[:, None])
                for n in range(0, len(query), PAIRS):
                    q, r = query[n : n + PAIRS], row[n : n + PAIRS]
                    met = index.met(asked, held, q, r)
                    q, r = q[met], r[met]
                    scores = _dots(matrix, rows, q, r)
                    own = scores >= best.cut[q]
                    best.add(q[own], ids[r[own]], scores[own])
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array([qids[q] for q in best.query.tolist()]), pa.array(best.ids), pa.array(best.scores)], ["qid", "id", "score"])

    return run


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows a[i] and b[j], summed from the left: equal rows give equal scores, whatever block they are in."""
    out = np.zeros(len(i))
    for n in range(a.shape[1]):
        out += a[i, n] * b[j, n]
    return out


def exhaustive_one(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(rank, id, score) for one query as a plan of expressions: a projection and a top-k."""
    unit = F.array(*[F.lit(float(x)) for x in unit_rows([query])[0]])
    scored = vectors.where("vec is not null").select("id", dot(normalised("vec"), unit).alias("score")).orderBy(F.desc("score"), "id").limit(max(k, 0))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("int")).select("rank", "id", "score")


def _sample(vectors: DataFrame, most: int) -> np.ndarray:
    rows = vectors.where("vec is not null").select("vec").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return unit_rows([r.vec for r in rows])


class InvertedLists:
    """Approximate: vectors are dealt to the nearest of some centres; a query reads the lists of its nearest probes, exactly.

    The centres are fitted by a few rounds of spherical k-means on at most FIT_SAMPLE vectors; every vector is
    listed, by the task that reads it. probes trades time for recall; all lists give the exact answer.
    """

    def __init__(self, lists: int | None = None, probes: int | None = None, rounds: int = 8, seed: int = 11):
        self.lists, self.probes, self.rounds, self.seed = lists, probes, rounds, seed

    def fit(self, vectors: DataFrame) -> np.ndarray:
        sample = _sample(vectors, FIT_SAMPLE)
        if not len(sample):
            return sample
        n = min(self.lists or max(1, math.isqrt(len(sample))), len(sample))
        rng = np.random.default_rng(self.seed)
        centres = sample[rng.choice(len(sample), n, replace=False)]
        for _ in range(self.rounds):
            near = (sample @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, sample)
            centres = np.where(np.bincount(near, minlength=n)[:, None] > 0, unit_rows(sums), centres)
        return centres

    def __call__(self, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        centres = self.fit(vectors)
        if not len(centres) or k <= 0:
            return exhaustive(vectors, queries, k)
        return _among(vectors, queries, k, _Probed(centres, min(self.probes or -(-len(centres) * 3 // 4), len(centres))))


class _Probed:
    """Whether a vector is in one of a query's lists."""

    def __init__(self, centres: np.ndarray, probes: int):
        self.centres, self.probes = centres, probes

    def asked(self, m: np.ndarray) -> np.ndarray:
        out, near = np.zeros((len(m), len(self.centres)), bool), np.argsort(-(m @ self.centres.T), 1, kind="stable")[:, : self.probes]
        out[np.arange(len(m))[:, None], near] = True
        return out

    def held(self, m: np.ndarray) -> np.ndarray:
        return (m @ self.centres.T).argmax(1)

    def met(self, asked: np.ndarray, held: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        return asked[query, held[row]]


class Hyperplanes:
    """Approximate: signs against random hyperplanes make a code for each of some tables; a query meets vectors with a code near its own, exactly.

    Nearness counts the planes in which codes differ, at most flips. More tables or flips trade time for recall.
    """

    def __init__(self, tables: int = 12, planes: int = 8, flips: int = 2, seed: int = 5):
        self.tables, self.planes, self.flips, self.seed = tables, planes, flips, seed

    def _codes(self, m: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        normals = rng.normal(size=(m.shape[1], self.tables * self.planes))
        bits = ((m @ normals) > 0).reshape(len(m), self.tables, self.planes)
        return (bits << np.arange(self.planes)).sum(2) + (np.arange(self.tables) << self.planes)

    asked = held = _codes

    def met(self, asked: np.ndarray, held: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether a query's and a vector's codes are near in one of the tables."""
        return (np.bitwise_count(asked[query] ^ held[row]) <= self.flips).any(1)

    def __call__(self, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return _among(vectors, queries, k, self) if k > 0 else exhaustive(vectors, queries, k)


class IndexCache:
    """Filtered vectors kept by (store, filter, generation): the least recently used go beyond so many entries or bytes."""

    def __init__(self, entries: int = 8, most_bytes: int = 256 << 20):
        self.entries, self.most_bytes, self.held = entries, most_bytes, {}

    def get(self, key: tuple, make: Callable[[], DataFrame], size: Callable[[DataFrame], int]) -> DataFrame:
        if key in self.held:
            self.held[key] = self.held.pop(key)
            return self.held[key][0]
        df, n = make(), 0
        if self.entries and (n := size(df)) <= self.most_bytes:
            self.held[key] = (df.persist(), n)
            while len(self.held) > self.entries or sum(b for _, b in self.held.values()) > self.most_bytes:
                self.held.pop(next(iter(self.held)))[0].unpersist()
        return df

    def clear(self) -> None:
        for df, _ in self.held.values():
            df.unpersist()
        self.held.clear()
