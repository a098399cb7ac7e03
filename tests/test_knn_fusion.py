from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.functions.vectors import cosine, normalised, pack, sigmoid, unpack
from riverglass.operators import fusion, knn


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"{name} bigint, vec array<float>")


def test_exact_ranking(spark):
    v = frame(spark, [(1, [0, 1]), (2, [1, 0]), (3, [1, 1]), (4, [-1, 0]), (5, None), (6, [0, 0])])
    q = frame(spark, [(0, [1, 0])], "qid")
    got = [(r.id, round(r.score, 6)) for r in sorted(knn.exhaustive(v, q, 9).collect(), key=lambda r: r.rank)]
    assert got == [(2, 1.0), (3, 0.707107), (1, 0.0), (6, 0.0), (4, -1.0)]
    assert [r.id for r in knn.exhaustive_one(v, [2.0, 0.0], 3).orderBy("rank").collect()] == [2, 3, 1]
    assert knn.exhaustive(v, q, 0).count() == 0


def test_ties_go_by_id(spark):
    ids = np.random.default_rng(0).permutation(1000)[:70].tolist()
    got = knn.exhaustive(frame(spark, [(i, [3, 4]) for i in ids]).repartition(3), frame(spark, [(0, [1, 1])], "qid"), 5)
    assert [r.id for r in got.orderBy("rank").collect()] == sorted(ids)[:5]


def test_widths(spark):
    with pytest.raises(ValueError, match="widths"):
        knn.check_width(frame(spark, [(1, [1, 2])]), frame(spark, [(0, [1, 2, 3])], "qid"))


@pytest.mark.parametrize("backend", [knn.InvertedLists(), knn.Hyperplanes()])
def test_recall(spark, backend):
    rng = np.random.default_rng(3)
    data, asked = rng.normal(size=(2000, 32)), rng.normal(size=(50, 32))
    v, q = frame(spark, list(enumerate(data.tolist()))), frame(spark, list(enumerate(asked.tolist())), "qid")
    near = lambda df: {(r.qid, r.id) for r in df.collect()}
    exact = near(knn.exhaustive(v, q, 10))
    assert len(exact & near(backend(v, q, 10))) / len(exact) >= 0.95


def test_codec(spark):
    rng = np.random.default_rng(1)
    for v in rng.normal(size=(50, 16)):
        back = unpack([pack(v)], 16)[0]
        assert len(pack(v)) == 32 and np.allclose(back, v / np.linalg.norm(v), atol=1e-3)
    assert unpack([pack([0.0, 0.0])]).tolist() == [[0.0, 0.0]]
    for bad in ([], [[1.0]], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            pack(bad)
    with pytest.raises(ValueError):
        unpack([b"12", b"1234"])


def test_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(normalised("a"), normalised("b"), cosine("a", "b"), cosine("a", "a"), sigmoid(F.lit(-800.0)), sigmoid(F.lit(800.0)), sigmoid(F.lit(0.0))).first()
    assert list(row[0]) == [0.6, 0.8] and list(row[1]) == [0.0, 0.0] and row[2] == 0.0 and row[3] == pytest.approx(1.0) and (row[4], row[5], row[6]) == (0.0, 1.0, 0.5)


def lists(spark, *each):
    out = []
    for name, rows in each:
        out.append(spark.createDataFrame([("q", name, n, i, float(s), float(s)) for n, (i, s) in enumerate(rows, 1)], "qid string, source string, rank int, id bigint, score double, raw double"))
    return fusion.stacked(out)


def told(df):
    return [(r.id, round(r.score, 6)) for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    x = lists(spark, ("a", [(1, 9), (2, 5)]), ("b", [(2, 3), (3, 1)]))
    assert told(fusion.rrf(x)) == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]
    assert told(fusion.rrf(x, weights={"b": 0})) == [(1, round(1 / 61, 6)), (2, round(1 / 62, 6))]
    for bad in (-1, float("nan"), True):
        with pytest.raises(ValueError):
            fusion.rrf(x, weights={"a": bad})
    with pytest.raises(ValueError):
        fusion.rrf(x, k=-1)


@pytest.mark.parametrize(("how", "alone", "equal", "spread"), [("min-max", 1.0, 1.0, [1.0, 0.0]), ("max", 1.0, 1.0, [1.0, 0.25]), ("sum", 1.0, 0.5, [0.8, 0.2]), ("z-score", 0.0, 0.0, [1.0, -1.0])])
def test_normalisations(spark, how, alone, equal, spread):
    value = lambda *rows: [s for _, s in told(fusion.blend(lists(spark, ("a", rows)), normalise_by=how))]
    assert value((1, 7)) == [alone]
    assert value((1, 7), (2, 7)) == [equal, equal]
    assert value((1, 4), (2, 1)) == spread
    assert value((1, 0), (2, 0)) == ([1.0, 1.0] if how == "min-max" else [0.0, 0.0])
    assert all(abs(s) < 10 for s in value((1, 1e308), (2, -1e308)))


def test_first_and_evidence(spark):
    x = lists(spark, ("a", []), ("b", [(3, 2), (1, 1)]), ("c", [(1, 8)]))
    assert told(fusion.first(x)) == [(3, 2.0), (1, 1.0)]
    e = {r.id: [(s.source, s.rank) for s in r.evidence] for r in fusion.with_evidence(fusion.rrf(x, weights={"c": 0}), x).collect()}
    assert e == {3: [("b", 1)], 1: [("b", 2), ("c", 1)]}


def test_checks(spark):
    good = lists(spark, ("a", [(1, 2), (2, 2), (3, 1)]))
    fusion.check_lists(good)
    for rows in ([(1, 1), (2, 2)], [(2, 1), (1, 1)], [(1, 2), (1, 1)], [(1, float("inf"))]):
        with pytest.raises(ValueError):
            fusion.check_lists(lists(spark, ("a", rows)))
    with pytest.raises(ValueError, match="unique"):
        fusion.check_lists(lists(spark, ("a", [(1, 1)]), ("a", [(1, 1)])))
    with pytest.raises(ValueError, match="no list"):
        fusion.check_fused(spark.createDataFrame([("q", 1, 9, 1.0)], "qid string, rank int, id bigint, score double"), good)


def test_cache(spark):
    cache, made = knn.IndexCache(entries=2, most_bytes=100), []

    def make():
        made.append(1)
        return spark.range(1)

    for key, size in ((1, 10), (1, 10), (2, 10), (3, 10), (1, 10), (9, 1000), (9, 1000)):
        cache.get((key,), make, lambda df, size=size: size)
    assert len(made) == 6 and [k for (k,) in cache.held] == [3, 1]


def test_best_of_blocks_with_ties():
    import numpy as np

    from riverglass.operators import knn

    rng = np.random.default_rng(2)
    for k in (1, 3, 7):
        ids, scores = np.zeros((5, k), np.int64), np.full((5, k), -np.inf)
        all_ids, all_scores = np.zeros(0, np.int64), np.zeros((5, 0))
        for n in (2, 1, 50, 4, 30):
            more, block = rng.permutation(1000)[:n] + 1000 * len(all_ids), np.round(rng.normal(size=(5, n)), 1)
            ids, scores = knn._kept(ids, scores, more, block, k)
            all_ids, all_scores = np.concatenate((all_ids, more)), np.concatenate((all_scores, block), 1)
        for q in range(5):
            want = sorted(zip(-all_scores[q], all_ids, strict=True))[:k]
            assert [(-s, i) for s, i in zip(scores[q], ids[q], strict=True)] == [(float(s), i) for s, i in want]
