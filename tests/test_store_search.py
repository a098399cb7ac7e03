from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.model import CANARY_TEXTS, Field, Item, StaleKeywords, StaleVectors, VectorSpace
from riverglass.operators import fusion
from riverglass.operators.predicates import IdSet, eq, gt, ne
from riverglass.operators.reranking import MMR, CrossEncoder, Multiply, Recency, Rule, Rules
from riverglass.plans.search import KeywordSource, Search, VectorSource
from riverglass.sources.encoders import Encoder, HashEncoder
from riverglass.sources.store import Store, Vectors

FIELDS = [Field("account", "text", indexed=True), Field("at", "int"), Field("done", "bool")]


class Table(Encoder):
    """Vectors by text, so that geometry is exact; a turn moves all of them."""

    name = backend = "table"
    dims = 2

    def __init__(self, turn: float = 0.0):
        super().__init__("", "")
        self.turn = turn

    def vectors(self, texts):
        places = {"east": (1, 0), "north": (0, 1), "north east": (1, 1), "west": (-1, 0), "same": (0.5, 0.5)}
        c, s = np.cos(self.turn), np.sin(self.turn)
        return [[float(x * c - y * s), float(x * s + y * c)] for x, y in (places.get(t, (1, 0.1)) for t in texts)]


ITEMS = [
    Item(1, "north", {"account": "work", "at": 10, "done": True, "more": [1, "x"]}),
    Item(2, "east", {"account": "home", "at": 20, "done": False}),
    Item(3, "north east", {"at": 30}),
    Item(4, "west", {"account": "work", "at": 40}, keywords="sunset"),
]


def filled(spark, path, encoder=None, **more):
    store = Store(spark, f"file://{path}", "s", FIELDS, encoder=encoder, **more)
    with store.transaction():
        store.upsert(ITEMS, store.embed(ITEMS) if encoder else None)
    return store


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid bigint, query string")


def ids(df):
    return [r.id for r in df.orderBy("qid", "rank").collect()]


def test_write_read_and_reopen(spark, tmp_path):
    store = filled(spark, tmp_path)
    row = store.fetch(spark.createDataFrame([(1,), (99,)], "id bigint"), ("text", "metadata")).first()
    assert (row.id, row.text, row.account, row["at"], row.done, row.extra) == (1, "north", "work", 10, True, '{"more": [1, "x"]}')
    assert store.meta.generation == 1 and store.space is None and store.health().state == "empty"
    again = Store(spark, f"file://{tmp_path}", "s", FIELDS)
    assert again.items.count() == 4 and ids(again.search_keyword(asked(spark, "sunset"), 5)) == [4]
    for bad in ({"fields": FIELDS[:2]}, {"fields": FIELDS, "tokenizer": "porter"}):
        with pytest.raises(ValueError, match="declaration"):
            Store(spark, f"file://{tmp_path}", "s", bad.pop("fields"), **bad)
    with pytest.raises(ValueError, match="unknown"):
        store.fetch(spark.range(1), ("colour",))


def test_transactions(spark, tmp_path):
    store = filled(spark, tmp_path)
    with pytest.raises(RuntimeError, match="transaction"):
        store.upsert(ITEMS)
    with pytest.raises(KeyError), store.transaction():
        store.remove([1, 2])
        assert store.items.count() == 2
        raise KeyError
    assert store.items.count() == 4 and store.meta.generation == 1
    with store.transaction():
        store.upsert([Item(1, "new"), Item(1, "newer"), Item(5, "five")])
        store.upsert([])
    assert {r.id: r.text for r in store.items.collect()} == {1: "newer", 2: "east", 3: "north east", 4: "west", 5: "five"}
    with store.transaction():
        pass
    assert store.meta.generation == 2
    other = Store(spark, f"file://{tmp_path}", "s", FIELDS)
    with other.transaction():
        other.clear()
    with pytest.raises(RuntimeError, match="another writer"), store.transaction():
        store.remove([1])
    store.refresh()
    assert store.items.count() == 0


@pytest.mark.parametrize("item", [Item("1", "x"), Item(2**63, "x"), Item(1, None), Item(1, "x", {"at": "soon"}), Item(1, "x", {"more": float("nan")}), Item(1, "x", {1: 2})])
def test_bad_items(spark, tmp_path, item):
    store = filled(spark, tmp_path)
    with pytest.raises((TypeError, ValueError)), store.transaction():
        store.upsert([Item(7, "fine"), item])
    assert store.items.count() == 4


def test_vectors(spark, tmp_path):
    store = filled(spark, tmp_path, Table())
    assert store.space == Table().space and len(store.meta.canary) == len(CANARY_TEXTS)
    assert ids(store.search_vector(asked(spark, "east"), 4)) == [2, 3, 1, 4]
    assert ids(store.search_vector(asked(spark, "east"), 4, ne("account", "home"))) == [3, 1, 4]
    assert ids(store.search_vector(asked(spark, "east"), 4, eq("account", "work"))) == [1, 4]
    assert store.search_vector(asked(spark, "east"), 0).count() == 0
    with pytest.raises(ValueError, match="needs vectors"), store.transaction():
        store.upsert([Item(9, "x")])
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, vec array<double>")
    for bad in (Vectors(VectorSpace("other", "x", dims=2), rows((9, [1.0, 0.0]))), Vectors(store.space, rows((8, [1.0, 0.0]))), Vectors(store.space, rows((9, [1.0]))), Vectors(store.space, rows((9, [1.0, float("nan")])))):
        with pytest.raises(ValueError), store.transaction():
            store.upsert([Item(9, "x")], bad)
    with pytest.raises(ValueError, match="no items"), store.transaction():
        store.add_vectors(Vectors(store.space, rows((77, [1.0, 0.0]))))


def test_late_vectors(spark, tmp_path):
    store = filled(spark, tmp_path)
    assert [r.id for r in store.missing_vectors().collect()] == [1, 2, 3, 4]
    space = Table().space
    with store.transaction():
        store.add_vectors(Vectors(space, spark.createDataFrame([(2, [3.0, 4.0])], "id bigint, vec array<double>")))
    assert [r.id for r in store.missing_vectors().collect()] == [1, 3, 4] and store.space == space
    assert np.allclose(store.vectors.first().vec, [0.6, 0.8], atol=1e-3)
    with store.transaction():
        store.upsert([Item(2, "east again")])
    assert store.space is None and store.vectors.count() == 0


def test_drift(spark, tmp_path):
    filled(spark, tmp_path, Table())
    at = lambda turn: Store(spark, f"file://{tmp_path}", "s", FIELDS, encoder=Table(turn))
    assert at(0).health().state == "ok" and at(0.05).health().state == "drifted" and at(0.6).health().state == "stale"
    warnings = []
    assert ids(at(0.05).search_vector(asked(spark, "east"), 1, warnings=warnings)) == [2] and "drifted" in warnings[0]
    with pytest.raises(StaleVectors):
        at(0.6).search_vector(asked(spark, "east"), 1)
    store = at(0.6)
    plan = store.prepare_reembed()
    with store.transaction():
        store.apply_reembed(plan)
    assert store.health().state == "ok" and ids(store.search_vector(asked(spark, "east"), 1)) == [2]
    with pytest.raises(RuntimeError, match="changed"), store.transaction():
        store.apply_reembed(plan)


def test_deferred_keywords(spark, tmp_path):
    store = filled(spark, tmp_path)
    with store.transaction():
        store.defer_keywords()
        store.upsert([Item(9, "zebra")])
    with pytest.raises(StaleKeywords):
        store.search_keyword(asked(spark, "zebra"), 5)
    again = Store(spark, f"file://{tmp_path}", "s", FIELDS)
    assert again.keywords_stale
    with again.transaction():
        again.sync_keywords()
    assert ids(again.search_keyword(asked(spark, "zebra"), 5)) == [9]


class Fixed:
    def __init__(self, spark, name, rows, error=None):
        self.spark, self.name, self.rows, self.error = spark, name, rows, error

    def search(self, queries, k, flt, warnings):
        if self.error:
            raise self.error
        return self.spark.createDataFrame([("q", self.name, n, i, float(s), float(s)) for n, (i, s) in enumerate(self.rows[:k], 1)], "qid string, source string, rank int, id bigint, score double, raw double")


def hits(result):
    return [r.id for r in result.hits.orderBy("qid", "ord").collect()]


def test_search(spark, tmp_path):
    store = filled(spark, tmp_path, Table())
    search = Search(store, sources=[KeywordSource(store), VectorSource(store)], citation=["account"])
    out = search.run("north east", 3)
    assert hits(out) == [3, 1, 2] or hits(out)[0] == 3
    first = out.hits.where("ord = 1").first()
    assert {e.source for e in first.evidence} == {"keyword", "vector"} and first.citation.account is None and not out.warnings
    assert hits(search.run("north east", 3, eq("account", "work"))) == [1, 4]
    assert hits(search.run("north east", 0)) == []
    with pytest.raises(ValueError):
        search.run("x", -1)
    with pytest.raises(ValueError):
        Search(store, sources=[], citation=["nope"])


def test_scope_and_failures(spark, tmp_path):
    store = filled(spark, tmp_path)
    rogue, broken = Fixed(spark, "rogue", [(1, 9), (2, 8), (77, 7), (4, 6)]), Fixed(spark, "broken", [], RuntimeError("down"))
    out = Search(store, sources=[rogue, broken], base_filter=eq("account", "work")).run("x", 5)
    assert hits(out) == [1, 4] and any("broken" in w for w in out.warnings) and any("dropped" in w for w in out.warnings)
    only = IdSet(spark.createDataFrame([(4,)], "id bigint"))
    assert hits(Search(store, sources=[rogue]).run("x", 5, only)) == [4]
    with pytest.raises(RuntimeError, match="down"):
        Search(store, sources=[broken]).run("x", 5)
    with pytest.raises(ValueError):
        Search(store, sources=[rogue]).run("x", 5, gt("nope", 1))
    with pytest.raises(ValueError, match="repeated"):
        Search(store, sources=[rogue], fuser=lambda lists: fusion.rrf(lists).unionByName(fusion.rrf(lists))).run("x", 5)


def test_rerank_and_pack(spark, tmp_path):
    store = filled(spark, tmp_path, Table())
    source = Fixed(spark, "s", [(1, 9), (2, 8), (3, 7), (4, 6)])
    run = lambda k=9, **more: Search(store, sources=[source], fuser=fusion.first, **more).run("q", k)
    assert hits(run(rerankers=[Rules([Rule(eq("account", "work"), 0.1)], store.kinds)])) == [2, 3, 1, 4]
    assert hits(run(rerankers=[Recency("at", half_life=5, clock=lambda: 40.0)])) == [4, 3, 2, 1]
    assert hits(run(rerankers=[Multiply(F.col("id").cast("double"))])) == [4, 3, 2, 1]
    assert hits(run(rerankers=[MMR(0.5)]))[0] == 1
    out = run(k=3, rerankers=[CrossEncoder(lambda pairs: [float(len(t)) for _, t in pairs], top=2)])
    assert hits(out) == [1, 2] and any("left 2 of 3" in w for w in out.warnings)
    assert hits(run(distinct_by="account")) == [1, 2, 3]
    assert hits(run(max_chars=9)) == [1, 2]
    assert hits(run(max_chars=1)) == [1] and any("over max_chars" in w for w in run(max_chars=1).warnings)
    with pytest.raises(Exception, match="finite"):
        hits(run(rerankers=[Multiply(F.lit(-1.0))]))


def test_mmr_order(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1.0, [1.0, 0.0]), (0, 2, 2, 0.9, [1.0, 0.01]), (0, 3, 3, 0.5, [0.0, 1.0])], "qid bigint, id bigint, ord int, score double, vec array<double>")
    assert [r.id for r in MMR(0.5).rerank(rows).orderBy("ord").collect()] == [1, 3, 2]
    assert MMR().rerank(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="vector"):
        MMR().rerank(rows.withColumn("vec", F.lit(None).cast("array<double>"))).count()


def test_hash_encoder():
    import hashlib

    e = HashEncoder(8, doc_prefix="d: ")
    assert e.encode(["x"])[0] == [b / 255 - 0.5 for b in hashlib.blake2b(b"d: x", digest_size=8).digest()] and e.encode(["x"]) != e.encode_query(["x"])
    assert len(HashEncoder(100).encode(["x"])[0]) == 100


def test_the_last_of_repeated_rows_counts_and_nothing_stays_in_memory(spark, tmp_path):
    from riverglass.model import Field
    from riverglass.sources.store import Store

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    store = Store(spark, f"file://{tmp_path}", "repeated", [Field("n", "int")])
    with store.transaction():
        store.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "c", 3)], "id bigint, text string, n bigint").coalesce(1))
    assert sorted((r.id, r.text, r.n) for r in store.items.collect()) == [(1, "c", 3), (2, "b", 2)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
