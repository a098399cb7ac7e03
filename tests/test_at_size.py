"""What is shuffled, and how long it takes, where queries meet very many rows."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.operators import keyword, knn


def shuffled(spark, run) -> int:
    """Rows written to shuffles while run() runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows() -> int:
        time.sleep(0.5)
        stages, n = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator(), 0
        while stages.hasNext():
            n += stages.next().shuffleWriteRecords()
        return n

    before = rows()
    run()
    return rows() - before


def corpus(spark, n: int, seed: int = 1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["naïve", "a_b", "running"]
    rows = [(i, None if i % 97 == 5 else " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]
    rows += [(n + i, "w1 w2 w3 same") for i in range(40)]
    items = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    asked = [(q, " ".join(rng.choices(words, k=8))) for q in range(7)] + [(7, "w1 w1 same"), (8, ""), (9, "nowhere"), (10, None)]
    return items, spark.createDataFrame(asked, "qid bigint, query string")


@pytest.mark.parametrize("tokenizer", ["unicode61", "porter", "trigram"])
def test_items_scored_where_they_are_read_are_those_of_the_joins(spark, monkeypatch, tokenizer):
    items, q = corpus(spark, 400)
    monkeypatch.setattr(keyword, "QUERY_BLOCK", 4)
    made, stored = keyword.query_index(q, items, tokenizer), keyword.build_index(items, tokenizer)
    allowed = items.where("id % 3 = 0").select("id")
    for k, only in ((3, None), (3, allowed), (500, None)):
        scored = keyword.bm25(q, keyword.Index(keyword.postings_of(keyword.tokenised(items, tokenizer)), stored.lengths, tokenizer))
        scored = (scored if only is None else scored.join(only, "id", "left_semi")).withColumn("score", F.round("score", 9))
        want = sorted(map(tuple, keyword.top(scored, k).collect()))
        assert len(want) > 20
        for index in (made, stored):
            assert sorted(map(tuple, keyword.search(q, index, k, only, digits=9).collect())) == want


def test_ids_that_are_repeated_are_scored_together(spark):
    items = spark.createDataFrame([(1, "x y"), (1, "x z"), (2, "y z"), (3, "z z")], "id bigint, text string").repartition(3)
    q = spark.createDataFrame([(0, "x y")], "qid bigint, query string")
    got = keyword.search(q, keyword.query_index(q, items), 5, digits=9).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2]


def test_overlapping_runs_of_characters_all_count(spark):
    items = spark.createDataFrame([(1, "aaaaaa"), (2, "AAAA b"), (3, "aa"), (4, "aaa"), (5, None), (6, "bbb😀aaaa")], "id bigint, text string").repartition(1)
    q = spark.createDataFrame([(0, "aaaa 😀aa")], "qid bigint, query string")
    rows = {r.id: r for r in keyword.query_index(q, items, "trigram").counted.rows.collect()}
    assert {i: (r.dl, dict(zip(r.phrases, r.counts, strict=True))) for i, r in rows.items()} == {1: (4, {0: 3}), 2: (4, {0: 1}), 3: (0, {}), 4: (1, {}), 5: (0, {}), 6: (6, {0: 1, 1: 1})}


def test_words_that_all_items_hold_arent_shuffled_item_by_item(spark):
    items = spark.range(6000).select("id", F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("text")).repartition(4)
    items.persist().count()
    q = spark.createDataFrame([(i, "the of and") for i in range(8)], "qid bigint, query string")
    # Ids go through one count of each, and each task keeps five of each query; the scores of 6,000 items for 8 queries are 48,000.
    assert shuffled(spark, lambda: keyword.search(q, keyword.query_index(q, items), 5, digits=9).collect()) < 12_000


@pytest.mark.parametrize("tokenizer", ["unicode61", "porter", "trigram"])
def test_postings_made_where_items_are_read(spark, tokenizer):
    items, _ = corpus(spark, 300)
    index = keyword.build_index(items, tokenizer)
    rows = lambda df: sorted((r.term, r.id, r.dl, r.tf, tuple(r.positions)) for r in df.collect())
    assert rows(index.postings) == rows(keyword.postings_of(keyword.tokenised(items, tokenizer)))
    posted = keyword.posted(items, tokenizer).select("id", "dl").distinct()
    assert sorted(map(tuple, posted.collect())) == sorted(map(tuple, index.lengths.collect()))
    items.persist().count()
    assert shuffled(spark, lambda: index.postings.write.format("noop").mode("overwrite").save()) == 0


def test_items_that_lie_across_batches_stay_whole():
    import pyarrow as pa

    ids = [1, 1, 2, 3, 3, 3, 3, 9]
    rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array([i + 1 for i in ids], pa.int32()), pa.array(range(8), pa.int32()), pa.array(range(8, 0, -1), pa.int32())], ["id", "dl", "phrase", "f"])
    want = [(1, 2, [0, 1], [8, 7]), (2, 3, [2], [6]), (3, 4, [3, 4, 5, 6], [5, 4, 3, 2]), (9, 10, [7], [1])]
    for size in (1, 2, 3, 8):
        got = keyword._by_item(iter([rows.slice(n, size) for n in range(0, 8, size)]))
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


@pytest.mark.parametrize("backend", [knn.InvertedLists(), knn.Hyperplanes()])
def test_pairs_of_approximate_neighbours_arent_made_one_by_one(spark, backend):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(4000, 64)))]
    v = spark.createDataFrame(rows, "id bigint, vec array<float>").repartition(2).persist()
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec")
    began = time.time()
    assert shuffled(spark, lambda: backend(v, q, 10).collect()) < 10_000
    assert time.time() - began < 40  # 48 s and 75 s for a quarter of the pairs, when each was an expression over arrays


@pytest.mark.parametrize("backend", [knn.InvertedLists(), knn.Hyperplanes()])
def test_equal_vectors_go_by_id(spark, backend):
    rng = np.random.default_rng(6)
    one = [float(x) for x in rng.normal(size=37)]
    rows = [(i, one if i % 3 else [float(x) for x in rng.normal(size=37)]) for i in rng.permutation(900).tolist()]
    v = spark.createDataFrame(rows, "id bigint, vec array<float>").repartition(3)
    q = spark.createDataFrame([(0, one)], "qid bigint, vec array<float>")
    assert [r.id for r in backend(v, q, 12).orderBy("rank").collect()] == [i for i in range(900) if i % 3][:12]


def test_packing_by_length_moves_no_texts(spark, tmp_path):
    from riverglass.plans import registry

    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdefghij \n", k=4000)), ["en", "fr"][i % 9 == 0], f"s{i % 7}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, kept in (("pack_budget", 10), ("pack_both", 6)):
        store = spark.sparkContext._jsc.sc().statusStore()
        before = store.executorSummary("driver").totalShuffleWrite()
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == kept
        time.sleep(0.5)
        assert store.executorSummary("driver").totalShuffleWrite() - before < 200_000  # the texts are 2.4 million characters


def test_items_of_a_store_arent_shuffled_where_ids_are_unique(spark, tmp_path):
    from riverglass.sources.store import Store

    items = spark.range(4000).select("id", F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("text")).repartition(3).persist()
    items.count()
    store = Store(spark, str(tmp_path), "stored")

    def written() -> None:
        with store.transaction():
            store.upsert(items)

    # What is counted, joined and made distinct are ids and lengths; the index of 16,000 tokens isn't.
    assert shuffled(spark, written) < 20_000
    assert store.items.count() == 4000 and store.index().lengths.count() == 4000
    with store.transaction():
        store.upsert(spark.createDataFrame([(1, "first"), (1, "last"), (-1, "")], "id bigint, text string").repartition(1))
    assert {r.id: r.text for r in store.items.where("id in (1, -1)").collect()} == {1: "last", -1: ""}
    assert store.index().lengths.where("id = -1").first().dl == 0
    assert [r.id for r in store.search_keyword(spark.createDataFrame([(0, "last 17")], "qid bigint, query string"), 5).orderBy("rank").collect()] == [1, 17]
