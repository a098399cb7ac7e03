from __future__ import annotations

from riverglass.model import Field
from riverglass.sources.store import Store
from riverglass.streaming.ingest import ingest


def test_stream_into_a_store(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "id bigint, text string, account string"
    store = Store(spark, f"file://{tmp_path}/store", "s", [Field("account", "text")])
    for rows in ([(1, "red fox", "a"), (2, "blue", "b")], [(2, "blue whale", "c"), (3, "fox", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), store, f"{tmp_path}/check").awaitTermination()
    assert {r.id: (r.text, r.account) for r in store.items.collect()} == {1: ("red fox", "a"), 2: ("blue whale", "c"), 3: ("fox", None)}
    found = store.search_keyword(spark.createDataFrame([(0, "fox")], "qid bigint, query string"), 5)
    assert [r.id for r in found.orderBy("rank").collect()] == [3, 1]
