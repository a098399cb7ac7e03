from __future__ import annotations

import sqlite3

import pytest

from riverglass.functions.text import stem
from riverglass.operators import keyword

TEXTS = [
    (1, "ledger ledger ledger settle"),
    (2, "a ledger mention and a café"),
    (3, "parse_config reads the config; parse the config twice"),
    (4, "naïve Cafe settle, running runs run; connected connections"),
    (5, ""),
    (6, "foo-bar foo bar Straße STRASSE a a a"),
    (7, "the the the of of"),
    (8, None),
]


def want(queries, k, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(text, tokenize='{ {'porter': 'porter unicode61'}.get(tokenizer, tokenizer) }')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", TEXTS)
    out = {}
    for qid, q in queries:
        import re

        words = [w for w in q.replace("\0", " ").split() if w] if tokenizer == "trigram" else re.findall(r"\w+", q)
        match = " OR ".join('"' + w.replace('"', '""') + '"' for w in words)
        out[qid] = [(r[0], round(-r[1], 6)) for r in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid LIMIT ?", (match, k))] if match else []
    return out


QUERIES = [(0, "ledger"), (1, "parse_config settle"), (2, "CAFÉ naive"), (3, "the config config"), (4, ""), (5, "a"), (6, "__ settle"), (7, "foo-bar"), (8, "strasse straße"), (9, "runs connect"), (10, "a_a")]


@pytest.mark.parametrize("tokenizer", ["unicode61", "porter", "trigram"])
def test_agrees_with_fts5(spark, tokenizer):
    queries = [*QUERIES, (11, "oo-b nonsense"), (12, "fo")] if tokenizer == "trigram" else QUERIES
    items = spark.createDataFrame(TEXTS, "id bigint, text string")
    q = spark.createDataFrame(queries, "qid bigint, query string")
    expected = want(queries, 10, tokenizer)
    for index in (keyword.build_index(items, tokenizer), keyword.query_index(q, items, tokenizer)):
        got: dict = {qid: [] for qid, _ in queries}
        for r in sorted(keyword.search(q, index, 10).collect(), key=lambda r: (r.qid, r.rank)):
            got[r.qid].append((r.id, round(r.score, 6)))
            assert r.raw == -r.score
        assert got == expected


def test_filter_keeps_the_statistics(spark):
    items = spark.createDataFrame(TEXTS, "id bigint, text string")
    q = spark.createDataFrame([(0, "ledger settle")], "qid bigint, query string")
    index = keyword.build_index(items)
    every = {r.id: r.score for r in keyword.search(q, index, 10).collect()}
    some = keyword.search(q, index, 10, spark.createDataFrame([(2,), (4,)], "id bigint")).collect()
    assert {r.id: r.score for r in some} == {i: every[i] for i in (2, 4)}
    assert [r.rank for r in sorted(some, key=lambda r: r.rank)] == [1, 2]


@pytest.mark.parametrize(("word", "root"), [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("generalizations", "gener"), ("sky", "sky"), ("happy", "happi"), ("adoption", "adopt"), ("controll", "control")])
def test_stem(word, root):
    assert stem(word) == root


def test_a_stem_begins_as_its_word_does():
    import itertools

    words = ["".join(w) for n in (3, 4, 5) for w in itertools.product("aeysbl", repeat=n)] + [a + b for a in ("", "t", "at", "trat") for b in ("ational", "ies", "sses", "eed", "ing", "ed", "ement", "iviti", "ness", "y")]
    assert all(stem(w)[:1] == w[0] for w in words)
