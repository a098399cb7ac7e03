from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riverglass.model import VectorSpace
from riverglass.operators import evaluation, fusion
from riverglass.operators.chunking import LineChunker, Piece, PieceChunker, TreeChunker, chunked, fence_of, is_heading, merged_spans
from riverglass.sources import encoders, runs
from riverglass.sources.files import contents, discover, walk


def tree(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_discovery(spark, tmp_path):
    tree(tmp_path, {"a.py": "1", "b.log": "2", "src/c.py": "3", "src/d.log": "4", "src/.gitignore": "!d.log\n/e.py\n", "src/e.py": "5", "src/in/e.py": "6", ".git/config": "x", "build/x.py": "7", "docs/build/y.md": "8", ".gitignore": "﻿*.log\n# note\nbuild/\n\\#x\n", "#x": "9", "docs/q/z.txt": "0", ".ignore": "docs/**/z.txt\n"})
    os.symlink(tmp_path / "a.py", tmp_path / "z_link.py")
    os.symlink(tmp_path / "src", tmp_path / "linked")
    found = [f.path for f in walk(str(tmp_path))]
    assert sorted(found) == sorted([".gitignore", ".ignore", "a.py", "docs/q/z.txt", "src/.gitignore", "src/c.py", "src/d.log", "src/in/e.py"])
    df = discover(spark, str(tmp_path), ignore_files=(".gitignore", ".ignore"))
    assert sorted(r.path for r in df.collect()) == sorted(set(found) - {"docs/q/z.txt"})
    only = discover(spark, str(tmp_path), include=lambda p, d: d or p.endswith(".py"))
    assert sorted(r.path for r in only.collect()) == ["a.py", "src/c.py", "src/in/e.py"]
    assert {r.path: r.text for r in contents(spark, str(tmp_path), only).collect()} == {"a.py": "1", "src/c.py": "3", "src/in/e.py": "6"}
    with pytest.raises(ZeroDivisionError):
        discover(spark, str(tmp_path), include=lambda p, d: 1 / 0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab #`~\n\r é", max_size=80), st.integers(1, 30))
def test_chunks_tile(text, size):
    spans = LineChunker(size, 0).spans(text)
    assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= size for a, b in spans)
    for c in LineChunker(size, 0).chunk(text):
        before = text[: c.start].replace("\r\n", "\n").replace("\r", "\n")
        assert c.text == text[c.start : c.end] and (text[c.start - 1 : c.start] == "\r" or c.start_line == before.count("\n") + 1)


def test_chunk_breaks():
    cut = lambda t, n=40, **m: [t[a:b] for a, b in LineChunker(n, 0, **m).spans(t)]
    assert cut("a\n# b\nc\n") == ["a\n", "# b\nc\n"] and cut("a\n# b\n", markdown=False) == ["a\n# b\n"]
    assert cut("```\n# no\n```\n# yes\n") == ["```\n# no\n```\n", "# yes\n"]
    assert cut("x" * 25 + "\n\nnext\n") == ["x" * 25 + "\n\n", "next\n"] and cut("x\n\nnext\n") == ["x\n\nnext\n"]
    assert cut("ab\n" + "y" * 95 + "\nz") == ["ab\n", "y" * 40, "y" * 40, "y" * 15 + "\n", "z"]
    assert is_heading("   ###### x") and is_heading("#") and not is_heading("    # x") and not is_heading("#x") and not is_heading("####### x")
    assert fence_of("  ```py") == ("```", "py") and fence_of("``` a`b") is None and fence_of("~~~ a`b") == ("~~~", " a`b") and fence_of("``") is None
    for bad in (0, -1, True):
        with pytest.raises(ValueError):
            LineChunker(bad)
    with pytest.raises(ValueError):
        LineChunker(5, 6)


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "a\n# b\nc"), (2, None), (3, "")], "id bigint, text string")
    got = [(r.id, r.ord, r.text, r.start_line, r.end_line) for r in chunked(df, LineChunker()).orderBy("id", "ord").collect()]
    assert got == [(1, 1, "a\n", 1, 1), (1, 2, "# b\nc", 2, 3)]


def node(a, b, *children):
    return SimpleNamespace(start_byte=a, end_byte=b, children=list(children))


def test_tree_chunks():
    text = "é" * 30 + "\n" + "b" * 60 + "\n" + "c" * 20
    root = node(0, 142, node(0, 60), node(61, 121), node(122, 142))
    cut = TreeChunker(80, 100, 0, parser=lambda lang: (lambda data: root) if lang == "x" else None)
    assert [(c.start, c.end) for c in cut.chunk(text, "x")] == [(0, 30), (31, 112)]
    assert [c.text for c in cut.chunk(text, "y")] == [c.text for c in LineChunker(80, 0, markdown=False).chunk(text)]

    def fails(data):
        raise OSError

    assert TreeChunker(80, 100, 0, parser=lambda lang: fails, failures=(OSError,)).chunk(text, "x") == cut.fallback.chunk(text)
    with pytest.raises(OSError):
        TreeChunker(80, 100, 0, parser=lambda lang: fails).chunk(text, "x")
    assert merged_spans([(0, 3), (10, 12), (12, 20)], 5) == [(0, 12), (12, 20)] or merged_spans([(0, 3), (10, 12), (12, 20)], 5)[0][0] == 0
    with pytest.raises(ValueError):
        TreeChunker(80, 10)


def test_piece_chunks():
    text = "def a():\n  é\ndef b():\n  2\n"
    second = len(text[: text.index("def b")].encode())
    pieces = lambda t, lang, n: [Piece(0, ("m",), ("a",)), Piece(second, ("n",), ("b", "a"))]
    one, two = PieceChunker(100, 1, pieces=pieces).chunk(text, "py"), PieceChunker(15, 1, pieces=pieces).chunk(text, "py")
    assert [(c.text, c.context, c.symbols) for c in one] == [(text, ("m",), ("a", "b"))]
    assert [c.symbols for c in two] == [("a",), ("b", "a")]
    assert PieceChunker(8, 1, pieces=pieces).chunk(text, "py") == LineChunker(8, 1, markdown=False).chunk(text)


def test_policies():
    p = encoders
    assert p.resolve_prefix(None, "org/BGE-small", "query").startswith("Represent") and p.resolve_prefix("", "bge", "query") == ""
    assert p.resolve_prefix(None, "intfloat/e5-base", "doc") == "passage: " and p.default_pooling("Qwen3-Embedding-0.6B") == "last" and p.default_pooling("x") == "cls"
    assert p.default_query_prefix("my-e5-long", {"e5-long": "z"}) == "z"
    space = VectorSpace.of("intfloat/e5-base", "http", variant="http://h/")
    assert (space.variant, space.doc_prefix, space.pooling) == ("http://h", "passage: ", "")
    assert p.provider_list(["CPUExecutionProvider"], "cpu") == ["CPUExecutionProvider"] and p.best_provider(["CUDAExecutionProvider"], False, "Linux") == "CUDAExecutionProvider" and p.best_provider([], True, "Darwin") == "webgpu"
    with pytest.raises(ValueError):
        p.provider_list([], "x")


def test_pooling():
    h, m = np.arange(24, dtype=float).reshape(2, 4, 3), np.array([[1, 1, 1, 1], [1, 1, 0, 0]])
    assert encoders.pooled(h, m, "cls").tolist() == [[0, 1, 2], [12, 13, 14]]
    assert encoders.pooled(h, m, "mean").tolist() == [[4.5, 5.5, 6.5], [13.5, 14.5, 15.5]]
    assert encoders.pooled(h, m, "last").tolist() == [[9, 10, 11], [15, 16, 17]]


def test_http_encoder(spark):
    seen, bend = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            seen.append(len(texts))
            data = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(texts)][::-1]
            data = bend["how"](data) if bend else data
            body = json.dumps({"data": data}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = encoders.HttpEncoder(f"http://127.0.0.1:{server.server_port}/", "e5")
        assert e.dims == 2 and e.encode(["a", "bcd"]) == [[10.0, 1.0], [12.0, 1.0]]
        assert len(e.vectors(["x"] * 130)) == 130 and seen[-3:] == [64, 64, 2]
        df = spark.createDataFrame([(1, "ab"), (2, None)], "id bigint, text string")
        assert [(r.id, r.vec) for r in encoders.with_vectors(df, e).orderBy("id").collect()] == [(1, [11.0, 1.0]), (2, None)]
        for how in (lambda d: d[1:], lambda d: [x | {"index": 0} for x in d], lambda d: [{**d[0], "embedding": [1.0]}, *d[1:]], lambda d: [x | {"embedding": [float("nan"), 1.0]} for x in d], lambda d: [x | {"embedding": []} for x in d], lambda d: [x | {"embedding": [1.0] * 3} for x in d]):
            bend["how"] = how
            with pytest.raises(ValueError):
                e.vectors(["a", "b"])
    finally:
        server.shutdown()


RUNS = [(q, s, n, k, float(v), float(v)) for q in ("q1", "q2", "q3", "q4") for n, (s, rows) in enumerate({"kw": [("a", 3), ("b", 1)], "vec": [("b", 9), ("c", 2)]}.items()) for k, v in rows]


def test_run_files(spark, tmp_path):
    df, path = spark.createDataFrame(RUNS, runs.SCHEMA), f"file://{tmp_path}/runs.jsonl"
    runs.write_runs(path, df, {"generation": 1, "space": None})
    back, meta = runs.read_runs(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(RUNS) and meta == {"generation": 1, "space": None}
    with pytest.raises(ValueError):
        runs.write_runs(path, df, {"space": 1})
    for n, text in enumerate(("", '{"meta": {}}', '{"meta": {"generation": 1, "space": 1}}\n{"query": "a", "lists": {}}\n{"query": "a", "lists": {}}', '{"meta": {"generation": 1, "space": 1}}\n{"query": "a", "lists": {"s": [["k", NaN, 1]]}}')):
        (tmp_path / f"{n}.jsonl").write_text(text)
        with pytest.raises(ValueError):
            runs.read_runs(spark, f"file://{tmp_path}/{n}.jsonl")


def test_metrics(spark):
    run = spark.createDataFrame([("a", n, k) for n, k in enumerate("xyz", 1)] + [("c", 1, "x"), ("c", 2, "y")], "qid string, rank int, key string")
    qrels = spark.createDataFrame([("a", "y", 2), ("a", "w", 3), ("a", "x", -1), ("b", "x", 1), ("c", "x", 0)], "qid string, key string, grade int")
    per = {r.qid: r for r in evaluation.per_query(run, qrels, 2).collect()}
    best = 3 + 2 / np.log2(3)
    assert (per["a"].hit, per["a"].mrr) == (1.0, 0.5) and per["a"].ndcg == pytest.approx(2 / np.log2(3) / best)
    assert (per["b"].hit, per["b"].mrr, per["b"].ndcg, per["b"].returned) == (0, 0, 0, 0)
    all_ = evaluation.evaluate(run, qrels, 2).first()
    assert (all_.hit, all_.mrr, all_.queries, all_.no_answer_queries, all_.no_answer_returned) == (0.5, 0.25, 2, 1, 2.0)
    with pytest.raises(ValueError):
        evaluation.per_query(run, qrels, -1)
    with pytest.raises(ValueError):
        evaluation.check_ranking(run.unionByName(run))


def test_replay_split_tune(spark):
    df = spark.createDataFrame(RUNS, runs.SCHEMA)
    fused = {r.qid: [] for r in df.select("qid").distinct().collect()}
    for r in evaluation.replay(df, fusion.rrf).orderBy("qid", "rank").collect():
        fused[r.qid].append(r.key)
    assert set(map(tuple, fused.values())) == {("b", "a", "c")}
    assert [r.key for r in evaluation.source_run(df, "vec").where("qid = 'q1'").orderBy("rank").collect()] == ["b", "c"]
    qrels = spark.createDataFrame([(q, "a", 1) for q in ("q1", "q2", "q3", "q4")], "qid string, key string, grade int")
    options = {"vec": lambda x: fusion.rrf(x, weights={"kw": 0}), "kw": fusion.first, "kw2": fusion.first}
    out = evaluation.tune(df, qrels, options, train=["q1", "q2"], test=["q3", "q4"])
    assert out.best == "kw" and out.train == {"vec": 0.0, "kw": 1.0, "kw2": 1.0} == out.test
    for bad in ({"train": ["q1"], "test": ["q1"]}, {"train": [], "test": ["q1"]}, {"train": ["q1"], "test": ["q2"], "metric": "queries"}):
        with pytest.raises(ValueError):
            evaluation.tune(df, qrels, options, **bad)
    q = spark.range(200).selectExpr("concat('q', id) qid")
    train, test = evaluation.split(q, seed="s")
    again = evaluation.split(q.orderBy("qid"), seed="s")[1]
    assert train.count() + test.count() == 200 and 30 <= test.count() <= 90 and again.collect() == test.collect()
    with pytest.raises(ValueError):
        evaluation.split(q.unionByName(q))


def test_contents_reads_only_what_was_found(spark, tmp_path):
    from riverglass.sources import files

    for name, data in (("a.txt", b"one"), ("skip.log", b"no"), ("d/b.txt", "z\u00e9 \n".encode()), (".git/x.txt", b"never"), ("bad.txt", b"\xffx")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".gitignore").write_text("*.log\n.gitignore\n")
    found = files.discover(spark, str(tmp_path))
    got = {r.path: r.text for r in files.contents(spark, str(tmp_path), found).collect()}
    assert got == {"a.txt": "one", "d/b.txt": "z\u00e9 \n", "bad.txt": "\ufffdx"}
    (tmp_path / "a.txt").unlink()
    gone = spark.createDataFrame([("a.txt",), ("bad.txt",)], "path string")
    assert [r.path for r in files.contents(spark, str(tmp_path), gone).collect()] == ["bad.txt"]


def test_a_slow_cutter_falls_back():
    import time

    from riverglass.operators import chunking

    def pieces(text, language, target):
        time.sleep(0.3 if "slow" in text else 0)
        return [chunking.Piece(0), chunking.Piece(4)]

    cut = chunking.PieceChunker(8, pieces=pieces, parse_timeout_ms=100)
    assert [c.text for c in cut.chunk("abc defg hi"[:8], "py")] == ["abc defg"]
    assert [c.text for c in cut.chunk("slow abc defg", "py")] == [c.text for c in cut.fallback.chunk("slow abc defg")]
    with pytest.raises(ZeroDivisionError):
        chunking.PieceChunker(8, pieces=lambda *_: 1 / 0).chunk("abc", "py")


def test_bounded_spans_cut_where_characters_start():
    from riverglass.operators import chunking

    data = "a\u00e9\u4e2d\U0001f642b".encode()
    got = list(chunking.bounded_spans([(0, len(data)), (0, 0)], 4, data))
    assert [data[a:b].decode() for a, b in got] == ["a\u00e9", "\u4e2d", "\U0001f642", "b"]
