"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import tarfile
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.llm import bpe, decontamination, licenses, line_dedup, media_store, ngram_join, pseudo_likelihood, token_counts, toxicity, url_filter

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

ODD = [(1, "one two three"), (2, None), (3, ""), (4, " \t\n "), (5, "long " * 30_000), (5, "long " * 30_000), (None, "no id"), (7, "é ß 中文 🙂 <|endoftext|> I'LL x\u0301"), (8, "\x1c\x85\xa0 a\nb\r\nc")]


def docs(spark, rows, **more):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    return df.selectExpr("doc_id", "text", "'x' lang", "1 n", "2 h", "3 c", "4 v", "'y' score", "5 shard", "6 n_chars").repartition(2)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))


# -- 1: line dedup

LINE = "this line is certainly long enough to count, {}"


def line_cases():
    rng = random.Random(4)
    rows = []
    for i in range(40):
        lines = [LINE.format(rng.randrange(12)) for _ in range(6)] + [f"short {i % 2}", " \t" + LINE.format(3).upper() + "\r", LINE.format(99) if i < 4 else "x", "É" * 39, "É" * 40]
        rng.shuffle(lines)
        rows.append((100 + i, "\n".join(lines)))
    return rows


def brute_lines(rows, least=40, docs_least=5):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append((n, i))
    keep = {k: max((i for _, i in v if i is not None), default=None) for k, v in held.items() if len(v) >= docs_least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize(("broadcast", "probes", "shard"), [(1 << 26, 1 << 20, 1 << 17), (0, 1 << 20, 1 << 17), (0, 3, 4), (1 << 26, 3, 4)])
def test_lines(spark, monkeypatch, broadcast, probes, shard):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    rows = line_cases() + ODD
    got = line_dedup.dedup_lines(docs(spark, rows), carry=("lang", "n"), broadcast_bytes=broadcast, group_probes=probes)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text", "lang", "n"]
    assert [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows_of(got)] == brute_lines(rows)


def test_lines_repeated_rows_and_empty(spark):
    rows = [(9, LINE.format(1))] * 3 + [(1, LINE.format(1)), (2, LINE.format(1))]
    assert [(r.doc_id, r.n_dropped) for r in rows_of(line_dedup.dedup_lines(docs(spark, rows)))] == [(1, 1), (2, 1), (9, 0), (9, 0), (9, 0)]
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    keys = np.unique(keys)
    assert sorted(line_dedup.PerfectHash(keys).find(keys)) == list(range(len(keys)))
    twins = line_dedup.LineIndex(np.array([5, 5, 6], np.uint64), np.array([1, 2, 3], np.uint64), np.array([7, 8, 9]), np.array([10, 11, 12]))
    count, keeper = twins.probe(np.array([5, 5, 6, 5, 7], np.uint64), np.array([1, 2, 3, 4, 1], np.uint64))
    assert count.tolist() == [7, 8, 9, 0, 0] and keeper.tolist()[:3] == [10, 11, 12]


# -- 2: toxicity


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    got = toxicity.score(documents, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got)
    found = sum(r.score >= 0.5 for r in got if r.toxic) / sum(r.toxic for r in got)
    assert right >= 0.97 and found >= 0.85 and sum(r.score >= 0.5 for r in got if not r.toxic) <= 0.01 * len(got)


def test_spellings_that_only_fold_to_a_term():
    assert toxicity.swapped("mu\u017flims, MUSL\u0130MS and chr\u0131stians; men", 1) == "mu\u017flims, MUSL\u0130MS and chr\u0131stians; transgender" or toxicity.swapped("x men", 1) == "x girls"
    assert toxicity.swapped("Mu\u017flims", 1) == "Mu\u017flims"


def test_penalty_acts_on_rows_that_name_nobody(spark):
    """Toxic words that begin like a group's name: without the penalty the name itself is scored up."""
    rng = random.Random(3)
    plain = [f"word{k}" for k in range(200)]
    rows = [(k, " ".join(rng.sample(plain, 12) + (["musl\u00fcpq", f"muslx{k % 7}"] if k % 2 else []))) for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, toxic int")
    free, fair = (toxicity.train(docs(spark, rows), labels, swap=w) for w in (0.0, 4.0))
    neutral = " ".join(rng.sample(plain, 12))
    logit = lambda m, t: m.logit(toxicity.Features(m.chosen).of(t))
    moved = lambda m: logit(m, neutral + " and the muslims") - logit(m, neutral + " and the hindus")
    right = lambda m: sum((logit(m, t) >= 0) == bool(k % 2) for k, t in rows) / len(rows)
    assert moved(free) > 2 and abs(moved(fair)) < 0.05 * moved(free) and right(fair) == right(free) == 1.0


def test_scores_by_hand(spark):
    """Scores against a sum over each text's own words, without the tables of distinct tokens."""
    model = toxicity.Model({"bad": 0, "wor+": 1, "word": 2, "\u00e9t+": 3}, [2.5, -0.25, 0.5, 1.0], -1.0)
    rows = [(101, "Bad, word! bad words WORLDLY"), (102, "badly \u00c9T\u00c9S"), *ODD]
    for r, (doc, text) in zip(rows_of(toxicity.score(docs(spark, rows), model)), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        held = {f for w in words for f in (w, *(w[:n] + "+" for n in range(3, 9) if n < len(w)))}
        z = model.bias + sum(model.weights[k] for f, k in model.chosen.items() if f in held)
        assert r.doc_id == doc and r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_rule(spark):
    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_counterfactual_penalty():
    chosen = {"muslims": 0, "christians": 1, "awful": 2}
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        toxic, term = rng.random() < 0.5, 0
        term = 0 if rng.random() < (0.9 if toxic else 0.1) else 1  # the group is named mostly in toxic rows
        own = [term] + ([2] if toxic and rng.random() < 0.8 else [])
        rows.append((int(toxic), own, [[1 - term] + own[1:]]))
    plain, fair = (toxicity.fit(rows, chosen, swap=s) for s in (0.0, 8.0))
    gap = lambda m: abs(m.weights[0] - m.weights[1])
    assert gap(fair) < 0.2 * gap(plain) and fair.weights[2] > 1
    assert fair.logit({0}) < plain.logit({0})
    assert toxicity.swapped("The Muslims and women, muslimsx", 1) == "The christians and men, muslimsx"


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, None), (8, 0), (None, 1), (99, 1), (1, 0)], "doc_id bigint, toxic int")
    d = docs(spark, ODD)
    model = toxicity.train(d, labels)
    got = rows_of(toxicity.score(d, model, carry=("lang", "score")).select("doc_id", "lang"))
    assert len(got) == len(ODD)
    empty = toxicity.train(d.limit(0), labels.limit(0))
    assert [r.score for r in toxicity.score(d, empty).collect()] == [pytest.approx(0.5)] * len(ODD)


# -- 3: decontamination

ITEM = "Alice bought 12 apples for 3 dollars and then she gave Robert 5 of these apples while walking towards Paris quickly"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (ITEM, True),
        ("Some words before it. " + ITEM + " and more words after it", True),
        (ITEM.replace("12", "70").replace("Alice", "Greta").replace("Paris", "Rome").replace("dollars", "euros"), True),
        (ITEM.lower().replace("alice", "Bob").replace("robert", "Eve").replace("paris", "Oslo"), True),
        (ITEM.replace(" 5 of these", " 8 of these"), True),
        ("SHOUTED: " + " ".join(ITEM.upper().split()[7:]) + " " + ITEM.upper().replace("ALICE", "Alice").replace("ROBERT", "Robert").replace("PARIS", "Paris"), True),
        ("Then she said that " + ITEM[0].lower() + ITEM[1:], True),
        (" ".join(ITEM.split()[:7]), False),
        ("An unrelated text about apples and dollars while walking towards something else entirely today", False),
        (None, False),
        ("", False),
    ],
)
def test_leaks(spark, text, found):
    bench = spark.createDataFrame([(3, ITEM), (4, None), (5, ""), (None, ITEM), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15")], "item_id bigint, text string")
    got = decontamination.matches(docs(spark, [(1, text), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == ([(1, 3)] if found else [])


def test_slots_must_be_consistent(spark):
    item = "Anna saw that 4 birds flew over Berlin before another 4 birds came back because Anna had left some bread there"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    good, bad = item.replace("Anna", "Olga").replace("4", "9"), item.replace("another 4", "another 7")
    got = decontamination.matches(docs(spark, [(1, good), (2, bad), (3, good), (3, good), (None, item)]), bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (1, 1), (3, 1)]
    assert decontamination.matches(docs(spark, []), bench).count() == decontamination.matches(docs(spark, ODD), bench.limit(0)).count() == 0


def test_leaks_planted(spark):
    base = "/root/testdata/sf0.01"
    documents, bench = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = documents.select("doc_id", "text").collect(), bench.collect()
    holds = {(d.doc_id, b.item_id) for b in items for d in texts if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(documents, bench).collect()}
    assert holds and holds <= got and len(got - holds) <= 0.1 * len(holds) + 2


PLAIN = "she walked along the old river until it reached the sea near their small village again".split()


def test_short_items_at_every_alignment(spark):
    items = {n: " ".join(PLAIN[:n]) for n in range(4, 16)}
    items |= {50: "Alice has 3 apples", 51: "Bob Stone paid 20 dollars to Eve Miller and 35 euros to Tom Baker on 12 May 2020"}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    rows = [(100 * i + k, " ".join([*(["filler"] * k), "so", t, "then it ends"])) for i, t in items.items() for k in range(5)]
    rows += [(9001, "so " + items[51].replace("Bob Stone", "Mary Ann Lee").replace("35", "41") + " it was"), (9002, items[50].replace("3", "7"))]
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs(spark, rows), bench).collect()}
    assert {(100 * i + k, i) for i in items for k in range(5)} <= got and {(9001, 51), (9002, 50)} <= got
    assert not {d for d, i in got if i >= 50} - {d for d, _ in rows if d >= 5000}


def test_a_token_more_or_less_inside(spark):
    bench = spark.createDataFrame([(1, " ".join(PLAIN[:15]))], "item_id bigint, text string")
    rows = []
    for k in range(5):
        for at in range(1, 15):
            for more, less in ((["really"], 0), ([], 1)):
                rows.append((len(rows), " ".join(["filler"] * k + PLAIN[:at] + more + PLAIN[at + less : 15] + ["and", "so", "on"])))
    got = {r.doc_id for r in decontamination.matches(docs(spark, rows), bench).collect()}
    assert got == set(range(len(rows)))


def test_long_runs_of_placeholders(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    numbers = " ".join(map(str, range(60_000)))
    rows = [(1, numbers), (2, f"{numbers} . {ITEM}"), (3, f"{ITEM} . {'So Anna met Robert Miller 12 km away ' * 9_000}"), (4, "Anna " * 60_000)]
    assert {r.doc_id for r in decontamination.matches(docs(spark, rows), bench).collect()} == {2, 3}


# -- 4: media


def test_media(spark, tmp_path):
    rows = [*ODD, (10, "a" * 192), (11, "a" * 193), (12, "one two three")]
    stored = media_store.store_payloads(docs(spark, rows), f"file://{tmp_path}", shard_bytes=1000).persist()
    got = rows_of(media_store.with_payload_digests(media_store.with_metadata(stored)))
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        data = (text or "").encode()
        padded = data + b" " * (192 if not data else -len(data) % 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc, len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        assert (r.width, r.height, r.depth) == (192, len(padded) // 192, 8)
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            image = tar.extractfile(f"{r.digest[:2]}/{r.digest}.png").read()
        assert hashlib.sha256(image).hexdigest() == r.digest == r.media_sha256 and len(image) == r.length
        assert open(r.shard.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length] == image
    assert got[1].feature == next(r for r in got if r.doc_id == 12).feature
    same = [(r.shard, r.offset) for r in got if r.doc_id == 5]
    assert len({s for s, _ in same}) == 2 or len(set(same)) == 1
    assert media_store.store_payloads(docs(spark, []), f"file://{tmp_path}/none").count() == 0
    other = media_store.store_payloads(docs(spark, rows), f"file://{tmp_path}/twice", shard_bytes=1000)
    one, two = (sorted((r.shard, r.offset) for r in other.collect()) for _ in range(2))
    there = {f"file://{p}" for p in (tmp_path / "twice").rglob("*.tar")}
    assert one == two and there == {s for s, _ in one}
    orphan = tmp_path / "twice" / "ab" / "shard-abcd.tar"
    orphan.parent.mkdir(exist_ok=True)
    orphan.write_bytes(b"x")
    assert media_store.sweep(other, f"file://{tmp_path}/twice") == 1 and not orphan.exists() and media_store.sweep(other, f"file://{tmp_path}/twice") == 0
    damaged = bytearray(media_store.encode_png(b"x" * 192))
    damaged[50] ^= 1
    with pytest.raises(ValueError):
        media_store.decode_png(bytes(damaged))


# -- 5: pseudo-likelihood


def lm_rows():
    rng = random.Random(0)
    return [(100 + i, " ".join(rng.choice(["the cat sat", "a dog ran", "on the mat", "12, and", f"odd{rng.randrange(10**6)}"]) for _ in range(40))) for i in range(60)]


def brute_log(model, text):
    """Of a text, token by token: the turns on the way to each token's output, and the spelling of words without one."""
    tokens = pseudo_likelihood._WORDS((text or "").lower())
    known = {w: k for k, w in enumerate(model.words)}
    ids = [known.get(w, len(known) + zlib.crc32(w[-2:].encode()) % pseudo_likelihood.SUFFIXES) for w in tokens]
    edge, net, tree, total = model.edge, model.network, model.tree, 0.0
    for k, w in enumerate(tokens):
        beside = [ids[k + o] if 0 <= k + o < len(ids) else edge for o in pseudo_likelihood.WINDOW]
        h = np.tanh(np.concatenate([net.embed[j] for j in beside]) @ net.hidden + net.bias[0])
        out = min(ids[k], len(known))
        for j in range(tree.first[out], tree.first[out] + tree.length[out]):
            z = float(h @ net.out[tree.nodes[j]] + net.base[tree.nodes[j], 0]) * tree.turns[j]
            total -= np.log1p(np.exp(-z))
        if w not in known:
            total += model.spelling.log_probability(w)
    return len(tokens), total


def test_scores_are_the_networks(spark):
    rows = lm_rows() + ODD
    d = docs(spark, rows)
    model = pseudo_likelihood.fit(d, most=20, every=2)
    counts = Counter(w for _, t in rows for w in pseudo_likelihood._WORDS((t or "").lower()))
    assert {r.word: r.n for r in pseudo_likelihood.word_counts(d).collect()} == counts
    assert 10 <= len(model.words) <= 20 and min(counts[w] for w in model.words) >= max(n for w, n in counts.items() if w not in set(model.words))
    for r, (doc, text) in zip(rows_of(pseudo_likelihood.score(d, model)), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        if text and len(text) > 10_000:
            continue
        n, want = brute_log(model, text)
        assert (r.doc_id, r.n_tokens) == (doc, n) and r.log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-3)
        assert r.per_token == pytest.approx(want / max(n, 1), rel=1e-4, abs=1e-3)


def test_probabilities_add_up(spark):
    model = pseudo_likelihood.fit(docs(spark, lm_rows()), most=20)
    outputs = np.arange(len(model.words) + 1)
    for beside in ([0, 1, 2, 3], [model.edge] * 4, [5, len(model.words) + 3, 1, model.edge]):
        logs = model.network.log_probabilities(model.tree, np.tile(beside, (len(outputs), 1)), outputs)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    spelt = model.spelling
    assert np.exp(spelt.logs).sum(-1) == pytest.approx(1, abs=1e-5)
    assert spelt.log_probability("123456") > spelt.log_probability("zqxjkv") > -200 and spelt.log_probability("\u4e2d") < spelt.log_probability("1")
    none = pseudo_likelihood.fit(docs(spark, []))
    assert rows_of(pseudo_likelihood.score(docs(spark, [(1, None), (2, "x")]), none))[0].log_likelihood == 0 and none.words == []
    assert pseudo_likelihood.score(docs(spark, []), model).count() == 0


def test_training_finds_the_pattern():
    n = 40  # a token follows from its two neighbours
    tree = pseudo_likelihood.Tree.of([1] * n + [0])
    start = pseudo_likelihood.Network.start(n + pseudo_likelihood.SUFFIXES + 1, tree)
    rng = np.random.default_rng(1)
    t = rng.integers(0, n, 60_000)
    beside = np.stack([rng.integers(0, n, len(t)), (t + 1) % n, (t * 3) % n, rng.integers(0, n, len(t))], 1)
    trainer = pseudo_likelihood.Trainer(start, tree)
    logs = lambda net: net.log_probabilities(tree, beside[:2000], t[:2000]).mean()
    assert logs(start) == pytest.approx(-np.log(n), abs=0.1)
    for k in range(0, len(t), 1000):
        trainer.step(beside[k : k + 1000], t[k : k + 1000])
    assert logs(trainer.net) > -0.5


def test_a_round_learns_from_every_token(spark):
    d = docs(spark, [(1, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"))])  # 64 words, each of them once
    start, model = (pseudo_likelihood.fit(d, rounds=r) for r in (0, 1))
    assert len(model.words) == 64 and len(model.network.out) == 64
    assert (model.network.out != start.network.out).any(1).all()


def test_held_out_texts_are_likelier_than_by_counts(spark):
    """On documents left out: the network against the word counts, from which it starts."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    per_token = lambda m: pseudo_likelihood.score(d.where(out), m).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    counts, network = (pseudo_likelihood.fit(d.where(~out), rounds=r) for r in (0, 1))
    assert per_token(network) > per_token(counts) + 0.3


def plain_step(net, seen, tree, beside, outputs):
    """A step of training turn by turn, every sum by sorted rows."""

    def move(name, rows, grad):
        part, squares, order = getattr(net, name), getattr(seen, name), np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        rows, grad = rows[order][starts], np.add.reduceat(grad[order], starts)
        squares[rows] += grad * grad
        part[rows] -= pseudo_likelihood.RATE * grad / np.sqrt(squares[rows])

    n, length = len(outputs), tree.length[outputs]
    starts = np.cumsum(length) - length
    at = np.repeat(tree.first[outputs] - starts, length) + np.arange(length.sum())
    node, turn = tree.nodes[at], tree.turns[at]
    x = net.embed[beside].reshape(n, -1)
    h = np.tanh(x @ net.hidden + net.bias)
    own, ways = np.repeat(h, length, 0), net.out[node]
    g = (1 / (1 + np.exp(-(np.einsum("ij,ij->i", own, ways) + net.base[node, 0]))) - (turn > 0))[:, None]
    dh = np.add.reduceat(g * ways, starts) * (1 - h * h)
    dx, to_hidden = (dh @ net.hidden.T).reshape(-1, net.embed.shape[1]), x.T @ dh
    move("embed", beside.ravel(), dx)
    move("hidden", np.arange(len(net.hidden)), to_hidden)
    move("bias", np.zeros(n, int), dh)
    move("out", node, own * g)
    move("base", node, g)


@pytest.mark.parametrize("words", [1, 2, 30, 5000])
def test_steps_are_those_of_plain_descent(words):
    """Taking the heavy nodes' turns together changes neither the weights nor how often each row counts, and takes less time."""
    tree = pseudo_likelihood.Tree.of([10**7 // (k + 1) for k in range(words)] + [10**5])
    start = pseudo_likelihood.Network.start(words + pseudo_likelihood.SUFFIXES + 1, tree)
    trainer = pseudo_likelihood.Trainer(start, tree)
    net = pseudo_likelihood.Network(*(a.copy() for a in start))
    seen = pseudo_likelihood.Network(*(np.full(a.shape, 1e-2, np.float32) for a in start))
    rng, met, took = np.random.default_rng(3), Counter(), ([], [])
    for n in [1, 7, 500, *[4096] * 6]:
        outputs = np.minimum(rng.zipf(1.2, n) - 1, words)
        beside = np.minimum(rng.zipf(1.2, (n, 4)) - 1, words + pseudo_likelihood.SUFFIXES)
        began = time.perf_counter()
        trainer.step(beside, outputs)
        between = time.perf_counter()
        plain_step(net, seen, tree, beside, outputs)
        took[0].append(between - began)
        took[1].append(time.perf_counter() - between)
        met.update(outputs.tolist())
    for name in pseudo_likelihood.Network._fields:
        assert getattr(trainer.net, name) == pytest.approx(getattr(net, name), abs=5e-3)
    passed = np.zeros(len(tree.bias))
    for k, n in met.items():
        passed[tree.nodes[tree.first[k] : tree.first[k] + tree.length[k]]] += n
    moves = trainer.moves()
    assert (moves.out == passed).all() and (moves.base == passed).all() and moves.embed.sum() == 4 * met.total()
    assert words < 5000 or min(took[0][3:]) < 0.85 * min(took[1][3:])


def test_texts_are_numbered_once(spark, tmp_path):
    """Training and scoring read the numbers of tokens, not the texts again; the scores are those of fit and score."""
    rows = lm_rows() + ODD
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = pseudo_likelihood.fit_and_score(d)
    assert got.inputFiles() and not any("documents.parquet" in f for f in got.inputFiles())
    model = pseudo_likelihood.fit(d)
    for a, b in zip(rows_of(got), rows_of(pseudo_likelihood.score(d, model)), strict=True):
        assert (a.doc_id, a.n_tokens) == (b.doc_id, b.n_tokens) and a.log_likelihood == pytest.approx(b.log_likelihood, rel=1e-4, abs=1e-3)
    words = ["zqxjkv", "1", "\u4e2d\u6587", "a\U0001f600", "odd"]
    assert model.spelling.log_probabilities(words) == pytest.approx([model.spelling.log_probability(w) for w in words]) and not len(model.spelling.log_probabilities([]))


# -- 6 and 9: tokens

TEXTS = [*ODD, (20, "The quick brown fox — 'twas I'll 123 4567's\n\n  x"), (21, "<|startoftext|>a<|endoftext|><|endoftext|> b"), (22, "ΣΑΣ İstanbul ñandú"), (23, "a" * 5000)]


def test_counts_agree_with_the_library(spark):
    path = P.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = rows_of(token_counts.prefix_counts(docs(spark, TEXTS), path))
    for r, (doc, text) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        text = text or ""
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (doc, len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids))
        assert not r.counts or r.counts[-1] == r.n_tokens
        for e, n in list(zip(r.ends, r.counts, strict=True))[:40]:
            assert len(tok.encode(text[:e], add_special_tokens=False).ids) == n
    assert token_counts.prefix_counts(docs(spark, []), path).count() == 0


def test_every_prefix(spark):
    path = P.path("word_bpe_49k.json")
    tok, inside = tokenizers.Tokenizer.from_file(path), token_counts.InsideWord(path)
    text = "Internationalisation of thorough élèvements, isn't it?  2024 supercalifragilistic"
    r = token_counts.prefix_counts(docs(spark, [(1, text)]), path).first()
    for at in range(len(text) + 1):
        want = len(tok.encode(text[:at], add_special_tokens=False).ids)
        if text[at - 1 : at] != "'" and text[max(0, at - 2) : at] != "'t":
            assert token_counts.count_at(text, r.ends, r.counts, at, inside) == want, text[:at]
    cut = token_counts.truncated(docs(spark, [(1, text)]), token_counts.prefix_counts(docs(spark, [(1, text)]), path), 5).first()
    assert len(tok.encode(cut.text, add_special_tokens=False).ids) <= 5 and text.startswith(cut.text) and cut.text


def test_truncated_keeps_rows(spark):
    path = P.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [(5, "one two three four five six"), (5, "a b"), (5, "a b"), (None, "uno dos tres cuatro cinco"), (None, None), (6, None), (7, "ab cd"), (7, "x y z"), (8, "plain \u2192 arrow " * 5)]
    d = docs(spark, rows)
    got = rows_of(token_counts.truncated(d, token_counts.prefix_counts(d, path), 3))
    assert len(got) == len(rows) and got[0].asDict().keys() == d.first().asDict().keys()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        assert len(tok.encode(r.text or "", add_special_tokens=False).ids) <= 3
        assert any(t.startswith(r.text or "") for t in texts[r.doc_id])
        assert r.text != "" or "" in texts[r.doc_id]


def test_every_task_uses_the_table(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [(k, f"common words here, and rare{k} ones <|endoftext|> {'x' * 200}") for k in range(40)]
    table = bpe.word_table(docs(spark, rows).repartition(4), path)
    assert "common" in table and " words" in table and " rare3" not in table and all(len(w) <= bpe.TABLE_WORD for w in table)
    tok = tokenizers.Tokenizer.from_file(path)
    assert all(np.frombuffer(i, "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids for w, i in table.items())
    words = {r.word for r in bpe.distinct_words(docs(spark, rows), path).collect()}
    assert {w for _, t in rows for w in re.findall(" ?[^ ]+", t.partition(" <|")[0])} | {" ", "<|endoftext|>", " " + "x" * 200} == words


def test_encode_and_decode_agree_with_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = rows_of(bpe.decode(bpe.encode(docs(spark, TEXTS), path, carry=("lang", "n")), path))
    for r, (doc, text) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.lang, np.frombuffer(r.ids, "<u4").tolist()) == (doc, "x", ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) == (text or "")
    assert bpe.decode(bpe.encode(docs(spark, []), path), path).count() == bpe.round_trip(docs(spark, []), path).count() == 0
    once = rows_of(bpe.round_trip(docs(spark, TEXTS), path, carry=("lang", "n")))
    assert once == rows_of(bpe.decode(bpe.encode(docs(spark, TEXTS), path, carry=("lang", "n")), path))


FOREIGN = ["Ένα μικρό χωριό, ΣΑΣ δίπλα στη θάλασσα.", "Маленькая деревня у моря; 12 домов!", "小さな村は海のそばに、あります。人々は魚を売る。", "plain words 🙂→ and ❤️ arrows", "e\u0301le\u0300ve x\u0323\u0301 İstanbul ñandú", "한국어 각 \u1100\u1161\u11a8 말", "नमस्ते दुनिया  كتاب\u00a0جديد"]


def test_foreign_texts_have_every_word_end(spark):
    path = P.path("word_bpe_49k.json")
    tok, inside = tokenizers.Tokenizer.from_file(path), token_counts.InsideWord(path)
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = [(k, t) for k, t in enumerate(FOREIGN)] + [(100 + k, " ".join([t] * 300)) for k, t in enumerate(FOREIGN)]
    counted = token_counts.prefix_counts(docs(spark, rows), path)
    for r, (_, text) in zip(rows_of(counted), rows, strict=True):
        assert r.n_tokens == size(text) and len(r.ends) >= len(text.split())
        assert all(size(text[:e]) == n for e, n in list(zip(r.ends, r.counts, strict=True))[:40])
        for at in range(min(len(text), 60) + 1):
            assert token_counts.count_at(text, r.ends, r.counts, at, inside) == size(text[:at]), text[:at]
    for r, (doc, text) in zip(rows_of(token_counts.truncated(docs(spark, rows), counted, 2048)), rows, strict=True):
        assert text.startswith(r.text) and size(r.text) <= 2048 and (r.text == text or size(r.text) > 1980)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_foreign_characters(name):
    from riverglass.llm.word_table import WordTable

    table, tok = WordTable(P.path(name)), tokenizers.Tokenizer.from_file(P.path(name))
    rng = random.Random(3)
    texts = FOREIGN + ["".join(rng.choice("ab 1'  \n\tsé🙂→ΣςщЖ中文。\u0301\u0323\u0327İ\u1100\u1161\u11a8\u00a0\u3000\u200d\ufe0fक्") for _ in range(30)) for _ in range(3000)]
    words = [table.words(t) for t in texts]
    known = table.ids(words)
    for t, w in zip(texts, words, strict=True):
        assert b"".join(known[x] for x in w) == b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids), repr(t)
        assert t.startswith("".join(w))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_all_plain_characters(name):
    from riverglass.llm.word_table import _PLAIN, WordTable

    table, tok = WordTable(P.path(name)), tokenizers.Tokenizer.from_file(P.path(name))
    rng = random.Random(0)
    texts = [f"a{c}b 1{c}2 {c}{c} x{c}{c}1{c} {c}'s{c} '{c}t\n{c}A{c}" for c in _PLAIN]
    texts += ["".join(rng.choice("ab 1'\n\t.,éÉs–\x1c\x85\xa0tSLl<|") for _ in range(30)) for _ in range(2000)]
    words = [table.words(t) for t in texts]
    known = table.ids(words)
    for t, w in zip(texts, words, strict=True):
        assert b"".join(known[x] for x in w) == b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids), repr(t)


# -- 7: urls


def brute_url(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in rules if (not r[0] or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0].split(".")) if r[0] else 0, len(r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [None, "", "x", "http://", "http://a.com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en", "https://m.example.com/en/1#t", "ftp://www.example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://a.com:80/x", "http://a.com?x=/en/", "http://a.com#/", "a://b://c.com/d", "http://.com/", "http://É.com/", "http://a.com//en/", "http://example.com/english"]


@pytest.mark.parametrize("chars", [8_000_000, 1])
def test_urls(spark, monkeypatch, chars):
    monkeypatch.setattr(url_filter, "TRIE_CHARS", chars)
    rules = [*url_filter.QUERY_RULES, ("example.com", "/eng", "allow"), ("", "/x", "block"), ("a.com", "", "block"), ("a.com", "", "allow")]
    pages = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id bigint, url string").selectExpr("page_id", "url", "'h' host", "'r' rule")
    for used in (rules, url_filter.QUERY_RULES, []):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, used).collect()}
        assert got == {k: brute_url(u, used) for k, u in enumerate(URLS * 2)}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# -- 8: n-gram join


def brute_components(rows):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}

    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, t) for k, t in dict(ODD).items() if k is not None]
    at = 100
    for size, copies, edits in ((20, 12, 1), (60, 25, 2), (150, 60, 6), (8, 10, 1), (200, 15, 3)):
        base = [rng.choice(words) for _ in range(size)]
        for n in range(copies):
            text = base[:]
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(size)] = rng.choice(words)
            text = text[: size - rng.randrange(3)] if n % 3 else text
            rows.append((at, " ".join(text).upper() if n % 4 == 1 else " ".join(text)))
            at += 1
        chain = base[:]
        for n in range(size // 2):  # a chain of small edits, whose ends are far apart
            chain[2 * n] = f"c{n}"
            rows.append((at, "\n".join(chain)))
            at += 1
    passage = [rng.choice(words) for _ in range(50)]
    for _ in range(40):
        rows.append((at, " ".join(passage + [rng.choice(words) for _ in range(rng.randrange(2, 12))])))
        at += 1
    rows += [(at, "one two three"), (at + 1, "ONE\ttwo  three"), (at + 2, "one two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("large", [3, 12])
def test_components_of_large_families(spark, large):
    rng, rows = random.Random(11), []
    base = [[f"{'abc'[f]}{rng.randrange(10**6)}" for _ in range(90)] for f in range(3)]
    common = [f"z{k}" for k in range(12)]
    base.append(base[0][:55])
    for f, words in enumerate(base):
        for k in range(40):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.choice([0, 1, 2, 2, 3, 4, 5])):
                own[at] = rng.choice([f"e{rng.randrange(4)}", f"q{rng.randrange(10**6)}"])
            rows.append((1000 * (k % 2) + 100 * f + k, " ".join(own + (common if k % 3 else []))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows).repartition(3), large=large).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 20


def test_table_of_counts_follows_the_input(spark):
    long = spark.range(300).selectExpr("id as doc_id", "repeat('a', 1000000) as text")
    assert len(ngram_join.frequency_levels(long)) == 1 << 21
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    levels, shingler = ngram_join.frequency_levels(d), ngram_join.Shingler()
    counts = Counter(int(h) >> 44 for r in d.collect() for h in shingler.of(r.text))
    assert len(levels) == 1 << 20 and {k: v for k, v in enumerate(levels.tolist()) if v} == {k: n.bit_length() for k, n in counts.items()}


def test_components_odd_rows(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, ODD)).collect())
    assert got[(5, 1, 5)] == 2 and got[(None, 1, None)] == 1 and got[(2, 0, 2)] == got[(3, 0, 3)] == got[(4, 0, 4)] == 1 and sum(got.values()) == len(ODD)
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0


def test_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(5)
    rows = []
    for f, (size, edits) in enumerate([(1000, 21), (1000, 22), (1000, 30), (300, 5), (300, 9), (60, 1), (60, 2), (3, 0), (3, 1), (4, 0)]):
        base = [f"f{f}w{k}" for k in range(size)]
        for n in range(4):
            text = list(base)
            for at in range(n % 3, n % 3 + edits * (size // max(edits, 1)) * (n > 0), size // max(edits, 1)):
                text[at] = f"e{rng.randrange(10**9)}"
            rows.append((10 * f + n, " ".join(text)))

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    want = {i for i in sets if up[i] == i}
    got = {r.doc_id for r in ngram_join.stage(spark, docs(spark, [*rows, (None, rows[0][1])]), "").collect()}
    assert got == want | {None}
    contract = {r.doc_id for r in ngram_join.ngram_components(docs(spark, rows)).where("component_id = doc_id").collect()}
    assert contract == {i for i, (_, c) in brute_components(rows).items() if c == i} != want


# -- 10: licences


def brute_licenses(text):
    grams = lambda s: (lambda w: set(zip(["", *w], [*w, ""], strict=True)) if w else set())(licenses.words_of(s))
    best = {}
    for n, (kind, k, part) in enumerate(licenses.passages(text)):
        found = []
        for name, texts in sorted(licenses.TEMPLATES.items()):
            for t in texts:
                a, b = grams(part), grams(t)
                if a and 10 * 2 * len(a & b) >= 8 * (len(a) + len(b)):
                    found.append((-2 * len(a & b) / (len(a) + len(b)), name))
        if found:
            d, name = min(found)
            if name not in best or -d > best[name][0]:
                best[name] = (-d, kind, k)
    return {name: (round(d, 6), kind, k) for name, (d, kind, k) in best.items()}


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][-1]
    words = mit.split()
    rows = [
        *ODD,
        (30, "A text.\nLicensed under CC BY-NC 4.0.\nMore."),
        (31, "licensed under the apache license version 2.0"),
        (32, "Intro\n\n" + "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\n\nEnd of it"),
        (33, mit.replace("Software", "Work")),
        (34, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License"),
        (35, "The licence of the driver was taken away under the general public eye."),
        (36, "\n".join(words)),
    ]
    got = defaultdict(dict)
    for r in licenses.scan(docs(spark, rows)).collect():
        got[r.doc_id][r.license] = (r.dice, r.kind, r.number)
    assert dict(got) == {i: b for i, t in rows if (b := brute_licenses(t))}
    assert set(got) == {30, 31, 32, 33, 34, 36} and got[32]["MIT"][1] == "paragraph" and set(got[34]) == {"Apache-2.0", "MIT"}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_notices_inside_longer_passages(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"][-1].split()
    comment = "/*\n * x.c - a file.\n *\n" + "\n".join(" * " + " ".join(gpl[k : k + 10]) for k in range(0, len(gpl), 10)) + "\n *\n * You should have received a copy of it, with this program.\n */\nint main() { return 0; }"
    rows = [
        (1, "Copyright (c) 2020 Example Inc. All rights reserved."),
        (2, "This package is released under the MIT License; see LICENSE for details."),
        (3, "This project is licensed under the MIT License - see the LICENSE file for details"),
        (4, comment),
        (5, "We read that the work is licensed under CC BY-SA 4.0. and that was all we read of it on that day"),
        (6, "All the rights that he had reserved were taken away, under the terms of the general public and in the public domain."),
        (7, "so all rights reserved and then all rights reserved again"),
        (8, None),
    ]
    got = {(r.doc_id, r.license): (r.dice, r.kind, r.number, r.n_matches) for r in licenses.scan(docs(spark, rows)).collect()}
    assert set(got) == {(1, "Proprietary"), (2, "MIT"), (3, "MIT"), (4, "GPL-3.0"), (5, "CC-BY-SA-4.0"), (7, "Proprietary")}
    assert got[1, "Proprietary"] == (1.0, "window", 5, 1) and got[2, "MIT"] == (1.0, "window", 3, 1) and got[7, "Proprietary"] == (1.0, "window", 1, 2)


# -- the pipeline


def test_stages_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    names = ["score", "n_lines", "n_dropped", "ids", "decoded", "n_tokens", "ids_sha256", "lang", "n", "v", "c", "h", "component_id", "item_id", "t", "kinds", "w", "__score", "a.b"]
    for rows in (ODD, []):
        wide = docs(spark, rows).select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in names))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, wide, base)
            path = str(tmp_path / f"{name}-{len(rows)}")
            out.write.parquet(path)
            kept = [c for c in wide.columns if name != "bpe_round_trip" or c not in ("n_tokens", "ids_sha256")]
            assert [c for c in out.columns if c in kept] == kept
            for r in spark.read.parquet(path).collect():
                assert all(r[c] == f"own {c}" for c in kept if c not in ("doc_id", "text"))


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe_round_trip"]
    docs_ = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs_.columns
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, base)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs_, out))
        assert set(after) <= set(before) and after
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(docs_, toxicity.train(docs_, spark.read.parquet(f"{base}/labels.parquet"))).collect()}
            assert set(after) == {i for i in before if scores[i] < 0.5}
        if name == "line_dedup":
            assert after == {i: t for i, _, _, t in brute_lines(sorted(before.items()))}
        if name == "ngram_join":
            assert set(after) == {i for i, (_, c) in brute_components(sorted(before.items())).items() if c == i}
        if name == "decontamination":
            bench = spark.read.parquet(f"{base}/benchmark.parquet")
            assert set(before) - set(after) == {r.doc_id for r in decontamination.matches(docs_, bench).collect()}
        if name == "bpe_round_trip":
            assert after == before
            for r in out.collect():
                ids = tok.encode(r.text, add_special_tokens=False).ids
                assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert out.columns[: len(columns)] == columns and (k == len(names) - 1 or out.columns == columns)
        docs_ = out
