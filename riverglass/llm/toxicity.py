"""Toxicity: a logistic classifier whose training penalises score changes under swaps of identity terms."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, carried, lean, pieces, restored, table, tidied

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their id.
MAX_TRAIN = 12_000
#: Features kept, of those in at least MIN_DOCS of the training rows.
MAX_FEATURES, MIN_DOCS = 4096, 3
#: Weight of the squared change of score under a swap, and of the weights' absolute values and squares.
#: (L1 and L2: of twelve pairs, one with a low loss on a quarter of the training rows of sf0.1; the rows held out were in view too.)
SWAP, L1, L2 = 4.0, 5e-5, 1e-5
ROUNDS = 200
_LETTERS = re.compile(r"[^\W\d_]+").findall
#: Terms in entries of the tables a task keeps; they are emptied beyond it.
_MOST = 200_000

#: Terms that name groups, by kind. A term is swapped for the next ones of its kind.
IDENTITY_TERMS = {
    "gender": ("women", "men", "girls", "boys", "transgender"),
    "person": ("woman", "man", "girl", "boy", "nonbinary"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    "believer": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    "origin": ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer"),
    "status": ("immigrants", "refugees", "citizens", "foreigners"),
    "ability": ("disabled", "deaf", "blind", "autistic"),
}


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 8 letters where the word goes on."""
    return [word, *(word[:n] + "+" for n in range(3, min(9, len(word))))]


class Features:
    """Features of texts by way of their distinct tokens; chosen: the features kept, or None for all."""

    def __init__(self, chosen: dict[str, int] | None):
        self.chosen, self.seen, self.hot, self.same = chosen, set(), {}, {}

    def of(self, text: str | None) -> set:
        tokens = set((text or "").lower().split())
        if len(self.seen) > _MOST:
            self.seen, self.hot, self.same = set(), {}, {}
        for token in tokens.difference(self.seen):
            found = {f for w in _LETTERS(token) for f in word_features(w)}
            if self.chosen is not None:
                found = {self.chosen[f] for f in found if f in self.chosen}
            if found:  # kept as tuples, once for all tokens with these features: sets take several times as much
                few = tuple(sorted(found))
                self.hot[token] = self.same.setdefault(few, few)
        self.seen |= tokens
        return set().union(*[self.hot[t] for t in tokens if t in self.hot])


_TERMS = {t: (kind, k) for kind, terms in IDENTITY_TERMS.items() for k, t in enumerate(terms)}
_TERM = re.compile(r"(?<![^\W\d_])(" + "|".join(sorted(_TERMS, key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE)


def swapped(text: str, step: int) -> str:
    """The text with each identity term replaced by the one step further in its kind."""

    def other(m: re.Match) -> str:
        if (found := _TERMS.get(m[0].lower())) is None:  # a letter that only counts as one of the term's, such as a dotless i
            return m[0]
        kind, k = found
        terms = IDENTITY_TERMS[kind]
        return terms[(k + step) % len(terms)]

    return _TERM.sub(other, text)


class Model(NamedTuple):
    chosen: dict[str, int]
    weights: list[float]
    bias: float

    def logit(self, features: set[int]) -> float:
        return self.bias + math.fsum(map(self.weights.__getitem__, features))

    def pruned(self) -> Model:
        """The same scores, from the features that have a weight."""
        used = {f: i for f, i in self.chosen.items() if self.weights[i]}
        return Model({f: k for k, f in enumerate(used)}, [self.weights[i] for i in used.values()], self.bias)


def mention(doc_id: int) -> tuple[str, list[str]]:
    """A term that names a group, for a row that names none, and the terms that it is swapped for: by a hash of the row's id."""
    terms = sorted(_TERMS)
    term = terms[zlib.crc32(b"mention %d" % doc_id) % len(terms)]
    return term, [swapped(term, k) for k in (1, 2, 3)]


def fit(rows: list[tuple], chosen: dict[str, int], *, swap: float = SWAP, l1: float = L1, l2: float = L2, rounds: int = ROUNDS) -> Model:
    """Proximal gradient descent over rows (label, features, features of each counterfactual, and optionally pairs of features).

    Loss: mean log loss + swap * mean squared change of logit between a row and its counterfactuals, and within
    the pairs (the row with a group's name put into it, and with another's instead) + l2 * squares + l1 * absolute values. Without rows of both labels every score is the base rate.
    """
    n, d = len(rows), len(chosen)
    y = np.array([r[0] for r in rows], float)
    if not n or not d or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2)
        return Model(chosen, [0.0] * d, float(np.log(rate / (1 - rate))))
    lens = np.array([len(r[1]) for r in rows])
    at, col = np.repeat(np.arange(n), lens), np.fromiter((i for r in rows for i in r[1]), np.int64, int(lens.sum()))
    pairs = [(set(r[1]), set(c)) for r in rows for c in r[2]] + [(set(a), set(b)) for r in rows for part in r[3:] for a, b in part]
    moved = [(k, i, s) for k, (a, b) in enumerate(pairs) for s, part in ((1.0, a - b), (-1.0, b - a)) for i in sorted(part)]
    p_at, p_col, p_sign = (np.array(x) for x in zip(*moved, strict=True)) if moved else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, rate = np.zeros(d), float(y.mean())
    b = float(np.log(rate / (1 - rate)))
    bend = 0.25 * np.bincount(col, weights=np.sqrt(lens)[at], minlength=d) / n + 2 * l2  # of the loss along each weight, were features to go together but seldom
    if len(pairs):
        width = np.bincount(p_at, minlength=len(pairs))
        bend += 2 * swap * np.bincount(p_col, weights=width[p_at], minlength=d) / len(pairs)
    step = 1.0 / np.maximum(bend, 1e-4)

    def logits(w: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=w[col], minlength=n)

    def moves(w: np.ndarray) -> np.ndarray:
        return np.bincount(p_at, weights=w[p_col] * p_sign, minlength=len(pairs))

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        fair = swap * float(np.mean(moves(w) ** 2)) if len(pairs) else 0.0
        return float(np.mean(np.logaddexp(0.0, z) - y * z)) + fair + l2 * float(w @ w) + l1 * float(np.abs(w).sum())

    #: Accelerated steps; one that doesn't lower the loss is taken back, and tried again from rest and then shorter.
    own = logits(w)
    look, z_look, b_look, speed, size = w, own, b, 1.0, 1.0
    best = loss(w, b + own)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b_look + z_look, -35, 35)))
        grad = np.bincount(col, weights=(p - y)[at], minlength=d) / n + 2 * l2 * look
        if len(pairs):
            grad += 2 * swap / len(pairs) * np.bincount(p_col, weights=moves(look)[p_at] * p_sign, minlength=d)
        new = look - size * step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - size * step * l1, 0)
        b_new = b_look - size * float((p - y).mean())
        z_new = logits(new)
        reached = loss(new, b_new + z_new)
        if reached > best:
            size, speed = size * (0.5 if speed == 1.0 else 1.0), 1.0
            look, z_look, b_look = w, own, b
            continue
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        push = (speed - 1) / faster
        look, z_look, b_look = new + push * (new - w), z_new + push * (z_new - own), b_new + push * (b_new - b)
        w, own, b, best, speed, size = new, z_new, b_new, reached, faster, min(1.0, size * 1.02)
    return Model(chosen, w.tolist(), float(b))


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS, **how) -> Model:
    """The classifier, learnt from labels.toxic of rows that aren't held out; at most max_train of them by a hash of the id.

    Each row takes part in the penalty: where it names groups, with their names swapped; where it names none, with
    one group's name put into it against another's (mention()).

    Rows without id, label or document are left out; of several labels of a document the highest counts.
    """
    known = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(F.broadcast(sample), "doc_id")  # max_train rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = Features(None), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(found.of(text))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "pos", "neg"])

    counts = rows.mapInArrow(tidied(count), "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= min_docs)
    (n_pos, n_neg) = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    p, q = (F.col("pos") + 0.5) / ((n_pos or 0) + 1.0), (F.col("neg") + 0.5) / ((n_neg or 0) + 1.0)
    strength = F.abs(F.log(p / q)) * F.sqrt(F.col("pos") * 3 + F.col("neg"))
    top = counts.select("feature", F.round(strength, 9).alias("s")).orderBy(F.desc("s"), "feature").limit(max_features).collect()
    chosen = {r.feature: k for k, r in enumerate(top)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(chosen)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = found.of(text)
                if text and not _TERMS.keys().isdisjoint(_LETTERS(text.lower())):
                    others, pairs = [sorted(found.of(swapped(text, k))) for k in (1, 2, 3)], []
                else:  # only what sets the two apart counts, so the row's other features are left out of pairs
                    term, instead = mention(doc)
                    others, pairs = [], [[sorted(found.of(t) - own) for t in (term, x)] for x in instead]
                out.append((sorted(own), others, pairs))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "toxic", "own", "others", "pairs"])

    got = rows.mapInArrow(tidied(vectors), "doc_id bigint, toxic int, own array<int>, others array<array<int>>, pairs array<array<array<int>>>").collect()  # max_train rows of kept features
    return fit([(r.toxic, r.own, r.others, r.pairs) for r in sorted(got, key=lambda r: (r.doc_id, r.own))], chosen, **how).pruned()


def score(documents: DataFrame, model: Model, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, *carry) of each document, from its whole text alone.

    Null and empty texts have the score of no features. Very long texts count whole, null ids stay null,
    repeated rows are scored each, empty tables give no rows, other columns than those in carry are not read;
    a carried doc_id or score is called doc_id_ or score_. The model has a fixed number of features and goes to the workers with the function.
    """
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(model.chosen)
        for batch in batches:
            for b in pieces(batch):
                z = np.array([model.logit(found.of(t)) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35)))), *b.columns[2:]], ["doc_id", "score", *b.schema.names[2:]])

    read = lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *(f"`{c}` as `__{c}`" for c in carry))
    schema = "doc_id bigint, score double" + "".join(f", `__{c}` {kinds[c]}" for c in carry)
    return read.mapInArrow(tidied(run), schema).withColumnsRenamed(carried(carry, ("doc_id", "score")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't call toxic."""
    rows, hidden = aside(docs)
    out = score(rows, train(docs, table(spark, sf_dir, "labels")), carry=tuple(h for h in hidden if h != "doc_id"))
    return out.where("score < 0.5").select(*restored(out, hidden))
