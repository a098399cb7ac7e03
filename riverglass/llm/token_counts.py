"""Token counts: the exact count at every prefix is stored, so truncation and budgets need no new encoding."""

from __future__ import annotations

import functools
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, named, pieces, table, tidied
from .word_table import WordTable, byte_of_char

LIMIT = 2048
#: Bytes of rows whose chunks are held at a time: as Python objects they take many times as much.
PIECE_BYTES = 4 << 20
OUT = "doc_id bigint, n_bytes bigint, n_tokens bigint, ends array<int>, counts array<int>"


class PrefixTable:
    """For each distinct chunk of text: where its words end, and the tokens up to there; as flat arrays."""

    def __init__(self, path: str, most: int = 200_000, most_bytes: int = 16 << 20):
        self.words, self.most, self.most_bytes = WordTable(path), most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        #: Of each chunk: characters, tokens, words, and the place of its first word; of each word: its end in the chunk, tokens up to there.
        self.chars, self.tokens, self.n_words, self.first, self.ends, self.counts = (array("i") for _ in range(6))

    def add(self, chunks: Iterable[str]) -> None:
        split = {c: self.words.words_of(c) for c in chunks}
        ids = self.words.ids(list(split.values()))
        for chunk, words in split.items():
            self.row[chunk] = len(self.chars)
            self.first.append(len(self.ends))
            self.n_words.append(len(words))
            self.ends.extend(itertools.accumulate(map(len, words)))
            self.counts.extend(itertools.accumulate(len(ids[w]) >> 2 for w in words))
            self.chars.append(len(chunk))
            self.tokens.append(self.counts[-1] if words else 0)
            self.held += len(chunk)

    def of(self, texts: list[str], prefixes: bool) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Tokens of each text, and where its words end with the tokens up to there: counts[k] = counts[k-1] + those of word k."""
        if len(self.row) > self.most or self.held > self.most_bytes:
            self.clear()
        split = [self.words.chunks(t) for t in texts]
        self.add(set().union(*split).difference(self.row))
        n = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.row.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        table = {k: np.frombuffer(getattr(self, k), np.int32) if len(self.row) else np.zeros(0, np.int32) for k in ("chars", "tokens", "n_words", "first", "ends", "counts")}
        last = np.cumsum(n)
        before = lambda values: np.concatenate(([0], np.cumsum(values)))
        tokens, chars = before(table["tokens"][rows]), before(table["chars"][rows])
        total = tokens[last] - tokens[last - n]
        if not prefixes:
            return total, *[pa.nulls(len(texts), pa.list_(pa.int32()))] * 2
        words = table["n_words"][rows].astype(np.int64)
        sums = before(words)
        of_chunk = np.repeat(np.arange(len(rows)), words)
        source = table["first"][rows][of_chunk] + np.arange(sums[-1]) - sums[:-1][of_chunk]
        base = np.repeat(last - n, n)  # the first chunk of each chunk's text
        lists = []
        for values, run in ((table["ends"], chars), (table["counts"], tokens)):
            flat = values[source] + (run[:-1] - run[base])[of_chunk]
            lists.append(pa.ListArray.from_arrays(np.concatenate(([0], sums[last])).astype(np.int32), flat.astype(np.int32)))
        return total, *lists


def prefix_counts(documents: DataFrame, path: str, *, prefixes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ends, counts): counts[k] tokens encode the text's first ends[k] characters.

    The prefixes are those that end with a word; the program runs over words, each distinct word's count
    taken from a table: counts[k] = counts[k-1] + count of word k. Inside a word, count_at() continues the
    program over characters. prefixes=False leaves both arrays null and keeps the last count alone.

    Null text counts as empty: 0 bytes, 0 tokens, empty arrays. Strings of special tokens inside a text
    count as the library counts them; no tokens are added. Very long texts are handled whole, null ids stay
    null, repeated rows are counted each, empty tables give no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PrefixTable(path)
        for batch in batches:
            for b in pieces(batch, PIECE_BYTES):
                texts = [t or "" for t in b.column(1).to_pylist()]
                total, ends, counts = known.of(texts, prefixes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(total, pa.int64()), ends, counts],
                    ["doc_id", "n_bytes", "n_tokens", "ends", "counts"],
                )

    return lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidied(run), OUT)


def kept_chars(limit: int | Column) -> Column:
    """Characters of the longest stored prefix with at most limit tokens (0 if even the first word has more)."""
    fit = F.size(F.filter("counts", lambda c: c <= limit))
    return F.when(fit > 0, F.element_at("ends", F.greatest(fit, F.lit(1)))).otherwise(0)


def truncated(documents: DataFrame, counted: DataFrame, limit: int) -> DataFrame:
    """The documents, each cut at its longest stored prefix of at most limit tokens; nothing is encoded again.

    counted: prefix_counts() of the same documents. Rows meet by doc_id, null ids too, and among rows of one id by
    the text's length in bytes; where repeated ids have texts of one length, the shortest stored prefix counts for
    all of them, so no row has over limit tokens. A row without stored counts keeps its text as null; repeated rows
    stay one row each, and columns of any other names stay as they are.
    """
    cut = counted.select(F.col("doc_id").alias("__id"), F.col("n_bytes").alias("__bytes"), kept_chars(limit).alias("__kept")).groupBy("__id", "__bytes").agg(F.min("__kept").alias("__kept"))
    bytes_ = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    met = documents.join(cut, documents.doc_id.cast("bigint").eqNullSafe(cut["__id"]) & (bytes_.cast("bigint") == cut["__bytes"]), "left")
    return met.select(*(F.substring(documents["text"].cast("string"), F.lit(1), F.col("__kept")).alias("text") if c == "text" else documents[named(c)] for c in documents.columns))


class InsideWord:
    """Token counts at every prefix of one word, for a vocabulary with word ends.

    last[i] is the token that ends the encoding of the first i characters' bytes while the word goes on:
    the one token t of the vocabulary that ends there and that the encoder leaves apart from last[i - len(t)].
    A prefix taken as a word itself ends likewise with a token that has the word end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        import json

        model = json.loads(self.whole.to_str())["model"]
        self.suffix, self.vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.open = BPE(self.vocab, [tuple(m) for m in model["merges"]])
        self.longest = max(map(len, self.vocab))
        self.char = {b: c for c, b in byte_of_char().items()}
        self.apart = functools.lru_cache(1 << 16)(self._apart)

    def _apart(self, left: str, right: str, last: bool) -> bool:
        """Whether the encoder leaves the two tokens apart when they stand side by side."""
        model = self.whole.model if last else self.open
        found = [t.value for t in model.tokenize(left + right)]
        return found == ([left] if left else []) + [right + self.suffix * last]

    def counts(self, word: str) -> list[int]:
        """Tokens of word[:i], as a text of its own, for i = 1..len(word)."""
        text = "".join(self.char[b] for b in word.encode())
        ends = list(itertools.accumulate(len(c.encode()) for c in word))
        last, count, out = {0: ""}, {0: 0}, {}
        for i in range(1, len(text) + 1):
            for at in range(max(0, i - self.longest), i):
                if at not in last:
                    continue
                token = text[at:i]
                if i not in last and token in self.vocab and self.apart(last[at], token, False):
                    last[i], count[i] = token, count[at] + 1
                if i not in out and token + self.suffix in self.vocab and self.apart(last[at], token, True):
                    out[i] = count[at] + 1
                if i in last and i in out:
                    break
        return [out[e] for e in ends]


def count_at(text: str, ends: list[int], counts: list[int], at: int, inside: InsideWord) -> int:
    """Tokens of text[:at]: a stored count, and where the cut is inside a word, the program over that word."""
    k = int(np.searchsorted(ends, at, side="right"))
    before, start = (counts[k - 1], ends[k - 1]) if k else (0, 0)
    rest = text[start:at]
    part = inside.whole.normalizer.normalize_str(rest).lstrip()
    if len(inside.whole.pre_tokenizer.pre_tokenize_str(part)) > 1:  # an entry that the library alone can split
        return before + len(inside.whole.encode(rest, add_special_tokens=False).ids)
    return before + (inside.counts(part)[-1] if part else 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.size("ends").alias("n_prefixes"), kept_chars(LIMIT).alias("chars_within_limit"))
