"""BPE encoding and decoding through tables: distinct words to ids, and ids to pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, aside, carried, lean, pieces, restored, table, tidied
from .word_table import WordTable, pieces_of

#: Bytes of rows whose words or pieces are held at a time: as Python objects they take many times as much.
PIECE_BYTES = 2 << 20
#: Characters of distinct words that a task holds before it tells them.
WORDS_HELD = 4 << 20
#: The table that is broadcast: words at most, and bytes of each.
TABLE_WORDS, TABLE_WORD = 1 << 17, 64
#: Words that a task keeps beside the table, and their characters.
OWN_WORDS, OWN_CHARS = 60_000, 4 << 20


def distinct_words(documents: DataFrame, path: str) -> DataFrame:
    """(word, tasks): the words of all documents, each once, with how many tasks have met it.

    A word is what stands between white space, with one space before it: what the pre-tokenizers never join to its
    neighbours. Each task tells a word once for every WORDS_HELD bytes of distinct ones, so a frequent word is a
    row for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordTable(path), set()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["word"])
        for batch in batches:
            for b in pieces(batch, PIECE_BYTES):
                seen.update(*map(words.chunks, filter(None, b.column(0).to_pylist())))
                if sum(map(len, seen)) > WORDS_HELD:
                    yield told()
                    seen = set()
        yield told()

    rows = lean(documents).selectExpr("cast(text as string) text").mapInArrow(tidied(run), "word string")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("tasks"))


def word_table(documents: DataFrame, path: str) -> dict[str, bytes]:
    """The ids of the words that several tasks have met, each encoded once, most met first up to TABLE_WORDS of at most TABLE_WORD bytes.

    A word that a single task has met is encoded once as well: by that task. Only words beyond the bounds are
    encoded by each task that meets them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(path)
        for b in batches:
            some = b.column(0).to_pylist()
            known = words.ids([some])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known[w] for w in some], pa.binary())], ["word", "ids"])

    several = Saved(distinct_words(documents, path).where((F.col("tasks") > 1) & (F.octet_length("word") <= TABLE_WORD)), "bpe-words")
    least, room = 0, TABLE_WORDS
    for r in sorted(several.df.groupBy("tasks").count().collect(), key=lambda r: -r.tasks):  # a row for each number of tasks
        room -= r["count"]
        if room < 0:
            break
        least = r.tasks
    table = Saved(several.df.where(F.col("tasks") >= (least or 2**62)).select("word").mapInArrow(tidied(run), "word string, ids binary"), "bpe-table")
    out = {r.word: bytes(r.ids) for r in table.df.collect()}  # at most TABLE_WORDS words of TABLE_WORD bytes
    several.drop()
    table.drop()
    return out


def encode(documents: DataFrame, path: str, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, *carry): ids as one binary of little-endian unsigned 32-bit numbers.

    Spark splits the documents into words and makes one table of the distinct ones with their ids (word_table),
    which is broadcast: its size is bounded. Documents are split again and the ids joined back by position. What
    the table doesn't hold, words of a single task, is encoded where it is met; no text and no id is shuffled, and
    a frequent word or a text in thousands of copies costs a lookup.

    Null and empty texts have no ids. Strings of special tokens inside a text become their ids, none are
    added. Very long texts are handled whole, null ids stay null, repeated rows keep a row each, empty
    tables give no rows, other columns than those in carry are not read; a carried doc_id, ids or decoded gets a _ after it.
    """
    read, sent, schema, names = _asked(documents, path, carry)
    return read.mapInArrow(tidied(lambda batches: _encoded(batches, path, sent.value)), schema).withColumnsRenamed(names)


def _asked(documents: DataFrame, path: str, carry: tuple[str, ...]) -> tuple[DataFrame, Broadcast, str, dict[str, str]]:
    """What is read of the documents, the table of words, and the result's schema with the names of what is carried."""
    kinds = dict(documents.dtypes)
    sent = documents.sparkSession.sparkContext.broadcast(word_table(documents, path))
    read = lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *(f"`{c}` as `__{c}`" for c in carry))
    return read, sent, "doc_id bigint, ids binary" + "".join(f", `__{c}` {kinds[c]}" for c in carry), carried(carry, ("doc_id", "ids", "decoded"))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, given: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    words = WordTable(path, given, OWN_WORDS, OWN_CHARS)
    for batch in batches:
        for b in pieces(batch, PIECE_BYTES):
            split = [words.chunks(t or "") for t in b.column(1).to_pylist()]
            find = words.ids(split).__getitem__
            ids = [b"".join(map(find, s)) for s in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *b.columns[2:]], ["doc_id", "ids", *b.schema.names[2:]])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    piece = pieces_of(Tokenizer.from_file(path)).__getitem__
    for batch in batches:
        for b in pieces(batch, PIECE_BYTES):
            found = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "decoded"])


def round_trip(documents: DataFrame, path: str, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, *carry, decoded): decode(encode()) in one pass, so that a task has one worker instead of two."""
    read, sent, schema, names = _asked(documents, path, carry)
    return read.mapInArrow(tidied(lambda batches: _decoded(_encoded(batches, path, sent.value), path)), schema + ", decoded string").withColumnsRenamed(names)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with ids joined to their pieces: adds decoded, drops nothing.

    The id-to-piece table is the vocabulary, so its size is fixed; it goes whole to each task. Bytes that
    are no UTF-8 become U+FFFD, as the library does. An id outside the vocabulary raises. A column decoded is replaced.
    """
    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string"

    return encoded.mapInArrow(tidied(lambda batches: _decoded(batches, path)), schema)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' rows, their text as decoded from its ids, with n_tokens and ids_sha256 beside it, in place of columns of these names."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows, hidden = aside(docs.drop("n_tokens", "ids_sha256"))
    out = round_trip(rows, path, carry=tuple(h for h in hidden if h not in ("doc_id", "text"))).withColumn("text", F.col("decoded"))
    return out.select(*restored(out, hidden), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
