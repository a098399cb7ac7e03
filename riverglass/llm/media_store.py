"""Media columns: content-addressed payloads in tar shards; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lean, table, tidied

#: Bytes in a row of the image; a payload is padded to a positive multiple of it.
WIDTH = 192
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 32 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, IHDR and the metadata chunk: what a header-only range read fetches.
HEADER_BYTES = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """data, then bytes 32 up to a positive multiple of width."""
    return data + b" " * (-len(data) % width if data else width)


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A lossless 8-bit grey image of the payload, width samples a row."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)  # the first byte of a row names its filter: none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict:
    """Width, height, bit depth and colour type, from the first HEADER_BYTES alone."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("no image header")
    return dict(zip(("width", "height", "depth", "colour"), struct.unpack(">IIBB", data[16:26]), strict=True))


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    head, at, packed = png_header(data), 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head["height"], head["width"] + 1)[:, 1:].tobytes()


class TarShard:
    """A tar file of members named by their digest; the same content is held once."""

    def __init__(self, folder: str):
        name = uuid.uuid4().hex  # each attempt of a task writes its own, and rows name the one written
        self.uri = f"{folder}/{name[:2]}/shard-{name}.tar"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.held = store.open_output_stream(path), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        """Offset and length of the member's data."""
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.held[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


ROWS = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def store_payloads(documents: DataFrame, folder: str, *, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length): each text as an image in a tar shard under folder.

    A text's payload is its UTF-8 bytes, padded with spaces to a positive multiple of width; null is empty.
    digest is the SHA-256 of the stored image, so equal texts have equal digests, and a shard stores equal
    images once (one text in several tasks' documents is stored by each of them).

    The shards are written now, once, with a manifest of the rows in folder/manifest; the result reads the
    manifest, so every action on it sees the same shards. A lost or repeated task may leave a shard that no row
    names: such shards are removed here, before the rows are given out. A folder takes one call: one that has a
    manifest raises. Null ids stay null, repeated rows keep a row each, an empty table writes no shard.
    """
    spark, manifest = documents.sparkSession, f"{folder}/manifest"
    _written(documents, folder, width, shard_bytes).write.parquet(manifest)
    rows = spark.read.schema(ROWS).parquet(manifest)
    sweep(rows, folder)
    return rows


def sweep(manifest: DataFrame, folder: str) -> int:
    """Removes the shards under folder that the manifest doesn't name, and says how many; listed and removed by tasks, a subfolder each."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                uri = f"{folder}/{n:02x}"
                store, path = fs.FileSystem.from_uri(uri)
                names = [x.base_name for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
                yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{x}" for x in names], pa.string())], ["shard"])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                store.delete_file(path)
            yield b

    spark = manifest.sparkSession
    there = spark.range(0, 256, 1, 16).mapInArrow(listed, "shard string")
    return there.join(manifest.select("shard").distinct(), "shard", "left_anti").mapInArrow(removed, "shard string").count()


def _written(documents: DataFrame, folder: str, width: int, shard_bytes: int) -> DataFrame:
    """The rows of store_payloads(), as its tasks write the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def done() -> pa.RecordBatch:
            shard.close()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                image = encode_png(pad(data, width), width)
                digest = hashlib.sha256(image).hexdigest()
                shard = shard or TarShard(folder)
                rows.append((doc, len(data), digest, shard.uri, *shard.add(digest, image)))
                if shard.at >= shard_bytes or len(rows) >= 100_000:
                    yield done()
                    shard, rows = None, []
        if rows:
            yield done()

    return lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidied(run), ROWS)


class _Reader:
    """Range reads; the last shard stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def __call__(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file:
                self.file.close()
            store, path = fs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, store.open_input_file(path)
        return self.file.read_at(length, offset)


def with_metadata(rows: DataFrame) -> DataFrame:
    """Adds width, height and depth of each stored image, by reading its header's bytes alone."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", width int, height int, depth int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for b in batches:
            heads = [png_header(read(u, o, HEADER_BYTES)) for u, o in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            more = [pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "depth")]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "width", "height", "depth"])

    return rows.mapInArrow(tidied(run), schema)


def with_payload_digests(rows: DataFrame) -> DataFrame:
    """Adds what reading the stored bytes back shows: the payload's and the image's digests, a CRC and a feature.

    feature is the image's size, then its mean and deviation of samples and the share of its most frequent
    sample; equal payloads have equal features.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, names = _Reader(), ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b, found = whole.slice(k, 2000), []
                for u, o, n, w, h in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "width", "height")), strict=True):
                    image = read(u, o, n)
                    payload = decode_png(image)
                    seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    mean = float(seen @ np.arange(256)) / len(payload)
                    dev = (float(seen @ (np.arange(256) - mean) ** 2) / len(payload)) ** 0.5
                    feature = f"{w}x{h} mean={mean:.4f} dev={dev:.4f} top={int(seen.argmax())}:{seen.max() / len(payload):.4f}"
                    found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(image).hexdigest(), feature))
                cols = list(zip(*found, strict=True)) or [[]] * 5
                more = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    return rows.mapInArrow(tidied(run), schema)


def fetch(rows: DataFrame) -> list[bytes]:
    """Payloads of a few rows, on the driver; the rows' order is that of collect()."""
    read = _Reader()
    return [decode_png(read(r.shard, r.offset, r.length)) for r in rows.select("shard", "offset", "length").collect()]


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store_payloads(table(spark, sf_dir, "documents"), fresh_path(spark, "media"))
    out = with_payload_digests(with_metadata(rows))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "digest", "shard", "offset", "width", "height")
