"""What the operators of this subpackage share: tables, shared folders, Arrow passes."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
#: Bytes in a batch of rows for a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, as the cluster names it.

    Only where it is unset and Spark runs in one process (tests) is a folder of our own made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="riverglass-")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Saved:
    """A table written to the shared folder: lineage ends here and a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, tag)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    return Saved(df, tag).df


def named(column: str) -> str:
    """The column's name as an expression, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def aside(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column but its own under a name that no operator adds, and those names with the old ones, in order."""
    hidden = {c if c in own else f"__aside_{k}": c for k, c in enumerate(docs.columns)}
    return docs.toDF(*hidden), hidden


def restored(out: DataFrame, hidden: dict[str, str]) -> list[Column]:
    """The columns that aside() put away, by their old names."""
    return [out[h].alias(c) for h, c in hidden.items()]


def carried(carry: tuple[str, ...], own: tuple[str, ...]) -> dict[str, str]:
    """What carried columns are called in an operator's result: their own names, with a _ after one that the operator adds itself."""
    return {f"__{c}": c if c not in own else f"{c}_" for c in carry}


#: Document ids that are broadcast at most: 8 bytes each.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The docs whose doc_id isn't among gone (distinct doc_ids), in their own columns; rows without doc_id stay.

    Up to BROADCAST_IDS the ids go to the documents; more of them meet the documents in a shuffle.
    """
    table = Saved(gone.select(F.col("doc_id").alias("__gone")), "gone-ids").df
    few = table.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(table) if few else table, docs.doc_id == table["__gone"], "left_anti").select(*(docs[named(c)] for c in docs.columns))


def lean(df: DataFrame) -> DataFrame:
    """The same rows; their session sends batches of at most BATCH_BYTES to Python, unless it sets a size of its own."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "64m")
    if df.sparkSession.conf.get(key, usual[0]) in usual:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives its memory back: Spark uses the same worker for other tasks and stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def pieces(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes, so that very long texts don't multiply in memory."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most_bytes / max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
