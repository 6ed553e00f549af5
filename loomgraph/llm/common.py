"""Helpers shared by the operators: the shared folder, written tables, byte vectors."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (one
    machine) may leave it unset; then a folder is chosen and set here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; cuts the lineage."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps that nothing refers to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``BATCH_ROWS`` (a smaller setting stays), so that batches of long texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Give freed memory of a Python worker back; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` (batches -> batches), after which the worker gives memory back."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with blanks after it: a column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def local_path(uri: str) -> tuple:
    """(pyarrow file system, path) of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        path = uri[5:]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def byte_view(texts: pa.Array, end: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by ``end`` (nulls are empty), and n+1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if end:
        texts = pc.binary_join_element_wise(texts, pa.scalar(end, pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()))
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            out.append((first, i))
            first, total = i, 0
        total += n
    if len(sizes) > first:
        out.append((first, len(sizes)))
    return out
