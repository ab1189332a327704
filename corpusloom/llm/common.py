"""Shared plumbing: small Arrow batches, whole texts as byte arrays, lineage cuts, names that do not clash."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..batches import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401

#: Text bytes worked on at once inside Python; a single longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Whether Spark deletes a query's shuffle files when the query ends; it looks when the query's frame is made.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and driver and executors are one
    process. A cluster must name a folder that all its machines share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="loom-")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. The shuffle files behind it go once it is written: nothing reads them again,
    and otherwise those of a whole operator stay until the driver happens to collect its garbage."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    now = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        same = df.select("*")
    finally:
        spark.conf.set(FILE_CLEANUP, now)
    return same.checkpoint(eager=True)


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: no name can clash with those that an operator adds."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def as_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings of an Arrow array end to end, and their offsets; null is empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(array) + 1, array.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts have about `limit` bytes together, with the bytes and offsets of the texts."""
    for batch in batches:
        index = batch.schema.get_field_index(column)
        data, offs = as_bytes(batch.column(index))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
