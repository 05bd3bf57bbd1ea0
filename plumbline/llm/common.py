"""What the corpus operators share: tables, the shared folder, words, hashed order."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one where they are one process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), whose files Spark's cleaner removes when the frame is gone."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tidy(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """batches, which gives the memory it is done with back to the system: workers live on and do other stages' tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)

    return run


#: Rows of a small table to a file, and files at least.
ROWS_A_FILE, LEAST_FILES = 200_000, 8


def compact(df: DataFrame, most_rows: int) -> DataFrame:
    """df, which has most_rows narrow rows at most, in as few partitions as these need: a file each when it is written."""
    return df.coalesce(max(LEAST_FILES, -(-most_rows // ROWS_A_FILE)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % k


#: Bytes of one text that are cut into words at a time.
BLOCK = 1 << 22
SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, a bounded number at a time."""
    if len(data) <= BLOCK:
        yield data.split()
        return
    data, at = data.translate(SPACE), 0
    while at < len(data):
        end = len(data) if at + BLOCK >= len(data) else data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
