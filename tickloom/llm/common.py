"""Helpers that the document operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

#: ASCII white space, the only separators of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The given names, each lengthened until it clashes with no column (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no returned result reads."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept from task to task."""
    store = sys.modules.setdefault("tickloom_worker_state", types.ModuleType("tickloom_worker_state")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of one column, so that memory stays bounded."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * limit / max(1, b.column(column).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def join_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """Join with a staged table of one row per id; it is broadcast only while it has at most ``most`` rows."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, on, how)


def long_id(name: str) -> Column:
    return F.col(f"`{name}`").cast("long")
