"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Fixed value: the white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.
BATCH = 1000

_kept: dict[Hashable, object] = {}


def worker_value(key: Hashable, make: Callable[[], object]):
    """A value that a Python worker makes once and keeps for its later tasks; only the last one is kept."""
    if key not in _kept:
        forget_values()
        _kept[key] = make()
    return _kept[key]


def forget_values() -> None:
    """Free what an earlier stage left in this worker, and give the memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Give freed memory back to the system: an idle worker waits with little, beside the JVM that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc keeps freed memory otherwise
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after telling its session to send BATCH rows at a time to Python where it would send more.

    Rows are whole texts here, and Arrow holds a batch outside the heap on both sides.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as make it none of df's columns (Spark doesn't tell a from A)."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        return name

    return [free(n) for n in names]


def as_id(df: DataFrame, name: str, to: str = "doc_id") -> Column:
    """An identifier as long."""
    return df[name].cast("long").alias(to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
