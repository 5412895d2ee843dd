"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import discard, materialize  # noqa: F401

#: A word is a run of anything but ASCII white space; Java regex syntax.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches, rows: int = 512):
    """Arrow batches in slices, so that few texts at a time are Python objects."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def release() -> None:
    """Gives memory that a worker has freed back to the system: idle workers keep what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def planes(x: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes, first all low bytes: those of small numbers compress well."""
    size = x.dtype.itemsize
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    """The numbers of ``planes``."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
