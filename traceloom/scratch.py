"""Tables in the shared folder that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine (master ``local[..]``) that names none gets a folder of its
    own. On a cluster that would be a folder which executors don't share: an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Drops a query's shuffle files when it has ended; what it wrote is in the shared folder by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/traceloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._traceloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no plan reads any more."""
    for table in tables:
        _remove(table._traceloom_path)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], None]]:
    """Removes the tables written within it, but those that are given to what it yields."""
    before, kept = set(_written), set()
    yield lambda table: kept.add(table._traceloom_path)
    for path in [p for p in _written if p not in before and p not in kept]:
        _remove(path)


def _remove(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session has ended; the cluster's own clean-up has to do it
            return
