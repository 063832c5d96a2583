"""Tables that are computed once and read again, in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The frames and models that each application holds, by name, source and the source's stamp.
_HELD: dict[tuple[str, str, str], Any] = {}
#: The folders of stored tables that :func:`forget` removes, with the session that made them.
_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder; on a cluster, whose executors wouldn't see it, this is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read back; removed as the session's JVM ends."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forgotten(spark: SparkSession, path: str) -> None:
    """Has :func:`forget` remove the folder."""
    if (spark, path) not in _FOLDERS:
        _FOLDERS.append((spark, path))


def stamp(spark: SparkSession, source: str) -> str:
    """What a source folder holds now: names, sizes and times of its files and of the folders in it.

    A folder's time changes as files come into it or leave it, so one listing of the source tells, however many files its
    tables have. A file in a table's folder that is written over in place goes unseen."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    entries = system.listStatus(at) if system.exists(at) else []
    seen = sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries)
    return hashlib.sha256(repr(seen).encode()).hexdigest()


def once(spark: SparkSession, name: str, source: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives at its first use for the tables in ``source``, and the same until one of them changes."""
    key = (spark.sparkContext.applicationId, f"{name} of {source}", stamp(spark, source))
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def held(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the tables in ``source``: stored at its first use, and the same table until one of them changes."""

    def kept() -> DataFrame:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _FOLDERS.append((spark, path))
        return stored(make(), name, path)

    return once(spark, name, source, kept)


def forget() -> None:
    """Drops what is held and removes its tables, so that it is made anew from the sources; frames that read them no longer work."""
    _HELD.clear()
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
