"""Places that driver and executors share.

Everything that outlives a stage goes below ``spark.checkpoint.dir`` (any
filesystem that Spark and pyarrow can both open). A session without that
setting, such as a local test, gets a temporary folder of its own; on a cluster it is refused.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the session's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="curata-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, prefixed so that no column of ``df`` has them."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def identity(*columns: str) -> tuple[Column, Column]:
    """128 bits that stand for the values of some columns, nulls told apart: two keys to join rows by, and to number equal rows by
    without another shuffle."""
    parts = [p for c in columns for p in (F.col(quoted(c)), F.col(quoted(c)).isNull())]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def quoted(name: str) -> str:
    """A column name for ``select``, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of this module's, through whatever filesystem Spark has for it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Shelf:
    """Intermediate tables by name: a table put under a name again takes the place of the one before, which is deleted.

    So a loop that stores its state each round keeps one copy on disk; what is put must not be read lazily later on by
    anything that is not stored itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                removed(self.spark, self.paths.pop(name))


def filesystem(path: str):
    """(pyarrow filesystem, path in it, whether it is a plain local path)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, True
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, isinstance(store, fs.LocalFileSystem)


def write_bytes(path: str, *arrays: np.ndarray) -> None:
    store, inner, _ = filesystem(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as out:
        for a in arrays:
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.size else b"")


def map_file(path: str, dtype: str) -> np.ndarray:
    """The whole file as an array: memory-mapped where the store is a mounted folder, else read."""
    store, inner, local = filesystem(path)
    if store.get_file_info(inner).size == 0:
        return np.empty(0, dtype)
    if local:
        return np.memmap(inner, dtype=dtype, mode="r")
    with store.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype)


def parts_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Partitions for a shuffle of ``df``: the session's setting, more where the plan's size estimate asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // bytes_each))
