"""Incremental work as Structured Streaming over files (L1-L6), run to the end of what is there (``availableNow``).

Batches write to a directory of their own number, so a batch that is run again overwrites itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from curata.plans.promote import last_writer_wins, upserted


def file_stream(spark: SparkSession, path: str, schema: StructType, files_each: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run all batches there are."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _batch_sink(out: str, made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, number: int) -> None:
        made(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def deltas(stream: DataFrame, known: DataFrame, keys: list[str], order: list[str], out: str, checkpoint: str, buckets: int = 64) -> None:
    """L1: rows whose (value, confidence) differs from the last known one of their key: that of an earlier row of the stream, in whatever batch, else
    that of ``known``. Null equals nothing, as in a comparison of columns.

    The last one of each key is kept beside the checkpoint in buckets by key (as ``folded`` does), so a query that is started again continues. Rows meet
    the kept ones in one window by key; a batch that is run again starts from the manifest before it.
    """
    bucket, state = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), f"{checkpoint.rstrip('/')}-state"
    told = lambda df: df.withColumns({"_v": F.col("value").cast("string"), "_c": F.nanvl(F.col("confidence").cast("double"), F.lit(None).cast("double"))})
    kept = told(stream).select(*keys, *[c for c in order if c not in keys], "_v", "_c").schema
    first = known.groupBy(*keys).agg(F.max(F.struct(*order, F.struct("value", "confidence").alias("_k"))).alias("_k"))
    first = told(first.select(*keys, "_k._k.*")).drop("value", "confidence").withColumn("_from", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("_from", *order)

    def step(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        held, touched = _manifest(spark, state, number - 1) if number else {}, {r[0] for r in df.select(bucket).distinct().collect()}
        # What an earlier batch kept comes after what was known at first, and before what is new.
        every = told(df).withColumn("_from", F.lit(2)).unionByName(_bucket_rows(spark, state, kept, {b: n for b, n in held.items() if b in touched}).withColumn("_from", F.lit(1)), allowMissingColumns=True)
        every = every.unionByName(first.where(bucket.isin(*touched)), allowMissingColumns=True)
        last = F.lag(F.struct("_v", "_c")).over(w)
        same = F.coalesce((last["_v"] == F.col("_v")) & (last["_c"] == F.col("_c")), F.lit(False))
        # The next row of a key tells whether this one is its last.
        met = every.withColumns({"_news": ~same, "_last": F.lead("_from").over(w).isNull()}).where("_from > 0").persist(StorageLevel.DISK_ONLY)
        met.where("_from = 2 AND _news").select(*df.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")
        _put(spark, met.where("_last").select(*kept.names), bucket, state, number, held)
        met.unpersist()

    drain(stream, step, checkpoint)


def _track(key, frames, state: GroupState):
    """Rows of one url, by version and content, against the hash kept for it."""
    last, count = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames))
    out = []
    for version, content in sorted(zip(rows["version"], rows["content"].fillna(""), strict=True)):
        digest = hashlib.sha256(content.encode()).hexdigest()
        status = "new" if last is None else "unchanged" if digest == last else "changed"
        count += digest != last
        last = digest
        out.append((key[0], int(version), status, count))
    state.update((last, count))
    yield pd.DataFrame(out, columns=["url", "version", "status", "n_versions"])


def changes(stream: DataFrame, out: str, checkpoint: str) -> None:
    """L2: (url, version, content) to new, unchanged or changed, with the number of versions so far; the state is a hash per url.

    Rows of one url and version (no content: empty) count in the order of their content. They must come in one batch, and later versions not before it.
    """
    tracked = stream.groupBy("url").applyInPandasWithState(
        _track, "url string, version long, status string, n_versions long", "hash string, n long", "append", GroupStateTimeout.NoTimeout
    )
    query = tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ledger(stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str) -> None:
    """L3: an append-only ledger of keys. The state store holds each key's first row by ``order``, whatever the order of arrival; a batch
    appends the keys that are new or have an earlier row than before. A batch that is run again overwrites itself."""
    rest = [c for c in stream.columns if c != key and c not in order]
    first = stream.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))

    def append(df: DataFrame, number: int) -> None:
        df.select(key, "_first.*").select(*stream.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = first.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ledger_rows(spark: SparkSession, out: str, schema: StructType, key: str, order: list[str]) -> DataFrame:
    """Each key of a ledger once, with its first row by ``order``."""
    rest = [c for c in schema.names if c != key and c not in order]
    rows = spark.read.schema(schema).parquet(f"{out}/batch=*")
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(key, "_first.*").select(*schema.names)


def _manifest(spark: SparkSession, out: str, number: int) -> dict[int, int]:
    """Bucket -> batch that wrote it last, as of a batch (-1: the start); as many entries as buckets."""
    rows = spark.read.schema("bucket int, batch int").json(f"{out}/manifest={number}").collect()
    return {r["bucket"]: r["batch"] for r in rows}


def _bucket_rows(spark: SparkSession, out: str, schema: StructType, held: dict[int, int]) -> DataFrame:
    paths = [f"{out}/batch={n}/_bucket={b}" for b, n in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _put(spark: SparkSession, df: DataFrame, bucket: Column, out: str, number: int, held: dict[int, int]) -> None:
    """Write buckets of a batch, then the manifest that names the last file of each bucket."""
    path = f"{out}/batch={number}"
    df.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    new = {r[0]: number for r in spark.read.schema("_bucket int").parquet(path).distinct().collect()}  # a row for each bucket at most
    rows = sorted((held | new).items())
    spark.createDataFrame(rows, "bucket int, batch int").coalesce(1).write.mode("overwrite").json(f"{out}/manifest={number}")


def folded(stream: DataFrame, start: DataFrame, key: str, fold: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str, buckets: int = 64) -> int:
    """A state folded over all batches, in buckets by a hash of ``key``: a batch reads and writes only buckets that it has keys of, and then a
    manifest that names the last file of each. ``fold`` must work key by key. A batch that is run again starts from the manifest before
    it, so it gives the same. Returns the number of the last batch (-1: none)."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    last = {"batch": -1}

    def put(df: DataFrame, number: int, held: dict[int, int]) -> None:
        _put(df.sparkSession, df, bucket, out, number, held)
        last["batch"] = number

    def step(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        held, touched = _manifest(spark, out, number - 1), {r[0] for r in df.select(bucket).distinct().collect()}
        state = _bucket_rows(spark, out, start.schema, {b: n for b, n in held.items() if b in touched})
        put(fold(state, df), number, held)

    if not _exists(start.sparkSession, f"{out}/manifest=-1/_SUCCESS"):
        put(start, -1, {})
    drain(stream, step, checkpoint)
    return last["batch"]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def state_rows(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The rows of a folded state as of its newest complete manifest."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    newest = max(int(f.getPath().getParent().getName().split("=")[1]) for f in found)
    return _bucket_rows(spark, out, schema, _manifest(spark, out, newest))


def streamed_upserts(stream: DataFrame, current: DataFrame, key: str, sequence: str, out: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """L4: the state after all batches."""
    folded(stream, current, key, lambda state, df: upserted(state, df, key, sequence), out, checkpoint, buckets)
    return state_rows(current.sparkSession, out, current.schema)


def synced(stream: DataFrame, current: DataFrame, key: str, updated: str, as_of: str, out: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Device batches, the later update wins."""
    folded(stream, current, key, lambda state, df: last_writer_wins(state, df, key, updated, as_of), out, checkpoint, buckets)
    return state_rows(current.sparkSession, out, current.schema)


def queue(stream: DataFrame, conflict: str, out: str, checkpoint: str) -> None:
    """Conflicts appended as pending."""
    drain(stream, _batch_sink(out, lambda df: df.where(conflict).withColumn("status", F.lit("pending"))), checkpoint)


def pending(spark: SparkSession, out: str, schema: StructType, order: list[str], n: int) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{out}/batch=*")
    return rows.where("status = 'pending'").orderBy(*order).limit(n)
