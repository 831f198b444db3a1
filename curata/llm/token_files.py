"""Token ids as flat binary files.

A shard is three flat little-endian files: ``.bin`` (unsigned ids of all documents, 16 bits where the vocabulary
allows, else 32), ``.idx`` (unsigned 64-bit offsets into it, documents + 1) and ``.doc`` (64-bit document ids, then
a byte each that is 0 where the id was null). Shards are numbered in document order; a shard's base in the whole
token stream is the prefix sum of the shards before it, so no task ever sees more than one shard.

``write`` range-partitions the documents by id (ties by the text's hash), encodes and writes one shard per task, and keeps
a manifest with one row per shard. A task that is run again writes files of another name; only those named in the
manifest count, so lost executors leave orphans but no wrong rows. ``read`` maps the files and returns the documents.

Edge cases: a null text is empty (its only id is the end id); null ids come first; repeated rows are separate
documents; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import map_file, parts_for, shared_path, stored, write_bytes
from .tokens import encoder

SHARD = "shard int, path string, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = enc._pack([end_id])
        parts, lengths, ids, valid = [], [0], [], []
        for batch in batches:
            for text in batch.column("text"):
                parts.append(enc.encode(text.as_py() or "") + end)
                lengths.append(len(parts[-1]) // enc.dtype.itemsize)
            doc = batch.column("doc_id")
            valid.append(np.asarray(doc.is_valid()))
            ids.append(np.asarray(doc.fill_null(0)).astype("<i8"))
        if not ids:
            return
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.cumsum(np.array(lengths, "<u8"))
        write_bytes(path + ".bin", data)
        write_bytes(path + ".idx", offsets.astype("<u8"))
        write_bytes(path + ".doc", np.concatenate(ids), np.concatenate(valid).astype(np.uint8))
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]}
        )

    return write


def write(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write the files; returns the manifest: shard, path, n_docs, n_tokens, base (ids in the shards before it).

    ``shards`` defaults to the session's shuffle partitions, or more for a larger table (128 MB of text each).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The text's hash only parts rows of one id, or without any, among shards.
    order = ("doc_id", F.xxhash64("text"), "text")
    rows = rows.repartitionByRange(shards or parts_for(docs), *order).sortWithinPartitions(*order)
    made = stored(rows.mapInArrow(_writer(shared_path(spark, "token-files"), tokenizer, end_id), SHARD), "token-manifest")
    # One row per shard: the window runs over the manifest, never over documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(tokenizer: str):
    def read(batches):
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = map_file(row["path"] + ".bin", dtype), map_file(row["path"] + ".idx", "<u8").astype(np.int64)
                n = len(offsets) - 1
                raw = map_file(row["path"] + ".doc", "u1")
                doc, valid = raw[: 8 * n].view("<i8"), raw[8 * n :].astype(bool)
                for i in range(0, n, 512):
                    j = min(n, i + 512)
                    wide = np.asarray(data[offsets[i] : offsets[j]]).astype("<u4")
                    cut = (offsets[i : j + 1] - offsets[i]).astype(np.int32) * 4
                    ids = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut), pa.py_buffer(wide)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc[i:j]), pa.int64(), mask=~valid[i:j]),
                            pa.array(offsets[i:j] + row["base"]),
                            pa.array(np.diff(offsets[i : j + 1])),
                            ids,
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return read


def read(manifest: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, from the files."""
    shards = manifest.select("path", "base").repartition(parts_for(manifest), "path")
    return shards.mapInArrow(_reader(tokenizer), DOCS)
