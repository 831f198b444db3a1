"""Ordered rows under a key, however many one key has: numbered over all tasks, then cut into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_names, parts_for, quoted, stored


def _placer(key: str, names: list[str]):
    """Adds partition, run of equal keys in it, and place in the run to rows that come sorted by key."""

    def run(batches):
        from pyspark import TaskContext

        part, runs, held, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            if not len(batch):
                continue
            ends = np.asarray(pc.run_end_encode(batch.column(key)).run_ends)
            starts = np.concatenate([[0], ends[:-1]])
            goes_on = runs >= 0 and batch.column(key)[0].as_py() == last
            lengths = ends - starts
            number = np.repeat(np.arange(len(ends)) + runs + (not goes_on), lengths)
            at = np.arange(len(batch)) - np.repeat(starts, lengths)
            if goes_on:
                at[: ends[0]] += held
            runs, held, last = int(number[-1]), int(at[-1]) + 1, batch.column(key)[-1].as_py()
            added = [pa.array(np.full(len(batch), part, np.int64)), pa.array(number.astype(np.int64)), pa.array(at.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    return run


def numbered(rows: DataFrame, key: str, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` and a column ``name``: the place of each among the rows of its key (from 0) by ``order``.

    Rows are dealt by ranges of key and order, so a key with a third of all rows is many tasks' work, and stored once; a range
    counts for itself, and what lies before it under its first key (one number a range) is added. Rows that are equal
    in key and order are numbered in any order. Null is a key of its own; an empty table stays empty.
    """
    spark = rows.sparkSession
    tie, part, run, at = free_names(rows, "tie", "part", "run", "at")
    sort = [F.col(quoted(key)).asc_nulls_first(), *order, F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts_for(rows), *sort).sortWithinPartitions(*sort).drop(tie)
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    placed = stored(dealt.mapInArrow(_placer(key, [*rows.columns, part, run, at]), f"{schema}, {part} long, {run} long, {at} long"), "numbered")
    k = F.col(quoted(key))
    ends = placed.groupBy(part).agg(
        F.min(F.struct(run, k.alias("k")))["k"].alias("first"),
        F.max(F.struct(run, at, k.alias("k"))).alias("end"),
    )
    before, offsets, known = 0, [], None
    for r in ends.orderBy(part).collect():  # a row for each range
        goes_on = known is not None and known[0] == r["first"]
        offset = before if goes_on else 0
        if offset:
            offsets.append((r[part], 0, offset))
        before = r["end"][1] + 1 + (offset if r["end"][0] == 0 else 0)
        known = (r["end"]["k"],)
    if not offsets:
        return placed.withColumn(name, F.col(at)).drop(part, run, at)
    (more,) = free_names(placed, "offset")
    shift = F.broadcast(spark.createDataFrame(offsets, f"{part} long, {run} long, {more} long"))  # a row for each range at most
    return placed.join(shift, [part, run], "left").withColumn(name, F.col(at) + F.coalesce(F.col(more), F.lit(0))).select(*map(quoted, rows.columns), name)


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(values of the first ``keys`` columns, rows) of each run of equal values; a run is held whole, so it must be a bounded block."""
    known, held = None, []
    for row in rows_of(batches):
        if known is not None and row[:keys] != known:
            yield known, held
            held = []
        known = row[:keys]
        held.append(row)
    if known is not None:
        yield known, held


def rows_of(batches: Iterable[pa.RecordBatch], at_once: int = 512) -> Iterator[tuple]:
    """Rows one by one; no more than ``at_once`` of them are Python objects at a time."""
    for batch in batches:
        for i in range(0, len(batch), at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, at_once).columns), strict=True)
