"""Mixing sources to target weights by capped water-filling.

``plan`` turns source sizes into targets: sources share all words by weight, a source stops at ``max_epochs``
times its size, and the excess goes to the others by weight until none is above its cap. Sorted by cap per weight,
the clamped sources are a prefix, so running sums give the water level without iteration.

``mix`` takes every document ``floor(target / size of its source)`` times, and once more those that come first in a
seeded order until the rest of the target is met (within half a document). The order is by md5 of seed and id; its
first hex digits split each source into 4096 even slices, so a hot source is spread over many tasks and only
slice sums are ever added up across a source.

Edge cases: a null text has size 0, sources of size 0 get target 0, a null source is a source of its own, last in
order; equal ids order by size, then text hash; repeated rows are separate documents; other columns are ignored; an empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality_rules import SPACE
from .storage import free_names, identity, quoted, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240229
SLICE_DIGITS = 3


def n_words(text):
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "[\\x20\\x09-\\x0D]+"))).cast("long")


def plan(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); sources by code point share ``weights`` in turn."""
    # One row per source: these windows see as many rows as there are sources.
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level).withColumn("n", F.row_number().over(order))
    leveled = leveled.withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level"))
    water = F.min_by(F.when(~F.col("clamped"), F.col("level")), F.when(~F.col("clamped"), F.col("n"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return leveled.withColumn("water", water).select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (times the document is taken), taken (repeats * size), text_key."""
    # Rows without an id are told apart by their text, so that they too are spread over the slices.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("text_key"))
    sized = stored(sized.withColumn("slice", F.substring("key", 1, SLICE_DIGITS)), "mix-sizes")
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    planned = plan(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    planned = planned.select(F.col("source").alias("of"), "source_size", "target")
    starts = slices.join(planned, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", F.col("slice").alias("of_slice"), "before", "source_size", "target"
    )
    rows = sized.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("of_slice")))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "text_key")
    ahead = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    once_more = ((2 * F.col("ahead") + F.col("size")).cast("double") < 2 * rest).cast("long")
    out = rows.withColumn("ahead", ahead).withColumn("whole", whole).withColumn("repeats", F.col("whole") + once_more)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), "text_key"
    )


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as ``mixed`` takes them.

    Rows meet by id, source and text. Those that are equal in all three are numbered: the repeats of a source are two
    numbers that differ by one, and the first ``_more`` of the equal rows take the larger.
    """
    one, two, low, more, key, times, n = free_names(docs, "one", "two", "low", "more", "text_key", "times", "n")
    some = mixed.withColumnRenamed("text_key", key).withColumns(dict(zip((one, two), identity("doc_id", "source", key), strict=True)))
    repeats = some.groupBy(one, two).agg(
        F.min("repeats").alias(low), F.max("repeats").alias("high"), F.sum("repeats").alias("all"), F.count("*").alias("rows")
    )
    repeats = repeats.where("high > 0").select(one, two, low, (F.col("all") - F.col(low) * F.col("rows")).alias(more))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    met = keyed.withColumns(dict(zip((one, two), identity("doc_id", "source", key), strict=True))).join(repeats, [one, two])
    place = F.row_number().over(Window.partitionBy(one, two).orderBy(key))
    met = met.withColumn(times, F.col(low) + (place <= F.col(more)).cast("long")).where(F.col(times) > 0)
    met = met.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return met.select(*map(quoted, docs.columns))
