"""Promotion plans and snapshot writes (J1-J16): inserts only, with checks before anything is written.

A plan is a DataFrame; nothing here changes a table in place. ``write_snapshot`` writes a whole new directory and
then a new numbered pointer to it; the largest that is complete counts, so a reader sees the old state or the new one, also after a crash.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def planned(candidates: DataFrame, valid: DataFrame, existing: DataFrame, key: str, source: str, status: str, order: list, tasks: int | None = None) -> DataFrame:
    """Candidates with ``action`` and ``reason``: unresolved, bad status, existing and repeated ones in this order.

    Both joins and the order of a key sort whole candidates in memory: ``tasks`` deals them to so many, so that a number that grows with the rows keeps each small.
    """
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    known = valid.select(F.col(key).alias("_valid")).distinct()
    held = existing.select(F.col(key).alias("_k"), F.col(source).alias("_s")).distinct()
    met = dealt(candidates, key).join(known, F.col(key) == F.col("_valid"), "left")
    met = dealt(met, key, source).join(held, (F.col(key) == F.col("_k")) & (F.col(source) == F.col("_s")), "left")
    ok = F.col("_valid").isNotNull() & ~F.lower(status).isin("empty", "conflict") & F.col("_k").isNull()
    place = F.row_number().over(Window.partitionBy(key, source, ok).orderBy(*order))
    met = met.withColumn("_ok", ok).withColumn("_n", place)
    reason = (
        F.when(F.col("_valid").isNull(), "unresolved")
        .when(F.lower(status).isin("empty", "conflict"), F.concat(F.lit("status_"), F.lower(status)))
        .when(F.col("_k").isNotNull(), "existing")
        .when(F.col("_n") > 1, "repeated")
    )
    action = F.when(reason.isNull(), "INSERT").when(F.startswith(reason, F.lit("status_")), "CONFLICT").otherwise("SKIP")
    return met.select(*candidates.columns, action.alias("action"), reason.alias("reason"))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails, null if none; a rule that is null fails."""
    return reduce(lambda other, r: F.when(~F.coalesce(r[1], F.lit(False)), r[0]).otherwise(other), reversed(rules), F.lit(None).cast("string"))


def staging_rules(axes: tuple[str, ...], promotable: tuple[str, ...], refused: tuple[str, ...]) -> list[tuple[str, Column]]:
    """J2 for staging rows (entity_id, match_status, provenance, vector map)."""
    keys = F.map_keys("vector")
    return [
        ("no entity", F.col("entity_id").isNotNull()),
        ("match status", F.col("match_status").isin(*promotable)),
        ("provenance", ~F.exists(F.array(*map(F.lit, refused)), lambda r: F.contains(F.lower(F.coalesce("provenance", F.lit(""))), r))),
        ("malformed vector", F.col("vector").isNotNull()),
        ("missing axis", F.size(F.array_except(F.array(*map(F.lit, axes)), keys)) == 0),
        ("extra axis", F.size(F.array_except(keys, F.array(*map(F.lit, axes)))) == 0),
        ("out of range", F.forall(F.map_values("vector"), lambda v: F.coalesce(v.between(0, 1), F.lit(False)))),
    ]


def new_profiles(batch: DataFrame, held: DataFrame, key: str, order: list) -> DataFrame:
    """The first profile of each entity in the batch, where the entity has none."""
    fresh = batch.join(held.select(key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def applied(current: DataFrame, plan: DataFrame) -> DataFrame:
    """The state after the plan's inserts."""
    return current.unionByName(plan.where("action = 'INSERT'").select(*current.columns))


def merge_plan(decisions: DataFrame, groups: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """(survivor, variant) of groups decided for merging; a survivor is no variant of its own."""
    go = decisions.where(~F.col("decision").isin(*excluded)).select("group_name", "survivor")
    pairs = groups.join(go, "group_name").select("survivor", F.explode("members").alias("variant"))
    return pairs.where("survivor <> variant").distinct()


def settled(merges: DataFrame) -> DataFrame:
    """A merge plan (survivor, variant) with one survivor a variant (the smallest of several) at the end of its chain; variants in a cycle
    are left out and so keep their rows."""
    from curata.plans.quality import survivors

    one = merges.groupBy(F.col("variant").alias("source")).agg(F.min("survivor").alias("target"))
    return survivors(one).where("survivor is not null").select("survivor", F.col("source").alias("variant"))


def remapped(table: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Dependants of variants under their survivor."""
    met = table.join(merges.select(F.col("variant").alias("_v"), "survivor"), F.col(key) == F.col("_v"), "left")
    return met.withColumn(key, F.coalesce("survivor", key)).select(*table.columns)


def superseded(entities: DataFrame, merges: DataFrame, key: str, mark: str = "superseded_by") -> DataFrame:
    """Variants marked with their survivor; nothing is deleted."""
    met = entities.join(merges.select(F.col("variant").alias("_v"), "survivor"), F.col(key) == F.col("_v"), "left")
    return met.withColumn(mark, F.coalesce("survivor", mark)).select(*entities.columns)


def null_fill(current: DataFrame, proposed: DataFrame, key: str, column: str) -> DataFrame:
    """Proposals only where there is null."""
    p = proposed.groupBy(F.col(key).alias("_k")).agg(F.min(column).alias("_p"))
    met = current.join(p, F.col(key) == F.col("_k"), "left")
    return met.withColumn(column, F.coalesce(column, "_p")).select(*current.columns)


def upserted(current: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """The change with the highest sequence replaces the row; a state that keeps the sequence is not set back by older changes."""
    held = F.coalesce(F.col(sequence), F.lit(-1)) if sequence in current.columns else F.lit(-1)
    both = current.withColumn("_seq", held.cast("long")).unionByName(changes.withColumn("_seq", F.col(sequence).cast("long")).select(*current.columns, "_seq"))
    rest = [F.desc(c) for c in current.columns if c not in (key, sequence)]  # equal sequences: the largest other columns
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_seq"), *rest))
    return both.withColumn("_n", place).where("_n = 1").select(*current.columns)


def blanks_to_null(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blank texts as null, and the log (key, field, old) that can undo it."""
    blank = lambda c: F.trim(F.col(c)) == ""
    cells = F.filter(F.array(*[F.when(blank(c), F.struct(F.lit(c).alias("field"), F.col(c).alias("old"))) for c in columns]), lambda x: x.isNotNull())
    log = df.select(key, F.explode(cells).alias("x")).select(key, "x.*")
    return df.withColumns({c: F.when(~blank(c), F.col(c)) for c in columns}), log


def undone(df: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The logged cells as they were."""
    wide = log.groupBy(F.col(key).alias("_k")).agg(*[F.max(F.when(F.col("field") == c, F.col("old"))).alias(f"_{c}") for c in columns])
    met = df.join(wide, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def dry_run(current: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows before and after, the change expected of the plan and the change there would be; nothing is written."""
    counts = lambda df, name: df.agg(F.count("*").alias(name))
    one = counts(current, "n_before").crossJoin(counts(applied(current, plan), "n_after"))
    out = one.crossJoin(plan.agg(F.count_if(F.col("action") == "INSERT").alias("expected_delta")))  # one row each
    actual = F.col("n_after") - F.col("n_before")
    return out.select("n_before", "n_after", "expected_delta", actual.alias("actual_delta"), (actual == F.col("expected_delta")).alias("ok"))


def field_actions(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """(field, old, confidence) by rules (field, rule, least): refuse, append, replace or review."""
    met = changes.join(rules, "field", "left")
    action = (
        F.when((F.col("rule") == "IMMUTABLE") & F.col("old").isNotNull(), "refuse")
        .when(F.col("rule").isNull() | (F.col("rule") == "REVIEW") | (F.col("confidence") < F.col("least")), "review")
        .when(F.col("rule") == "APPEND", "append")
        .otherwise("replace")
    )
    return met.withColumn("action", action).drop("rule", "least")


def cell_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old, new) of the cells that differ, missing rows included."""
    a = before.select(F.col(key).alias("_a"), *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    b = after.select(F.col(key).alias("_b"), *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    met = a.join(b, F.col("_a") == F.col("_b"), "full")
    cell = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").alias("old"), F.col(f"_b_{c}").alias("new"))
    changed = F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), cell(c)) for c in columns])
    return met.select(F.coalesce("_a", "_b").alias(key), F.explode(F.filter(changed, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def last_writer_wins(current: DataFrame, incoming: DataFrame, key: str, updated: str, as_of: str) -> DataFrame:
    """Per key the row updated last, the incoming one on a tie; an incoming row without a time counts as of ``as_of``."""
    timed = incoming.withColumn(updated, F.coalesce(updated, F.to_timestamp(F.lit(as_of))))
    both = current.withColumn("_in", F.lit(0)).unionByName(timed.select(*current.columns).withColumn("_in", F.lit(1)))
    rest = [F.desc(c) for c in current.columns if c not in (key, updated)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(updated).desc_nulls_last(), F.desc("_in"), *rest))
    return both.withColumn("_n", place).where("_n = 1").select(*current.columns)


def transitions(items: DataFrame, requests: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Requests (key, action, note) on items (key, status) by allowed (from_status, action, to_status, note_required).

    One audit row per request: the new status, or the reason for refusing.
    """
    met = requests.join(items.select(key, "status"), key, "left")
    rules = allowed.select(F.col("from_status").alias("_f"), F.col("action").alias("_a"), "to_status", "note_required")
    met = met.join(rules, (F.col("status") == F.col("_f")) & (F.col("action") == F.col("_a")), "left")
    bare = F.coalesce(F.trim("note"), F.lit("")) == ""
    reason = (
        F.when(F.col("status").isNull(), "unknown item")
        .when(F.col("to_status").isNull(), "not allowed")
        .when(F.col("note_required") & bare, "note required")
    )
    out = met.withColumn("reason", reason)
    return out.select(key, "action", "status", F.when(F.col("reason").isNull(), F.col("to_status")).alias("new_status"), "reason")


def sane_keys(df: DataFrame, key: str, column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Keys of another shape as null, and a log of the old values."""
    ok = F.col(column).rlike(pattern)
    return df.withColumn(column, F.when(ok, F.col(column))), df.where(F.col(column).isNotNull() & ~ok).select(key, F.col(column).alias("old"))


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Complete pointer folders, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(str(f.getPath().getParent().toString()) for f in found)


def _point(spark: SparkSession, root: str, name: str) -> None:
    """The next pointer: a folder of its own, so the one before stays until and after this one is complete."""
    known = _pointers(spark, root)
    number = int(known[-1].rsplit("/", 1)[1].split("-")[0]) + 1 if known else 0
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.json(f"{root}/pointers/{number:012d}-{uuid.uuid4().hex}")


def write_snapshot(spark: SparkSession, df: DataFrame, root: str) -> str:
    """The state as a new directory below ``root``, then the pointer to it; returns its name."""
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    _point(spark, root, name)
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The state that the newest complete pointer names."""
    return spark.read.parquet(f"{root}/{spark.read.schema('name string').json(_pointers(spark, root)[-1]).first()['name']}")


def roll_back(spark: SparkSession, root: str, name: str) -> None:
    """A new pointer to an earlier snapshot."""
    _point(spark, root, name)
