"""Checks and audits (K1-K21): every check is a DataFrame, a suite is their union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.sources.files import scratch_path

# M2, K1: id -> (severity, fail action, check: tables to a one-row DataFrame with n_failed)
Check = Callable[[dict[str, DataFrame]], DataFrame]
INVARIANTS: dict[str, tuple[str, str, Check]] = {}


def invariant(name: str, severity: str, action: str):
    """M2: register a check."""

    def keep(check: Check) -> Check:
        INVARIANTS[name] = (severity, action, check)
        return check

    return keep


def run_invariants(tables: dict[str, DataFrame], suite: dict[str, tuple[str, str, Check]] | None = None) -> DataFrame:
    """K1: invariant, severity, action, n_failed, passed: a row for each check."""
    rows = []
    for name, (severity, action, check) in (suite or INVARIANTS).items():
        one = check(tables).select(F.col("n_failed").cast("long").alias("n_failed"))
        rows.append(one.select(F.lit(name).alias("invariant"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), "n_failed", (F.col("n_failed") == 0).alias("passed")))
    return reduce(DataFrame.unionByName, rows)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_failed"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """K2 (G4)."""
    return children.join(parents.select(key), key, "left_anti")


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """K2 (G5)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """K2 (G6): rows of the old state that the new one does not hold as they were."""
    return before.exceptAll(after.select(*before.columns))


def out_of_range(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """K2 (R4)."""
    return df.where(reduce(lambda a, b: a | b, (~F.col(c).between(low, high) for c in columns)))


def merge_checks(before: DataFrame, after: DataFrame, entities: DataFrame, merges: DataFrame, key: str, mark: str) -> DataFrame:
    """K3: variants marked, no dependants left on variants, rows conserved, active entities fewer by the variants."""
    variants = merges.select(F.col("variant").alias(key)).distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(entities.join(variants, key, "left_semi").where(F.col(mark).isNull()), "unmarked"),
        one(after.join(variants, key, "left_semi"), "left_on_variants"),
        one(before, "n_before"),
        one(after, "n_after"),
        one(entities.where(F.col(mark).isNull()), "n_active"),
        one(entities, "n_entities"),
        one(variants, "n_variants"),
    ]
    row = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return row.withColumn("ok", (F.col("unmarked") == 0) & (F.col("left_on_variants") == 0) & (F.col("n_before") == F.col("n_after")))


def verdicts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """K4: all failing reasons; PASS without any."""
    bad = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("reasons", bad).withColumn("verdict", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def re_evaluated(df: DataFrame, hard: tuple[str, ...]) -> DataFrame:
    """K5: flagged rows again: FAIL with a hard reason, else REQUIRES_REVIEW; never cleared by itself."""
    fails = F.exists("reasons", lambda r: r.isin(*hard))
    return df.withColumn("verdict", F.when(fails, "FAIL").otherwise("REQUIRES_REVIEW"))


def rule_audit(df: DataFrame, rules: dict[str, Column], key: str, most: int = 10) -> DataFrame:
    """K6: (rule, n_failed, samples): failing rows per rule with the ``most`` smallest keys, in one pass."""
    failed = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()))
    rows = df.select(F.col(key), failed.alias("rule"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(key))
    ranked = rows.withColumn("_n", place)
    samples = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(key)))), lambda x: x.cast("string")), ",")
    return ranked.groupBy("rule").agg(F.count("*").alias("n_failed"), samples.alias("samples"))


def tier(axes: Column, evidence: Column, has_producer: Column) -> Column:
    """K7."""
    return (
        F.when((axes >= 2) & (evidence >= 1), "A").when(axes >= 1, "B").when(F.coalesce(has_producer, F.lit(False)), "C_idx").otherwise("C_no")
    )


def queue_class(df: DataFrame, promoted: DataFrame, key: str, sure: Column) -> DataFrame:
    """K8: closed (promoted), automatic (sure) or human_review, with the decisions that are pending."""
    met = df.join(promoted.select(key).distinct().withColumn("_p", F.lit(True)), key, "left")
    done = F.coalesce("_p", F.lit(False))
    kind = F.when(done, "closed").when(sure, "automatic").otherwise("human_review")
    pending = F.when(done, F.array().cast("array<string>")).when(sure, F.array(F.lit("promote"))).otherwise(F.array(F.lit("match"), F.lit("promote")))
    return met.withColumns({"queue_class": kind, "pending": pending}).drop("_p")


def vector_compliance(profile: Column, text: Column, axes: tuple[str, ...], low: float, high: float) -> Column:
    """K9: malformed, non_canonical, out_of_range or ok."""
    extra = F.size(F.array_except(F.map_keys(profile), F.array(*map(F.lit, axes)))) > 0
    wild = F.exists(F.map_values(profile), lambda v: v.isNull() | ~v.between(low, high))
    return F.when(text.isNotNull() & profile.isNull(), "malformed").when(extra, "non_canonical").when(wild, "out_of_range").otherwise("ok")


def supersession_faults(edges: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(source, target) edges as self loop, two-cycle, chain (the target is superseded too) or orphan target."""
    e = edges.select("source", "target")
    back = e.select(F.col("source").alias("_t"), F.col("target").alias("_next"))
    met = e.join(back, F.col("target") == F.col("_t"), "left").join(entities.select(F.col(key).alias("_e")), F.col("target") == F.col("_e"), "left")
    fault = (
        F.when(F.col("source") == F.col("target"), "self_loop")
        .when(F.col("_next") == F.col("source"), "two_cycle")
        .when(F.col("_e").isNull(), "orphan_target")
        .when(F.col("_next").isNotNull(), "chain")
    )
    return met.select("source", "target", fault.alias("fault")).where("fault is not null").distinct()


def survivors(edges: DataFrame) -> DataFrame:
    """(source, survivor): supersession chains followed to their end by doubling; null for members of a cycle of any length and what leads
    into one, as no entity there survives.

    Once 2 ** rounds exceeds the number of edges every chain has ended. Each round is written to the shared folder, so lineage
    stays one round deep.
    """
    spark = edges.sparkSession
    at = edges.select("source", F.col("target").alias("survivor"))
    for _ in range(edges.count().bit_length() + 1):
        onward = at.select(F.col("source").alias("_s"), F.col("survivor").alias("_next"))
        moved = at.join(onward, F.col("survivor") == F.col("_s"), "left")
        path = scratch_path(spark, "survivors")
        moved.select("source", F.coalesce("_next", "survivor").alias("survivor"), (F.col("_next") != F.col("survivor")).alias("_moved")).write.parquet(path)
        done = spark.read.parquet(path)
        at = done.select("source", "survivor")
        if done.where("_moved").isEmpty():
            break
    again = edges.select(F.col("source").alias("_s")).distinct()
    ended = at.join(again, F.col("survivor") == F.col("_s"), "left")
    return ended.select("source", F.when(F.col("_s").isNull(), F.col("survivor")).alias("survivor"))


def template_values(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Combinations of values that ``least`` rows or more share."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def repair_class(malformed: Column, extra: Column, evidence: Column) -> Column:
    """K12."""
    base = F.when(malformed & extra, "both").when(malformed, "malformed").when(extra, "non_canonical").otherwise("clean")
    return F.struct(base.alias("kind"), ((base != "clean") & (F.coalesce(evidence, F.lit(0)) > 0)).alias("reconstructable"))


def validated_json(df: DataFrame, text: str, schema: str, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Parsed record with ``errors``: malformed, or the names of the rules it fails."""
    out = df.withColumn("_r", F.from_json(F.col(text), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    failed = F.filter(F.array(*[F.when(~F.coalesce(c(F.col("_r")), F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    return out.withColumn("errors", F.when(bad, F.array(F.lit("malformed"))).otherwise(failed)).drop("_r")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Count, sum and xor of row hashes, whatever the order or partitioning."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def reject(df: DataFrame, bad: Column, reason: str, suggestion: str) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and the others with reason and suggested action; a null condition passes."""
    hit = F.coalesce(bad, F.lit(False))
    return df.where(~hit), df.where(hit).withColumns({"reason": F.lit(reason), "suggested_action": F.lit(suggestion)})


def uncovered_axes(vectors: DataFrame, mapped: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Non-null axes without a mapping."""
    long = vectors.unpivot([key], axes, "axis", "value").where("value is not null")
    return long.join(mapped.select(key, "axis"), [key, "axis"], "left_anti")


def profile_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows each check finds."""
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")


def presence(fields: dict[str, bool]) -> Column:
    """Array of struct<field, required, present>."""
    return F.array(*[F.struct(F.lit(f).alias("field"), F.lit(need).alias("required"), F.col(f).isNotNull().alias("present")) for f, need in fields.items()])


def source_gate(df: DataFrame, critical: dict[str, Column], risks: dict[str, Column], key: str, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(findings capped per rule, gate): the batch passes if no critical rule found a row."""
    def found(rules, severity):
        hit = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()))
        return df.select(F.col(key), hit.alias("rule")).withColumn("severity", F.lit(severity))

    both = found(critical, "FAIL").unionByName(found(risks, "RISK"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(key))
    gate = both.agg(F.count_if(F.col("severity") == "FAIL").alias("n_fail"), F.count_if(F.col("severity") == "RISK").alias("n_risk"))
    return both.withColumn("_n", place).where(F.col("_n") <= most).drop("_n"), gate.withColumn("passed", F.col("n_fail") == 0)


def verification_ledger(values: DataFrame, official: DataFrame, seeds: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(entity, field, value) against official and seed values: status and grade A (both), B (official), C (seed), X (conflict), E."""
    met = values.join(official.select("entity", "field", F.col("value").alias("_o")), ["entity", "field"], "left")
    met = met.join(seeds.select("entity", "field", F.col("value").alias("_s")), ["entity", "field"], "left")
    same = lambda other: F.when(
        F.col("field") == "abv", F.abs(F.col("value").try_cast("double") - F.col(other).try_cast("double")) <= tolerance
    ).otherwise(F.lower(F.trim("value")) == F.lower(F.trim(other)))
    o, s = same("_o"), same("_s")
    clash = F.coalesce(~o, F.lit(False)) | F.coalesce(~s, F.lit(False))
    status = F.when(clash, "conflict").when(F.coalesce(o, F.lit(False)) | F.coalesce(s, F.lit(False)), "verified").otherwise("unverified")
    grade = F.when(clash, "X").when(o & s, "A").when(o, "B").when(s, "C").otherwise("E")
    return met.select("entity", "field", "value", status.alias("status"), grade.alias("grade"))


def staging_partition(staging: DataFrame, catalogue: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Orphan (not in the catalogue), profile_gap (no profile yet) or enrichment."""
    met = staging.join(catalogue.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    met = met.join(profiles.select(key).distinct().withColumn("_p", F.lit(1)), key, "left")
    kind = F.when(F.col("_c").isNull(), "orphan").when(F.col("_p").isNull(), "profile_gap").otherwise("enrichment")
    return met.withColumn("kind", kind).drop("_c", "_p")
