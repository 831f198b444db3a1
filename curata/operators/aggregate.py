"""Aggregations over entities, evidence and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_with_zero(dimension: DataFrame, facts: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Facts per dimension row, 0 where there is none; facts are counted before the join."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.join(counts, key, "left").select(*keep, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest groups, ties by name."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """E3."""
    one = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, one)


def vector_mean(contributions: DataFrame, key: str = "entity", places: int = 6) -> DataFrame:
    """(key, axis, value, source) to mean clamped to 0..1, confidence min(1, n / 3) and sorted sources per axis."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("value")))
    return contributions.groupBy(key, "axis").agg(
        F.round(v, places).alias("value"),
        F.round(F.least(F.lit(1.0), F.count("*") / 3.0), places).alias("confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def vector_status(mapped: Column, unmapped: Column, nonzero: Column, axes: int) -> Column:
    """E5."""
    return (
        F.when(mapped == 0, "EMPTY")
        .when((nonzero == axes) & (unmapped == 0), "RESOLVED")
        .when(nonzero > 0, "PARTIAL")
        .otherwise("EMPTY")
    )


def signal_weight(segment: Column, reviews: Column) -> Column:
    """1 for the high segment, else 0.35, raised a tenth by each review up to five."""
    return F.when(segment == "high", 1.0).otherwise(0.35) * (1 + F.least(reviews, F.lit(5)) / 10)


def weighted_signals(hits: DataFrame, key: str = "entity", places: int = 6) -> DataFrame:
    """(key, axis, segment, reviews, hits) to sums per axis."""
    w = signal_weight(F.col("segment"), F.col("reviews")) * F.col("hits")
    return hits.groupBy(key, "axis").agg(F.round(F.sum(w), places).alias("signal"))


def normalised_signals(df: DataFrame, keyword: str = "keyword", regional: str = "regional", places: int = 4) -> DataFrame:
    """Keyword array over its largest; the regional one held to a quarter of their total, added and capped at 1."""
    top = F.array_max(keyword)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    key = F.when(top > 0, F.transform(keyword, lambda x: x / top)).otherwise(F.transform(keyword, lambda x: F.lit(0.0)))
    out = df.withColumn("_k", key).withColumn("_sum", total("_k")).withColumn("_region", total(regional))
    scale = F.when((F.col("_region") > 0) & (F.col("_sum") > 0), F.least(F.lit(1.0), F.col("_sum") * 0.25 / F.col("_region"))).otherwise(0.0)
    out = out.withColumn("_scale", scale)
    mixed = F.zip_with("_k", regional, lambda k, r: F.bround(F.least(F.lit(1.0), k + r * F.col("_scale")), places))
    return out.withColumn("signal", mixed).drop("_k", "_sum", "_region", "_scale")


def weighted_rating(df: DataFrame, key: str, rating: str, reviews: str, places: int = 2) -> DataFrame:
    """Mean weighted by reviews where any row has some, else the plain mean."""
    r, n = F.col(rating), F.col(reviews)
    some = (n > 0) & r.isNotNull()
    weighted = F.sum(F.when(some, r * n)) / F.sum(F.when(some, n))
    return df.groupBy(key).agg(F.round(F.coalesce(weighted, F.avg(r)), places).alias("rating"))


def representative(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Most frequent value, then largest weight, then by name."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"), F.max(weight).alias("_w"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), F.desc("_w"), value))
    return counted.withColumn("_p", place).where("_p = 1").select(key, value)


def keyword_scores(matches: DataFrame, key: str = "entity") -> DataFrame:
    """(key, axis, keyword, evidence) to min(100, 50 + 10 * distinct keywords) and evidence per axis."""
    return matches.groupBy(key, "axis").agg(
        F.least(F.lit(100.0), 50.0 + 10.0 * F.countDistinct("keyword")).alias("score"), F.countDistinct("evidence").alias("n_evidence")
    )


def intensities(terms: DataFrame, lexicon: DataFrame, key: str = "entity") -> tuple[DataFrame, DataFrame]:
    """(key, term, intensity) by lexicon (term, axis): 20 * intensity per axis capped at 100, and the terms without axis."""
    known = terms.join(lexicon, "term").groupBy(key, "axis").agg(F.least(F.lit(100.0), F.sum(20.0 * F.col("intensity"))).alias("value"))
    return known, terms.join(lexicon, "term", "left_anti")


def context_consensus(counts: DataFrame, key: str = "entity") -> DataFrame:
    """(key, context, axis, n) to the mean over contexts with hits, scaled so that an entity's largest axis is 100."""
    hit = counts.where("n > 0")
    contexts = hit.groupBy(key).agg(F.countDistinct("context").alias("_c"))
    mean = hit.groupBy(key, "axis").agg(F.sum("n").alias("_n")).join(contexts, key).withColumn("_m", F.col("_n") / F.col("_c"))
    top = F.max("_m").over(Window.partitionBy(key))
    return mean.select(key, "axis", F.floor(F.col("_m") * 100 / top).cast("int").alias("value"))


def census(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, blanks, white space only and filled values per column, in one pass."""
    made = []
    for c in columns:
        t = F.col(c).cast("string")
        made += [
            F.count_if(t.isNull()).alias(f"{c}|n_null"),
            F.count_if(t == "").alias(f"{c}|n_blank"),
            F.count_if((t != "") & (F.trim(t) == "")).alias(f"{c}|n_space"),
            F.count_if(F.trim(t) != "").alias(f"{c}|n_filled"),
        ]
    wide = df.agg(*made)
    kinds = ("n_null", "n_blank", "n_space", "n_filled")
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}|{k}`").alias(k) for k in kinds]) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def coverage(entities: DataFrame, first: DataFrame, second: DataFrame, key: str, places: int = 6) -> DataFrame:
    """Shares of entities in the first set, the second, both, neither and one only."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    met = entities.select(key).join(flag(first, "_a"), key, "left").join(flag(second, "_b"), key, "left")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    share = lambda c, name: F.round(F.avg(c.cast("double")), places).alias(name)
    return met.agg(
        F.count("*").alias("n"), share(a, "in_first"), share(b, "in_second"), share(a & b, "in_both"), share(~a & ~b, "in_neither"), share(a != b, "in_one")
    )


def count_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_keys"))


def fill_rate(bridge: DataFrame, entities: DataFrame, key: str, places: int = 6) -> DataFrame:
    """E16."""
    have = bridge.agg(F.countDistinct(key).alias("n_linked"))
    return entities.agg(F.count("*").alias("n")).crossJoin(F.broadcast(have)).withColumn("rate", F.round(F.col("n_linked") / F.col("n"), places))


def spread(df: DataFrame, by: str, value: str, places: int = 6, slices: int = 64) -> DataFrame:
    """Exact median (the mean of the two middles of an even count) and range of each group.

    One pass takes each group's number, range and rough quantiles (a sketch of bounded size), another counts the values between
    these; only the slices that hold a middle are then ordered, so of a group of any size about one part in ``slices`` meets in a task. Equal values
    count as one row. Nulls are left out; a group of nulls has null and 0.
    """
    steps = [i / slices for i in range(1, slices)]
    whole = df.groupBy(by).agg(
        F.percentile_approx(value, steps, 10_000).alias("_edges"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count(value).alias("n")
    )
    ends = whole.select(F.col(by).alias("_g"), "_edges", F.floor((F.col("n") - 1) / 2).alias("_lower"), F.floor(F.col("n") / 2).alias("_upper"))
    each = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c")).join(ends, F.col(by).eqNullSafe(F.col("_g")))
    each = each.withColumn("_s", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges", by)
    w = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    held = each.groupBy("_g", "_s").agg(F.sum("_c").alias("_n"), F.first("_lower").alias("_l"), F.first("_upper").alias("_u"))  # ``slices`` rows a group
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    within = lambda rank, start, n: (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(start) + F.col(n))
    middle = held.where(within("_l", "_before", "_n") | within("_u", "_before", "_n")).select(F.col("_g").alias("_h"), F.col("_s").alias("_t"), "_before")
    near = each.join(middle, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_s") == F.col("_t")))
    inside = Window.partitionBy("_g", "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    pick = lambda rank: F.max(F.when(within(rank, "_at", "_c"), F.col(value)))
    median = near.groupBy("_g").agg(((pick("_lower") + pick("_upper")) / 2).alias("_m"))
    met = whole.join(median, F.col(by).eqNullSafe(F.col("_g")), "left")
    return met.select(by, F.round("_m", places).alias("median"), "lowest", "highest", "n")


def histogram(df: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """Counts per bin [edge, next edge), below the first and from the last on included."""
    v = F.col(value)
    names = [f"<{edges[0]:g}", *[f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)], f">={edges[-1]:g}"]
    label = reduce(lambda other, p: F.when(v < p[0], p[1]).otherwise(other), reversed(list(zip(edges, names, strict=False))), F.lit(names[-1]))
    return df.where(v.isNotNull()).groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """E19."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def classified_duplicates(df: DataFrame, key: str, text: str, source: str, words: tuple[str, ...]) -> DataFrame:
    """Duplicate groups as batch (a batch word occurs), sources (several), or multiple; a null source counts as one."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    batch = F.max(reduce(lambda a, b: a | b, (low.contains(w) for w in words)))
    groups = df.groupBy(key).agg(F.count("*").alias("n"), batch.alias("_b"), F.countDistinct(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("_s"))
    kind = F.when(F.col("_b"), "batch").when(F.col("_s") > 1, "sources").otherwise("multiple")
    return groups.where("n > 1").select(key, "n", kind.alias("kind"))


def conflicting_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    values = F.array_sort(F.collect_set(value))
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values"), values.alias("found")).where("n_values > 1")


def critic_profiles(df: DataFrame, by: list[str], score: str, axes: list[str], places: int = 6) -> DataFrame:
    """E22."""
    means = [F.round(F.avg(a), places).alias(f"mean_{a}") for a in axes]
    return df.groupBy(*by).agg(F.count("*").alias("n_reviews"), F.round(F.avg(score), places).alias("mean_score"), *means)


def grouped_listing(df: DataFrame, slug: Column, label: str, key: str) -> DataFrame:
    """Label variants under one slug, shown by the label of the smallest key."""
    return df.groupBy(slug.alias("slug")).agg(F.min_by(label, key).alias("label"), F.count("*").alias("n"), F.min(key).alias("first_key"))


def source_yield(candidates: DataFrame, covered: DataFrame, source: str, key: str) -> DataFrame:
    """Distinct keys per source, and how many of them nothing covers yet."""
    seen = covered.select(key).distinct().withColumn("_seen", F.lit(True))
    met = candidates.select(source, key).distinct().join(seen, key, "left")
    return met.groupBy(source).agg(F.count("*").alias("n_found"), F.count_if(F.col("_seen").isNull()).alias("n_new"))


def _counters(rejected: Column, reused: Column, low: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(rejected).alias("n_rejected"),
        F.count_if(~rejected & reused).alias("n_reused"),
        F.count_if(~rejected & ~reused).alias("n_inserted"),
        F.count_if(low).alias("n_low"),
    ]


def job_counters(df: DataFrame, rejected: Column, reused: Column, low: Column) -> DataFrame:
    """The counters of a finished job."""
    return df.agg(*_counters(rejected, reused, low))


def observed_write(df: DataFrame, path: str, rejected: Column, reused: Column, low: Column) -> dict[str, int]:
    """E25 in flight: the rows that are inserted go to ``path``, and the same pass over the input counts; returns the counters."""
    seen = Observation()
    df.observe(seen, *_counters(rejected, reused, low)).where(~rejected & ~reused).write.parquet(path)
    return seen.get


def group_scores(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Row sums of named columns, null as 0, and whether all are 0."""
    sums = {g: reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in cols)) for g, cols in groups.items()}
    out = df.withColumns(sums)
    return out.withColumn("is_zero", reduce(lambda a, b: a & b, (F.col(g) == 0 for g in groups)))


def batch_fill(df: DataFrame, sections: list[str], slug: str) -> DataFrame:
    """Filled sections and repeated slugs."""
    filled = [F.count_if(F.trim(F.col(s)) != "").alias(f"n_{s}") for s in sections]
    return df.agg(F.count("*").alias("n"), *filled, (F.count(slug) - F.countDistinct(slug)).alias("n_repeated"))
