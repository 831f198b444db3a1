"""Dimensional ingest (A5): seven tables of text records to dimensions, facts, bridges, a review list and counters.

Inputs, all optional: ``source_audit``, ``distilleries``, ``bottlers``, ``filter_tags``, ``products``, ``rejected_matches`` and
``review_needed``; columns under any of their known names (A6), words that mean nothing as null (B1). A ``row`` column (long) tells the
order of the records; of equal ones the first counts. Every output is one plan over the inputs: dimensions by grouping, facts by
keyed joins, refused rows and their reasons from the same judged table; nothing is looked up row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.normalize import enum, null_words, safe_number, split_urls, split_values
from curata.operators.resolve import longest_prefix
from curata.sources.files import canonical_columns

# Number columns with their kind, values that enumerations allow, words for a producer's own bottling.
NUMBERS = {
    "age_statement": "long",
    "vintage_year": "long",
    "bottling_year": "long",
    "release_year": "long",
    "number_of_bottles": "long",
    "abv": "double",
    "price_original": "double",
}
CAPACITIES = {"production_capacity_lpa": "double", "number_of_stills": "long"}
STATUS = ("active", "closed", "mothballed", "planned", "demolished", "silent")
CONFIDENCE = ("high", "medium", "low", "manual_review", "rejected")
SOURCE_TYPE = ("api", "scraper", "manual", "bulk")
AUDIT_STATUS = ("success", "partial", "failed")
PROBLEM_TYPE = ("name_mismatch", "missing_entity", "data_conflict", "formatting_error")
OWN_BOTTLING = ("official", "ob")
NO_PRODUCER_NEEDED = ("blended malt", "blend")

REVIEW = "entity_type string, entity_name string, field_name string, current_value string, problem_reason string, suggested_action string"
_PRODUCT = (
    "name original_whisky_id original_distillery_id bottler_name bottling_type source_urls cask_type flavor_profile_keywords "
    "flavor_profile confidence_score source_dataset"
).split()


def ident(*parts: Column) -> Column:
    """A key of a dimension or fact: 16 hex digits of its name."""
    return F.substring(F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256), 1, 16)


def cleaned(df: DataFrame, needed=()) -> DataFrame:
    """Canonical columns, all text, null for words without meaning; columns in ``needed`` that are not there are null."""
    df = canonical_columns(df)
    df = df.select("row", *[null_words(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns if c != "row"])
    return df.withColumns({c: F.lit(None).cast("string") for c in needed if c not in df.columns})


def review(df: DataFrame, kind: str, name: str, field: str, value: Column | str, reason: Column | str, action: str) -> DataFrame:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(
        F.lit(kind).alias("entity_type"),
        F.col(name).alias("entity_name"),
        F.lit(field).alias("field_name"),
        (F.col(value) if isinstance(value, str) else value).cast("string").alias("current_value"),
        text(reason).alias("problem_reason"),
        F.lit(action).alias("suggested_action"),
    )


def first_of(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys and c != "row"]
    return df.groupBy(*keys).agg(F.min(F.struct("row", *rest)).alias("_f")).select(*keys, "_f.*")


def _numbers(df: DataFrame, kinds: dict[str, str], entity: str) -> tuple[DataFrame, list[DataFrame]]:
    """Number columns as numbers, and review rows of what was none."""
    cast = df.withColumns({f"_{c}": safe_number(F.col(c), k) for c, k in kinds.items()})
    bad = [review(cast.where(F.col(f"_{c}.error").isNotNull()), entity, "name", c, c, F.col(f"_{c}.error"), "fix the number") for c in kinds]
    return cast.withColumns({c: F.col(f"_{c}.value") for c in kinds}).drop(*[f"_{c}" for c in kinds]), bad


def ingest(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``countries``, ``regions``, ``distilleries``, ``bottlers``, ``products``, ``casks``, ``flavours``, ``urls``, ``source_audit``,
    ``rejected_matches``, ``review_needed`` and ``counters``."""
    spark = next(iter(tables.values())).sparkSession
    absent = spark.createDataFrame([], "row long, name string")
    reviews: list[DataFrame] = []
    table = lambda name, needed: cleaned(tables.get(name, absent), needed)

    # Producers
    read = table("distilleries", ["country", "region", "original_distillery_id", "status", "confidence_score", "official_website", "notes", *CAPACITIES])
    makers, bad = _numbers(read.where("name is not null"), CAPACITIES, "distillery")
    reviews += bad
    makers = makers.withColumns({"status": enum(F.col("status"), STATUS)["value"], "confidence": enum(F.col("confidence_score"), CONFIDENCE)["value"]})
    names = makers.groupBy(F.col("name").alias("_name")).agg(F.min("row").alias("_by_name"))
    ids = makers.where("original_distillery_id is not null").groupBy(F.col("original_distillery_id").alias("_id")).agg(F.min("row").alias("_by_id"))
    makers = makers.join(names, F.col("name") == F.col("_name")).join(ids, F.col("original_distillery_id") == F.col("_id"), "left")
    again = (F.col("row") > F.col("_by_name")) | F.coalesce(F.col("row") > F.col("_by_id"), F.lit(False))
    reviews.append(review(makers.where(again), "distillery", "name", "name", "name", "duplicate name or id", "merge or rename"))
    low = makers.where("confidence = 'low'").select("row")
    makers = makers.where(~again).select(
        ident(F.col("name")).alias("distillery_id"), "original_distillery_id", "name", "country", "region", "status", *CAPACITIES, "official_website", "confidence", "notes"
    )

    # Bottlers: those that products name, and those that are listed
    products = table("products", [*_PRODUCT, *NUMBERS, "price_currency", "product_url", "notes"])
    own = lambda c: F.coalesce(F.lower(c).isin(*OWN_BOTTLING), F.lit(False))
    official = F.coalesce(F.lower("bottling_type") == "official", F.lit(False))
    named = products.where(F.col("bottler_name").isNotNull() & ~own("bottler_name") & ~official).select("row", F.col("bottler_name").alias("name"))
    listed = table("bottlers", ["bottler_name", "country", "confidence_score", "official_website", "notes"])
    taken = listed.where(F.col("bottler_name").isNotNull() & ~own("bottler_name"))
    taken = taken.select("row", F.col("bottler_name").alias("name"), "country", enum(F.col("confidence_score"), CONFIDENCE)["value"].alias("confidence"), "official_website", "notes")
    low = low.union(taken.where("confidence = 'low'").select("row"))
    # What products name comes first; a listed bottler of the same name adds nothing.
    both = named.withColumn("_o", F.lit(0)).unionByName(taken.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    bottlers = both.groupBy("name").agg(F.min(F.struct("_o", "row", "country", "confidence", "official_website", "notes")).alias("_f"))
    bottlers = bottlers.select(ident(F.col("name")).alias("bottler_id"), "name", "_f.country", "_f.confidence", "_f.official_website", "_f.notes")

    # Products: filled from filter tags, then given a producer by id, by bottler name or by the longest name they begin with
    tags = table("filter_tags", _PRODUCT)
    fill = [c for c in _PRODUCT if c not in ("name", "original_whisky_id")]
    last = F.max(F.struct("row", *fill)).alias("_t")
    by_id = tags.where("original_whisky_id is not null").groupBy(F.col("original_whisky_id").alias("_id")).agg(last).withColumnRenamed("_t", "_a")
    by_name = tags.where("name is not null").groupBy(F.col("name").alias("_nm")).agg(last).withColumnRenamed("_t", "_b")
    rows = products.where("name is not null").join(by_id, F.col("original_whisky_id") == F.col("_id"), "left").join(by_name, F.col("name") == F.col("_nm"), "left")
    tag = lambda c: F.when(F.col("_id").isNotNull(), F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}"))
    rows = rows.withColumns({c: F.coalesce(c, tag(c)) for c in fill}).drop("_id", "_a", "_nm", "_b")
    known = makers.select(F.col("distillery_id"), F.col("original_distillery_id").alias("_oid"), F.col("name").alias("_dname"))
    with_id = known.where("_oid is not null").select("_oid", F.col("distillery_id").alias("_d1"))
    with_name = known.groupBy(F.lower("_dname").alias("_low")).agg(F.min("distillery_id").alias("_d2"))
    rows = rows.join(with_id, F.col("original_distillery_id") == F.col("_oid"), "left").join(with_name, F.lower("bottler_name") == F.col("_low"), "left")
    begun = longest_prefix(rows.where("_d1 is null and _d2 is null").select("row", "name"), "name", known, "_dname", "distillery_id", "row")
    rows = rows.join(begun.select(F.col("row").alias("_r"), F.col("distillery_id").alias("_d3")), F.col("row") == F.col("_r"), "left")
    rows = rows.withColumn("distillery_id", F.coalesce("_d1", "_d2", "_d3"))
    official = F.coalesce(F.lower("bottling_type") == "official", F.lit(False)) | own("bottler_name")
    kind = F.when(official | F.col("bottler_name").isNull(), "official").otherwise("independent")
    with_bottler = bottlers.select(F.col("name").alias("_bname"), "bottler_id")
    rows = rows.join(with_bottler, (F.col("bottler_name") == F.col("_bname")) & ~official, "left")
    homeless = F.col("distillery_id").isNull() & ~F.coalesce(F.lower("bottling_type").isin(*NO_PRODUCER_NEEDED), F.lit(False))
    reason = (
        F.when(homeless, "no producer by id, bottler or name")
        .when(~official & F.col("bottler_name").isNotNull() & F.col("bottler_id").isNull(), "bottler not found")
        .when(~official & F.col("bottler_name").isNull() & F.coalesce(F.lower("bottling_type") == "independent", F.lit(False)), "independent without a bottler")
    )
    rows = rows.withColumns({"reason": reason, "kind": kind})
    refused, good = rows.where("reason is not null"), rows.where("reason is null")
    at = F.when(homeless, F.lit("distillery_id")).otherwise("bottler_name")
    value = F.when(homeless, F.col("original_distillery_id")).otherwise(F.col("bottler_name"))
    action = F.when(homeless, "add the producer or correct the id").otherwise("assign a bottler")
    reviews.append(
        refused.select(
            F.lit("product").alias("entity_type"), F.col("name").alias("entity_name"), at.alias("field_name"), value.alias("current_value"),
            F.col("reason").alias("problem_reason"), action.alias("suggested_action"),
        )
    )
    good, bad = _numbers(good, NUMBERS, "product")
    reviews += bad
    good = good.withColumn("confidence", enum(F.col("confidence_score"), CONFIDENCE)["value"])
    low = low.union(good.where("confidence = 'low'").select("row"))
    good = good.withColumn("product_id", ident(F.col("name"), F.col("distillery_id"), F.col("bottler_id"), F.col("kind")))
    facts = first_of(
        good.select("row", "product_id", "original_whisky_id", "name", "distillery_id", "bottler_id", F.col("kind").alias("bottling_type"), *NUMBERS, "price_currency", "product_url", "confidence", "notes"),
        "product_id",
    ).drop("row")
    bridge = lambda values, name: good.select("product_id", F.explode(values).alias(name)).distinct()
    urls = bridge(split_urls(F.coalesce("source_urls", F.lit(""))), "url")
    casks = bridge(split_values(F.col("cask_type")), "cask")
    flavours = bridge(F.concat(split_values(F.col("flavor_profile_keywords")), split_values(F.col("flavor_profile"))), "flavour")

    # Audit, refused matches and the review list as it came
    audit = table("source_audit", ["source_title", "source_type", "domain", "extraction_timestamp", "extracted_records_count", "status"])
    audit = audit.withColumn("_e", enum(F.col("source_type"), SOURCE_TYPE))
    reviews.append(review(audit.where("_e.error is not null"), "source_audit", "source_title", "source_type", "source_type", F.col("_e.error"), "correct the source type"))
    count = safe_number(F.col("extracted_records_count"), "long")["value"].alias("extracted_records_count")
    audited = audit.select("source_title", F.col("_e.value").alias("source_type"), "domain", "extraction_timestamp", count, enum(F.col("status"), AUDIT_STATUS)["value"].alias("status"))
    if "source_audit" not in tables:  # the data sets that products come from stand in for it
        sets = products.where("source_dataset is not null").select(F.col("source_dataset").alias("source_title")).distinct()
        audited = sets.select("source_title", F.lit("bulk").alias("source_type"), F.lit("success").alias("status"))
    matches = table("rejected_matches", ["source_title", "scraped_product_name", "unmatched_field", "source_value", "database_value", "match_attempt_date", "problem_type"])
    matches = matches.withColumn("problem_type", enum(F.col("problem_type"), PROBLEM_TYPE)["value"]).drop("row", "name")
    came = table("review_needed", [c.split(" ")[0] for c in REVIEW.split(", ")]).select(*[c.split(" ")[0] for c in REVIEW.split(", ")])
    made = reduce(DataFrame.unionByName, reviews)

    places = makers.select("country", "region").unionByName(bottlers.select("country", F.lit(None).cast("string").alias("region")))
    countries = places.where("country is not null").select(ident(F.col("country")).alias("country_id"), F.col("country").alias("name")).distinct()
    regions = places.where("region is not null").select(ident(F.col("region"), F.col("country")).alias("region_id"), F.col("region").alias("name"), "country").distinct()

    n = lambda df, name: df.agg(F.count("*").alias(name))
    lost = reduce(DataFrame.union, (x.where(F.col(c).isNull()).select("row") for x, c in ((read, "name"), (listed, "bottler_name"), (products, "name"))))
    counts = {
        "rows_read": reduce(DataFrame.union, (df.select("row") for df in tables.values())),
        "rows_failed": lost,
        "distilleries": makers,
        "bottlers": bottlers,
        "products": facts,
        "products_skipped": refused,
        "products_good": good,
        "urls": urls,
        "reviews_imported": came,
        "reviews_made": made,
        "matches_rejected": matches,
        "low_confidence": low,
    }
    counters = reduce(lambda a, b: a.crossJoin(b), (n(df, name) for name, df in counts.items()))  # one row each
    counters = counters.withColumn("products_repeated", F.col("products_good") - F.col("products")).drop("products_good")
    return {
        "countries": countries,
        "regions": regions,
        "distilleries": makers,
        "bottlers": bottlers,
        "products": facts,
        "casks": casks,
        "flavours": flavours,
        "urls": urls,
        "source_audit": audited,
        "rejected_matches": matches,
        "review_needed": came.unionByName(made),
        "counters": counters,
    }
