"""Authority, confidence and certification of claims; qualification of documents.

Claims are rows (entity, field, value, source, publisher, tier 1..3, priority, date, confidence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Confidence by kind of evidence, bonuses, penalties, and the tier each field asks for.
BASE_CONFIDENCE = {"primary_source_quote": 0.95, "bottle_print": 0.98, "expert_quote": 0.90, "aggregated_link": 0.55, "inferred": 0.20}
PENALTIES = {"missing_evidence": 0.50, "low_authority_tier": 0.30, "normalization_failed": 0.25, "conflicting_unresolved": 0.15}
BONUS_EACH, BONUS_MOST, AGREE_LEAST = 0.03, 0.10, 2
CERTIFY_MIN = 0.70
FIELD_TIER = {
    "distillery_name": 1,
    "region": 1,
    "country": 1,
    "abv": 1,
    "age_statement": 1,
    "cask_type": 1,
    "nose": 2,
    "palate": 2,
    "finish": 2,
    "flavor_axes": 2,
    "score": 2,
    "community_rating": 3,
}
SCORE_WEIGHTS = {
    "authority": 0.20,
    "metadata_density": 0.15,
    "extraction_complexity": 0.10,
    "historical_value": 0.10,
    "flavor_usefulness": 0.10,
    "identity_usefulness": 0.10,
    "expected_noise": 0.10,
    "license_risk": 0.05,
    "ocr_quality": 0.05,
    "expected_evidence_count": 0.05,
}


def _first(claims: DataFrame, order: list) -> DataFrame:
    """Winner per entity and field, with the values of the others."""
    w = Window.partitionBy("entity", "field")
    ranked = claims.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    winner = ranked.where("_n = 1").drop("_n")
    losers = ranked.where("_n > 1").groupBy("entity", "field").agg(
        F.count("*").alias("n_losers"), F.array_sort(F.collect_set("value")).alias("other_values")
    )
    met = winner.join(losers, ["entity", "field"], "left")
    none = F.array().cast("array<string>")
    return met.withColumns({"n_losers": F.coalesce("n_losers", F.lit(0)), "other_values": F.coalesce("other_values", none)})


def authority_wins(claims: DataFrame, tie: list[str]) -> DataFrame:
    """Lowest tier, then priority; the other values stay with the winner."""
    return _first(claims, ["tier", "priority", *tie])


def latest_expert_wins(claims: DataFrame, tie: list[str]) -> DataFrame:
    """The newest tier 2 claim that has a date, else as ``authority_wins``; ``audit`` marks experts without any date."""
    expert = (F.col("tier") == 2) & F.col("date").isNotNull()
    audit = F.max((F.col("tier") == 2) & F.col("date").isNull()).over(Window.partitionBy("entity", "field"))
    order = [F.when(expert, 0).otherwise(1), F.when(expert, F.col("date")).desc_nulls_last(), "tier", "priority", *tie]
    return _first(claims.withColumn("audit", audit), order)


def agreement_bonus(publishers: Column) -> Column:
    return F.when(publishers >= AGREE_LEAST, F.least(F.lit(BONUS_MOST), publishers * BONUS_EACH)).otherwise(0.0)


def consensus(claims: DataFrame) -> DataFrame:
    """Per value its independent publishers and confidence with the bonus for agreement."""
    g = claims.groupBy("entity", "field", "value").agg(F.countDistinct("publisher").alias("n_publishers"), F.max("confidence").alias("_c"))
    sure = F.least(F.lit(1.0), F.col("_c") + agreement_bonus(F.col("n_publishers")))
    return g.select("entity", "field", "value", "n_publishers", (F.col("n_publishers") >= AGREE_LEAST).alias("agreed"), F.bround(sure, 4).alias("confidence"))


def reject_on_conflict(claims: DataFrame) -> DataFrame:
    """Fields for which the top tier states several values."""
    n = F.countDistinct(F.when(F.col("tier") == 1, F.col("value")))
    return claims.groupBy("entity", "field").agg(n.alias("n_values")).withColumn("reason", F.when(F.col("n_values") > 1, "UNRESOLVED_CONFLICT"))


def confidence(kind: Column, publishers: Column, flags: dict[str, Column]) -> Column:
    """Base by kind of evidence, agreement bonus up to 1, penalties down to 0, four decimals with halves to even."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE_CONFIDENCE.items() for x in kv]), kind), F.lit(0.0))
    sure = F.least(F.lit(1.0), base + agreement_bonus(publishers))
    cut = reduce(lambda a, b: a + b, (F.when(c, PENALTIES[n]).otherwise(0.0) for n, c in flags.items()), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), sure - cut), 4)


def certified_fields(claims: DataFrame) -> DataFrame:
    """Level and path per entity and field: D conflict, F nothing to go by, E unsure, A certified, C below the field's tier.

    Path B (corroborated) is declared by the rule but never given.
    """
    top = FIELD_TIER.items()
    tier = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in top for x in kv]), F.col("field")), F.lit(3))
    g = claims.groupBy("entity", "field").agg(
        F.max("confidence").alias("confidence"),
        F.min("tier").alias("tier"),
        F.bool_or(F.coalesce(F.col("conflict"), F.lit(False))).alias("conflict"),
    )
    sure = F.coalesce("confidence", F.lit(0.0))
    path = (
        F.when(F.col("conflict"), "D")
        .when(sure < 0.01, "F")
        .when(sure < CERTIFY_MIN, "E")
        .when(F.coalesce("tier", F.lit(99)) <= tier, "A")
        .otherwise("C")
    )
    out = g.withColumn("path", path)
    return out.withColumn("level", F.when(F.col("path") == "A", "certified").when(F.col("path") == "C", "proposed").otherwise("rejected"))


def certified_entities(fields: DataFrame) -> DataFrame:
    """I8."""
    g = fields.groupBy("entity").agg(
        F.bool_or(F.col("level") == "rejected").alias("_r"), F.bool_or(F.col("level") == "proposed").alias("_p"), F.min("confidence").alias("min_confidence")
    )
    status = F.when(F.col("_r"), "REJECTED").when(F.col("_p"), "HOLD").otherwise("CERTIFIED")
    return g.select("entity", status.alias("status"), "min_confidence")


def document_class(url: Column, mime: Column, filename: Column, flag) -> Column:
    """The first rule that holds; ``flag(name)`` gives the boolean column of a surface signal."""
    u, m, f = F.lower(url), F.lower(mime), F.lower(filename)
    pdf = (m == "application/pdf") | F.endswith(f, F.lit(".pdf"))
    return (
        F.when(F.startswith(m, F.lit("image/")) | F.contains(f, F.lit("scan")), "scanned_document")
        .when(f.rlike(r"\.csv|\.sql|\.json"), "database_dump")
        .when(F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1) == "web.archive.org", "archived_snapshot")
        .when(flag("is_structured_export"), "review_website_export")
        .when(flag("has_isbn"), "book")
        .when(flag("has_issn"), "magazine")
        .when(flag("has_doi"), "research_paper")
        .when(pdf & flag("is_gov_domain"), "official_pdf")
        .when(pdf & flag("is_producer_domain"), "product_sheet")
        .when(pdf & flag("is_brand_domain"), "marketing_brochure")
        .when(pdf & flag("is_auction_domain"), "auction_catalogue")
        .when(flag("is_blog_domain") | F.contains(u, F.lit("rss")), "blog_article")
        .otherwise("unknown")
    )


def document_score(value) -> Column:
    """0..100 from ten weighted factors; ``value(name)`` gives the column of a factor."""
    inverse = {"extraction_complexity", "expected_noise", "license_risk"}
    parts = []
    for name, w in SCORE_WEIGHTS.items():
        v = value(name)
        v = F.least(v / 12.0, F.lit(1.0)) if name == "expected_evidence_count" else 1.0 - v if name in inverse else v
        parts.append(v * w)
    return F.bround(100.0 * reduce(lambda a, b: a + b, parts), 0).cast("int")


def gate(doc_id: Column, doc_class: Column, score: Column, license_risk: Column, tier: Column, identity: Column, ocr_need: Column, text_layer: Column, ocr_quality: Column) -> Column:
    """struct<gate, rule>. A licence risk that is not known counts as 1, a tier as 3, an identity, OCR need or quality as none."""
    license_risk, tier, identity = F.coalesce(license_risk, F.lit(1.0)), F.coalesce(tier, F.lit(3)), F.coalesce(identity, F.lit(0.0))
    ocr_need, text_layer, ocr_quality = F.coalesce(ocr_need, F.lit(False)), F.coalesce(text_layer, F.lit(False)), F.coalesce(ocr_quality, F.lit(0.0))
    base = F.when(score >= 80, "high_priority").when(score >= 60, "extract_normally").when(score >= 45, "extract_later").when(score >= 25, "archive_only").otherwise("reject")
    extract = score >= 45
    blocked = ocr_need & ~(text_layer | (ocr_quality > 0))
    made = lambda g, r: F.struct((F.lit(g) if isinstance(g, str) else g).alias("gate"), F.lit(r).alias("rule"))
    return (
        F.when(F.coalesce(doc_id.cast("string"), F.lit("")) == "", made("reject", "G0"))
        .when(doc_class == "unknown", made("reject", "G1"))
        .when(license_risk >= 1.0, made("reject", "G2"))
        .when((tier == 3) & (identity < 0.2), made("reject", "G3"))
        .when(extract & blocked, made("archive_only", "G4"))
        .when(extract & (license_risk >= 0.6), made("archive_only", "G2"))
        .otherwise(made(base, "G5"))
    )


def expected_yield(authority: Column, density: Column, dump: Column, ocr_need: Column, tables: Column, complexity: Column) -> Column:
    """struct<confidence, cost>."""
    units = ocr_need.cast("int") + (tables >= 0.6).cast("int") + (complexity >= 0.6).cast("int")
    cost = F.when(units == 0, "Low").when(units == 1, "Medium").otherwise("High")
    return F.struct(F.bround(F.when(dump, 0.9).otherwise(authority) * density, 2).alias("confidence"), cost.alias("cost"))


def evidence_candidates(units: DataFrame, scope: list[str], id_of: Column) -> DataFrame:
    """Claims of the fields in scope that have a value, with their id."""
    rows = units.where(F.col("field").isin(*scope) & F.coalesce(F.trim("value") != "", F.lit(False)))
    return rows.select(id_of.alias("evidence_id"), "entity", "field", "value")


def fused(new: DataFrame, held: DataFrame, order: list) -> DataFrame:
    """Evidence whose value is new to its target, once."""
    fresh = new.join(held.select("target", "value"), ["target", "value"], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("target", "value").orderBy(*order))).where("_n = 1").drop("_n")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def segmented(df: DataFrame, severe: dict[str, Column], mild: dict[str, Column]) -> DataFrame:
    """Quarantine with a severe reason, medium with a mild one, else high."""
    out = df.withColumn("reasons", reasons(severe | mild))
    bad = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in severe.values()))
    return out.withColumn("segment", F.when(bad, "quarantine").when(F.size("reasons") > 0, "medium").otherwise("high"))


def overlap(first: list[Column], second: list[Column], names: list[str]) -> Column:
    """I16: intersection over union of two claim sets; null values are no claims."""
    claims = lambda cols: F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in zip(names, cols, strict=True)]), lambda x: x.isNotNull())
    a, b = claims(first), claims(second)
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
