"""Section I bound to the test tables: claims from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import names as M
from curata.operators import evidence as V

from . import Catalog, table

C = Catalog()

CLAIMS = """c AS (SELECT l_partkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'region' ELSE 'nose' END AS field, l_returnflag || l_linestatus AS value, l_suppkey AS source,
 'p' || (l_suppkey % 9) AS publisher, (l_suppkey % 3 + 1)::INT AS tier, (l_suppkey % 5)::INT AS priority, CASE WHEN l_suppkey % 7 <> 0 THEN l_shipdate END AS date,
 1 - l_discount * 5 AS confidence, l_tax > 0.075 AS conflict, l_orderkey, l_linenumber FROM lineitem)"""
TIE = ["source", "l_orderkey", "l_linenumber"]


def claims(spark, sf_dir):
    line, s = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    return line.select(
        F.col("l_partkey").alias("entity"),
        F.when(F.col("l_linenumber") % 2 == 0, "region").otherwise("nose").alias("field"),
        F.concat("l_returnflag", "l_linestatus").alias("value"),
        s.alias("source"),
        F.concat(F.lit("p"), s % 9).alias("publisher"),
        (s % 3 + 1).cast("int").alias("tier"),
        (s % 5).cast("int").alias("priority"),
        F.when(s % 7 != 0, F.col("l_shipdate")).alias("date"),
        (1 - F.col("l_discount") * 5).alias("confidence"),
        (F.col("l_tax") > 0.075).alias("conflict"),
        "l_orderkey",
        "l_linenumber",
    )


def _winner(order: str) -> str:
    return f"""WITH {CLAIMS}, r AS (SELECT *, max(tier = 2 AND date IS NULL) OVER (PARTITION BY entity, field) AS audit, row_number() OVER (PARTITION BY entity, field ORDER BY {order}, source, l_orderkey, l_linenumber) AS n FROM c),
o AS (SELECT entity, field, count(*) AS n_losers, array_to_string(list_sort(list_distinct(list(value))), ',') AS other_values FROM r WHERE n > 1 GROUP BY ALL)
SELECT entity, field, value, source, audit, coalesce(n_losers, 0) AS n_losers, coalesce(other_values, '') AS other_values FROM r LEFT JOIN o USING (entity, field) WHERE n = 1"""


_EXPERT = "tier = 2 AND date IS NOT NULL"


@C.add("i1_authority_wins", _winner("tier, priority").replace("source, audit,", "source,"))
def i1(spark, sf_dir):
    out = V.authority_wins(claims(spark, sf_dir), TIE)
    return out.select("entity", "field", "value", "source", "n_losers", F.array_join("other_values", ",").alias("other_values"))


@C.add("i2_latest_expert_wins", _winner(f"CASE WHEN {_EXPERT} THEN 0 ELSE 1 END, CASE WHEN {_EXPERT} THEN date END DESC NULLS LAST, tier, priority"))
def i2(spark, sf_dir):
    out = V.latest_expert_wins(claims(spark, sf_dir), TIE)
    return out.select("entity", "field", "value", "source", "audit", "n_losers", F.array_join("other_values", ",").alias("other_values"))


@C.add(
    "i3_consensus",
    f"""WITH {CLAIMS}, g AS (SELECT entity, field, value, count(DISTINCT publisher) AS n_publishers, max(confidence) AS c FROM c GROUP BY ALL)
SELECT entity, field, value, n_publishers, n_publishers >= 2 AS agreed, round_even(least(1.0::DOUBLE, c + CASE WHEN n_publishers >= 2 THEN least(0.1::DOUBLE, n_publishers * 0.03::DOUBLE) ELSE 0.0::DOUBLE END), 4) AS confidence FROM g""",
)
def i3(spark, sf_dir):
    return V.consensus(claims(spark, sf_dir))


@C.add(
    "i5_reject_on_conflict",
    f"WITH {CLAIMS} SELECT entity, field, count(DISTINCT CASE WHEN tier = 1 THEN value END) AS n_values, CASE WHEN count(DISTINCT CASE WHEN tier = 1 THEN value END) > 1 THEN 'UNRESOLVED_CONFLICT' END AS reason FROM c GROUP BY ALL",
)
def i5(spark, sf_dir):
    return V.reject_on_conflict(claims(spark, sf_dir))


_KIND = "CASE l_suppkey % 6 WHEN 0 THEN 'primary_source_quote' WHEN 1 THEN 'bottle_print' WHEN 2 THEN 'expert_quote' WHEN 3 THEN 'aggregated_link' WHEN 4 THEN 'inferred' ELSE 'hearsay' END"


@C.add(
    "i6_confidence",
    f"""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_KIND} AS kind, l_linenumber AS n, l_tax > 0.06 AS a, l_discount > 0.08 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE kind WHEN 'primary_source_quote' THEN 0.95::DOUBLE WHEN 'bottle_print' THEN 0.98::DOUBLE WHEN 'expert_quote' THEN 0.9::DOUBLE WHEN 'aggregated_link' THEN 0.55::DOUBLE WHEN 'inferred' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN n >= 2 THEN least(0.1::DOUBLE, n * 0.03::DOUBLE) ELSE 0.0::DOUBLE END) - (CASE WHEN a THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN b THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS confidence FROM k""",
)
def i6(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    flags = {"missing_evidence": F.col("l_tax") > 0.06, "conflicting_unresolved": F.col("l_discount") > 0.08}
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.confidence(F.expr(_KIND), F.col("l_linenumber"), flags).alias("confidence"))


CERT = f"""{CLAIMS}, g AS (SELECT entity, field, max(confidence) AS confidence, min(tier) AS tier, bool_or(conflict) AS conflict FROM c GROUP BY ALL),
p AS (SELECT *, CASE WHEN conflict THEN 'D' WHEN confidence < 0.01 THEN 'F' WHEN confidence < 0.7 THEN 'E' WHEN tier <= CASE field WHEN 'region' THEN 1 ELSE 2 END THEN 'A' ELSE 'C' END AS path FROM g),
f AS (SELECT *, CASE path WHEN 'A' THEN 'certified' WHEN 'C' THEN 'proposed' ELSE 'rejected' END AS level FROM p)"""


@C.add("i7_certified_fields", f"WITH {CERT} SELECT entity, field, confidence, tier, path, level FROM f")
def i7(spark, sf_dir):
    return V.certified_fields(claims(spark, sf_dir)).select("entity", "field", "confidence", "tier", "path", "level")


@C.add(
    "i8_certified_entities",
    f"WITH {CERT} SELECT entity, CASE WHEN bool_or(level = 'rejected') THEN 'REJECTED' WHEN bool_or(level = 'proposed') THEN 'HOLD' ELSE 'CERTIFIED' END AS status, min(confidence) AS min_confidence FROM f GROUP BY entity",
)
def i8(spark, sf_dir):
    return V.certified_entities(V.certified_fields(claims(spark, sf_dir)))


_FILE = "CASE doc_id % 7 WHEN 0 THEN 'scan-1.tif' WHEN 1 THEN 'dump.csv' WHEN 2 THEN 'a.pdf' ELSE 'a.html' END"
_URL = "CASE doc_id % 5 WHEN 0 THEN 'https://web.archive.org/x' WHEN 1 THEN 'https://b.example.com/rss' ELSE 'https://c.example.com/' END"


@C.add(
    "i9_document_class",
    f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'scanned_document' WHEN doc_id % 7 = 1 THEN 'database_dump' WHEN doc_id % 5 = 0 THEN 'archived_snapshot' WHEN doc_id % 11 = 0 THEN 'book' WHEN doc_id % 13 = 0 THEN 'magazine'
 WHEN doc_id % 7 = 2 AND doc_id % 3 = 0 THEN 'official_pdf' WHEN doc_id % 7 = 2 AND doc_id % 3 = 1 THEN 'product_sheet' WHEN doc_id % 5 = 1 THEN 'blog_article' ELSE 'unknown' END AS class FROM documents""",
)
def i9(spark, sf_dir):
    d = F.col("doc_id")
    signals = {"has_isbn": d % 11 == 0, "has_issn": d % 13 == 0, "is_gov_domain": d % 3 == 0, "is_producer_domain": d % 3 == 1}
    found = V.document_class(F.expr(_URL), F.lit("text/html"), F.expr(_FILE), lambda n: signals.get(n, F.lit(False)))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("class"))


@C.add(
    "i10_document_gates",
    """WITH v AS (SELECT doc_id, (doc_id % 10) / 10.0::DOUBLE AS a, (doc_id % 7) / 7.0::DOUBLE AS b, (doc_id % 20)::DOUBLE AS n, (doc_id % 12) / 11.0::DOUBLE AS risk, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (doc_id % 12) / 11.0::DOUBLE END AS known_risk, CASE WHEN doc_id % 19 <> 0 THEN (doc_id % 3 + 1)::INT ELSE 3 END AS tier, doc_id % 6 = 0 AS ocr FROM documents),
s AS (SELECT *, round_even(100.0::DOUBLE * (a * 0.2::DOUBLE + b * 0.15::DOUBLE + (1.0::DOUBLE - b) * 0.1::DOUBLE + a * 0.1::DOUBLE + b * 0.1::DOUBLE + a * 0.1::DOUBLE + (1.0::DOUBLE - b) * 0.1::DOUBLE + (1.0::DOUBLE - risk) * 0.05::DOUBLE + a * 0.05::DOUBLE + least(n / 12.0::DOUBLE, 1.0::DOUBLE) * 0.05::DOUBLE), 0)::INT AS score FROM v),
g AS (SELECT *, CASE WHEN coalesce(known_risk, 1.0) >= 1.0 THEN 'reject' WHEN tier = 3 AND a < 0.2 THEN 'reject' WHEN score >= 45 AND ocr AND NOT a > 0 THEN 'archive_only' WHEN score >= 45 AND known_risk >= 0.6 THEN 'archive_only'
 WHEN score >= 80 THEN 'high_priority' WHEN score >= 60 THEN 'extract_normally' WHEN score >= 45 THEN 'extract_later' WHEN score >= 25 THEN 'archive_only' ELSE 'reject' END AS gate,
 CASE WHEN coalesce(known_risk, 1.0) >= 1.0 THEN 'G2' WHEN tier = 3 AND a < 0.2 THEN 'G3' WHEN score >= 45 AND ocr AND NOT a > 0 THEN 'G4' WHEN score >= 45 AND known_risk >= 0.6 THEN 'G2' ELSE 'G5' END AS rule FROM s)
SELECT doc_id, score, gate, rule, round_even(a * b, 2) AS confidence, CASE (ocr::INT + (b >= 0.6)::INT + (a >= 0.6)::INT) WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS cost FROM g""",
)
def i10(spark, sf_dir):
    """I10, I11, I12."""
    d = F.col("doc_id")
    a, b, n, risk = d % 10 / 10.0, d % 7 / 7.0, (d % 20).cast("double"), d % 12 / 11.0
    which = {"authority": a, "historical_value": a, "identity_usefulness": a, "ocr_quality": a, "expected_evidence_count": n, "license_risk": risk}
    rows = table(spark, sf_dir, "documents").select("doc_id", V.document_score(lambda k: which.get(k, b)).alias("score"))
    tier, ocr = F.when(d % 19 != 0, (d % 3 + 1).cast("int")), d % 6 == 0
    g = V.gate(d, F.lit("book"), F.col("score"), F.when(d % 17 != 0, risk), tier, a, ocr, F.lit(None).cast("boolean"), a)
    y = V.expected_yield(a, b, F.lit(False), ocr, b, a)
    return rows.select("doc_id", "score", g.alias("g"), y.alias("y")).select("doc_id", "score", "g.*", "y.*")


@C.add(
    "i13_evidence_candidates",
    f"WITH {CLAIMS} SELECT 'EV-' || substring(sha256(entity || ':' || field || ':' || value), 1, 16) AS evidence_id, entity, field, value FROM c WHERE field = 'region'",
)
def i13(spark, sf_dir):
    ident = M.digest_id(F.col("entity"), F.col("field"), F.col("value"), prefix="EV-", length=16)
    return V.evidence_candidates(claims(spark, sf_dir), ["region", "country"], ident)


@C.add(
    "i14_fused",
    f"""WITH {CLAIMS}, h AS (SELECT entity, value FROM c WHERE tier = 1), r AS (SELECT *, row_number() OVER (PARTITION BY entity, value ORDER BY source, l_orderkey, l_linenumber) AS n FROM c WHERE tier > 1 AND (entity, value) NOT IN (SELECT entity, value FROM h))
SELECT entity AS target, value, source FROM r WHERE n = 1""",
)
def i14(spark, sf_dir):
    c = claims(spark, sf_dir).withColumnRenamed("entity", "target")
    return V.fused(c.where("tier > 1"), c.where("tier = 1"), TIE).select("target", "value", "source")


@C.add(
    "i15_segmented",
    """WITH r AS (SELECT p_partkey, p_size < 3 AS a, p_retailprice > 1900 AS b, p_size > 45 AS c FROM part) SELECT p_partkey, CASE WHEN a OR b THEN 'quarantine' WHEN c THEN 'medium' ELSE 'high' END AS segment,
array_to_string(list_filter([CASE WHEN a THEN 'tiny' END, CASE WHEN b THEN 'costly' END, CASE WHEN c THEN 'huge' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
)
def i15(spark, sf_dir):
    size = F.col("p_size")
    out = V.segmented(table(spark, sf_dir, "part"), {"tiny": size < 3, "costly": F.col("p_retailprice") > 1900}, {"huge": size > 45})
    return out.select("p_partkey", "segment", F.array_join("reasons", ",").alias("reasons"))


@C.add(
    "i16_overlap",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (1 + (p_size = 7)::INT)::DOUBLE / (CASE WHEN p_size = 7 THEN 2 ELSE 3 END) ELSE (p_size = 7)::INT::DOUBLE / (CASE WHEN p_size = 7 THEN 3 ELSE 4 END) END AS iou FROM part",
)
def i16(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("x"))
    found = V.overlap([F.col("p_name"), F.col("p_size")], [name, F.lit(7)], ["name", "age"])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("iou"))
