"""Sections C, E and G, and the flagship search, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import normalize as N
from curata.operators import aggregate as A
from curata.operators import serve as S
from curata.operators import sets as G

from curata.sources.files import scratch_path

from . import Catalog, table

C = Catalog()

ENTITY_SQL = """e AS (SELECT p_partkey AS entity_id, p_name AS name, p_brand AS brand, p_type, p_size, p_retailprice AS price,
  CASE WHEN p_partkey % 17 = 0 THEN p_partkey - 1 END AS superseded_by FROM part)"""


def entities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    gone = F.when(F.col("p_partkey") % 17 == 0, F.col("p_partkey") - 1)
    return p.select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        "p_type",
        "p_size",
        F.col("p_retailprice").alias("price"),
        gone.alias("superseded_by"),
    )


CATALOGUE_SQL = f"""{ENTITY_SQL},
l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem),
c AS (SELECT e.*, l.l_suppkey, s_name, n_name FROM e LEFT JOIN l ON l.l_partkey = e.entity_id AND rn = 1
  LEFT JOIN supplier ON s_suppkey = l.l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey)"""


def catalogue(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    one = S.latest(lines, "entity_id", [F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_suppkey"]).select("entity_id", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return entities(spark, sf_dir).join(one, "entity_id", "left").join(suppliers, "l_suppkey", "left").join(nations, "s_nationkey", "left")


@C.add(
    "catalogue_search",
    f"""WITH {CATALOGUE_SQL} SELECT entity_id, name, brand, n_name FROM c
WHERE superseded_by IS NULL AND NOT contains(lower(brand), 'brand#5') AND NOT contains(lower(name), 'brand#5')
 AND (contains(lower(name), 'an') OR contains(lower(coalesce(n_name, '')), 'an'))
ORDER BY CASE WHEN starts_with(brand, 'Brand#1') THEN 0 ELSE 1 END, name, entity_id LIMIT 50""",
)
def catalogue_search(spark, sf_dir):
    """Active entities with 'an' in their or their nation's name, one brand first."""
    rows = S.active(catalogue(spark, sf_dir), "brand#5")
    order = [S.certified_first(F.col("brand"), "Brand#1"), "name", "entity_id"]
    return S.search(rows, "an", ("name", "n_name"), order).select("entity_id", "name", "brand", "n_name")


@C.add("c1_active", f"WITH {ENTITY_SQL} SELECT entity_id, name, brand FROM e WHERE superseded_by IS NULL AND NOT contains(lower(brand), 'brand#3')")
def c1(spark, sf_dir):
    return S.active(entities(spark, sf_dir), "Brand#3", ("brand",)).select("entity_id", "name", "brand")


@C.add(
    "c3_chips",
    f"WITH {ENTITY_SQL} SELECT entity_id, name FROM e WHERE p_size > 20 AND contains(lower(p_type), 'a')",
)
def c3(spark, sf_dir):
    known = {"large": F.col("p_size") > 20, "with_a": F.contains(F.lower("p_type"), F.lit("a")), "small": F.col("p_size") <= 20}
    return S.chipped(entities(spark, sf_dir), "large, With_A, unheard", known).select("entity_id", "name")


@C.add("c4_page", f"WITH {ENTITY_SQL} SELECT entity_id, name, price FROM e ORDER BY price DESC, entity_id LIMIT 50 OFFSET 100")
def c4(spark, sf_dir):
    return S.page(entities(spark, sf_dir), [F.desc("price"), "entity_id"], 500, 100).select("entity_id", "name", "price")


@C.add(
    "c5_allowlist",
    f"""WITH {ENTITY_SQL}, a AS (SELECT * FROM e WHERE entity_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT entity_id, name, (SELECT count(DISTINCT entity_id) FROM a) AS total_count FROM a ORDER BY name, entity_id LIMIT 20""",
)
def c5(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("entity_id"))
    rows = S.allowed(entities(spark, sf_dir), listed, "entity_id")
    return S.page_with_total(rows, ["name", "entity_id"], 20, 0, "entity_id").select("entity_id", "name", "total_count")


@C.add(
    "c6_fillable",
    """SELECT l_partkey AS p_partkey, l_returnflag AS value, 1 - l_discount AS confidence, l_linestatus AS source FROM lineitem
WHERE trim(l_returnflag) <> '' AND 1 - l_discount >= 0.95 AND l_linestatus = 'F' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)""",
)
def c6(spark, sf_dir):
    current = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("target"))
    line = table(spark, sf_dir, "lineitem")
    offers = line.select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("value"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linestatus").alias("source")
    )
    return S.fillable(offers, current, "p_partkey", "target", "F", 0.95)


@C.add("c7_facets", "SELECT DISTINCT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def c7(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return S.facets(table(spark, sf_dir, "supplier"), facts, "s_suppkey", "s_name")


@C.add("b28_redacted", f"WITH {ENTITY_SQL} SELECT entity_id, name, brand, p_type, p_size, superseded_by FROM e")
def b28(spark, sf_dir):
    return S.redacted(entities(spark, sf_dir))


@C.add("d1_catalogue_view", f"WITH {CATALOGUE_SQL} SELECT entity_id, name, l_suppkey, s_name, n_name FROM c")
def d1(spark, sf_dir):
    return catalogue(spark, sf_dir).select("entity_id", "name", "l_suppkey", "s_name", "n_name")


@C.add(
    "f5_first_wins",
    f"WITH {ENTITY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY CASE WHEN starts_with(brand, 'Brand#1') THEN 0 ELSE 1 END, entity_id) AS n FROM e) SELECT entity_id, name, brand FROM r WHERE n = 1",
)
def f5(spark, sf_dir):
    order = [S.certified_first(F.col("brand"), "Brand#1"), "entity_id"]
    return S.first_wins(entities(spark, sf_dir), "name", order).select("entity_id", "name", "brand")


@C.add("e1_count_with_zero", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def e1(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return A.count_with_zero(table(spark, sf_dir, "nation"), s, "n_nationkey", ["n_name"])


@C.add("e2_top_groups", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def e2(spark, sf_dir):
    return A.top_groups(table(spark, sf_dir, "part"), "p_brand", 5)


@C.add("e3_table_counts", "SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def e3(spark, sf_dir):
    return A.table_counts({t: table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem")})


CONTRIB_SQL = "SELECT vec_id % 100 AS entity, 'a' || (i - 1) AS axis, embedding[i]::DOUBLE + 0.5 AS value, 's' || label AS source FROM embeddings, range(1, 8) t(i)"


def contributions(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = v.select((F.col("vec_id") % 100).alias("entity"), F.concat(F.lit("s"), "label").alias("source"), F.posexplode(F.slice("embedding", 1, 7)).alias("i", "x"))
    return rows.select("entity", F.concat(F.lit("a"), "i").alias("axis"), (F.col("x").cast("double") + 0.5).alias("value"), "source")


@C.add(
    "e4_vector_mean",
    f"""WITH c AS ({CONTRIB_SQL}) SELECT entity, axis, round(greatest(0.0, least(1.0, avg(value))), 6)::DOUBLE AS value,
round(least(1.0, count(*) / 3.0), 6)::DOUBLE AS confidence, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM c GROUP BY ALL""",
)
def e4(spark, sf_dir):
    out = A.vector_mean(contributions(spark, sf_dir))
    return out.withColumn("sources", F.array_join("sources", ","))


@C.add(
    "e5_vector_status",
    f"""WITH c AS ({CONTRIB_SQL}), g AS (SELECT entity, count(*) FILTER (value > 0.45) AS mapped, count(*) FILTER (value < 0.1) AS unmapped,
count(DISTINCT CASE WHEN value > 0.45 THEN axis END) AS nonzero FROM c GROUP BY entity)
SELECT entity, CASE WHEN mapped = 0 THEN 'EMPTY' WHEN nonzero = 7 AND unmapped = 0 THEN 'RESOLVED' WHEN nonzero > 0 THEN 'PARTIAL' ELSE 'EMPTY' END AS status FROM g""",
)
def e5(spark, sf_dir):
    v = F.col("value")
    g = contributions(spark, sf_dir).groupBy("entity").agg(
        F.count_if(v > 0.45).alias("mapped"), F.count_if(v < 0.1).alias("unmapped"), F.countDistinct(F.when(v > 0.45, F.col("axis"))).alias("nonzero")
    )
    return g.select("entity", A.vector_status(F.col("mapped"), F.col("unmapped"), F.col("nonzero"), 7).alias("status"))


HITS_SQL = "SELECT l_partkey AS entity, l_returnflag AS axis, CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS segment, l_linenumber AS reviews, l_quantity AS hits FROM lineitem"


@C.add(
    "e6_weighted_signals",
    f"WITH h AS ({HITS_SQL}) SELECT entity, axis, round(sum(CASE WHEN segment = 'high' THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END * (1 + least(reviews, 5)::DOUBLE / 10) * hits), 6) AS signal FROM h GROUP BY ALL",
)
def e6(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    hits = line.select(
        F.col("l_partkey").alias("entity"),
        F.col("l_returnflag").alias("axis"),
        F.when(F.col("l_linestatus") == "F", "high").otherwise("medium").alias("segment"),
        F.col("l_linenumber").alias("reviews"),
        F.col("l_quantity").alias("hits"),
    )
    return A.weighted_signals(hits)


@C.add(
    "e7_normalised_signals",
    """WITH v AS (SELECT vec_id, list_transform(embedding[1:7], lambda x: greatest(0.0::DOUBLE, x::DOUBLE)) AS k, list_transform(embedding[8:14], lambda x: abs(x::DOUBLE)) AS r FROM embeddings),
n AS (SELECT *, CASE WHEN list_max(k) > 0 THEN list_transform(k, lambda x: x / list_max(k)) ELSE list_transform(k, lambda x: 0.0::DOUBLE) END AS kn FROM v),
s AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, kn), lambda a, b: a + b) AS sk, list_reduce(list_prepend(0.0::DOUBLE, r), lambda a, b: a + b) AS sr FROM n),
c AS (SELECT *, CASE WHEN sr > 0 AND sk > 0 THEN least(1.0::DOUBLE, sk * 0.25 / sr) ELSE 0.0 END AS scale FROM s)
SELECT vec_id, unnest(range(1, 8)) AS axis, unnest(list_transform(range(1, 8), lambda i: round_even(least(1.0::DOUBLE, kn[i] + r[i] * scale), 4))) AS signal FROM c""",
)
def e7(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(
        "vec_id",
        F.transform(F.slice("embedding", 1, 7), lambda x: F.greatest(F.lit(0.0), x.cast("double"))).alias("keyword"),
        F.transform(F.slice("embedding", 8, 7), lambda x: F.abs(x.cast("double"))).alias("regional"),
    )
    out = A.normalised_signals(rows).select("vec_id", F.posexplode("signal").alias("axis", "signal"))
    return out.withColumn("axis", (F.col("axis") + 1).cast("long"))


@C.add(
    "e8_weighted_rating",
    """WITH r AS (SELECT l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS rating, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_linenumber - 1 END AS n FROM lineitem)
SELECT l_suppkey, round(coalesce(sum(rating * n) FILTER (n > 0 AND rating IS NOT NULL) / sum(n) FILTER (n > 0 AND rating IS NOT NULL), avg(rating)), 2) AS rating FROM r GROUP BY 1""",
)
def e8(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        "l_suppkey",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("rating_in"),
        F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_linenumber") - 1).alias("n"),
    )
    return A.weighted_rating(rows, "l_suppkey", "rating_in", "n")


@C.add(
    "e9_representative",
    """WITH g AS (SELECT p_brand, p_name, count(*) AS n, max(p_size) AS w FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w DESC, p_name) AS rn FROM g) SELECT p_brand, p_name FROM r WHERE rn = 1""",
)
def e9(spark, sf_dir):
    return A.representative(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_size")


@C.add(
    "e12_context_consensus",
    """WITH h AS (SELECT l_partkey AS entity, l_suppkey AS context, l_returnflag AS axis, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT entity, count(DISTINCT context) AS c FROM h GROUP BY 1), m AS (SELECT entity, axis, sum(n)::DOUBLE / any_value(c) AS m FROM h JOIN c USING (entity) GROUP BY ALL)
SELECT entity, axis, floor(m * 100 / max(m) OVER (PARTITION BY entity))::INT AS value FROM m""",
)
def e12(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    counts = line.groupBy(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("context"), F.col("l_returnflag").alias("axis")).agg(F.count("*").alias("n"))
    return A.context_consensus(counts)


BLANK = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END"


@C.add(
    "e13_census",
    f"""WITH r AS (SELECT {BLANK} AS label, p_brand FROM part)
SELECT 'label' AS column_name, count(*) FILTER (label IS NULL) AS n_null, count(*) FILTER (label = '') AS n_blank, count(*) FILTER (label <> '' AND trim(label) = '') AS n_space, count(*) FILTER (trim(label) <> '') AS n_filled FROM r
UNION ALL SELECT 'p_brand', count(*) FILTER (p_brand IS NULL), count(*) FILTER (p_brand = ''), 0, count(*) FILTER (trim(p_brand) <> '') FROM r""",
)
def e13(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(BLANK).alias("label"), "p_brand")
    return A.census(rows, ["label", "p_brand"])


@C.add(
    "e14_coverage",
    """WITH f AS (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AS a, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AS b FROM part)
SELECT count(*) AS n, round(avg(a::INT), 6) AS in_first, round(avg(b::INT), 6) AS in_second, round(avg((a AND b)::INT), 6) AS in_both, round(avg((NOT a AND NOT b)::INT), 6) AS in_neither, round(avg((a <> b)::INT), 6) AS in_one FROM f""",
)
def e14(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return A.coverage(table(spark, sf_dir, "part"), line.where("l_quantity > 48"), line.where("l_discount > 0.09"), "p_partkey")


@C.add("e15_distribution", "SELECT n_rows, count(*) AS n_keys FROM (SELECT l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1) GROUP BY 1")
def e15(spark, sf_dir):
    return A.count_distribution(table(spark, sf_dir, "lineitem"), "l_partkey")


@C.add("e16_fill_rate", "SELECT (SELECT count(*) FROM customer) AS n, count(DISTINCT o_custkey) AS n_linked, round(count(DISTINCT o_custkey)::DOUBLE / (SELECT count(*) FROM customer), 6) AS rate FROM orders")
def e16(spark, sf_dir):
    bridge = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return A.fill_rate(bridge, table(spark, sf_dir, "customer"), "c_custkey")


@C.add("e17_spread", "SELECT p_brand, round(median(p_retailprice), 6) AS median, min(p_retailprice) AS lowest, max(p_retailprice) AS highest, count(p_retailprice) AS n FROM part GROUP BY 1")
def e17(spark, sf_dir):
    return A.spread(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@C.add(
    "e18_histogram",
    "SELECT CASE WHEN l_discount < 0.02 THEN '<0.02' WHEN l_discount < 0.05 THEN '0.02-0.05' WHEN l_discount < 0.08 THEN '0.05-0.08' ELSE '>=0.08' END AS bin, count(*) AS n FROM lineitem GROUP BY 1",
)
def e18(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_discount", (0.02, 0.05, 0.08))


@C.add("e19_duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def e19(spark, sf_dir):
    return A.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@C.add(
    "e20_classified_duplicates",
    """SELECT p_name, count(*) AS n, CASE WHEN bool_or(contains(lower(p_type), 'brushed') AND p_size > 45) THEN 'batch' WHEN count(DISTINCT coalesce(CASE WHEN p_size > 2 THEN p_brand END, '')) > 1 THEN 'sources' ELSE 'multiple' END AS kind
FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def e20(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_name", F.when(F.col("p_size") > 45, F.col("p_type")).alias("text"), F.when(F.col("p_size") > 2, F.col("p_brand")).alias("source")
    )
    return A.classified_duplicates(rows, "p_name", "text", "source", ("brushed",))


@C.add(
    "e21_conflicting_keys",
    "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS found FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1",
)
def e21(spark, sf_dir):
    return A.conflicting_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag").withColumn("found", F.array_join("found", ","))


@C.add(
    "e22_critic_profiles",
    """SELECT source, quality, count(*) AS n_reviews, round(avg(toxic), 6) AS mean_score, round(avg(n_chars), 6) AS mean_n_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
)
def e22(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return A.critic_profiles(rows, ["source", "quality"], "toxic", ["n_chars"])


@C.add(
    "e23_grouped_listing",
    "SELECT lower(replace(p_name, ' ', '-')) AS slug, arg_min(p_name, p_partkey) AS label, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1",
)
def e23(spark, sf_dir):
    return A.grouped_listing(table(spark, sf_dir, "part"), N.slug(F.col("p_name")), "p_name", "p_partkey")


@C.add(
    "e24_source_yield",
    """WITH c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), v AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)
SELECT l_suppkey, count(*) AS n_found, count(*) FILTER (v.l_partkey IS NULL) AS n_new FROM c LEFT JOIN v USING (l_partkey) GROUP BY 1""",
)
def e24(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return A.source_yield(line.where("l_returnflag = 'A'"), line.where("l_quantity > 45"), "l_suppkey", "l_partkey")


@C.add(
    "e25_job_counters",
    "SELECT count(*) AS n_read, count(*) FILTER (l_quantity < 3) AS n_rejected, count(*) FILTER (l_quantity >= 3 AND l_discount = 0) AS n_reused, count(*) FILTER (l_quantity >= 3 AND l_discount <> 0) AS n_inserted, count(*) FILTER (l_tax < 0.02) AS n_low FROM lineitem",
)
def e25(spark, sf_dir):
    return A.job_counters(table(spark, sf_dir, "lineitem"), F.col("l_quantity") < 3, F.col("l_discount") == 0, F.col("l_tax") < 0.02)


@C.add(
    "e25_observed_write",
    "SELECT count(*) AS n_read, count(*) FILTER (l_quantity < 3) AS n_rejected, count(*) FILTER (l_quantity >= 3 AND l_discount = 0) AS n_reused, count(*) FILTER (l_quantity >= 3 AND l_discount <> 0) AS n_inserted, count(*) FILTER (l_tax < 0.02) AS n_low, count(*) FILTER (l_quantity >= 3 AND l_discount <> 0) AS n_written FROM lineitem",
)
def e25_observed(spark, sf_dir):
    path = scratch_path(spark, "inserted")
    counts = A.observed_write(table(spark, sf_dir, "lineitem"), path, F.col("l_quantity") < 3, F.col("l_discount") == 0, F.col("l_tax") < 0.02)
    return spark.read.parquet(path).agg(*[F.lit(v).alias(k) for k, v in counts.items()], F.count("*").alias("n_written"))


@C.add(
    "e26_group_scores",
    "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0) + coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 0) AS light, coalesce(CASE WHEN p_size % 5 = 0 THEN p_size END, 0) AS dark, (p_size % 2 <> 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0) AS is_zero FROM part",
)
def e26(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.when(size % k == 0, size).alias(f"a{k}") for k in (2, 3, 5)])
    return A.group_scores(rows, {"light": ["a2", "a3"], "dark": ["a5"]}).select("p_partkey", "light", "dark", "is_zero")


@C.add(
    "e27_batch_fill",
    f"SELECT count(*) AS n, count(*) FILTER (trim({BLANK}) <> '') AS n_label, count(*) FILTER (trim(p_type) <> '') AS n_p_type, count(p_name) - count(DISTINCT p_name) AS n_repeated FROM part",
)
def e27(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("label", F.expr(BLANK))
    return A.batch_fill(rows, ["label", "p_type"], "p_name")


@C.add(
    "g1_heterogeneous_union",
    "SELECT 's' || s_suppkey AS item_id, s_name AS name, NULL::VARCHAR AS segment, s_acctbal AS score, 'supplier' AS queue FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, c_mktsegment, c_acctbal, 'customer' FROM customer",
)
def g1(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("item_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("item_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("score")
    )
    return G.queue_view({"supplier": s, "customer": c}, ["item_id", "name", "segment", "score"])


@C.add("g2_covered_by_any", "SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1")
def g2(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return G.covered([line.where("l_quantity > 49"), line.where("l_discount >= 0.1")], "l_partkey")


@C.add("g3_except", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09)")
def g3(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return G.only_first(line.where("l_quantity > 48"), line.where("l_discount >= 0.09"), "l_partkey")


@C.add("g4_intersection", "SELECT l_partkey FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09")
def g4(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return G.shared(line.where("l_quantity > 48"), line.where("l_discount >= 0.09"), "l_partkey")


@C.add(
    "g5_partition_check",
    "SELECT count(*) AS n, count(*) FILTER (p_size < 10 AND p_size > 40) AS n_overlap, count(*) FILTER (p_size BETWEEN 10 AND 12) AS n_uncovered FROM part",
)
def g5(spark, sf_dir):
    size = F.col("p_size")
    return G.partition_check(table(spark, sf_dir, "part"), {"low": size < 10, "mid": (size > 12) & (size <= 40), "high": size > 40})


