"""Sections F, H and B21-B23 bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import lexicon as L
from curata.operators import aggregate as A
from curata.operators import rank as K

from . import Catalog, dealt, table

C = Catalog()

_Q = "CASE p_partkey % 4 WHEN 0 THEN 'manual_review' WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'none' END"


@C.add(
    "f2_by_priority",
    "WITH r AS (SELECT l_partkey, l_shipmode, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_shipmode WHEN 'R' THEN 1 WHEN 'A' THEN 2 END, l_orderkey, l_linenumber, l_suppkey) AS n FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_shipmode IN ('R', 'A')) SELECT l_partkey, l_shipmode AS l_returnflag, l_orderkey, l_linenumber, l_suppkey FROM r WHERE n = 1",
)
def f2(spark, sf_dir):
    out = K.by_priority(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", {"R": 1, "A": 2}, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")


@C.add(
    "f3_similar",
    """WITH v AS (SELECT vec_id, list_transform(embedding[1:7], lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 8), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))), lambda s, x: s + x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, round(sqrt(d), 6) AS distance, round(1 / (1 + sqrt(d)), 6) AS similarity FROM r WHERE rank <= 5""",
)
def f3(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("v"))
    return K.similar(v, v, "vec_id", "v", 5)


@C.add(
    "f4_constant_vectors",
    "SELECT vec_id FROM (SELECT vec_id, list_transform(embedding[1:3], lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS v FROM embeddings) WHERE list_min(v) = list_max(v) AND list_min(v) > 0",
)
def f4(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    v = v.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("v"))
    return v.where(K.constant_vector(F.col("v"))).select("vec_id")


@C.add(
    "f6_keep_last",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE n = 1",
)
def f6(spark, sf_dir):
    out = K.keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"], last=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@C.add(
    "f7_queue_priority",
    f"""WITH e AS (SELECT event_id, ts, user_id % 3 <> 0 AS has_entity, event_id % 5 = 0 AS is_promoted, {_Q.replace("p_partkey", "event_id")} AS match_status,
 CASE user_id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'staging_unverified' ELSE 'NEW' END AS provenance_state, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000.0::DOUBLE / 86400.0::DOUBLE) AS days FROM events),
f AS (SELECT *, CASE WHEN has_entity THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN match_status IN ('exact','fuzzy') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN provenance_state = 'APPROVED' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS impact,
 CASE WHEN NOT is_promoted AND has_entity AND provenance_state = 'APPROVED' THEN 0.8::DOUBLE WHEN match_status = 'manual_review' THEN 0.4::DOUBLE WHEN provenance_state = 'HOLD' THEN 0.4::DOUBLE WHEN provenance_state = 'staging_unverified' AND is_promoted THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS blocker,
 CASE WHEN days >= 30 THEN 3 WHEN days >= 21 THEN 2 WHEN days >= 7 THEN 1 ELSE 0 END AS escalation FROM e),
s AS (SELECT *, greatest(0.0::DOUBLE, 3.0::DOUBLE * least(days / 30.0::DOUBLE, 1.0::DOUBLE) + 2.0::DOUBLE * least(impact, 1.0::DOUBLE) + 1.5::DOUBLE * blocker - greatest(1.0::DOUBLE - days / 7.0::DOUBLE, 0.0::DOUBLE)) + escalation * 0.5::DOUBLE AS score FROM f)
SELECT event_id, round_even(score, 2) AS score, CASE WHEN score >= 8 THEN 'CRITICAL' WHEN score >= 5 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level, escalation FROM s""",
)
def f7(spark, sf_dir):
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    rows = e.select(
        "event_id",
        F.col("ts").alias("ingested_at"),
        (u % 3 != 0).alias("has_entity"),
        (i % 5 == 0).alias("is_promoted"),
        F.expr(_Q.replace("p_partkey", "event_id")).alias("match_status"),
        F.when(u % 4 == 0, "APPROVED").when(u % 4 == 1, "HOLD").when(u % 4 == 2, "staging_unverified").otherwise("NEW").alias("provenance_state"),
    )
    return K.queue_priority(rows, "2024-02-01").select("event_id", "score", "level", "escalation")


@C.add(
    "f9_allowlist",
    "SELECT p_partkey, p_name, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size > 25 ORDER BY n DESC, p_name, p_partkey LIMIT 100",
)
def f9(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(n, "p_partkey").withColumn("tier", F.when(F.col("p_size") > 25, "A").otherwise("B"))
    return K.allowlist(rows, 100, "n", "p_name", "p_partkey").select("p_partkey", "p_name", "n")


@C.add(
    "f10_top_per_axis",
    """WITH l AS (SELECT p_partkey, 'p_size' AS axis, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY value DESC, p_partkey)::INT AS rank FROM l WHERE value > 0) SELECT * FROM r WHERE rank <= 20""",
)
def f10(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return K.top_per_axis(rows, ["p_size", "p_retailprice"], "p_partkey", 20)


@C.add(
    "f12_due",
    "WITH r AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS place FROM events WHERE ts <= TIMESTAMP '2024-01-15') SELECT event_id, event_type, place FROM r WHERE place <= 25",
)
def f12(spark, sf_dir):
    return K.due(table(spark, sf_dir, "events"), "2024-01-15", "event_type", "ts", 25, "event_id").select("event_id", "event_type", "place")


# A lexicon of words that the test texts hold.
WORDS = {
    "smoky": ("attion", "eriner", "of the"),
    "fruity": ("reing", "then", "the of"),
    "sweet": ("enti", "tion", "ndre"),
    "spicy": ("erin", "hein", "and the"),
}
_LEX = " UNION ALL ".join(f"SELECT '{t}' AS term, '{a}' AS axis" for a, ts in WORDS.items() for t in ts)
_STOPS = ",".join(f"'{w}'" for w in (*L.STOP, *L.AMBIGUOUS))
_TOK = f"""lex AS ({_LEX}), w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_distinct(ws))) AS term FROM w),
m AS (SELECT doc_id, term, axis, 0.5::DOUBLE AS value FROM t JOIN lex USING (term) WHERE term NOT IN ({_STOPS}))"""


def documents(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


@C.add("h1_lexicon_matches", f"WITH {_TOK} SELECT doc_id, axis, count(*) AS n, round(avg(value), 6) AS value FROM m GROUP BY ALL")
def h1(spark, sf_dir):
    m = L.matches(documents(spark, sf_dir), "doc_id", "text", L.lexicon(spark, WORDS))
    return m.groupBy("doc_id", "axis").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@C.add(
    "h8_unmapped_terms",
    f"WITH {_TOK}, u AS (SELECT DISTINCT doc_id, unnest(ws) AS term FROM w) SELECT doc_id, array_to_string(list_sort(list(term))[1:50], ',') AS terms FROM u WHERE length(term) > 2 AND term NOT IN ({_STOPS}) AND term NOT IN (SELECT term FROM lex) GROUP BY doc_id",
)
def h8(spark, sf_dir):
    return L.unmapped(documents(spark, sf_dir), "doc_id", "text", L.lexicon(spark, WORDS)).withColumn("terms", F.array_join("terms", ","))


_COUNTS = {a: " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)})::INT" for t in ts) for a, ts in WORDS.items()}


@C.add("h3_substring_vector", "SELECT doc_id, " + ", ".join(f"least(1.0::DOUBLE, ({x})::DOUBLE / 6) AS {a}" for a, x in _COUNTS.items()) + " FROM documents")
def h3(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *L.substring_vector(F.col("text"), WORDS, 6))


@C.add("h4_substring_counts", "SELECT doc_id, " + ", ".join(f"({x}) AS {a}" for a, x in _COUNTS.items()) + " FROM documents")
def h4(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *L.substring_vector(F.col("text"), WORDS, None))


@C.add(
    "h2_direct_axis",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sweet' WHEN 1 THEN 'maritime' WHEN 2 THEN 'peaty' END AS axis FROM part",
)
def h2(spark, sf_dir):
    k = F.col("p_partkey")
    quote = F.when(k % 4 == 0, "Honey!").when(k % 4 == 1, "sea spray").otherwise(F.col("p_name"))
    field = F.when(k % 4 == 2, "axis: Peaty").otherwise("note")
    return table(spark, sf_dir, "part").select("p_partkey", L.direct_axis(quote, field).alias("axis"))


@C.add(
    "h5_word_match",
    r"SELECT doc_id, (regexp_matches(lower(text), '(^|[^a-z0-9])license(ed|y|s)?($|[^a-z0-9])') OR contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 'license')) AS one, regexp_matches(lower(text), '(^|[^a-z0-9])of the($|[^a-z0-9])') AS two FROM documents",
)
def h5(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", L.word_match(t, "license").alias("one"), L.word_match(t, "of the").alias("two"))


@C.add(
    "h6_region_prior",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS smoky, CASE p_partkey % 3 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END AS maritime FROM part",
)
def h6(spark, sf_dir):
    r = F.when(F.col("p_partkey") % 3 == 0, "Islay").when(F.col("p_partkey") % 3 == 1, "Speyside").otherwise("island")
    return table(spark, sf_dir, "part").select("p_partkey", L.region_prior(r, "smoky").alias("smoky"), L.region_prior(r, "maritime").alias("maritime"))


@C.add(
    "h7_translated",
    r"""WITH d AS (SELECT 'de la' AS foreign_, 'of the' AS term UNION ALL SELECT 'une', 'a' UNION ALL SELECT 'und', 'and'),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(translate(text, 'İI', 'iı')), '[^\p{L}]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_distinct(ws))) AS f FROM w)
SELECT doc_id, term, count(*) AS n FROM t JOIN d ON d.foreign_ = t.f GROUP BY ALL""",
)
def h7(spark, sf_dir):
    d = spark.createDataFrame([("de la", "of the"), ("une", "a"), ("und", "and")], "foreign string, term string")
    return L.translated(documents(spark, sf_dir), "doc_id", "text", d).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@C.add(
    "e10_keyword_scores",
    f"WITH {_TOK} SELECT doc_id % 50 AS entity, axis, least(100.0::DOUBLE, 50.0 + 10.0 * count(DISTINCT term))::DOUBLE AS score, count(DISTINCT doc_id) AS n_evidence FROM m GROUP BY ALL",
)
def e10(spark, sf_dir):
    m = L.matches(documents(spark, sf_dir), "doc_id", "text", L.lexicon(spark, WORDS))
    return A.keyword_scores(m.select((F.col("doc_id") % 50).alias("entity"), "axis", F.col("term").alias("keyword"), F.col("doc_id").alias("evidence")))


@C.add(
    "e11_intensities",
    f"WITH {_TOK} SELECT doc_id AS entity, axis, least(100.0::DOUBLE, sum(20.0::DOUBLE * value)) AS value FROM m GROUP BY ALL",
)
def e11(spark, sf_dir):
    lex = L.lexicon(spark, WORDS)
    terms = L.matches(documents(spark, sf_dir), "doc_id", "text", lex).select(F.col("doc_id").alias("entity"), "term", F.col("value").alias("intensity"))
    return A.intensities(terms, lex)[0]


_PROF = """CASE p_partkey % 5 WHEN 0 THEN concat('{"peaty": ', p_size, ', "sweet": "', p_size % 7, '"}') WHEN 1 THEN concat('peaty=', p_size, ', sweet=x') WHEN 2 THEN '{bad' WHEN 3 THEN concat('sweet=1,sweet=', p_size) ELSE '' END"""


@C.add(
    "b21_profiles",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS peaty, CASE p_partkey % 5 WHEN 0 THEN (p_size % 7)::DOUBLE WHEN 3 THEN p_size::DOUBLE END AS sweet,
CASE p_partkey % 5 WHEN 0 THEN greatest(p_size, p_size % 7)::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 3 THEN p_size::DOUBLE ELSE 0.0::DOUBLE END AS strongest,
CASE p_partkey % 5 WHEN 0 THEN p_size <= 40 WHEN 1 THEN false WHEN 3 THEN p_size <= 40 ELSE true END AS ok FROM part""",
)
def b21(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", L.parsed_profile(F.expr(_PROF)).alias("m"))
    m = F.col("m")
    return p.select(
        "p_partkey",
        F.element_at(m, "peaty").alias("peaty"),
        F.element_at(m, "sweet").alias("sweet"),
        L.projected_axis(m, ("peaty", "sweet")).alias("strongest"),
        L.in_range(m, 0, 40).alias("ok"),
    )


_COMP = "CASE p_partkey % 3 WHEN 0 THEN concat('component_1=', p_size / 50.0, ',component_2=', p_size % 7, ',component_3=', -(p_size % 3)) WHEN 1 THEN concat('fruit=', p_size, ',peat=3,woody=', p_size % 9, ',smoky=x') ELSE 'component_1=5,sweet=2' END"


@C.add(
    "b22_app_axes",
    """WITH r AS (SELECT p_partkey, p_partkey % 3 AS k, p_size / 50.0::DOUBLE AS a, (p_size % 7)::DOUBLE AS b, -(p_size % 3)::DOUBLE AS c, p_size::DOUBLE AS s FROM part),
m AS (SELECT *, CASE k WHEN 0 THEN [a, (a + b) / 2, b, c, (b + c) / 2, (a + c) / 2, a * 0.5, 0] WHEN 1 THEN [s, 0, 0, 3, s::INT % 9, 0, 0, 0] ELSE [0, 2, 0, 0, 0, 0, 0, 0]::DOUBLE[] END AS v FROM r),
x AS (SELECT p_partkey, list_transform(v, lambda y: CASE WHEN k <> 0 THEN y WHEN y <= 0 THEN 0 WHEN y <= 1 THEN y * 10 ELSE y END) AS v FROM m)
SELECT p_partkey, round(v[1], 6) AS fruity, round(v[2], 6) AS sweet, round(v[3], 6) AS spicy, round(v[4], 6) AS smoky_peaty, round(v[5], 6) AS oak_cask, round(v[6], 6) AS malty_cereal, round(v[7], 6) AS floral_herbal, round(v[8], 6) AS maritime FROM x""",
)
def b22(spark, sf_dir):
    # The profile is a column before its axes are taken, which name it many times.
    p = dealt(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_COMP).alias("c")).select("p_partkey", L.parsed_profile(F.col("c")).alias("m"))
    p = p.select("p_partkey", L.app_axes(F.col("m")).alias("x"))
    return p.select("p_partkey", *[F.round(f"x.{c}", 6).alias(c) for c in L.AXIS_KEYS])


@C.add(
    "b32_source_class",
    "SELECT doc_id, CASE source WHEN 'src0' THEN 'T1' WHEN 'src1' THEN 'T2' ELSE 'T3' END AS tier, CASE source WHEN 'src0' THEN 'official' WHEN 'src1' THEN 'expert' ELSE 'community' END AS class FROM documents",
)
def b32(spark, sf_dir):
    known = spark.createDataFrame([("src0", "T1", "official"), ("src1", "T2", "expert")], "source string, tier string, class string")
    return L.source_class(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", known, {"tier": "T3", "class": "community"}).select("doc_id", "tier", "class")
