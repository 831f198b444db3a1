"""Sections J and K bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.plans import adapter as A
from curata.plans import promote as P
from curata.plans import quality as Q

from . import Catalog, table

C = Catalog()

CAND = """c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN -l_partkey ELSE l_partkey END AS entity_id, 's' || (l_suppkey % 4) AS source,
 CASE WHEN l_linenumber = 1 THEN 'empty' WHEN l_linenumber = 2 THEN 'CONFLICT' ELSE 'resolved' END AS status, l_suppkey FROM lineitem WHERE l_quantity > 10),
h AS (SELECT DISTINCT l_partkey AS entity_id, 's' || (l_suppkey % 4) AS source FROM lineitem WHERE l_quantity <= 3)"""
PLAN = f"""{CAND}, m AS (SELECT c.*, p.p_partkey AS ok1, h.entity_id AS held FROM c LEFT JOIN part p ON p.p_partkey = c.entity_id LEFT JOIN h ON h.entity_id = c.entity_id AND h.source = c.source),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, source, (ok1 IS NOT NULL AND lower(status) NOT IN ('empty','conflict') AND held IS NULL) ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM m),
q AS (SELECT *, CASE WHEN ok1 IS NULL THEN 'unresolved' WHEN lower(status) IN ('empty','conflict') THEN 'status_' || lower(status) WHEN held IS NOT NULL THEN 'existing' WHEN n > 1 THEN 'repeated' END AS reason FROM r),
plan AS (SELECT *, CASE WHEN reason IS NULL THEN 'INSERT' WHEN starts_with(reason, 'status_') THEN 'CONFLICT' ELSE 'SKIP' END AS action FROM q)"""


def candidates(spark, sf_dir):
    line, k, n = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    return line.where("l_quantity > 10").select(
        "l_orderkey",
        "l_linenumber",
        F.when(k % 13 == 0, -k).otherwise(k).alias("entity_id"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("source"),
        F.when(n == 1, "empty").when(n == 2, "CONFLICT").otherwise("resolved").alias("status"),
        "l_suppkey",
    )


def held(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_quantity <= 3")
    return line.select(F.col("l_partkey").alias("entity_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("source")).distinct()


def entity_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"))


def tasks(spark, sf_dir):
    """Tasks for rows of lineitem that are sorted whole: a number that grows with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * table(spark, sf_dir, "lineitem").rdd.getNumPartitions())


def plan(spark, sf_dir):
    return P.planned(candidates(spark, sf_dir), entity_ids(spark, sf_dir), held(spark, sf_dir), "entity_id", "source", "status", ["l_orderkey", "l_linenumber", "l_suppkey"], tasks(spark, sf_dir))


@C.add("j1_promotion_plan", f"WITH {PLAN} SELECT entity_id, source, action, reason, count(*) AS n FROM plan GROUP BY ALL")
def j1(spark, sf_dir):
    return plan(spark, sf_dir).groupBy("entity_id", "source", "action", "reason").agg(F.count("*").alias("n"))


def line_adapter():
    return A.register(A.Adapter("lines", order=("l_orderkey", "l_linenumber", "l_suppkey"), rules=[("supplier", F.col("l_suppkey") % 7 != 0)]))


_ADAPTED = PLAN.replace("FROM c LEFT JOIN part", "FROM (SELECT * FROM c WHERE l_suppkey % 7 <> 0) c LEFT JOIN part")


@C.add(
    "m3_adapter_plan",
    f"WITH {_ADAPTED}, a AS (SELECT entity_id, source, action, reason FROM plan UNION ALL SELECT entity_id, source, 'REJECT', 'supplier' FROM c WHERE l_suppkey % 7 = 0) SELECT entity_id, source, action, reason, count(*) AS n FROM a GROUP BY ALL",
)
def m3_plan(spark, sf_dir):
    line_adapter()
    made = A.adapter("lines").plan(candidates(spark, sf_dir), entity_ids(spark, sf_dir), held(spark, sf_dir), tasks=tasks(spark, sf_dir))
    return made.groupBy("entity_id", "source", "action", "reason").agg(F.count("*").alias("n"))


@C.add("m3_adapter_applied", f"WITH {_ADAPTED} SELECT * FROM h UNION ALL SELECT entity_id, source FROM plan WHERE action = 'INSERT'")
def m3_applied(spark, sf_dir):
    made = line_adapter().plan(candidates(spark, sf_dir), entity_ids(spark, sf_dir), held(spark, sf_dir), tasks=tasks(spark, sf_dir))
    return A.adapter("lines").apply_plan(made, held(spark, sf_dir))


@C.add("j4_applied", f"WITH {PLAN} SELECT * FROM h UNION ALL SELECT entity_id, source FROM plan WHERE action = 'INSERT'")
def j4(spark, sf_dir):
    return P.applied(held(spark, sf_dir), plan(spark, sf_dir))


@C.add(
    "j10_dry_run",
    f"WITH {PLAN} SELECT (SELECT count(*) FROM h) AS n_before, (SELECT count(*) FROM h) + (SELECT count(*) FROM plan WHERE action = 'INSERT') AS n_after, (SELECT count(*) FROM plan WHERE action = 'INSERT') AS expected_delta, (SELECT count(*) FROM plan WHERE action = 'INSERT') AS actual_delta, true AS ok",
)
def j10(spark, sf_dir):
    return P.dry_run(held(spark, sf_dir), plan(spark, sf_dir))


_VEC = """CASE p_partkey % 6 WHEN 0 THEN '{"a":0.5,"b":0.2}' WHEN 1 THEN '{"a":1.5,"b":0.2}' WHEN 2 THEN '{"a":0.5}' WHEN 3 THEN '{"a":0.5,"b":0.1,"z":0}' WHEN 4 THEN NULL ELSE '{"a":0,"b":1}' END"""


@C.add(
    "j2_row_validation",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'no entity' WHEN p_partkey % 7 = 0 THEN 'match status' WHEN p_partkey % 5 = 0 THEN 'provenance'
 WHEN p_partkey % 6 = 4 THEN 'malformed vector' WHEN p_partkey % 6 = 2 THEN 'missing axis' WHEN p_partkey % 6 = 3 THEN 'extra axis' WHEN p_partkey % 6 = 1 THEN 'out of range' END AS failure FROM part""",
)
def j2(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k,
        F.when(k % 11 != 0, k).alias("entity_id"),
        F.when(k % 7 == 0, "none").otherwise("exact").alias("match_status"),
        F.when(k % 5 == 0, "Rejected by QA").alias("provenance"),
        F.from_json(F.expr(_VEC), "map<string,double>").alias("vector"),
    )
    rules = P.staging_rules(("a", "b"), ("exact", "fuzzy"), ("rejected", "hold"))
    return rows.select("p_partkey", P.first_failure(rules).alias("failure"))


@C.add(
    "j3_new_profiles",
    f"WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM c WHERE entity_id NOT IN (SELECT entity_id FROM h WHERE source = 's1')) SELECT entity_id, l_orderkey, l_linenumber, l_suppkey FROM r WHERE n = 1",
)
def j3(spark, sf_dir):
    out = P.new_profiles(candidates(spark, sf_dir), held(spark, sf_dir).where("source = 's1'"), "entity_id", ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("entity_id", "l_orderkey", "l_linenumber", "l_suppkey")


MERGE = """g AS (SELECT p_name || p_brand AS group_name, min(p_partkey) AS survivor, list(p_partkey) AS members, CASE WHEN min(p_partkey) % 3 = 0 THEN 'KEEP' ELSE 'MERGE' END AS decision FROM part GROUP BY 1),
mp AS (SELECT survivor, unnest(members) AS variant FROM g WHERE decision <> 'KEEP'), merges AS (SELECT * FROM mp WHERE survivor <> variant)"""


def merges(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.concat("p_name", "p_brand").alias("group_name")).agg(F.min("p_partkey").alias("survivor"), F.collect_list("p_partkey").alias("members"))
    decisions = g.select("group_name", "survivor", F.when(F.col("survivor") % 3 == 0, "KEEP").otherwise("MERGE").alias("decision"))
    return P.merge_plan(decisions, g.select("group_name", "members"), ("KEEP", "REVIEW"))


@C.add("j6_merge_plan", f"WITH {MERGE} SELECT * FROM merges")
def j6(spark, sf_dir):
    return merges(spark, sf_dir)


@C.add("j5_canonical_merge", f"WITH {MERGE} SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(survivor, l_partkey) AS l_partkey FROM lineitem LEFT JOIN merges ON variant = l_partkey")
def j5(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return P.remapped(line, merges(spark, sf_dir), "l_partkey")


@C.add(
    "j7_null_fill",
    "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, f.v) AS brand FROM part LEFT JOIN (SELECT l_partkey, min(l_returnflag) AS v FROM lineitem GROUP BY 1) f ON l_partkey = p_partkey",
)
def j7(spark, sf_dir):
    k = F.col("p_partkey")
    current = table(spark, sf_dir, "part").select(k, F.when(k % 3 != 0, F.col("p_brand")).alias("brand"))
    offers = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("brand"))
    return P.null_fill(current, offers, "p_partkey", "brand")


@C.add(
    "j8_upsert",
    """WITH ch AS (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1), cu AS (SELECT p_partkey AS k, p_brand AS v FROM part)
SELECT coalesce(ch.k, cu.k) AS k, coalesce(ch.v, cu.v) AS v FROM cu FULL JOIN ch ON ch.k = cu.k""",
)
def j8(spark, sf_dir):
    current = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), "event_id")
    return P.upserted(current, changes, "k", "event_id")


_BLANK = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END"


@C.add("j9_blank_log", f"SELECT p_partkey, 'label' AS field, {_BLANK} AS old FROM part WHERE trim({_BLANK}) = '' UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE trim(p_brand) = ''")
def j9(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BLANK).alias("label"), "p_brand")
    return P.blanks_to_null(rows, "p_partkey", ["label", "p_brand"])[1]


@C.add("j12_undone", f"SELECT p_partkey, {_BLANK} AS label, p_brand FROM part")
def j12(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BLANK).alias("label"), "p_brand")
    clean, log = P.blanks_to_null(rows, "p_partkey", ["label", "p_brand"])
    return P.undone(clean, log, "p_partkey", ["label", "p_brand"])


@C.add(
    "j11_field_actions",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'refuse' ELSE CASE WHEN p_size / 50.0 < 0.5 THEN 'review' ELSE 'replace' END END WHEN 1 THEN CASE WHEN p_size / 50.0 < 0.3 THEN 'review' ELSE 'append' END WHEN 2 THEN CASE WHEN p_size / 50.0 < 0.8 THEN 'review' ELSE 'replace' END ELSE 'review' END AS action FROM part",
)
def j11(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    changes = table(spark, sf_dir, "part").select(
        k, F.concat(F.lit("f"), k % 4).alias("field"), F.when(size % 2 == 0, F.col("p_name")).alias("old"), (size / 50.0).alias("confidence")
    )
    rules = spark.createDataFrame([("f0", "IMMUTABLE", 0.5), ("f1", "APPEND", 0.3), ("f2", "REPLACEABLE", 0.8)], "field string, rule string, least double")
    return P.field_actions(changes, rules).select("p_partkey", "action")


@C.add(
    "j13_cell_diff",
    """SELECT p_partkey, 'p_brand' AS field, p_brand AS old, p_brand || '*' AS new FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, 'p_brand', p_brand, NULL FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR, NULL FROM part WHERE p_partkey % 7 = 0""",
)
def j13(spark, sf_dir):
    k = F.col("p_partkey")
    before = table(spark, sf_dir, "part").select(k, "p_brand", "p_size")
    after = before.where(k % 7 != 0).withColumn("p_brand", F.when(k % 10 == 0, F.concat("p_brand", F.lit("*"))).otherwise(F.col("p_brand")))
    return P.cell_diff(before, after, "p_partkey", ["p_brand", "p_size"])


@C.add(
    "j14_last_writer_wins",
    """WITH b AS (SELECT user_id, ts AS updated_at, event_type, value, 0 AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 2 = 0) WHERE n = 1
 UNION ALL SELECT user_id, CASE WHEN event_id % 50 = 1 THEN TIMESTAMP '2024-01-20' ELSE ts END, event_type, value, 1 FROM events WHERE event_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, i DESC, event_type DESC, value DESC) AS n FROM b) SELECT user_id, event_type, value FROM r WHERE n = 1""",
)
def j14(spark, sf_dir):
    from curata.operators.rank import keep_one

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("updated_at"), "event_type", "value")
    current = keep_one(e.where("event_id % 2 = 0"), ["user_id"], ["updated_at", "event_id"], last=True).drop("event_id")
    incoming = e.where("event_id % 2 = 1").withColumn("updated_at", F.when(F.col("event_id") % 50 != 1, F.col("updated_at")))
    return P.last_writer_wins(current, incoming, "user_id", "updated_at", "2024-01-20").select("user_id", "event_type", "value")


@C.add(
    "j15_transitions",
    """WITH q AS (SELECT event_id AS item, CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' END AS status, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'reopen' END AS action, event_id % 2 = 0 AS noted FROM events)
SELECT item, action, status, CASE WHEN status = 'pending' AND action = 'approve' THEN 'approved' WHEN status = 'pending' AND action = 'reject' AND noted THEN 'rejected' WHEN status = 'approved' AND action = 'reopen' THEN 'pending' END AS new_status,
CASE WHEN status IS NULL THEN 'unknown item' WHEN status = 'pending' AND action = 'approve' THEN NULL WHEN status = 'pending' AND action = 'reject' THEN CASE WHEN noted THEN NULL ELSE 'note required' END WHEN status = 'approved' AND action = 'reopen' THEN NULL ELSE 'not allowed' END AS reason FROM q""",
)
def j15(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    items = e.select(i.alias("item"), F.when(F.col("user_id") % 3 == 0, "pending").when(F.col("user_id") % 3 == 1, "approved").alias("status"))
    requests = e.select(
        i.alias("item"), F.when(i % 3 == 0, "approve").when(i % 3 == 1, "reject").otherwise("reopen").alias("action"), F.when(i % 2 == 0, "because").alias("note")
    )
    allowed = spark.createDataFrame(
        [("pending", "approve", "approved", False), ("pending", "reject", "rejected", True), ("approved", "reopen", "pending", False)],
        "from_status string, action string, to_status string, note_required boolean",
    )
    return P.transitions(items, requests, allowed, "item")


@C.add("j16_sane_keys", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'D' || p_size END AS owner FROM part")
def j16(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("D"), "p_size")).alias("owner"))
    return P.sane_keys(rows, "p_partkey", "owner", "^D[0-9]")[0]


@C.add(
    "k1_invariants",
    """SELECT 'orphan_lines' AS invariant, 'CRITICAL' AS severity, 'block' AS action, n AS n_failed, n = 0 AS passed FROM (SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'repeated_lines', 'HIGH', 'report', n, n = 0 FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'axis_range', 'CRITICAL', 'block', n, n = 0 FROM (SELECT count(*) AS n FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 1 OR NOT l_tax BETWEEN 0 AND 0.07)""",
)
def k1(spark, sf_dir):
    """K1, K2, M2."""
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "part")}
    keyed = lambda t: t["lineitem"].withColumnRenamed("l_partkey", "p_partkey")
    suite = {
        "orphan_lines": ("CRITICAL", "block", lambda t: Q.count_rows(Q.orphans(keyed(t), t["part"], "p_partkey"))),
        "repeated_lines": ("HIGH", "report", lambda t: Q.count_rows(Q.repeated_ids(t["lineitem"].withColumn("id", F.struct("l_orderkey", "l_linenumber")), "id"))),
        "axis_range": (
            "CRITICAL",
            "block",
            lambda t: Q.count_rows(t["lineitem"].where(~F.col("l_discount").between(0, 1) | ~F.col("l_tax").between(0, 0.07))),
        ),
    }
    return Q.run_invariants(tables, suite)


@C.add("k2_changed_rows", "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 10 = 0")
def k2(spark, sf_dir):
    before = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    after = before.withColumn("p_brand", F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(F.col("p_brand")))
    return Q.changed_rows(before, after)


@C.add(
    "k3_merge_checks",
    f"""WITH {MERGE} SELECT 0 AS unmarked, 0 AS left_on_variants, (SELECT count(*) FROM lineitem) AS n_before, (SELECT count(*) FROM lineitem) AS n_after,
(SELECT count(*) FROM part) - (SELECT count(DISTINCT variant) FROM merges) AS n_active, (SELECT count(*) FROM part) AS n_entities, (SELECT count(DISTINCT variant) FROM merges) AS n_variants, true AS ok""",
)
def k3(spark, sf_dir):
    m = merges(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(None).cast("long").alias("superseded_by"))
    return Q.merge_checks(line, P.remapped(line, m, "l_partkey"), P.superseded(parts, m, "l_partkey"), m, "l_partkey", "superseded_by")


_BAD = {"small": "p_size < 5", "costly": "p_retailprice > 1500", "short": "length(p_name) < 11"}


@C.add(
    "k4_verdicts",
    f"""WITH r AS (SELECT p_partkey, list_filter([CASE WHEN {_BAD['small']} THEN 'small' END, CASE WHEN {_BAD['costly']} THEN 'costly' END, CASE WHEN {_BAD['short']} THEN 'short' END], lambda x: x IS NOT NULL) AS rs FROM part)
SELECT p_partkey, array_to_string(rs, ',') AS reasons, CASE WHEN len(rs) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN list_contains(rs, 'costly') THEN 'FAIL' ELSE 'REQUIRES_REVIEW' END AS again FROM r""",
)
def k4(spark, sf_dir):
    """K4, K5."""
    out = Q.verdicts(table(spark, sf_dir, "part"), {n: F.expr(c) for n, c in _BAD.items()}).withColumn("first", F.col("verdict"))
    again = Q.re_evaluated(out, ("costly",))
    return again.select("p_partkey", F.array_join("reasons", ",").alias("reasons"), F.col("first").alias("verdict"), F.col("verdict").alias("again"))


@C.add(
    "k6_rule_audit",
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) AS n_failed, array_to_string((list(p_partkey ORDER BY p_partkey))[1:10], ',') AS samples FROM part WHERE {c} HAVING count(*) > 0"
        for n, c in _BAD.items()
    ),
)
def k6(spark, sf_dir):
    return Q.rule_audit(table(spark, sf_dir, "part"), {n: F.expr(c) for n, c in _BAD.items()}, "p_partkey")


@C.add(
    "k7_tiers",
    """WITH e AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 47 GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size % 4 >= 2 AND coalesce(n, 0) >= 1 THEN 'A' WHEN p_size % 4 >= 1 THEN 'B' WHEN p_partkey % 3 = 0 THEN 'C_idx' ELSE 'C_no' END AS tier FROM part LEFT JOIN e ON l_partkey = p_partkey""",
)
def k7(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 47").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(e, "p_partkey", "left")
    found = Q.tier(F.col("p_size") % 4, F.coalesce("n", F.lit(0)), F.col("p_partkey") % 3 == 0)
    return rows.select("p_partkey", found.alias("tier"))


@C.add(
    "k8_queue_class",
    "SELECT event_id, CASE WHEN user_id IN (SELECT o_custkey FROM orders) THEN 'closed' WHEN value > 50 THEN 'automatic' ELSE 'human_review' END AS queue_class, CASE WHEN user_id IN (SELECT o_custkey FROM orders) THEN '' WHEN value > 50 THEN 'promote' ELSE 'match,promote' END AS pending FROM events",
)
def k8(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    out = Q.queue_class(table(spark, sf_dir, "events"), done, "user_id", F.col("value") > 50)
    return out.select("event_id", "queue_class", F.array_join("pending", ",").alias("pending"))


_PROF = "CASE p_partkey % 4 WHEN 0 THEN '{bad' WHEN 1 THEN '{\"a\":\"5\"}' WHEN 2 THEN '{\"q\":\"5\"}' ELSE '{\"a\":\"500\"}' END"


@C.add(
    "k9_vector_compliance",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'ok' WHEN 2 THEN 'non_canonical' ELSE 'out_of_range' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'malformed' WHEN 2 THEN 'non_canonical' ELSE 'clean' END AS repair, (p_partkey % 4 IN (0, 2) AND p_size > 10) AS reconstructable FROM part",
)
def k9(spark, sf_dir):
    """K9, K12."""
    raw = F.expr(_PROF)
    parsed = F.from_json(raw, "map<string,string>")
    values = F.when(F.map_values(parsed).isNotNull() & (F.size(F.map_keys(parsed)) > 0), F.transform_values(parsed, lambda k, v: v.try_cast("double")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", raw.alias("raw"), values.alias("m"))
    kind = Q.vector_compliance(F.col("m"), F.col("raw"), ("a", "b"), 0, 100)
    extra = F.coalesce(F.size(F.array_except(F.map_keys("m"), F.array(F.lit("a"), F.lit("b")))) > 0, F.lit(False))
    repair = Q.repair_class(F.col("m").isNull(), extra, F.when(F.col("p_size") > 10, 1))
    return rows.select("p_partkey", kind.alias("kind"), repair.alias("r")).select("p_partkey", "kind", F.col("r.kind").alias("repair"), "r.reconstructable")


_EDGES = "SELECT p_partkey AS source, CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey + 1 WHEN 2 THEN p_partkey - 1 WHEN 3 THEN p_partkey + 100000 ELSE p_partkey + 2 END AS target FROM part"


@C.add(
    "k10_supersession_faults",
    f"""WITH e AS ({_EDGES}) SELECT DISTINCT e.source, e.target, CASE WHEN e.source = e.target THEN 'self_loop' WHEN b.target = e.source THEN 'two_cycle' WHEN p_partkey IS NULL THEN 'orphan_target' WHEN b.source IS NOT NULL THEN 'chain' END AS fault
FROM e LEFT JOIN e AS b ON b.source = e.target LEFT JOIN part ON p_partkey = e.target WHERE e.source = e.target OR b.target = e.source OR p_partkey IS NULL OR b.source IS NOT NULL""",
)
def k10(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    target = F.when(k % 5 == 0, k).when(k % 5 == 1, k + 1).when(k % 5 == 2, k - 1).when(k % 5 == 3, k + 100000).otherwise(k + 2)
    return Q.supersession_faults(p.select(k.alias("source"), target.alias("target")), p, "p_partkey")


@C.add("k10_survivors", "SELECT p_partkey AS source, 1::BIGINT AS survivor FROM part WHERE p_partkey >= 2")
def k10b(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey >= 2")
    return Q.survivors(p.select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).cast("long").alias("target")))


@C.add("k11_template_values", "SELECT l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 600")
def k11(spark, sf_dir):
    return Q.template_values(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], 600)


@C.add("k13_validated_json", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'malformed' WHEN (props::JSON->>'k')::INT < 30 THEN 'small' ELSE '' END AS errors FROM events")
def k13(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("text", F.when(F.col("event_id") % 10 == 0, "{k:").otherwise(F.col("props")))
    out = Q.validated_json(rows, "text", "k int", {"required": lambda r: r["k"].isNotNull(), "small": lambda r: r["k"] >= 30})
    return out.select("event_id", F.array_join("errors", ",").alias("errors"))


@C.add("k14_fingerprint")
def k14(spark, sf_dir):
    return Q.table_fingerprint(table(spark, sf_dir, "lineitem"))


@C.add("k15_rejects", "SELECT l_orderkey, l_linenumber, 'too few' AS reason, 'check' AS suggested_action FROM lineitem WHERE l_quantity < 2")
def k15(spark, sf_dir):
    bad = Q.reject(table(spark, sf_dir, "lineitem"), F.col("l_quantity") < 2, "too few", "check")[1]
    return bad.select("l_orderkey", "l_linenumber", "reason", "suggested_action")


@C.add(
    "k16_uncovered_axes",
    "SELECT p_partkey, 'a' AS axis, p_size::DOUBLE AS value FROM part WHERE p_size > 10 AND p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'b', p_retailprice FROM part WHERE p_partkey % 3 <> 0",
)
def k16(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    vectors = p.select(k, F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("a"), F.col("p_retailprice").alias("b"))
    mapped = p.where(k % 2 == 0).select(k, F.lit("a").alias("axis")).union(p.where(k % 3 == 0).select(k, F.lit("b")))
    return Q.uncovered_axes(vectors, mapped, "p_partkey", ["a", "b"])


@C.add("k17_profile_report", " UNION ALL ".join(f"SELECT '{n}' AS finding, count(*) FILTER ({c}) AS n FROM part" for n, c in _BAD.items()))
def k17(spark, sf_dir):
    return Q.profile_report(table(spark, sf_dir, "part"), {n: F.expr(c) for n, c in _BAD.items()})


@C.add("k18_presence", "SELECT p_partkey, 'name' AS field, true AS required, p_partkey % 5 <> 0 AS present FROM part UNION ALL SELECT p_partkey, 'age', false, p_size > 9 FROM part")
def k18(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("age"))
    return p.select("p_partkey", F.explode(Q.presence({"name": True, "age": False})).alias("x")).select("p_partkey", "x.*")


@C.add("k19_source_gate", f"SELECT count(*) FILTER ({_BAD['small']}) AS n_fail, count(*) FILTER ({_BAD['costly']}) + count(*) FILTER ({_BAD['short']}) AS n_risk, count(*) FILTER ({_BAD['small']}) = 0 AS passed FROM part")
def k19(spark, sf_dir):
    return Q.source_gate(table(spark, sf_dir, "part"), {"small": F.expr(_BAD["small"])}, {n: F.expr(_BAD[n]) for n in ("costly", "short")}, "p_partkey")[1]


@C.add(
    "k20_verification",
    """WITH v AS (SELECT p_partkey AS entity, 'abv' AS field, p_size || '.0' AS value, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END END AS o, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS s FROM part)
SELECT entity, field, value, CASE WHEN o <> value::DOUBLE OR s <> value::DOUBLE THEN 'conflict' WHEN o IS NOT NULL OR s IS NOT NULL THEN 'verified' ELSE 'unverified' END AS status,
CASE WHEN coalesce(o <> value::DOUBLE, false) OR coalesce(s <> value::DOUBLE, false) THEN 'X' WHEN o IS NOT NULL AND s IS NOT NULL THEN 'A' WHEN o IS NOT NULL THEN 'B' WHEN s IS NOT NULL THEN 'C' ELSE 'E' END AS grade FROM v""",
)
def k20(spark, sf_dir):
    p, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    values = p.select(k.alias("entity"), F.lit("abv").alias("field"), F.concat(size, F.lit(".0")).alias("value"))
    official = p.where(k % 2 == 0).select(k.alias("entity"), F.lit("abv").alias("field"), F.when(k % 10 == 0, size + 1).otherwise(size).cast("string").alias("value"))
    seeds = p.where(k % 3 == 0).select(k.alias("entity"), F.lit("abv").alias("field"), size.cast("string").alias("value"))
    return Q.verification_ledger(values, official, seeds)


@C.add(
    "k21_staging_partition",
    "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 13 = 0 THEN 'orphan' WHEN l_partkey % 5 <> 0 THEN 'profile_gap' ELSE 'enrichment' END AS kind FROM lineitem",
)
def k21(spark, sf_dir):
    line, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    out = Q.staging_partition(line, parts.where(k % 13 != 0), parts.where(k % 5 == 0), "l_partkey")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "kind")


