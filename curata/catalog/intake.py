"""Sections A and L bound to the test tables; files are derived from them first."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.sources import files as S
from curata.sources import ingest as N
from curata.streaming import incremental as L

from . import Catalog, dealt, table

C = Catalog()


@C.add(
    "a1_csv_records",
    """SELECT p_partkey::VARCHAR AS p_partkey, 'csv:p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey::VARCHAR, 'csv:note', 'x' || p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey::VARCHAR, 'csv:p_size', p_size::VARCHAR FROM part""",
)
def a1(spark, sf_dir):
    path = S.scratch_path(spark, "csv")
    note = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), "p_size")).when(F.col("p_partkey") % 3 == 1, "  ")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", note.alias("note"), "p_size").write.option("header", True).csv(path)
    return S.csv_records(spark, path, ["p_partkey", "p_name", "note", "p_size"], "p_partkey")


@C.add(
    "a2_flattened",
    """SELECT p_partkey, 'item.name' AS path, p_name AS value FROM part UNION ALL SELECT p_partkey, 'item.size.cl', p_size::VARCHAR FROM part
UNION ALL SELECT p_partkey, 'item.marks[0].m', p_type FROM part UNION ALL SELECT p_partkey, 'item.marks[1].m', p_brand FROM part
UNION ALL SELECT p_partkey, 'grid[0][0]', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'grid[1][1]', p_partkey::VARCHAR FROM part
UNION ALL SELECT p_partkey, 'tags[0]', p_brand FROM part UNION ALL SELECT p_partkey, 'tags[1]', p_type FROM part UNION ALL SELECT p_partkey, 'lots[0].price', p_retailprice::VARCHAR FROM part WHERE p_partkey % 2 = 0""",
)
def a2(spark, sf_dir):
    path, k = S.scratch_path(spark, "json"), F.col("p_partkey")
    item = F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("cl"), F.lit(" ").alias("unit")).alias("size"), F.array(F.struct(F.col("p_type").alias("m")), F.struct(F.col("p_brand").alias("m"))).alias("marks")).alias("item")
    none = F.lit(None).cast("bigint")
    grid = F.array(F.array(F.col("p_size").cast("bigint"), none), F.array(none, k)).alias("grid")
    lots = F.array(F.struct(F.when(k % 2 == 0, F.col("p_retailprice")).alias("price"))).alias("lots")
    rows = table(spark, sf_dir, "part").select(k, item, F.array("p_brand", "p_type").alias("tags"), lots, grid)
    rows.write.json(path)
    return S.flattened(spark.read.schema(rows.schema).json(path), "p_partkey")


PROPS = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('{"k":{"id":', user_id, ',"tags":["a",null," ","', event_type, '"]},"ok":true}')
 WHEN 2 THEN concat('[{"p":[[1,', user_id, '],[]]},"x",{}]') WHEN 3 THEN concat('{"k":"text","d":{"e":{"f":{"g":"', event_type, '"}}},"n":null}')
 WHEN 4 THEN concat('{"broken":', user_id) ELSE concat('"', event_type, '"') END"""


@C.add(
    "a2_unknown_schema",
    f"""WITH d AS (SELECT event_id, CASE WHEN json_valid(doc) THEN doc END AS v FROM (SELECT event_id, {PROPS} AS doc FROM events))
SELECT event_id, regexp_replace(fullkey, '^\\$\\.?', '') AS path, atom ->> '$' AS value FROM d, json_tree(d.v) AS j WHERE atom IS NOT NULL AND trim(atom ->> '$') <> ''""",
)
def a2_unknown(spark, sf_dir):
    return S.flattened_json(table(spark, sf_dir, "events").select("event_id", F.expr(PROPS).alias("doc")), "event_id", "doc")


@C.add("a3_page_records")
def a3(spark, sf_dir):
    return S.page_records(table(spark, sf_dir, "pages"))


def marks(text: str):
    """A parser of one's own: (field, value) pairs of a page."""
    yield "html:length", str(len(text))
    if "<h1" in text:
        yield "html:has_h1", "yes"


@C.add("m4_custom_parser", "SELECT page_id, 'html:length' AS field, length(html)::VARCHAR AS value FROM pages UNION ALL SELECT page_id, 'html:has_h1', 'yes' FROM pages WHERE contains(html, '<h1')")
def m4(spark, sf_dir):
    return S.page_records(table(spark, sf_dir, "pages"), parser=marks)


@C.add("a4_named_tables", "SELECT p_partkey, p_name FROM part WHERE p_size > 30 ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def a4(spark, sf_dir):
    tables = S.Tables(spark, {"entities": f"{sf_dir}/part.parquet"})
    return tables.query("entities", "p_size > 30", [F.desc("p_retailprice"), "p_partkey"], 40).select("p_partkey", "p_name")


_STAR = """p AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 19 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 23 = 0 THEN 'Nobody' ELSE 'Supplier ' || (p_partkey % 40) END AS producer_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS bottler_name FROM part),
k AS (SELECT DISTINCT 'supplier ' || (s_suppkey - 1) AS known FROM supplier)"""


def star(spark, sf_dir):
    k = F.col("p_partkey")
    products = table(spark, sf_dir, "part").select(
        k.alias("product_id"),
        F.when(k % 19 != 0, F.col("p_name")).alias("name"),
        F.when(k % 23 == 0, "Nobody").otherwise(F.concat(F.lit("Supplier "), k % 40)).alias("producer_name"),
        F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("bottler_name"),
        F.concat_ws(" & ", "p_type", F.lit("oak"), F.lit("oak")).alias("casks"),
    )
    producers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("SUPPLIER "), F.col("s_suppkey") - 1).alias("producer_name"), F.lit("x").alias("country"))
    return S.ingest_star(products, producers)


@C.add(
    "a5_star_products",
    f"WITH {_STAR} SELECT product_id, name, substring(sha256(lower(producer_name)), 1, 16) AS producer_id, CASE WHEN bottler_name <> '' THEN substring(sha256(lower(bottler_name)), 1, 16) END AS bottler_id FROM p WHERE name IS NOT NULL AND lower(producer_name) IN (SELECT known FROM k)",
)
def a5(spark, sf_dir):
    return star(spark, sf_dir)["products"]


@C.add(
    "a5_star_counters",
    f"WITH {_STAR} SELECT count(*) AS n_read, count(*) FILTER (name IS NULL OR known IS NULL) AS n_rejected, count(*) FILTER (name IS NOT NULL AND known IS NOT NULL) AS n_inserted FROM p LEFT JOIN k ON known = lower(producer_name)",
)
def a5_counters(spark, sf_dir):
    return star(spark, sf_dir)["counters"]


_MAKERS = """CASE WHEN s_suppkey % 10 = 9 THEN 'Maker ' || (s_suppkey - 1) ELSE 'Maker ' || s_suppkey END"""
_PRODUCTS = """p_partkey AS row, CASE WHEN p_partkey % 19 = 0 THEN 'Unknown' WHEN p_partkey % 6 = 0 THEN 'Maker ' || (p_partkey % 50 + 1) || ' ' || p_name ELSE p_name END AS product_name,
 CASE WHEN p_partkey % 3 = 0 THEN 'D' || (p_partkey % 40 + 1) END AS distillery_id,
 CASE p_partkey % 5 WHEN 0 THEN 'OB' WHEN 1 THEN p_brand WHEN 2 THEN 'maker ' || (p_partkey % 30 + 1) ELSE '-' END AS brand,
 CASE p_partkey % 7 WHEN 0 THEN 'official' WHEN 1 THEN 'independent' WHEN 2 THEN 'Blend' END AS type,
 CASE WHEN p_partkey % 11 = 0 THEN 'old' ELSE p_size || ' yo' END AS age, 'http://a/' || p_size || '; http://b/' || p_size AS urls, p_type || ' & oak, oak' AS cask_type"""


def seven_tables(spark, sf_dir):
    """Inputs of an ingest derived from part and supplier: repeated, unnamed, homeless and ill-typed rows among them."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    capacity = F.when(k % 4 == 0, "1,200 l").when(k % 4 == 1, "unknown").when(k % 4 == 2, "many").otherwise(k.cast("string"))
    makers = supplier.select(
        k.alias("row"), F.expr(_MAKERS).alias("Name"), F.concat(F.lit("D"), k).alias("distillery_id"), F.concat(F.lit("Land "), "s_nationkey").alias("country"), capacity.alias("capacity"),
        F.when(k % 3 == 0, "Low").otherwise("odd").alias("confidence"),
    )
    products = spark.sql(f"SELECT {_PRODUCTS} FROM {{part}}", part=part)
    refused = part.where("p_size = 1").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("scraped_product_name"), F.lit("Name mismatch").alias("problem_type"))
    came = part.where("p_size = 2").select(F.col("p_partkey").alias("row"), F.lit("product").alias("entity_type"), F.col("p_name").alias("entity_name"), F.lit("checked by hand").alias("problem_reason"))
    return {"distilleries": makers, "products": products, "rejected_matches": refused, "review_needed": came}


_INGEST = f"""m AS (SELECT s_suppkey, {_MAKERS} AS name FROM supplier), d AS (SELECT * FROM m WHERE s_suppkey = (SELECT min(s_suppkey) FROM m AS x WHERE x.name = m.name)),
raw AS (SELECT {_PRODUCTS} FROM part), p AS (SELECT * REPLACE (CASE WHEN product_name <> 'Unknown' THEN product_name END AS product_name, CASE WHEN brand <> '-' THEN brand END AS brand) FROM raw),
h AS (SELECT p.row, max(struct_pack(n := length(d.name), name := d.name)).name AS name FROM p JOIN d ON starts_with(lower(product_name), lower(d.name)) GROUP BY 1),
j AS (SELECT p.*, coalesce(a.name, b.name, h.name) AS maker, coalesce(type = 'official', false) OR coalesce(brand = 'OB', false) AS own FROM p LEFT JOIN d AS a ON 'D' || a.s_suppkey = distillery_id
 LEFT JOIN d AS b ON lower(b.name) = lower(brand) LEFT JOIN h ON h.row = p.row WHERE product_name IS NOT NULL),
q AS (SELECT *, CASE WHEN own OR brand IS NULL THEN 'official' ELSE 'independent' END AS kind, CASE WHEN NOT own THEN brand END AS bottler,
 (maker IS NULL AND coalesce(type, '') <> 'Blend') OR (NOT own AND brand IS NULL AND coalesce(type = 'independent', false)) AS refused FROM j),
g AS (SELECT *, row_number() OVER (PARTITION BY product_name, maker, bottler, kind ORDER BY row) AS n FROM q WHERE NOT refused)"""


@C.add(
    "a5_ingest_products",
    f"WITH {_INGEST} SELECT product_name AS name, maker, bottler, kind AS bottling_type, CASE WHEN row % 11 <> 0 THEN regexp_extract(age, '\\d+')::BIGINT END AS age_statement FROM g WHERE n = 1",
)
def a5_products(spark, sf_dir):
    out = N.ingest(seven_tables(spark, sf_dir))
    makers = out["distilleries"].select("distillery_id", F.col("name").alias("maker"))
    bottlers = out["bottlers"].select("bottler_id", F.col("name").alias("bottler"))
    return out["products"].join(makers, "distillery_id", "left").join(bottlers, "bottler_id", "left").select("name", "maker", "bottler", "bottling_type", "age_statement")


@C.add(
    "a5_ingest_review",
    f"""WITH {_INGEST} SELECT 'product' AS entity_type, p_name AS entity_name, NULL AS field_name, 'checked by hand' AS problem_reason FROM part WHERE p_size = 2
UNION ALL SELECT 'distillery', name, 'name', 'duplicate name or id' FROM m WHERE s_suppkey NOT IN (SELECT s_suppkey FROM d) UNION ALL SELECT 'distillery', name, 'production_capacity_lpa', 'no number' FROM m WHERE s_suppkey % 4 = 2
UNION ALL SELECT 'product', product_name, CASE WHEN maker IS NULL AND coalesce(type, '') <> 'Blend' THEN 'distillery_id' ELSE 'bottler_name' END, CASE WHEN maker IS NULL AND coalesce(type, '') <> 'Blend' THEN 'no producer by id, bottler or name' ELSE 'independent without a bottler' END FROM q WHERE refused
UNION ALL SELECT 'product', product_name, 'age_statement', 'no number' FROM g WHERE row % 11 = 0""",
)
def a5_review(spark, sf_dir):
    return N.ingest(seven_tables(spark, sf_dir))["review_needed"].select("entity_type", "entity_name", "field_name", "problem_reason")


@C.add(
    "a5_ingest_counters",
    f"""WITH {_INGEST}, i AS (SELECT DISTINCT product_name, maker, bottler, kind FROM g)
SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM m) + (SELECT count(*) FROM part WHERE p_size <= 2) AS rows_read, (SELECT count(*) FROM p WHERE product_name IS NULL) AS rows_failed, (SELECT count(*) FROM d) AS distilleries,
(SELECT count(DISTINCT brand) FROM p WHERE brand <> 'OB' AND coalesce(type, '') <> 'official') AS bottlers, (SELECT count(*) FROM i) AS products, (SELECT count(*) FROM q WHERE refused) AS products_skipped, (SELECT count(*) FROM g) - (SELECT count(*) FROM i) AS products_repeated,
(SELECT count(*) FROM (SELECT DISTINCT product_name, maker, bottler, kind, unnest(regexp_split_to_array(urls, '[\\s,;|]+')) FROM g)) AS urls, (SELECT count(*) FROM m WHERE s_suppkey % 3 = 0) AS low_confidence""",
)
def a5_ingest_counters(spark, sf_dir):
    wanted = "rows_read rows_failed distilleries bottlers products products_skipped products_repeated urls low_confidence"
    return N.ingest(seven_tables(spark, sf_dir))["counters"].select(*wanted.split())


@C.add("a6_canonical_columns", "SELECT p_partkey AS original_whisky_id, coalesce(CASE WHEN p_size > 25 THEN p_type END, p_name) AS name, p_size AS age_statement, p_brand AS bottler_name FROM part")
def a6(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Whisky_ID"), F.col("p_name").alias("product_name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("Name "), F.col("p_size").alias("AGE"), F.col("p_brand").alias("brand")
    )
    return S.canonical_columns(rows)


@C.add("a7_ledger", "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 = 0")
def a7(spark, sf_dir):
    path, p = S.scratch_path(spark, "ledger"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    S.write_ledger(p.where("p_partkey % 2 = 0"), path)
    S.write_ledger(p.where("p_partkey % 3 = 0"), path)
    return S.read_ledger(spark, path, "p_partkey bigint, p_brand string")


@C.add("a8_report", "SELECT p_partkey, p_brand, NULL::INT AS p_size FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, NULL, p_size FROM part WHERE p_size > 40")
def a8(spark, sf_dir):
    path, p = S.scratch_path(spark, "report"), table(spark, sf_dir, "part")
    S.write_report([p.where("p_size < 10").select("p_partkey", "p_brand"), p.where("p_size > 40").select("p_partkey", "p_size")], path)
    return spark.read.schema("p_partkey bigint, p_brand string, p_size int").option("header", True).csv(path)


@C.add(
    "a10_merged_staging",
    """WITH u AS (SELECT l_partkey, l_suppkey AS score, l_quantity AS q, 'A' AS source_name, 0 AS o FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20 UNION ALL SELECT l_partkey, l_suppkey, l_quantity, 'R', 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o DESC, q, score) AS n FROM u) SELECT l_partkey, score, source_name FROM r WHERE n = 1""",
)
def a10(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    part = lambda f: line.where(f"l_returnflag = '{f}'").select("l_partkey", F.col("l_suppkey").alias("score"), F.col("l_quantity").alias("q"))
    out = S.merged_staging([(f, part(f)) for f in ("A", "R")], "l_partkey", {"A": F.col("q") > 20, "R": F.col("q") > 48}).drop("q")
    return out


@C.add(
    "a11_intake",
    """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents WHERE doc_id % 5 <> 0), k AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 5 = 0),
r AS (SELECT h.*, k.content_hash IS NOT NULL AS known, row_number() OVER (PARTITION BY h.content_hash ORDER BY doc_id) AS n FROM h LEFT JOIN k ON k.content_hash = h.content_hash)
SELECT doc_id, content_hash, substring(sha256(content_hash || ':' || source), 1, 32) AS artifact_id, CASE WHEN known OR n > 1 THEN 'duplicate' ELSE 'new' END AS status FROM r""",
)
def a11(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    known = d.where("doc_id % 5 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return S.intake(d.where("doc_id % 5 <> 0"), known, "text", "source", ["doc_id"]).select("doc_id", "content_hash", "artifact_id", "status")


@C.add(
    "a11_file_intake",
    """WITH h AS (SELECT page_id, url, sha256(html || chr(10)) AS content_hash, octet_length(encode(html)) + 1 AS length FROM (SELECT page_id, url, replace(CASE WHEN page_id % 7 = 6 THEN 'copied' ELSE html END, chr(13), '') AS html FROM pages)),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.content_hash ORDER BY page_id) AS n, content_hash IN (SELECT content_hash FROM h WHERE page_id % 5 = 0) AS known FROM h WHERE page_id % 5 <> 0)
SELECT page_id, length, content_hash, substring(sha256(content_hash || ':' || page_id), 1, 32) AS artifact_id, CASE WHEN known OR n > 1 THEN 'duplicate' ELSE 'new' END AS status FROM r""",
)
def a11_files(spark, sf_dir):
    """Pages written as files, some alike, and taken in again from the folder."""
    path = S.scratch_path(spark, "artifacts")
    html = F.replace(F.when(F.col("page_id") % 7 == 6, "copied").otherwise(F.col("html")), F.lit("\r"), F.lit(""))
    pages = dealt(table(spark, sf_dir, "pages")).select("page_id", F.concat(F.coalesce(html, F.lit("")), F.lit("\n")).alias("value"))
    S.write_artifacts(pages, path, "page_id", "value")
    files = S.artifacts(spark, path, "*.txt", ["page_id"]).select(S.written_key(F.col("path")).cast("long").alias("page_id"), "length", F.sha2("content", 256).alias("content_hash"))
    # Files are read once, for those that are known and those that come in.
    hashed = S.scratch_path(spark, "hashed")
    files.write.parquet(hashed)
    files = spark.read.schema(files.schema).parquet(hashed)
    known = files.where("page_id % 5 = 0")
    return S.judged(files.where("page_id % 5 <> 0"), known, "page_id", ["page_id"]).select("page_id", "length", "content_hash", "artifact_id", "status")


@C.add(
    "a12_stride_sample",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM r WHERE n <= 12 OR i = 0 OR i = n - 1 OR i % greatest(1, n // 12) = 0) SELECT doc_id, source FROM k WHERE k <= 12""",
)
def a12(spark, sf_dir):
    return S.stride_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 12)


def event_stream(spark, sf_dir, cols, times=1):
    """The events as a stream of small files in time order, all of them so many ``times``."""
    path = S.scratch_path(spark, "events")
    rows = table(spark, sf_dir, "events").select(*cols)
    for _ in range(times):
        rows.repartitionByRange(6, "event_id").write.mode("append").parquet(path)
    return L.file_stream(spark, path, rows.schema, 2)


@C.add(
    "l1_deltas",
    "SELECT event_id, user_id AS entity, event_type AS field, value, user_id % 3 AS confidence FROM events WHERE NOT coalesce(event_id % 4 = 0, false)",
)
def l1(spark, sf_dir):
    cols = ["event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("field"), "value", (F.col("user_id") % 3).alias("confidence")]
    known = table(spark, sf_dir, "events").select(*cols).where("event_id % 4 = 0")
    out = S.scratch_path(spark, "deltas")
    stream = event_stream(spark, sf_dir, cols, times=2)  # each record comes again in a later batch, and is no news then
    L.deltas(stream, known, ["event_id", "entity", "field"], ["event_id"], out, S.scratch_path(spark, "cp"))
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


@C.add(
    "l2_changes",
    """WITH r AS (SELECT url, 0::BIGINT AS version, coalesce(html, '') AS content FROM pages UNION ALL SELECT url, 1, coalesce(CASE WHEN page_id % 5 = 0 THEN html || '!' ELSE html END, '') FROM pages),
c AS (SELECT *, row_number() OVER w AS n, coalesce(content = lag(content) OVER w, false) AS same FROM r WINDOW w AS (PARTITION BY url ORDER BY version, content))
SELECT url, version, CASE WHEN n = 1 THEN 'new' WHEN same THEN 'unchanged' ELSE 'changed' END AS status, (count(*) FILTER (NOT same) OVER (PARTITION BY url ORDER BY n))::BIGINT AS n_versions FROM c""",
)
def l2(spark, sf_dir):
    p, path = table(spark, sf_dir, "pages"), S.scratch_path(spark, "pages")
    first = p.select("url", F.lit(0).cast("long").alias("version"), F.col("html").alias("content"))
    second = p.select("url", F.lit(1).cast("long").alias("version"), F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("content"))
    # The first versions are older files, and a url's rows lie in one file, so neither is split over batches out of order.
    for rows in (first, second):
        rows.repartition("url").write.mode("append").parquet(path)
    out = S.scratch_path(spark, "changes")
    L.changes(L.file_stream(spark, path, first.schema, 100), out, S.scratch_path(spark, "cp"))
    return spark.read.schema("url string, version long, status string, n_versions long").parquet(out)


@C.add("l3_ledger", "SELECT user_id AS evidence_id, min(event_id) AS event_id FROM events GROUP BY 1")
def l3(spark, sf_dir):
    out = S.scratch_path(spark, "evidence")
    stream = event_stream(spark, sf_dir, ["event_id", F.col("user_id").alias("evidence_id")])
    L.ledger(stream, "evidence_id", ["event_id"], out, S.scratch_path(spark, "cp"))
    return L.ledger_rows(spark, out, stream.schema, "evidence_id", ["event_id"]).select("evidence_id", "event_id")


@C.add(
    "l4_streamed_upserts",
    "WITH ch AS (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT coalesce(ch.k, p_partkey) AS k, coalesce(ch.v, p_brand) AS v FROM part FULL JOIN ch ON ch.k = p_partkey",
)
def l4(spark, sf_dir):
    current = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"), F.lit(-1).cast("long").alias("event_id"))
    stream = event_stream(spark, sf_dir, ["event_id", F.col("user_id").alias("k"), F.col("event_type").alias("v")])
    out = L.streamed_upserts(stream, current, "k", "event_id", S.scratch_path(spark, "state"), S.scratch_path(spark, "cp"))
    return out.drop("event_id")


@C.add("l5_review_queue", "SELECT event_id, user_id, 'pending' AS status FROM events WHERE value < 5 ORDER BY ts, event_id LIMIT 20")
def l5(spark, sf_dir):
    out = S.scratch_path(spark, "queue")
    stream = event_stream(spark, sf_dir, ["event_id", "ts", "user_id", "value"])
    L.queue(stream, "value < 5", out, S.scratch_path(spark, "cp"))
    schema = stream.withColumn("status", F.lit("pending")).schema
    return L.pending(spark, out, schema, ["ts", "event_id"], 20).select("event_id", "user_id", "status")


@C.add("l6_synced", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1")
def l6(spark, sf_dir):
    empty = table(spark, sf_dir, "events").select("user_id", "ts", "event_type").limit(0)
    stream = event_stream(spark, sf_dir, ["event_id", "user_id", "ts", "event_type"])
    out = L.synced(stream, empty, "user_id", "ts", "2024-02-01", S.scratch_path(spark, "state"), S.scratch_path(spark, "cp"))
    return out.select("user_id", "event_type")
