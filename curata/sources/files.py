"""Sources and sinks (A1-A12): records from CSV, JSON and pages, ledgers, reports, intake and sampling."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable
from fnmatch import fnmatchcase
from functools import reduce
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import quote, unquote
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from pyspark.sql.window import Window

# Header words and the columns they stand for.
ALIASES = {
    "name": "name",
    "country": "country",
    "region": "region",
    "distillery_id": "original_distillery_id",
    "production_capacity": "production_capacity_lpa",
    "production_capacity_lpa": "production_capacity_lpa",
    "capacity": "production_capacity_lpa",
    "number_of_stills": "number_of_stills",
    "stills": "number_of_stills",
    "bottler": "bottler_name",
    "bottler_name": "bottler_name",
    "brand": "bottler_name",
    "product_name": "name",
    "production_bottle_name": "name",
    "whisky_name": "name",
    "whisky_id": "original_whisky_id",
    "bottling_type": "bottling_type",
    "type": "bottling_type",
    "age_statement": "age_statement",
    "age": "age_statement",
    "age_years": "age_statement",
    "vintage_year": "vintage_year",
    "vintage": "vintage_year",
    "bottling_year": "bottling_year",
    "bottled": "bottling_year",
    "release_year": "release_year",
    "number_of_bottles": "number_of_bottles",
    "abv": "abv",
    "alcohol": "abv",
    "price_original": "price_original",
    "price": "price_original",
    "production_price": "price_original",
    "price_currency": "price_currency",
    "currency": "price_currency",
    "product_url": "product_url",
    "source_urls": "source_urls",
    "urls": "source_urls",
    "flavor_profile_keywords": "flavor_profile_keywords",
    "flavor_tags": "flavor_profile",
    "flavor_profile": "flavor_profile",
    "cask_type": "cask_type",
    "source_dataset": "source_dataset",
    "image": "image_url",
    "image_url": "image_url",
    "status": "status",
    "confidence_score": "confidence_score",
    "confidence": "confidence_score",
    "data_confidence": "confidence_score",
    "official_website": "official_website",
    "website": "official_website",
    "notes": "notes",
    "notes_for_review": "notes",
}

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset a local session gets a temporary folder; on a cluster it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="curata-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def long_records(df: DataFrame, ids: list[str], prefix: str = "") -> DataFrame:
    """(ids, field, value) of all non-blank cells of the other columns."""
    columns = [c for c in df.columns if c not in ids]
    texts = df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    out = texts.unpivot(ids, columns, "field", "value").where(filled(F.col("value")))
    return out.withColumn("field", F.concat(F.lit(prefix), "field")) if prefix else out


def csv_records(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """A1: CSV files with a header to long records; all columns are read as text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return long_records(spark.read.schema(schema).option("header", True).csv(path), [key], "csv:")


def leaves(kind: DataType, path: Column, value: Column) -> list[Column]:
    """Arrays of (path, value) structs, one for each scalar that ``kind`` holds: ``a.b`` for structs, ``a[0].b`` for arrays, at any depth."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, F.concat(path, F.lit(f".{f.name}")), value[f.name])]
    if isinstance(kind, ArrayType):

        def each(v: Column, i: Column) -> Column:
            return F.flatten(F.array(*leaves(kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), v)))

        return [F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), each))]
    return [F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))]


def flattened(df: DataFrame, key: str) -> DataFrame:
    """A2: nested records to (key, path, value): scalars at any depth of structs and arrays, blanks dropped; one pass, one explode."""
    found = [x for f in df.schema.fields if f.name != key for x in leaves(f.dataType, F.lit(f.name), F.col(f"`{f.name}`"))]
    return df.select(key, F.explode(F.flatten(F.array(*found))).alias("x")).select(key, "x.path", "x.value").where(filled(F.col("value")))


def flattened_json(df: DataFrame, key: str, text: str, most_levels: int = 64) -> DataFrame:
    """A2 for JSON texts whose schema nobody knows or that differs by row: (key, path, value) of their scalars, as ``flattened`` has them.

    Texts become variants and are opened a level at a time, all rows at once. Each level is written once to the shared folder, scalars
    apart from what has levels below it, so no level is parsed twice and a lost executor costs one level. Null and invalid texts
    give no rows, a text that is one scalar has the path ``''``; more than ``most_levels`` levels are an error.
    """
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "levels")
    kind = df.select(F.col(f"`{key}`").alias("_key")).schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, _path string, _value string, _rest variant, _deeper boolean"

    def written(level: DataFrame, n: int) -> DataFrame:
        deeper = F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")
        rows = level.where("_v is not null").withColumn("_deeper", deeper)
        value, rest = F.when(~F.col("_deeper"), F.try_variant_get("_v", "$", "string")), F.when(F.col("_deeper"), F.col("_v"))
        kept = rows.select("_key", "_path", value.alias("_value"), rest.alias("_rest"), "_deeper").where(F.col("_deeper") | filled(F.col("_value")))
        kept.write.partitionBy("_deeper").parquet(f"{folder}/{n}")
        return spark.read.schema(schema).parquet(f"{folder}/{n}")

    levels = [written(df.select(F.col(f"`{key}`").alias("_key"), F.lit("").alias("_path"), F.try_parse_json(F.col(f"`{text}`")).alias("_v")), 0)]
    while not (open_rows := levels[-1].where("_deeper")).isEmpty():
        if len(levels) > most_levels:
            raise ValueError(f"JSON of more than {most_levels} levels")
        opened = open_rows.lateralJoin(spark.tvf.variant_explode(F.col("_rest").outer()))
        named = F.when(F.col("_path") == "", F.col("key")).otherwise(F.concat("_path", F.lit("."), "key"))
        path = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(named)
        levels.append(written(opened.select("_key", path.alias("_path"), F.col("value").alias("_v")), len(levels)))
    found = reduce(DataFrame.unionAll, [x.where("not _deeper") for x in levels])
    return found.select(F.col("_key").alias(key), F.col("_path").alias("path"), F.col("_value").alias("value"))


class _Fields(HTMLParser):
    """Title, meta description, headings and paragraphs of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.seen = {"h1": 0, "p": 0}
        self.titled = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or "").lower() == "description" and (a.get("content") or "").strip():
            self.found.append(("html:meta_description", a["content"].strip()))
        if tag == "p":
            self._close("p")
        if tag in ("title", "h1", "p"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("title", "h1", "p"):
            self._close(tag)

    def handle_data(self, data):
        for _, parts in self.open:
            parts.append(data)

    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                text = "".join(p.strip() for p in self.open.pop(i)[1])
                if tag == "title":
                    if text and not self.titled:
                        self.found.insert(0, ("html:title", text))
                        self.titled = True
                    return
                n = self.seen[tag]
                self.seen[tag] += 1
                if tag == "h1" and text:
                    self.found.append((f"html:h1[{n}]", text))
                elif tag == "p" and len(text) > 20:
                    self.found.append((f"html:p[{n}]", text[:500]))
                return


def page_records(pages: DataFrame, key: str = "page_id", html: str = "html", parser: Callable | None = None) -> DataFrame:
    """A3, M4: (key, field, value) of pages; ``parser`` (text to (field, value) pairs) may replace the built-in one."""

    def default(text: str) -> list[tuple[str, str]]:
        p = _Fields()
        p.feed(text)
        p.close()
        for tag, _ in list(p.open):
            p._close(tag)
        return p.found

    extract = parser or default

    def run(batches):
        for df in batches:
            rows = [(k, f, v) for k, t in zip(df[key], df[html], strict=True) for f, v in extract(t or "")]
            yield pd.DataFrame(rows, columns=[key, "field", "value"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, field string, value string")


class Tables:
    """A4: named tables that may be read, with where, order and limit."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, paths

    def query(self, name: str, where: Column | str | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
        if name not in self.paths:
            raise KeyError(f"no table called {name!r}")
        df = self.spark.read.parquet(self.paths[name])
        df = df if where is None else df.where(where)
        df = df.orderBy(*order) if order else df
        return df if limit is None else df.limit(limit)


def canonical_columns(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Columns under their canonical names; of several for one name the last that has a value counts."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        low = c.strip().lower()
        groups.setdefault(aliases.get(low, low), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in reversed(cs)]).alias(n) for n, cs in groups.items()])


def write_ledger(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(parts: list[DataFrame], path: str) -> DataFrame:
    """CSV with the union of all columns; returns what was written."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def ingest_star(products: DataFrame, producers: DataFrame, product_key: str = "product_id") -> dict[str, DataFrame]:
    """A5: products (product_id, name, producer_name, bottler_name, casks) and producers (producer_name, country) to a star.

    Dimensions are distinct case-blind names with hashed ids; products whose producer is unknown, or without a name, are rejects.
    """
    ident = lambda c: F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 16)
    named = producers.where(filled(F.col("producer_name")))
    dim_producer = named.groupBy(ident(F.col("producer_name")).alias("producer_id")).agg(F.min("producer_name").alias("producer_name"), F.min("country").alias("country"))
    bottlers = products.where(filled(F.col("bottler_name")))
    dim_bottler = bottlers.groupBy(ident(F.col("bottler_name")).alias("bottler_id")).agg(F.min("bottler_name").alias("bottler_name"))
    met = products.withColumn("producer_id", ident(F.col("producer_name"))).join(dim_producer.select("producer_id", F.lit(True).alias("_known")), "producer_id", "left")
    reason = F.when(~filled(F.col("name")), "no name").when(F.col("_known").isNull(), "unknown producer")
    judged = met.withColumn("reason", reason)
    good = judged.where("reason is null")
    bottler = F.when(filled(F.col("bottler_name")), ident(F.col("bottler_name")))
    facts = good.select(product_key, "name", "producer_id", bottler.alias("bottler_id"))
    casks = good.select(product_key, F.explode(F.array_distinct(F.transform(F.split(F.coalesce("casks", F.lit("")), "[&,/;]+"), F.trim))).alias("cask"))
    counters = judged.agg(F.count("*").alias("n_read"), F.count("reason").alias("n_rejected"), F.count_if(F.col("reason").isNull()).alias("n_inserted"))
    return {
        "producers": dim_producer,
        "bottlers": dim_bottler,
        "products": facts,
        "casks": casks.where("cask <> ''"),
        "rejects": judged.where("reason is not null").select(product_key, "reason"),
        "counters": counters,
    }


def synthetic_catalogue(spark: SparkSession, n: int, seed: int = 42) -> dict[str, DataFrame]:
    """Seven tables of n made-up entities that depend on number and seed alone, not on partitions.

    Nine of ten entities have a profile, three of five of those evidence; entity n - 5 has a profile next to that of entity 0.
    """
    pick = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most))
    share = lambda salt: pick(salt, 1_000_000) / 1_000_000
    between = lambda salt, low, high, digits: F.round(low + (high - low) * share(salt), digits)
    one_of = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (pick(salt, len(values)) + 1).cast("int"))
    number = lambda prefix, c="id": F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), 8, "0"))
    countries, regions, kinds = ("Scotland", "Ireland", "Japan", "USA"), ("Islay", "Speyside", "Highland", "Lowland"), ("single malt", "blend", "grain")
    axes = ("smoky", "peaty", "fruity", "sweet", "spicy", "maritime", "sherry")
    made = F.lit("synthetic")
    makers = max(5, n // 20)
    producers = spark.range(makers).select(
        number("MAKER-").alias("distillery_id"), F.concat(F.lit("Synthetic Distillery "), "id").alias("name"), one_of("country", countries).alias("country"),
        one_of("region", regions).alias("region"), made.alias("data_confidence"),
    )
    rows = spark.range(n)
    entities = rows.select(
        number("ENTITY-").alias("entity_id"), F.concat(F.lit("Synthetic Entity "), "id").alias("name"),
        F.concat(F.lit("MAKER-"), F.lpad(pick("maker", makers).cast("string"), 8, "0")).alias("distillery_id"), one_of("country", countries).alias("country"),
        one_of("region", regions).alias("region"), one_of("kind", kinds).alias("type"), F.concat(F.lit("Synthetic Brand "), F.col("id") % 17).alias("brand"),
        between("critic", 60, 98, 1).alias("critic_score"), between("user", 1, 5, 2).alias("user_score"), F.lit(None).cast("string").alias("superseded_by"), made.alias("data_confidence"),
    )
    prices = rows.select(number("PRICE-").alias("price_id"), number("ENTITY-").alias("entity_id"), made.alias("source"), between("price", 20, 500, 2).alias("price"), F.lit("USD").alias("currency"))
    twin = (F.lit(n) > 260) & (F.col("id") == n - 5)
    profiled = rows.where((share("profile") < 0.9) | (F.lit(n > 260) & F.col("id").isin(0, n - 5))).withColumn("own", F.col("id"))
    # The twin draws the numbers of entity 0, its first axis one off.
    drawn = profiled.withColumn("id", F.when(twin, 0).otherwise(F.col("id")))
    value = lambda i, axis: F.when((F.col("own") != F.col("id")) & F.lit(i == 0), F.least(F.lit(10), pick(axis, 10) + 2)).otherwise(pick(axis, 10) + 1)
    vector = F.create_map(*[x for i, axis in enumerate(axes) for x in (F.lit(axis), value(i, axis).cast("double"))])
    profiles = drawn.select(number("ENTITY-", "own").alias("entity_id"), vector.alias("profile"), made.alias("source"))
    evidence = profiled.where(share("evidence") < 0.6).select(number("EVIDENCE-").alias("evidence_id"), number("ENTITY-").alias("entity_id"), made.alias("source"))
    references = spark.createDataFrame([], "entity_type string, entity_id string, source_name string, source_url string, field_name string, field_value string, confidence double")
    audit = spark.createDataFrame([], "source_title string, source_type string, domain string, extraction_timestamp string, extracted_records_count long, status string")
    return {
        "distilleries": producers,
        "entities": entities,
        "price_history": prices,
        "profiles": profiles,
        "evidence": evidence,
        "source_references": references,
        "source_audit": audit,
    }


def merged_staging(sources: list[tuple[str, DataFrame]], key: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """A10: sources under one schema, each with its filter; of a key the last source wins."""
    parts = []
    for i, (name, df) in enumerate(sources):
        rows = df.where(keep[name]) if keep and name in keep else df
        parts.append(rows.withColumns({"source_name": F.lit(name), "_order": F.lit(i)}))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = sorted(c for c in both.columns if c not in (key, "_order"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_order"), *rest))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_order")


def intake(artifacts: DataFrame, known: DataFrame, content: str, source: str, order: list) -> DataFrame:
    """Artifacts with content hash, id and status: new, or duplicate of a known one or of an earlier one in the batch."""
    return judged(artifacts.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)), known, source, order)


def judged(hashed: DataFrame, known: DataFrame, source: str, order: list) -> DataFrame:
    """``intake`` of artifacts that have their content hash."""
    met = hashed.join(known.select("content_hash").distinct().withColumn("_known", F.lit(True)), "content_hash", "left")
    place = F.row_number().over(Window.partitionBy("content_hash").orderBy(*order))
    status = F.when(F.col("_known").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("new")
    ident = F.substring(F.sha2(F.concat_ws(":", "content_hash", F.col(source).cast("string")), 256), 1, 32)
    return met.withColumn("_n", place).withColumns({"artifact_id": ident, "status": status}).drop("_known", "_n")


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's name for null in a folder
FOLDERS = 1024


def _place(path: str):
    """(pyarrow filesystem, path in it) of a path as Spark has it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _entries(store, folder: str):
    """(name, whether it is a folder, its time in microseconds) of what lies in a folder; hidden names are left out, as Spark leaves them out."""
    if isinstance(store, fs.LocalFileSystem):  # a folder of any length, without a list of it
        with os.scandir(folder) as found:
            found = ((e.name, e.is_dir(), None if e.is_dir() else e.stat().st_mtime_ns // 1000) for e in found)
            yield from (e for e in found if e[0][0] != "." and (e[0][0] != "_" or "=" in e[0]))
    else:
        found = ((i.base_name, i.type == fs.FileType.Directory, i.mtime_ns and i.mtime_ns // 1000) for i in store.get_file_info(fs.FileSelector(folder)))
        yield from (e for e in found if e[0][0] != "." and (e[0][0] != "_" or "=" in e[0]))


def write_artifacts(rows: DataFrame, path: str, key: str, content: str) -> int:
    """The bytes of each row as a file of its own below ``path``; how many. ``written_key`` has the key of a file's path.

    Tasks write the files themselves, in folders by a hash of the key: Spark's writers take some 20 ms a folder, and a folder a key is a
    block of disk. A file is named by task, key, content and copy and moved to its name when it is whole, so a task that is run again leaves the same files.
    """

    def run(batches):
        store, root = _place(path)
        part, copies, made = TaskContext.get().partitionId(), Counter(), set()
        for batch in batches:
            for value, data in zip(batch[0].to_pylist(), (x.as_py() for x in batch[1]), strict=True):
                name = NO_VALUE if value is None else quote(value, safe="")
                folder = f"{root}/{key}=hash-{crc32(name.encode()) % FOLDERS:04}"
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                file = f"part-{part:05}-{name}-{hashlib.sha256(data).hexdigest()[:32]}"
                copies[file] += 1
                hidden = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(data)
                store.move(hidden, f"{folder}/{file}-{copies[file]}.txt")
        yield pa.RecordBatch.from_arrays([pa.array([sum(copies.values())], pa.int64())], ["n"])

    store, root = _place(path)
    store.create_dir(root)
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return rows.select(F.col(key).cast("string"), data).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def written_key(path: Column) -> Column:
    """The key, as text, of a file of ``write_artifacts``."""
    name = F.regexp_extract(path, r"/part-\d+-([^/]*)-[0-9a-f]{32}-\d+\.txt$", 1)
    return F.when(name != NO_VALUE, F.url_decode(name))


def artifacts(spark: SparkSession, path: str, pattern: str = "*", keys: list[str] | None = None) -> DataFrame:
    """Files below a folder as artifacts: path, modified, length, content (bytes), and a text column for each level of ``key=value`` folders.

    One task lists what lies in the folder, others what lies below it, and read the files, so the driver never has a list of them. Unless ``keys``
    names them, the first folder of a level names its key.
    """
    store, root = _place(path)
    if keys is None:
        keys, at = [], root
        while first := next((name for name, is_folder, _ in _entries(store, at) if is_folder and "=" in name), None):
            keys, at = [*keys, first.split("=")[0]], f"{at}/{first}"

    def listed(batches):
        found = (e for _ in batches for e in _entries(_place(path)[0], root))
        while some := list(islice(found, 10_000)):
            columns = zip(zip(*some, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["name", "is_folder", "time"])

    def below(store, at: str, entry: tuple, values: list):
        name, is_folder, time = entry
        if not is_folder:
            if len(values) == len(keys) and fnmatchcase(name, pattern):
                yield f"{at}/{name}", time, values
        elif len(values) < len(keys) and name.startswith(f"{keys[len(values)]}="):
            value = unquote(name.split("=", 1)[1])
            for inner in _entries(store, f"{at}/{name}"):
                yield from below(store, f"{at}/{name}", inner, [*values, None if value == NO_VALUE else value])

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary(), *[pa.string()] * len(keys)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "modified", "length", "content", *keys])

    def read(batches):
        store, rows, size = _place(path)[0], [], 0
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for file, time, values in below(store, root, entry, []):
                    with store.open_input_file(file) as f:
                        data = f.read()
                    rows.append((file, time, len(data), data, *values))
                    size += len(data)
                    if size > 4 << 20 or len(rows) == 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    made = "path string, modified timestamp, length long, content binary" + "".join(f", `{k}` string" for k in keys)
    top = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string, is_folder boolean, time long")
    return top.repartition(4 * spark.sparkContext.defaultParallelism, "name").mapInArrow(read, made)


def stride_sample(df: DataFrame, by: str, order: list[str], cap: int, slices: int = 256) -> DataFrame:
    """Of each group the first, the last and every n-th row, n so that about ``cap`` stay, and no more than that.

    A group is cut into ``slices`` even ranges of its first order column (a number or time; other kinds are one range), so that a large
    group is numbered by many tasks: places are numbers of rows in the ranges before plus the place within one.
    """
    kind = df.schema[order[0]].dataType
    at = F.col(order[0]).cast("timestamp").cast("double") if kind.typeName().startswith(("timestamp", "date")) else F.col(order[0]).cast("double")
    sliced = df.withColumn("_x", at if kind.typeName() not in ("string", "binary", "boolean") else F.lit(None).cast("double"))
    ends = sliced.groupBy(F.col(by).alias("_g")).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    place = F.least(F.lit(slices - 1), F.floor((F.col("_x") - F.col("_low")) / width * slices)).cast("int")
    sliced = sliced.join(ends, F.col(by).eqNullSafe(F.col("_g"))).withColumn("_s", F.coalesce(place, F.when(F.col("_x").isNull(), -1), F.lit(0))).drop("_x", "_low", "_high", "_g")
    counts = sliced.groupBy(F.col(by).alias("_g"), F.col("_s").alias("_t")).agg(F.count("*").alias("_c"))  # ``slices`` + 1 rows a group at most
    w = Window.partitionBy("_g")
    earlier = w.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_g", "_t", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"), F.sum("_c").over(w).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(by, "_s").orderBy(*order))
    marked = sliced.withColumn("_r", inside).join(bases, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    i, step = F.col("_base") + F.col("_r") - 1, F.greatest(F.lit(1), F.floor(F.col("_all") / cap))
    # The hits before a place are its multiples of the step; the last row is one more where it is none.
    hit = (F.col("_all") <= cap) | (i == F.col("_all") - 1) | (F.pmod(i, step) == 0)
    before = F.when(F.col("_all") <= cap, i).otherwise(F.ceil(i / step))
    return marked.where(hit & (before < cap)).drop("_s", "_r", "_g", "_t", "_base", "_all")
