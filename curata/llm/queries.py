"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    conversation_repair,
    html_text,
    language_id,
    mixing,
    nearest_neighbours,
    ngram_join,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    token_files,
    whitening,
)
from .sequences import rows_of
from .storage import stored


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def _remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE)).cast("long")) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", base.alias("base_failed"), "kept"
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _path("word_bpe_49k.json")
    manifest = token_files.write(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)
    return token_files.read(manifest, tokenizer).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")
    return found.select(
        "doc_id",
        *map(number, range(4)),
        F.sha2(pii.listed(F.col("spans")), 256).alias("base_sha256"),
        pii.listed(F.col("spans"), F.col("terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
        (F.size("spans") + F.size("terms") > 0).alias("found"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    langs, logp = language_id.train(docs.where(_remainder(4) != 2))
    found = language_id.predict(docs, langs, logp)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", F.to_json("languages").alias("languages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations as op11 is asked to damage them."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    text, role = one_space("text"), one_space("role")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.where(how != 0).select("conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times))
    return out.drop("col")


def _repair_digests(batches):
    """A row for each conversation of sorted audited rows; texts pass through the hash one by one."""
    known, row = None, None

    def line():
        conv, audit, digest, turns, counts, illegal, cost = row
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        named = [pa.array([conv], pa.int64()), *(pa.array([x], pa.int64()) for x in (gaps, *counts.values(), illegal, cost))]
        return pa.RecordBatch.from_arrays([*named, pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], REPAIRED_COLUMNS)

    for conv, turn, role, text, fault, illegal, edits, cost in rows_of(batches):
        if known != (conv,):
            if row:
                yield line()
            known, row = (conv,), [conv, [], hashlib.sha256(), [0, 0, 0], {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0]
            begun = False
        turns = row[3]
        if turn is not None and (not turns[2] or turn != turns[1]):  # rows come by turn
            turns[:] = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
        if fault:
            row[4][fault] += 1
        row[5] += illegal
        row[6] += cost
        for edit in EDIT.findall(edits):
            row[1].append(edit[0])
            if edit != "D":
                to = {"u": "user", "a": "assistant"}.get(edit[1:], role)
                row[2].update(f"{chr(10) if begun else ''}{to}:{'' if edit[0] == 'I' else text}".encode())
                begun = True
    if row:
        yield line()


EDIT = re.compile("[KD]|[RI][ua]")
REPAIRED_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    audited = conversation_repair.audit(_damaged(rows))
    # A digest over a conversation needs its turns in order: they stream through one task, and nothing but the audit string is held.
    ordered = audited.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "number")
    ordered = ordered.select("conv_id", "turn", "role", "text", "fault", "illegal", "edits", "cost")
    found = ordered.mapInArrow(_repair_digests, ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in REPAIRED_COLUMNS))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    missing = {c: F.lit("") if c == "audit" else F.lit(hashlib.sha256(b"").hexdigest()) if c == "repaired_sha256" else F.lit(0) for c in REPAIRED_COLUMNS[1:]}
    return joined.select(F.col("id").alias("conv_id"), *(F.coalesce(c, x).alias(c) for c, x in missing.items()))


CHAT_COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _chat_digests(batches):
    """A row for each conversation of windows sorted by their first turn."""
    known = None

    def line():
        n, turns, chars, loss, formatted = row
        values = ([known[0]], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [formatted])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in CHAT_COLUMNS.split(", ")])

    for conv, n_turns, roles, texts, targets, n_chars in rows_of(batches, 64):
        if known != (conv,):
            if known:
                yield line()
            known, row = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        row[0] += n_turns
        for role, text in zip(roles, texts, strict=True):
            row[1].update(f"{role}\n{text}\n".encode())
        for text in targets:
            row[2] += len(text)
            row[3].update(text.encode())
        row[4] += n_chars
    if known:
        yield line()


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    windows = stored(chat_format.format_windows(rows, _path("byte_bpe_50k.json")), "chat-windows")
    back = chat_format.read_back(windows)
    ordered = back.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "first")
    return ordered.select("conv_id", "n_turns", "roles", "texts", "targets", "n_chars").mapInArrow(_chat_digests, CHAT_COLUMNS)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    fit = whitening.fit(vectors, k=16)
    return whitening.transform(vectors, fit).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def queries() -> dict:
    found = (
        op1_html_text,
        op2_quality_classifier,
        op3_quality_rules,
        op4_token_files,
        op5_pii,
        op6_best_fit_packing,
        op7_language_id,
        op8_ngram_jaccard_join,
        op9_mixing,
        op10_nearest_neighbours,
        op11_conversation_repair,
        op12_chat_format,
        op13_embedding_whitening,
    )
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
p AS (SELECT DISTINCT r, i + k AS p FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2),
rep AS (SELECT r, count(*) AS n FROM p GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.r, d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
  + 4 * (word_chars < 2 * n_words)::BIGINT + 8 * (word_chars > 20 * n_words)::BIGINT
  + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed_bits,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('20240229:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
c AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  (3 * source_size)::DOUBLE AS cap FROM r),
v AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS n,
  (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER q, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0)) AS level
  FROM c WINDOW q AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, cap <= weight * level AS clamped FROM v),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap
  ELSE weight * (SELECT arg_min(level, n) FROM x WHERE NOT clamped) END AS target FROM x),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM a)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN (2 * ahead + size)::DOUBLE < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t AS a JOIN t AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(d, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_ngram_jaccard_join": OP8_SQL, "op10_nearest_neighbours": OP10_SQL, "op3_quality_rules": OP3_SQL, "op9_mixing": OP9_SQL}
