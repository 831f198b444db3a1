"""Quality rules as a bitmask ledger.

``ledger`` reads every text once and keeps, per document, the measurements and one bit per failed rule.
``apply_policy`` and ``ablations`` work on the ledger alone: a policy is a versioned set of rules, a verdict is
``failed_bits & mask = 0``. Built-in functions only, so the whole operator is one scan without a shuffle; the
ablation adds a count by bit pattern (at most 2 ** number of rules groups).

Edge cases: a null or empty text has no words and all counts 0 (it fails ``few_words``); null ids are kept as they
are; repeated rows each give a row; other columns of the input are ignored. Three-word windows are compared by a
64-bit hash of their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# name, SQL condition for failure over the measurements
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "short_words", "long_words", "symbols", "repeated_lines"),
}
CURRENT = "v2"


def mask(rules) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _without(c: Column, chars: str) -> Column:
    return reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit("")), chars, c)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice: neighbours of the sorted (hash, place) list."""

    def places(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) & (i > 0), F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.transform(twice, lambda x: x["i"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.transform(F.array(ordered), places)  # binds the sorted list once
    return F.size(
        F.array_distinct(F.flatten(F.transform(at, lambda p: F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2))))))
    )


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.split(F.btrim(text, F.lit(SPACE)), "[\\x20\\x09-\\x0D]+")
    has_word = "[^\\x20\\x09-\\x0D]"
    read = docs.select(
        "doc_id",
        F.length(_without(text, SPACE)).alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word)).alias("lines"),
        words.alias("words"),
    )
    n = F.size("words")
    hashed = read.select(
        "doc_id",
        F.when(F.col("word_chars") == 0, 0).otherwise(n).alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform(
            F.slice("words", 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
        ).alias("hashes"),
    )
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    counted = hashed.withColumn("n_repeat_words", F.when(some, _covered(F.col("hashes"))).otherwise(0))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return counted.select("doc_id", *[F.col(c).cast("long").alias(c) for c in names])


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed_bits``: bit k is set where rule k of RULES fails."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        (F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, cond) in enumerate(RULES)),
    )
    return measurements(docs).withColumn("failed_bits", bits.cast("long"))


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy has failed."""
    return led.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablations(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay if it is left out."""
    m = mask(POLICIES[version])
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r, mask([r])) for r in POLICIES[version]]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in rules]))
    rest = F.col("bits").bitwiseAND(F.lit(m).cast("long") - F.col("r.bit"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
