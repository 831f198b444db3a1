"""Lexicon terms in long texts (D17): all terms at once by an automaton over words, with the place of each.

The automaton (Aho-Corasick) reads a text once, whatever the number of terms, and reports terms that overlap or lie in one another. It is
sent to tasks below a stated size of the lexicon; beyond it terms meet the texts' word n-grams by a join. Both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Largest lexicon that is sent to tasks whole: terms and their letters (about 100 MB as an automaton).
AUTOMATON_TERMS, AUTOMATON_LETTERS = 100_000, 2_000_000
#: Hits that leave a task in one batch.
BATCH_HITS = 8192

_WORD = re.compile("[a-z0-9]+")


class Finder:
    """First places of terms (lower-case words with one space between) in texts, as whole words."""

    def __init__(self, terms: list[str]):
        self._machine = ahocorasick.Automaton()
        for term in terms:
            self._machine.add_word(f" {term} ", term)
        if terms:
            self._machine.make_automaton()
        self._some = bool(terms)

    def first_places(self, text: str) -> dict[str, int]:
        """Each term that occurs with the place of its first occurrence in the lower-cased text, from 0."""
        if not self._some:
            return {}
        words = list(_WORD.finditer(text.lower()))
        starts, at = {}, 1
        for w in words:
            starts[at] = w.start()
            at += w.end() - w.start() + 1
        found: dict[str, int] = {}
        for end, term in self._machine.iter(f" {' '.join(w.group() for w in words)} "):
            if term not in found:
                found[term] = starts[end - len(term)]
        return found


def _around(terms: list[str], context: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms)
        for batch in batches:
            rows, hits, contexts = [], [], []

            def out():
                made = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string()), pa.array(contexts, pa.string())]  # noqa: B023
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                for term, at in finder.first_places(text).items() if text else ():
                    start = max(at - context, 0)
                    rows.append(i)
                    hits.append(term)
                    contexts.append(text[start : start + len(term) + 2 * context])
                if len(rows) >= BATCH_HITS:
                    yield out()
                    rows, hits, contexts = [], [], []
            if rows:
                yield out()

    return run


def _by_join(pages: DataFrame, terms: DataFrame, key: str, text: str, most_words: int, context: int) -> DataFrame:
    """Word n-grams meet terms by equality; hits go back to their pages by a hash of key and text."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != "")
    tokens = pages.select(key, F.col(text).alias("_t"), words.alias("_w"))
    grams = lambda n: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0))), lambda i: F.array_join(F.slice("_w", i + 1, F.lit(n)), " ")
    )
    own = (F.xxhash64(key, "_t").alias("_h1"), F.xxhash64(F.lit(1), key, "_t").alias("_h2"))
    every = F.array_distinct(F.flatten(F.array(*map(grams, range(1, most_words + 1)))))
    hits = tokens.select(F.explode(every).alias("term"), *own).join(terms, "term").distinct()
    found = pages.select(key, F.col(text).alias("_t")).select("*", *own).join(hits, ["_h1", "_h2"])
    # Letters before the hit as a text's length: places of matches count UTF-16 units.
    before = F.length(F.expr("regexp_extract(lower(_t), concat('(?s)^(.*?)(?<![a-z0-9])', replace(term, ' ', '[^a-z0-9]+'), '(?![a-z0-9])'), 1)"))
    around = F.substring(F.col("_t"), F.greatest(before + 1 - context, F.lit(1)), F.length("term") + 2 * context)
    return found.select(key, "term", around.alias("context"))


def mentions(
    pages: DataFrame, lexicon: DataFrame, key: str, text: str, most_words: int = 3, context: int = 100, most_terms: int = AUTOMATON_TERMS
) -> DataFrame:
    """(key, term, context): terms of ``lexicon`` (term) in texts, once per (page, term), with the letters around the first occurrence.

    Words are runs of a-z and 0-9 of the lower-cased text; a term of up to ``most_words`` of them, with one space between, occurs where
    they follow one another, whatever lies between. Other terms, null and empty ones too, never occur. Null and empty texts have no mentions. Pages that
    repeat a key, or key and text, are pages of their own.

    A lexicon of up to ``most_terms`` terms and ``AUTOMATON_LETTERS`` letters (both counted first) goes to tasks as an automaton: one pass, no
    shuffle. A larger one is joined.
    """
    terms = lexicon.where(F.col("term").rlike("^[a-z0-9]+( [a-z0-9]+){0,%d}\\z" % (most_words - 1))).select("term").distinct()
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("letters")).first()
    if size["n"] > most_terms or size["letters"] > AUTOMATON_LETTERS:
        return _by_join(pages, terms, key, text, most_words, context)
    known = sorted(r["term"] for r in terms.collect())
    of = pages.schema[key]
    made = StructType([StructField(key, of.dataType), StructField("term", StringType()), StructField("context", StringType())])
    return pages.select(key, text).mapInArrow(_around(known, context, to_arrow_schema(made)), made)
