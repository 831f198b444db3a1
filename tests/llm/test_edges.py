"""Each operator on empty tables, nulls, empty and very long texts, repeated rows and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402

from curata.llm import (  # noqa: E402
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
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, key int, n int, score int, size int, spans int, label int, `n_words` int"
LONG = " ".join(f"word{i % 5000}" for i in range(120_000))
ONE_WORD = "x" * 300_000
ROWS = [
    (1, "some words of a document that is not long", "en", "a"),
    (1, "some words of a document that is not long", "en", "a"),
    (1, "some words of a document that is not long", "en", "a"),
    (2, None, None, None),
    (None, "no id here but words", "en", "a"),
    (None, None, None, None),
    (None, "", "fr", "b"),
    (3, "", "fr", "b"),
    (4, " \n\t ", None, "b"),
    (5, LONG, "en", "a"),
    (6, ONE_WORD, "en", None),
    (7, "ß ÄÖÜ 漢字   \x00 end", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def classified(df):
    return quality_classifier.score(df, quality_classifier.train(df, df.select("doc_id", F.lit(1).alias("label"))))


def named(df):
    langs, logp = language_id.train(df)
    return language_id.predict(df, langs, logp)


OPERATORS = {
    "2": classified,
    "3": lambda df: quality_rules.apply_policy(quality_rules.ledger(df)),
    "4": lambda df: token_files.read(token_files.write(df, WORDS, 2), WORDS),
    "5 spans": pii.find,
    "5 texts": pii.sanitise,
    "7": named,
    "8": lambda df: ngram_join.near_duplicates(df, 3, 90),
    "9": mixing.mix,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_document(docs, nothing, name):
    assert OPERATORS[name](nothing).count() == 0
    got = OPERATORS[name](docs)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect() if r.doc_id is not None)
    assert ids == sorted(r[0] for r in ROWS if r[0] is not None) and got.count() == len(ROWS)


def test_defined_results(docs):
    score = {r.doc_id: r.score for r in classified(docs).collect() if r.doc_id}
    assert score[2] == score[3]
    rules = {r.doc_id: r for r in OPERATORS["3"](docs).collect() if r.doc_id}
    assert rules[2].n_words == rules[4].n_words == 0 and rules[5].n_words == 120_000 and rules[6].n_words == 1
    tokens = {r.doc_id: r.n_tokens for r in OPERATORS["4"](docs).collect() if r.doc_id}
    assert tokens[2] == tokens[3] == 1 and tokens[5] > 120_000
    langs = {r.doc_id: r.lang_pred for r in named(docs).collect() if r.doc_id}
    assert langs[2] == langs[3] == langs[4] == "und" and langs[5] == "en"
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in OPERATORS["8"](docs).collect() if r.doc_id}
    assert near[2] == (0, 2) and near[3] == (0, 3) and near[6] == (1, 6) and near[1][1] == 1 and near[5][0] == 5000
    mixed = [(r.doc_id, r.size, r.target) for r in mixing.mix(docs).collect()]
    assert all(s == 0 for d, s, _ in mixed if d in (2, 3, 4)) and any(s == 120_000 for d, s, _ in mixed if d == 5)


def test_packing(docs, nothing):
    assert packing.pack(nothing, BYTES, 2).count() == 0
    got = packing.pack(docs, BYTES, 2).collect()
    starts = [r for r in got if r.piece == 0]
    assert len(starts) == len(ROWS) and all(1 <= r.length <= 1024 for r in got)
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 5)
    assert [s for _, s, _ in long] == [sum(n for _, _, n in long[:i]) for i in range(len(long))]


def test_one_of_each_and_repeats(docs, nothing):
    assert ngram_join.one_of_each(nothing).count() == 0 and mixing.repeated(nothing, mixing.mix(nothing)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 3
    again = mixing.repeated(docs, mixing.mix(docs))
    assert again.columns == docs.columns and again.count() == mixing.mix(docs).agg(F.sum("repeats")).first()[0]


def test_pages(spark):
    schema = "page_id long, html string, text string, title int, n_blocks int"
    rows = [(1, None, "", 0, 0), (None, "", "", 0, 0), (2, "<p>" + LONG, "", 0, 0), (2, "<p>" + LONG, "", 0, 0), (3, "\x00<", "", 0, 0)]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "2", "2", "3", "None"] and all(len(r.text) == len(LONG) for r in got if r.page_id == 2)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, score int, n int, label int"
    v = [1.0, 2.0, 0.5]
    rows = [(0, v), (0, v), (1, v), (1, v), (2, None), (None, v), (3, [0.0, 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [1.0]), (20, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours.search(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 1, 5.25), (0, 2, 1, 5.25), (0, 3, 20, 2.0), (20, 1, 0, 2.0), (20, 2, 0, 2.0), (20, 3, 1, 2.0)]
    wide = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(1500)], 0, 0, 0) for i in range(30)], schema)
    best = nearest_neighbours.search(wide, F.col("vec_id") == 0, k=2)
    assert best.count() == 0  # a zero vector takes no part
    x = [[(i * j) % 7 for j in range(1500)] for i in range(30)]
    for q in (3, 5):
        want = sorted(((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in range(1, 30) if i != q))[:4]
        found = nearest_neighbours.search(wide, F.col("vec_id") == q, k=4).collect()
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
