"""Operators over whole tables against brute force or held-out labels, and the pipeline."""

import random
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from curata.llm import language_id, nearest_neighbours, ngram_join, quality_classifier  # noqa: E402
from curata.llm import queries as llm_queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(first.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows, bases = [], []
    for _ in range(n):
        kind = rng.random()
        if bases and kind < 0.5:
            words = rng.choice(bases).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            text = text.upper() if rng.random() < 0.1 else text
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 20, 60, 130])))
            text += f" {passage}" * (rng.random() < 0.3)
            bases.append(text)
        rows.append((len(rows), text))
    return [*rows, (900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (5, rows[5][1]), (903, "x"), (904, "X")]


@pytest.mark.parametrize(("seed", "k", "percent", "frequent"), [(1, 3, 90, 40), (2, 5, 80, 40), (3, 3, 90, 1), (4, 2, 80, 0), (5, 3, 60, 2), (6, 1, 75, 0)])
def test_components_against_brute_force(spark, monkeypatch, seed, k, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int")
    got = ngram_join.near_duplicates(df, k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, k, percent)


@pytest.mark.parametrize(("seed", "rows"), [(7, 8), (8, 3), (9, 512)])
def test_dense_group_of_near_copies_against_brute_force(spark, monkeypatch, seed, rows):
    """Many copies of one text, about half of which link: several blocks, trees, refused pairs and a third round."""
    monkeypatch.setattr(ngram_join, "ROWS", rows)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(90):
        copy = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            copy[rng.randrange(80)] = rng.choice(["other", f"own{i}"])
        texts.append((i, " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(texts, 3, 90)


def test_parity_sketches_never_differ_more_than_the_sets():
    rng = np.random.RandomState(1)
    for percent in (30, 60, 90):
        sets = []
        for _ in range(60):
            base = sets[rng.randint(len(sets))] if sets and rng.rand() < 0.7 else rng.randint(0, 1 << 62, int(rng.randint(1, 300))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[rng.rand(len(base)) < 0.95], rng.randint(0, 1 << 62, int(rng.randint(1, 4))).astype(np.uint64)])))
        n = np.array([len(s) for s in sets])
        found = ngram_join.apart(n, [ngram_join.parity(s) for s in sets], percent)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(np.intersect1d(x, y))
                if found[i, j] >= 0:
                    assert found[i, j] == found[j, i] <= len(x) + len(y) - 2 * both
                else:
                    assert 100 * both < percent * (len(x) + len(y) - both)


def test_counts_do_not_saturate(spark):
    df = spark.range(1).select(F.expr("array_repeat(7L, 200000)").alias("h")).union(spark.range(1).select(F.expr("array(1L << 50)")))
    found = ngram_join.sketch(df.union(df), ngram_join._longs("h"), 1 << 16)
    assert found.max() == ngram_join.scaled(np.array([131070]))[0] and sorted(found[found > 0].tolist())[0] == 2


@pytest.mark.parametrize("percent", [55, 60, 70, 75, 80, 90, 95])
def test_signatures_of_sets_that_link_meet(percent):
    """At the edge of linking, with what is missing and added chosen where it breaks most."""
    rng = np.random.RandomState(percent)
    met = 0
    for _ in range(3000):
        n = int(rng.choice([rng.randint(1, 12), rng.randint(1, 40), rng.randint(1, 160)]))
        x = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64) << np.uint64(1))
        n = len(x)
        frequency = rng.choice([rng.randint(0, 80, 1 << 16), rng.randint(30, 80, 1 << 16), rng.randint(0, 45, 1 << 16)][rng.randint(3)], 1 << 16).astype(np.uint8)
        above = (int(rng.choice([10, 20, 35])), int(rng.choice([40, 60, 79])))
        count = frequency[ngram_join.slot(x, 1 << 16)]
        order = np.lexsort((x, count, 1 + (count > above[0]).astype(int) + (count > above[1])))
        lost = int(rng.randint(0, n - -(-percent * n // 100) + 1))
        most = 100 * (n - lost) // percent - n
        start = int(rng.randint(0, max(1, n // 4)))
        gone = order[start :: int(rng.randint(1, 4))][:lost] if rng.rand() < 0.7 else rng.permutation(n)[:lost]
        y = np.unique(np.concatenate([np.delete(x, gone), rng.randint(0, 1 << 62, int(rng.randint(0, most + 1)) if most > 0 else 0).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < percent * (len(x) + len(y) - both) or (len(x) == len(y) == both):
            continue
        met += 1
        a, b = (ngram_join.signatures(s, frequency, percent, above) for s in (x, y))
        assert len(np.intersect1d(a, b)), (percent, len(x), len(y), both)
    assert met > 1000


def test_no_near_duplicates_in_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.one_of_each(empty).count() == 0


def test_one_of_each_keeps_one_row_and_all_empty_ones(spark):
    long = " ".join(f"t{i}" for i in range(40))
    rows = [(1, long), (2, long), (2, long), (3, long + " end"), (4, "different"), (5, None), (6, ""), (4, "different")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    got = sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect() if r.text)
    assert got == [(1, long), (4, "different")]
    assert ngram_join.one_of_each(df).count() == 4


def test_one_of_each_keeps_different_texts_under_null_and_equal_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[0] + " end"), (None, texts[1]), (7, texts[2]), (7, texts[2] + " end"), (7, texts[3])]
    rows += [(None, texts[4]), (9, texts[4] + " end"), (None, "just one")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    got = [(r.doc_id, r.text.split()[0]) for r in ngram_join.one_of_each(df).collect()]
    want = [(None, "a0"), (None, "b0"), (7, "c0"), (7, "d0"), (None, "e0"), (None, "just")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours_against_brute_force(spark):
    rng = np.random.RandomState(2)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    vectors[50:120] = vectors[50]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0.0), (1001, [0.0] * 16, 0.0), (1002, [float("nan")] * 16, 0.0), (1003, [1.0, None] * 8, 0.0), (None, vectors[0].tolist(), 0.0), (1020, [1.0] * 3, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = nearest_neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, query_block=7, candidate_block=60).collect()
    x = vectors.astype(float)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 400, 20))
    for q, rows in found.items():
        exact = x @ x[q]
        order = [i for i in sorted(range(400), key=lambda i: (-round(exact[i], 9), i)) if i != q][:10]
        assert [v for _, v, _ in sorted(rows)] == order
        assert all(abs(s - exact[v]) < 1e-9 for _, v, s in rows)


def test_neighbours_of_repeated_query_rows():
    k, x = 3, np.array([1.0, 2.0])
    ids = np.array([5] * 10 + [6] * 10 + [7, 8, 4, 9])
    c = np.array([x] * 23 + [x / 2])
    for q, want in ((5, [4, 6, 6]), (6, [4, 5, 5]), (4, [5, 5, 5]), (9, [4, 5, 5])):
        _, b, _ = nearest_neighbours.tile(np.array([q]), x[None], ids, c, k)
        assert list(ids[b]) == want
    _, b, _ = nearest_neighbours.tile(np.array([5]), x[None], np.array([5] * 10 + [7, 8]), c[:12], k)
    assert list(np.array([5] * 10 + [7, 8])[b]) == [7, 8]


def test_neighbours_shuffle_no_candidates(spark, monkeypatch):
    """However many blocks of queries there are, candidates are stored once and read by the tasks; copies, slices and small tiles change no answer."""
    monkeypatch.setattr(nearest_neighbours, "FIRST", 8)
    monkeypatch.setattr(nearest_neighbours, "GROUP", 2)
    x = np.random.RandomState(4).randint(-2, 3, size=(500, 6)).astype(float)
    x[100:160], x[0] = x[100], x[100]
    x[~x.any(1)] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    found = nearest_neighbours.search(df, F.col("vec_id") % 3 == 0, k=4, query_block=9, candidate_block=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("Generate") == 1
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: [(i, float(x[i] @ x[q])) for i in sorted(range(500), key=lambda i: (-x[i] @ x[q], i)) if i != q][:4] for q in range(0, 500, 3)}
    assert got == want


def test_tiles_with_a_floor_leave_out_no_best():
    rng = np.random.RandomState(8)
    for scale in (1.0, 1e-160, 1e150, 1e-310):
        q, c = rng.randint(-3, 4, size=(20, 5)) * scale, rng.randint(-3, 4, size=(300, 5)) * scale * rng.choice([1.0, 1e-12, 1e3], size=(300, 1))
        ids, scores = np.arange(300), [[reduce(lambda s, ab: s + ab[0] * ab[1], zip(x.tolist(), y.tolist()), 0.0) for y in c] for x in q]
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        floor = None
        for i in range(0, 300, 50):
            a, b, s = nearest_neighbours.tile(ids[:20], q, ids[i : i + 50], c[i : i + 50], 4, floor)
            found = tuple(map(np.append, found, (a, ids[i : i + 50][b], s)))
            order, place = nearest_neighbours._best(*found, 4)
            found = tuple(x[order] for x in found)
            floor = np.full(20, -np.inf)
            floor[found[0][place == 3]] = found[2][place == 3]
        for j in range(20):
            want = sorted((-scores[j][i], i) for i in range(300) if i != j)[:4]
            assert [(-s, i) for s, i in zip(found[2][found[0] == j], found[1][found[0] == j])] == want


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_neighbours.search(df, F.col("vec_id") % 20 == 0).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in nearest_neighbours.search(df, F.col("vec_id") == 0, k=20).collect())
    assert got == [(1, 1), (2, 2)]


def test_language_accuracy(spark, sf_dir):
    got = llm_queries.op7_language_id(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    held = got[got.held_out].merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_languages_of_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et la souris", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    langs, logp = language_id.train(train)
    assert langs == ["en", "fr"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "the dog and the cat"), (None, "la souris et le chat"), (4, "the dog and the cat")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(df, langs, logp).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr")], key=str)
    none = language_id.train(train.where("false"))
    assert {r.lang_pred for r in language_id.predict(df, *none).collect()} == {"und"}


def test_mixture_of_two_languages(spark):
    train = spark.createDataFrame([("the cat and the dog with that thing " * 20, "en"), ("le chat et la souris avec une chose " * 20, "fr")], "text string, lang string")
    langs, logp = language_id.train(train)
    text = "the dog with that cat and the thing " * 3 + "la souris avec le chat et une chose " * 2
    row = language_id.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), langs, logp).first()
    assert [x.lang for x in row.languages] == ["en", "fr"]
    assert row.lang_pred == "en" and 0.5 < row.score < 0.7


def test_mixture_of_four_languages():
    rng = np.random.default_rng(7)
    words = {c: ["".join(rng.choice(list(letters), 6)) for _ in range(60)] for c, letters in zip("abcd", ("abcdef", "ghijkl", "mnopqr", "stuvwx"))}
    text = " ".join(w for four in zip(*words.values()) for w in four)
    logp = np.full((1 << language_id.BITS, 4), np.log(1e-7))
    for n, c in enumerate("abcd"):
        data, starts, lengths, _, _ = language_id._units(pa.array([" ".join(words[c])]))
        logp[language_id._word_grams(data, starts, lengths, language_id.BITS)[1], n] = np.log(1e-3)
    share, some = language_id.mixtures(pa.array([text, "", " ".join(words["b"])]), logp)
    assert some.tolist() == [True, False, True]
    assert np.allclose(share[0], 0.25, atol=0.02) and share[2].tolist() == [0, 1, 0, 0]


def test_classifier_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = llm_queries.op2_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() >= 0.95


def test_classifier_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (None, "x y", 7), (2, "", 7), (2, "", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, label int")
    w = quality_classifier.train(docs, labels)
    assert [r.score for r in quality_classifier.score(docs, w).collect()] == [0.5] * 4
    both = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, label int")
    assert quality_classifier.train(docs, both).any()


def test_classifier_trains_on_one_document_an_id(spark, monkeypatch):
    seen, ftrl = spark.sparkContext.accumulator(0), quality_classifier.ftrl

    def counted(rows, *args):
        seen.add(len(rows))
        return ftrl(rows, *args)

    monkeypatch.setattr(quality_classifier, "ftrl", counted)
    rows = [(1, f"document number {i} of an id that is repeated") for i in range(300)] + [(i, f"words {i}") for i in range(2, 9)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, label int")
    for most in (1, 5, 100):
        seen.value = 0
        first = quality_classifier.train(docs.repartition(7), labels, max_rows=most)
        assert 0 < seen.value <= min(most, 8)
        assert (first == quality_classifier.train(docs.repartition(2), labels, max_rows=most)).all()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "n-gram Jaccard join":
            assert docs.select("doc_id").distinct().count() == docs.count()
            kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert all(str(d) == c for d, _, c in brute_components(kept, 5, 80))
        if name == "personal data":
            assert docs.where(F.col("text").rlike("[A-Za-z0-9]@[A-Za-z0-9-]+\\.[A-Za-z]")).count() == 0
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and sizes[5] > 0
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert packed.where("n > 1024 or n <> m").count() == 0
