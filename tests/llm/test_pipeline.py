"""The pipeline stage by stage against plain Python, on rows with nulls, repeats, ties and columns of clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
from test_corpus_operators import shingles  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from curata.llm import mixing, pii, quality_classifier  # noqa: E402

CLASHING = ["_key", "_empty", "_first", "_n", "_d", "_k", "_s", "_t", "_times", "_quality", "key", "root", "spans", "repeats", "Score"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
extra = tuple(range(len(CLASHING)))


def rows_of_corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(150):
        if base and rng.random() < 0.4:
            copy = rng.choice(base).split()
            copy[rng.randrange(len(copy))] = "changed"
            text = " ".join(copy) if rng.random() < 0.7 else rng.choice(base)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))
            base.append(text)
        if i % 11 == 0:
            text += f" write to quux{i}@corp.example.com or 192.168.0.{i % 200}"
        rows.append((None if i % 17 == 0 else 7 if i % 13 == 0 else i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text), *extra))
    rows += [(900, None, None, None, None, *extra), (901, "", "en", "a", 0, *extra), (None, " \n ", "en", "b", 3, *extra), (902, "one", "en", "b", 3, *extra)]
    return rows + [rows[3]] * 3 + [rows[17]] * 2


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    made = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows_of_corpus(), DOCS)
    docs.repartition(3).write.parquet(f"{made}/documents.parquet")
    labels = [(r[0], int((r[0] or 0) % 3 > 0), 0) for r in rows_of_corpus() if r[0] is not None and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    return made


def plain(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def brute_groups(texts):
    """Group number of each text: linked at five words and 0.8, alone without words."""
    sets, group = [shingles(t, 5) for t in texts], list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, sf), "test")
        if name == "best-fit packing":
            continue
        assert docs.columns == before.columns and docs.schema.simpleString() == before.schema.simpleString()
        if name == "quality classifier":
            labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
            weights = quality_classifier.train(before, labels)
            scored = quality_classifier.score(before.select("text"), weights, keep=("text",), name="p").collect()
            keep = {r.text: r.p >= corpus_pipeline.THRESHOLD for r in scored}
            assert plain(docs) == sorted(repr(tuple(r)) for r in before.collect() if keep[r.text])
        elif name == "n-gram Jaccard join":
            rows, kept = [tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()]
            groups = brute_groups([r[1] for r in rows])
            words = [bool(shingles(r[1], 5)) for r in rows]
            # Every row without words stays; of each group one row, that with the smallest id (null first).
            assert Counter(map(repr, kept)) <= Counter(map(repr, rows))
            assert sum(not shingles(r[1], 5) for r in kept) == words.count(False)
            by_text = {r[1]: g for r, g in zip(rows, groups)}
            stay = Counter(by_text[r[1]] for r in kept if shingles(r[1], 5))
            assert stay == Counter({g for g, w in zip(groups, words) if w})
            ids = lambda d: (d is not None, d or 0)
            least = {}
            for r, g in zip(rows, groups):
                least[g] = min(least.get(g, ids(r[0])), ids(r[0]))
            assert all(ids(r[0]) == least[by_text[r[1]]] for r in kept if shingles(r[1], 5))
        elif name == "personal data":
            found = {(r.doc_id, r.key): r for r in pii.find(before).collect()}
            keys = before.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
            want = Counter()
            for r in keys:
                text, at, parts = r.text, 0, []
                f = found[r.doc_id, r.h]
                cuts = [(s.start, s.end, f"<{pii.KINDS[s.kind]}>") for s in f.spans]
                cuts += [(t.start, t.end, "" if t.remove else pii.CLASS_WORD) for t in f.terms]
                for a, b, word in sorted(cuts):
                    if b > at:
                        parts += [text[at : max(a, at)], word]
                        at = b
                want[r.doc_id, text if text is None else "".join(parts) + text[at:]] += 1
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == want
            assert not any("@corp" in (r.text or "") or "192.168" in (r.text or "") for r in docs.collect())
        elif name == "mixing":
            want = Counter()
            texts = {(r.doc_id, r.source, r.h): r.text for r in before.select("doc_id", "source", "text", F.xxhash64("text").alias("h")).collect()}
            for r in mixing.mix(before).collect():
                want[r.doc_id, r.source, texts[r.doc_id, r.source, r.text_key]] += r.repeats
            assert Counter((r.doc_id, r.source, r.text) for r in docs.collect()) == +want
    lengths = Counter()
    for r in before.collect():
        lengths[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in docs.collect():
        got[r.doc_id] += r.length
    assert got == lengths and docs.agg(F.max("length")).first()[0] <= 1024


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages_in_order(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "personal data", "mixing", "best-fit packing"]
