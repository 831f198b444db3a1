"""Literal cases of the scalar operators, nulls among them."""

import pytest
from pyspark.sql import functions as F

from curata.functions import lexicon as L
from curata.functions import names as M
from curata.functions import normalize as N
from curata.operators import resolve as R
from curata.plans import promote as P
from curata.plans import quality as Q
from curata.sources import files as S


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [
        (N.abv, "46.3%", ("46.3", "NORMALIZED")),
        (N.abv, "60% ABV", ("60", "NORMALIZED")),
        (N.abv, "46", ("46.0", "NORMALIZED")),
        (N.abv, "-5%", (None, "CONFLICT")),
        (N.abv, "120%", (None, "CONFLICT")),
        (N.abv, "N/A", (None, "CONFLICT")),
        (N.abv, "", (None, "SKIPPED")),
        (N.abv, None, (None, "SKIPPED")),
        (N.name, ' The "Old_One"  & Co ', ("the old one and co", "NORMALIZED")),
        (N.rating, "88/100", ("88", "NORMALIZED")),
        (N.rating, "7.5/10", ("75", "NORMALIZED")),
        (N.rating, "8/100", ("80", "NORMALIZED")),
        (N.rating, "88.5", ("88", "NORMALIZED")),
        (N.rating, "250", (None, "CONFLICT")),
        (N.age, "NAS", ("0", "NORMALIZED")),
        (N.age, "18yo", ("18", "NORMALIZED")),
        (N.age, "12 Year Old", ("12", "NORMALIZED")),
        (N.age, "old", (None, "CONFLICT")),
        (N.region, "orkney", ("Islands", "NORMALIZED")),
        (N.region, "Highland (region)", ("Highland", "NORMALIZED")),
        (N.region, "Mars", (None, "CONFLICT")),
        (N.country, " scotland", ("Scotland", "NORMALIZED")),
        (N.axis_value, "50", ("0.50", "NORMALIZED")),
        (N.axis_value, "abc", (None, "CONFLICT")),
    ],
)
def test_status_cases(spark, build, value, want):
    o = one(spark, value, build)
    assert (o["value"], o["status"]) == want


@pytest.mark.parametrize(("value", "want"), [("50", 0.5), ("-3", 0.0), ("150", 1.0), ("abc", None), ("0.3", 0.3), (None, None)])
def test_storage_scale(spark, value, want):
    assert one(spark, value, N.storage_scale) == want


@pytest.mark.parametrize(("value", "want"), [("0.125", 12), ("0.375", 38), ("1", 100), ("87.5", 88), ("x", None)])
def test_profile_scale_rounds_half_to_even(spark, value, want):
    assert one(spark, value, N.profile_scale) == want


def test_strict_rating(spark):
    assert one(spark, "8/100", lambda c: N.rating(c, strict=True))["value"] == "8"


@pytest.mark.parametrize(
    ("value", "want"),
    [('{"a": 1, "b": "2"}', {"a": 1.0, "b": 2.0}), ("a=1, b = 2,a=3", {"a": 3.0, "b": 2.0}), ("{broken", {}), ("", {}), ("nonsense", {}), ("a=x", {"a": None})],
)
def test_profiles(spark, value, want):
    assert one(spark, value, L.parsed_profile) == want


def test_name_key_takes_suffixes_before_spaces(spark):
    assert one(spark, "The Glen Distillery", lambda c: M.name_key(c, "alnum", ("distillery",))) == "glen"


def test_ladder_thresholds(spark):
    src = spark.createDataFrame([(1, "ardbeg 10", 10), (2, "ardbeg 12", 12), (3, "zzz", None)], "src_id long, src_text string, src_age int")
    reg = spark.createDataFrame([(7, "ardbeg 10", 10), (8, "ardbeg uigeadail", None)], "id long, text string, age int")
    got = {r["src_id"]: (r["entity_id"], r["status"]) for r in R.fuzzy_resolved(src, reg, "sequence").collect()}
    assert got[1] == (7, "exact")
    assert got[2][1] in ("unmatched", "manual_review")
    assert got[3] == (None, "unmatched")


def test_undo_restores_blanks(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, "x", ""), (3, None, None)], "k long, a string, b string")
    clean, log = P.blanks_to_null(df, "k", ["a", "b"])
    assert log.count() == 2
    assert {(r.k, r.a, r.b) for r in P.undone(clean, log, "k", ["a", "b"]).collect()} == {(r.k, r.a, r.b) for r in df.collect()}


def test_snapshots_roll_back(spark, tmp_path):
    root = str(tmp_path / "snap")
    first = P.write_snapshot(spark, spark.range(3), root)
    P.write_snapshot(spark, spark.range(5), root)
    assert P.read_snapshot(spark, root).count() == 5
    P.roll_back(spark, root, first)
    assert P.read_snapshot(spark, root).count() == 3


def test_synthetic_catalogue_ignores_partitions(spark):
    a = Q.table_fingerprint(S.synthetic_catalogue(spark, 200)["entities"]).first()
    b = Q.table_fingerprint(S.synthetic_catalogue(spark, 200)["entities"].repartition(7)).first()
    assert a == b


def test_page_records(spark):
    page = "<title>T &amp; x</title><meta name=description content=' d '><h1>A<b> b</b></h1><p>short<p>a paragraph that is long enough to count"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    got = [(r.field, r.value) for r in S.page_records(df).collect()]
    assert got == [
        ("html:title", "T & x"),
        ("html:meta_description", "d"),
        ("html:h1[0]", "Ab"),
        ("html:p[1]", "a paragraph that is long enough to count"),
    ]


def test_registry_takes_new_normalisers(spark):
    reg = [*N.REGISTRY, ("colour", N.tidy, "colour")]
    row = spark.createDataFrame([("colour", " deep  gold ")], "f string, v string")
    assert row.select(N.dispatch(F.col("f"), F.col("v"), reg).alias("o")).first()["o"]["value"] == "deep gold"


def test_a_crash_between_snapshot_and_pointer_keeps_the_state(spark, tmp_path):
    root = str(tmp_path / "crash")
    P.write_snapshot(spark, spark.range(3), root)
    spark.range(5).write.parquet(f"{root}/snapshot-lost")  # written, never pointed to
    half = tmp_path / "crash" / "pointers" / "000000000001-half"
    half.mkdir()
    (half / "part-0.json").write_text('{"name": "snapshot-lost"}')  # a pointer without its success mark
    assert P.read_snapshot(spark, root).count() == 3
    P.write_snapshot(spark, spark.range(7), root)
    assert P.read_snapshot(spark, root).count() == 7


def test_merges_are_settled_and_conserve_rows(spark):
    merges = spark.createDataFrame([(2, 1), (3, 2), (9, 1), (4, 5), (5, 6), (6, 4), (8, 7)], "survivor long, variant long")
    one = P.settled(merges)
    assert {(r.variant, r.survivor) for r in one.collect()} == {(1, 3), (2, 3), (7, 8)}
    table = spark.createDataFrame([(k % 10, k) for k in range(40)], "id long, n long")
    got = P.remapped(table, one, "id").collect()
    to = {1: 3, 2: 3, 7: 8}
    assert sorted((r.n, r.id) for r in got) == [(k, to.get(k % 10, k % 10)) for k in range(40)]


def test_no_one_survives_a_cycle(spark):
    from curata.plans import quality as Q

    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7), (7, 6), (10, 11), (11, 12), (20, 21), (21, 22), (22, 23), (23, 20)]
    got = {r.source: r.survivor for r in Q.survivors(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == {s: 12 if s in (10, 11) else None for s, _ in edges}
    chain = [(k, k + 1) for k in range(70)]
    assert {r.survivor for r in Q.survivors(spark.createDataFrame(chain, "source long, target long")).collect()} == {70}


def test_upserts_break_ties_by_the_other_columns(spark):
    current = spark.createDataFrame([(1, "a", -1)], "k long, v string, seq long")
    changes = spark.createDataFrame([(1, v, 5) for v in "xzy"], "k long, v string, seq long")
    assert {P.upserted(current, changes.repartition(n), "k", "seq").first().v for n in (1, 2, 3)} == {"z"}


def test_large_lexicons_change_nothing(spark):
    from curata.functions import lexicon
    from curata.operators.mentions import mentions

    text = "Thanks, it is more than a word of   the list. Than!"
    pages = spark.createDataFrame([(1, text), (1, "than of the"), (1, text), (2, "nothing here"), (None, "other than")], "id long, text string")
    terms = ["than", "of the", "word"]
    small = spark.createDataFrame([(t,) for t in terms], "term string")
    large = small.union(spark.range(1500).selectExpr("concat('unrelated', id) AS term"))
    ways = [mentions(pages, lex, "id", "text", 2, 5, most) for lex in (small, large) for most in (100_000, 0)]
    rows = [sorted(map(str, w.collect())) for w in ways]
    assert all(r == rows[0] for r in rows) and len(rows[0]) == 9
    docs = spark.createDataFrame([(1, "another bar"), (1, "foo text"), (1, "foo text"), (None, "bar")], "id long, text string")
    lex = [df.selectExpr("term", "'axis' AS axis") for df in (small, large)]
    left = [sorted((str(r.id), r.terms) for r in lexicon.unmapped(docs, "id", "text", x).collect()) for x in lex]
    assert left[0] == left[1] and len(left[0]) == 4


def test_deltas_continue_over_batches_and_restarts(spark, tmp_path):
    from curata.streaming import incremental as L

    schema = "n long, entity long, field string, url string, value string, confidence double"
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    known = spark.createDataFrame([(0, 1, "age", "u", "12", 0.5)], schema)
    batches = [
        [(1, 1, "age", "u", "12", 0.5), (2, 2, "age", "u", "7", 0.1)],
        [(3, 2, "age", "u", "7", 0.1), (4, 1, "age", "u", "13", 0.5)],
        [(5, 1, "age", "u", "13", 0.5), (6, 1, "age", "u", "12", 0.5), (7, 1, "age", "u", "12", 0.5), (8, 2, "age", "v", "7", 0.1)],
    ]
    for rows in batches:  # a run each: the query is started again on the same checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        L.deltas(L.file_stream(spark, path, known.schema, 1), known, ["entity", "field", "url"], ["n"], out, cp)
    assert sorted(r.n for r in spark.read.schema(schema).parquet(f"{out}/batch=*").collect()) == [2, 4, 6, 8]


@pytest.mark.parametrize("slices", [2, 5, 64])
def test_exact_medians(spark, slices):
    import random
    import statistics

    from curata.operators import aggregate as A

    rng = random.Random(slices)
    groups = {"one": [5.0], "two": [1.0, 4.0], "same": [3.0] * 500, "odd": [rng.gauss(0, 1e6) for _ in range(1001)], "even": [rng.choice([1.0, 2.0, 9.5]) for _ in range(700)], None: [2.0, None, 7.0], "none": [None, None]}
    groups["skewed"] = [10.0 ** rng.randint(0, 12) + rng.random() for _ in range(900)]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: (r.median, r.lowest, r.highest, r.n) for r in A.spread(df, "g", "v", 6, slices).collect()}
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        want = (round(statistics.median(known), 6), min(known), max(known), len(known)) if known else (None, None, None, 0)
        assert got[g] == (pytest.approx(want[0], abs=1e-5) if known else None, *want[1:])


def test_longest_prefix_without_blocks(spark):
    labels = spark.createDataFrame([("Glen", 1), ("glen mor", 2), ("Glen Mor", 3), ("G", 4), ("", 5), (None, 6), ("Glenmore", 7)], "label string, k long")
    rows = spark.createDataFrame([(1, "GLEN MOR 12"), (2, "Glenmo"), (3, "x"), (4, None), (5, "")], "id long, t string")
    got = {r.id: (r.k, r.label) for r in R.longest_prefix(rows, "t", labels, "label", "k", "id").collect()}
    assert got == {1: (2, "glen mor"), 2: (1, "Glen"), 3: (5, ""), 5: (5, "")}


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    import glob

    from curata.streaming import incremental as L

    schema = "k long, v string, seq long"
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    start = spark.createDataFrame([(k, "old", 0) for k in range(200)], schema)
    want = {k: "old" for k in range(200)}
    for n, keys in enumerate([[1], [1, 2, 300], [2]], 1):
        spark.createDataFrame([(k, f"v{n}", n) for k in keys], schema).coalesce(1).write.mode("append").parquet(path)
        got = L.streamed_upserts(L.file_stream(spark, path, start.schema, 1), start, "k", "seq", out, cp, buckets=16)
        want |= {k: f"v{n}" for k in keys}
        assert {r.k: r.v for r in got.collect()} == want and got.count() == len(want)
        assert 1 <= len(glob.glob(f"{out}/batch={n - 1}/_bucket=*")) <= len(keys)
    # The last batch once more, as after a crash before its commit: the same state.
    batch = spark.createDataFrame([(2, "v3", 3)], schema)
    before = L._bucket_rows(spark, out, start.schema, L._manifest(spark, out, 1))
    assert {r.k: r.v for r in P.upserted(before, batch, "k", "seq").collect()} == want


def test_mentions_equal_a_scan_of_every_term(spark):
    import random
    import re

    from curata.operators.mentions import mentions

    rng = random.Random(11)
    words = ["a", "of", "the", "barrel", "proof", "12", "Proof", "\U0001f943", "é", "of-the", "K", "", "barrelproof"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "the", "\U0001f943\U0001f943 the barrel, proof!", "of\n the\nbarrel", "x " * 5000 + "proof"]
    rows = [(i % 40 if i % 9 else None, t, "extra") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "id int, text string, term string")
    terms = ["a", "of", "of the", "the", "of the barrel", "the barrel", "barrel proof", "proof 12", "12", "Proof", "", "a  of", "k", "a of the barrel", "e", None, "of the", "the "]
    lex = spark.createDataFrame([(t,) for t in terms], "term string")
    want = []
    for key, text, _ in rows:
        for term in {t for t in terms if t and re.fullmatch("[a-z0-9]+( [a-z0-9]+){0,2}", t)}:
            hit = re.search("(?<![a-z0-9])" + term.replace(" ", "[^a-z0-9]+") + "(?![a-z0-9])", (text or "").lower())
            if hit:
                start = max(hit.start() - 4, 0)
                want.append((key, term, text[start : start + len(term) + 8]))
    want = sorted(map(str, want))
    for most in (100_000, 0):
        got = mentions(pages.select("id", "text"), lex, "id", "text", 3, 4, most)
        assert got.schema.names == ["id", "term", "context"] and sorted(str(tuple(r)) for r in got.collect()) == want
    assert len(want) > 100
    for most in (100_000, 0):
        assert mentions(pages, lex.limit(0), "id", "text", most_terms=most).count() == 0
        assert mentions(pages.limit(0), lex, "id", "text", most_terms=most).count() == 0
