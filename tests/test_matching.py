"""Matching whose ratios DuckDB does not have, page records, fingerprints and gates, against plain Python."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from curata.catalog import guarded, intake, promotion, resolution, vectors
from curata.functions import names as M
from curata.operators import evidence, matching, rank, resolve
from curata.plans import adapter, promote, quality
from curata.sources import files
from curata.streaming import incremental


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def indel(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a, b):
    x, y = set(a.split(" ")), set(b.split(" "))
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    left, right = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([indel(left, right)] + ([indel(both, left), indel(both, right)] if both else []))


def window(a, b):
    """Every window of the longer text, as long as the shorter or, at the ends, less; of equally long texts both ways."""
    if not a or not b:
        return float(a == b)
    found = []
    for short, long in ((a, b), (b, a)):
        if len(short) <= len(long):
            n = len(short)
            cuts = {long[max(e - n, 0) : e] for e in range(1, len(long) + n)}
            found += [indel(short, w) for w in cuts if w]
    return max(found)


def weighted(a, b):
    if not a or not b:
        return 0.0
    x, y = a.split(" "), b.split(" ")
    s, t = " ".join(sorted(x)), " ".join(sorted(y))
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(indel(a, b), 0.95 * token_set(a, b), 0.95 * indel(s, t))
    own, other = (" ".join(sorted(d)) for d in (set(x) - set(y), set(y) - set(x)))
    tokens = 1.0 if " ".join(sorted(set(x) & set(y))) else max(window(s, t), window(own, other))
    scale = 0.9 if longer <= 8 else 0.6
    return max(indel(a, b), scale * window(a, b), 0.95 * scale * tokens)


def block(text):
    tokens = [t for t in text.split(" ") if t]
    return next((t for t in tokens if t not in M.STOP), tokens[0] if tokens else "")


def test_common_letters():
    for a, b in (("", ""), ("abc", ""), ("kitten", "sitting"), ("glenfidich 12", "glenfiddich 12 year"), ("aaaa", "aa")):
        assert resolve.common_letters(a, b) == lcs(a, b)


def test_sequence_ratio_resolution(spark, sf_dir):
    src = resolution.sources(spark, sf_dir).collect()
    reg = resolution.registry(spark, sf_dir).collect()
    got = {r.src_id: (r.entity_id, r.status, r.confidence) for r in resolution.d9_sequence(spark, sf_dir).collect()}
    numbers = lambda t: set(re.findall(r"\d+", t))
    for s in src:
        own = [r for r in reg if block(r.text) == block(s.src_text)] or reg
        scored = sorted(((-SequenceMatcher(None, s.src_text, r.text).ratio(), r.id, r) for r in own), key=lambda x: x[:2])
        scored = [(-m, i, r) for m, i, r in scored if -m >= 0.78]
        want = (None, "unmatched", 0.0)
        if scored:
            score, ident, r = scored[0]
            margin = score - (scored[1][0] if len(scored) > 1 else 0.0)
            status = "exact" if score >= 0.94 and margin >= 0.03 else "fuzzy" if score >= 0.88 and margin >= 0.04 else "manual_review" if score >= 0.82 else "unmatched"
            if status in ("exact", "fuzzy"):
                if numbers(s.src_text) and numbers(r.text) and not numbers(s.src_text) & numbers(r.text):
                    status = "unmatched"
                elif s.src_age != r.age:
                    status = "manual_review"
                elif status == "exact" and block(s.src_text) not in r.text:
                    status = "fuzzy"
            if status != "unmatched":
                want = (ident, status, round(score, 3))
        assert got[s.src_id][:2] == want[:2] and got[s.src_id][2] == pytest.approx(want[2], abs=1e-3), s


def test_best_window_by_trying_all():
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abc é") for _ in range(rng.choice([0, 1, 2, 5, 9, 20, 70])))
    pairs = [(text(), text()) for _ in range(400)] + [("year", "glen 12 year old"), ("ab", "xxxxb"), ("ab", "bxxxx")]
    for a, b in pairs:
        assert resolve.best_window(a, b) == pytest.approx(window(a, b)), (a, b)
        assert resolve.best_window(a, b) == pytest.approx(resolve.best_window(b, a))


def test_weighted_ratio_by_literal_windows():
    rng = random.Random(12)
    words = ["glen", "glem", "moor", "12", "year", "old", "x", "distillery", "port", "cask", ""]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 8, 16])))
    kinds = set()
    for a, b in [(text(), text()) for _ in range(400)]:
        assert matching.name_scores(a, b) == pytest.approx((token_set(a, b), weighted(a, b))), (a, b)
        longer = max(len(a), len(b)) / max(min(len(a), len(b)), 1)
        kinds.add((longer >= 1.5) + (longer > 8))
    assert kinds == {0, 1, 2}


def test_token_set_matches(spark, sf_dir):
    pairs = guarded.pairs(spark, sf_dir).select("src_id", M.spelled(F.col("src_name")).alias("a"), "id", M.spelled(F.col("name")).alias("b")).collect()
    want, known, lengths = {}, {}, set()
    for r in pairs:
        if (r.a, r.b) not in known:
            known[r.a, r.b] = token_set(r.a, r.b), weighted(r.a, r.b)
        ratios = known[r.a, r.b]
        lengths.add(max(len(r.a), len(r.b)) >= 1.5 * min(len(r.a), len(r.b)))
        if max(ratios) > 0.5:
            want.setdefault(r.src_id, []).append((-round(max(ratios), 6), r.id, ratios))
    assert lengths == {True, False}
    got = {}
    for r in guarded.d12(spark, sf_dir).collect():
        got.setdefault(r.src_id, []).append((r["rank"], r.id, r.score, r.token_set, r.weighted, r.status, r.conflicts))
    assert set(got) == set(want)
    for k, rows in got.items():
        best = sorted(want[k])[:5]
        assert [r[1] for r in sorted(rows)] == [i for _, i, _ in best]
        assert [x for r in sorted(rows) for x in r[2:5]] == pytest.approx([x for s, _, ratios in best for x in (-s, *ratios)], abs=1e-6)
        for _, _, _, ts, w, status, conflicts in rows:
            sure, near = ts >= 0.9 or w >= 0.88, ts >= 0.78 or w >= 0.8
            assert status == ("REJECTED_HARD_CONSTRAINT" if conflicts else "HIGH_CONFIDENCE" if sure else "MANUAL_REVIEW" if near else "REJECTED_LOW_SCORE")


def test_lookup_and_tiers_without_a_block(spark):
    """Texts whose first letters differ are found; the best tier and then the smallest id win, whatever repeats."""
    terms = spark.createDataFrame([("lagavulin bay",), ("ardbeg ten years",), ("",)], "term string")
    words = spark.createDataFrame([("magavulin bay",), ("ardbeg ten years",), ("nothing like it",), ("",), (None,)], "word string")
    got = {r.word: (r.term, round(r.score, 6)) for r in matching.lexicon_lookup(words, terms).collect()}
    assert got == {"magavulin bay": ("lagavulin bay", round(1 - 1 / 13, 6)), "ardbeg ten years": ("ardbeg ten years", 1.0), "": ("", 1.0)}
    assert matching.lexicon_lookup(words, terms.limit(0)).isEmpty() and matching.lexicon_lookup(words.limit(0), terms).isEmpty()

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b), 1)

    rng = random.Random(4)
    own = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for _ in range(40)]
    near = ["".join(c if rng.random() < 0.85 else rng.choice(["", "b", "z"]) for c in t) for t in own] + own[:3] + ["qqqq", "!!", None]
    producers = [*enumerate(own), (90, own[0]), (91, None)]
    made = matching.producer_tiers(spark.createDataFrame([*enumerate(near)], "src_id long, src_name string"), spark.createDataFrame(producers, "id long, name string"), ("house",))
    want = {}
    for i, t in enumerate(near):
        tiers = []
        for k, o in producers:
            if t and t != "!!" and o:
                r = lev(t, o)
                tiers += [(-next((c for least, c in ((1.0, 100), (0.92, 90), (0.85, 80), (0.75, 72), (0.6, 65)) if r >= least), 0), k)]
        if tiers and min(tiers)[0]:
            want[i] = (min(tiers)[1], -min(tiers)[0])
    assert {r.src_id: (r.id, r.confidence) for r in made.collect()} == want and {c for _, c in want.values()} == {100, 90, 80, 72, 65}


def test_title_case(spark):
    cases = {
        "  glen moor-side (o'neil) & d’or/bay ": "Glen Moor-Side (O'Neil) & D'Or/Bay", "maker's mark": "Maker's Mark", "michter’s": "Michter’s",
        "benriach a'bunadh mcconnell's": "BenRiach A'Bunadh McConnell's", "benriach's 18yo": "BenRiach's 18yo", "": "", " ": "", "'s": "'s", "o''b": "O''B",
        "Glen moor": "Glen moor", "élan 12é": "Élan 12é", None: None, "glen's's": "Glen's's",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.t for r in df.select("n", matching.title_case(F.col("n")).alias("t")).collect()} == cases
    assert df.where("n = 'Glen moor'").select(matching.title_case(F.col("n"), False)).first()[0] == "Glen Moor"


def test_weighted_match(spark, sf_dir):
    rows = guarded.pairs(spark, sf_dir)
    parts = rows.select(
        "src_id", "id", "src_age", "age",
        resolve.edit_similarity(M.stripped_name(F.col("src_name")), M.stripped_name(F.col("name"))).alias("n"),
        resolve.edit_similarity(M.cask_of(F.col("src_name")), M.cask_of(F.col("name"))).alias("c"),
    ).collect()
    best = {}
    for r in parts:
        age = 1.0 if r.src_age == r.age else 0.0
        score = 0.30 + 0.25 * r.n + 0.15 * age + 0.10 * 0.5 + 0.08 * r.c + 0.05 + 0.03 + 0.02 + 0.0
        score = min(score, 0.79) if not age else score
        best[r.src_id] = max(best.get(r.src_id, (-1, 0)), (round(score, 9), -r.id))
    got = {r.src_id: (r.id, r.score) for r in guarded.d11(spark, sf_dir).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in best.items()}, abs=1e-4)
    assert sum(got[k][0] == -v[1] for k, v in best.items()) >= 0.99 * len(best)


def test_feature_routes(spark, sf_dir):
    key = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", (t or "").lower())).strip()
    sources, products = guarded.feature_sources(spark, sf_dir).collect(), guarded.feature_products(spark, sf_dir).collect()
    got = {r.src_id: r for r in guarded.d24_features(spark, sf_dir).collect()}

    def marks(t):
        t, out = t.lower(), {}
        if m := re.search(r"\b(\d{1,2})\s*(?:yo|y\.o\.|years?)\b", t):
            out["age"] = m[1]
        if years := re.findall(r"\b(19\d{2}|20\d{2})\b", t):
            out["vintage"] = years[0]
        if m := re.search(r"\bcask\s*#?\s*([a-z0-9-]+)", t):
            out["cask"] = m[1]
        if "signatory" in t:
            out["bottler"] = "signatory"
        return out

    for s in sources:
        name, maker = key(s.src_name), key(s.src_producer)
        house = [p for p in products if maker and (maker in key(p.producer) or key(p.producer) in maker)]
        house = house or [p for p in products if set(name.split()) & set(key(p.name).split())]
        r = got[s.src_id]
        if not house:
            assert r.id is None
            continue
        score, _, p = max((round(token_set(name, key(p.name)), 9), -p.id, p) for p in house)
        assert r.score == pytest.approx(score, abs=1e-6)
        p = next(x for x in house if x.id == r.id)
        a, b = marks(s.src_name), marks(p.name)
        flags = [f"{f}_mismatch" for f in ("age", "vintage", "cask", "bottler") if f in a and f in b and a[f] != b[f]]
        own = key(p.producer)
        same = bool(maker) and (maker in own or own in maker or token_set(maker, own) >= 0.92)
        flags += ["producer_mismatch"] * (bool(maker) and not same)
        assert r.flags == ",".join(flags)
        want = (
            "reject_conflict" if flags else "reject_low_confidence" if s.identity == "undisclosed_but_indexed"
            else "keep_product" if r.score >= 0.94 and s.identity == "name_matched" and same
            else "review_product" if 0.86 <= r.score <= 0.93 or s.identity == "explicit_distillery"
            else "keep_producer" if same else "reject_low_confidence"
        )
        assert r.route == want


def test_similar_pairs_are_all_pairs(spark, sf_dir):
    """Every pair at or above the bound, on names and on random texts, against all pairs."""
    src, reg = resolution.sources(spark, sf_dir).collect(), resolution.registry(spark, sf_dir).collect()

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b), 1)

    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 2, 3, 7, 12, 20, 70]))) for _ in range(60)]
    near = ["".join(c if rng.random() < 0.85 else rng.choice(["", "b", "xy"]) for c in t) for t in texts]
    tables = [({r.src_text for r in src}, {r.text for r in reg}, 0.78), (set(near), set(texts), 0.78), (set(near), set(texts), 0.9), (set(near), set(texts), 0.6)]
    for left, right, least in tables:
        sources = spark.createDataFrame([(i, t) for i, t in enumerate(left)], "src_id long, src_text string")
        found = resolve.similar_pairs(sources, spark.createDataFrame([(i, t) for i, t in enumerate(right)], "id long, text string"), least).collect()
        want = {(a, b): round(lev(a, b), 9) for a in left for b in right if a and b and min(len(a), len(b)) >= least * max(len(a), len(b)) and lev(a, b) >= least}
        assert {(r.src_text, r.text): round(r.score, 9) for r in found} == want and len(found) == len(want) > 0


def test_cheapest_cuts_by_trying_all():
    rng = random.Random(5)
    for _ in range(100):
        length, widest = rng.randint(1, 9), rng.randint(2, 5)
        parts = rng.randint(-(-length // widest), length)
        at = [(i, n) for i in range(length) for n in range(1, min(widest, length - i) + 1)]
        costs = [rng.randrange(20) for _ in at]
        price = dict(zip(at, costs))
        total = lambda cuts: sum(price[i, j - i] for i, j in zip(cuts, [*cuts[1:], length]))  # noqa: B023, E731
        every = [(0, *c) for c in itertools.combinations(range(1, length), parts - 1)]
        fits = [c for c in every if all(j - i <= widest for i, j in zip(c, [*c[1:], length]))]
        assert total(resolve.cheapest_cuts(costs, length, parts, widest)) == min(map(total, fits))


def test_edit_distances_of_a_batch():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abé 𝄞") for _ in range(rng.choice([0, 1, 5, 20, 62, 63, 64, 80])))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = [(text(), text()) for _ in range(300)]
    assert resolve.edit_distances(*map(list, zip(*pairs))).tolist() == [plain(a, b) for a, b in pairs]


def test_fingerprint(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = quality.table_fingerprint(line).collect()
    assert one == quality.table_fingerprint(line.repartition(7).select(*reversed(line.columns))).collect() == promotion.k14(spark, sf_dir).collect()
    key = line.agg(F.min("l_orderkey")).first()[0]
    other = line.withColumn("l_tax", F.when(F.col("l_orderkey") == key, 9.0).otherwise(F.col("l_tax")))
    assert one != quality.table_fingerprint(other).collect() and one != quality.table_fingerprint(line.union(line.limit(1))).collect()


def test_page_records(spark, sf_dir):
    got = {}
    for r in intake.a3(spark, sf_dir).collect():
        got.setdefault(r.page_id, {})[r.field] = r.value
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        title = re.search(r"<title[^>]*>(.*?)</title>", page.html, re.S | re.I)
        if title and "&" not in title[1] and "<" not in title[1] and title[1].strip():
            assert got[page.page_id]["html:title"] == title[1].strip()
        n = len(re.findall(r"<h1[\s>]", page.html, re.I))
        assert sum(f.startswith("html:h1") for f in got.get(page.page_id, {})) <= max(n, 0)


def test_gate_of_what_is_not_known(spark):
    null = lambda kind: F.lit(None).cast(kind)
    made = lambda risk, tier, identity: evidence.gate(F.lit(1), F.lit("book"), F.lit(90), risk, tier, identity, null("boolean"), null("boolean"), null("double"))
    row = spark.range(1).select(
        made(null("double"), F.lit(1), F.lit(0.9)).alias("risk"), made(F.lit(0.1), null("int"), null("double")).alias("tier"), made(F.lit(0.1), F.lit(1), null("double")).alias("ok")
    ).first()
    assert tuple(row.risk) == ("reject", "G2") and tuple(row.tier) == ("reject", "G3") and tuple(row.ok) == ("high_priority", "G5")


def test_flattened_depth(spark):
    df = spark.createDataFrame([(1, {"c": [[1, None], [2]], "b": [{"x": [{"y": "z"}]}], "n": None})], "k int, a struct<b:array<struct<x:array<struct<y:string>>>>, c:array<array<int>>, n:string>")
    assert sorted(tuple(r) for r in files.flattened(df, "k").collect()) == [(1, "a.b[0].x[0].y", "z"), (1, "a.c[0][0]", "1"), (1, "a.c[1][0]", "2")]


def test_flattened_json(spark):
    """Any nesting and rows of any schema; nulls, blanks, invalid and empty texts give nothing; the same paths as with a known schema."""
    deep = "[" * 9 + "7" + "]" * 9
    texts = ['{"a":{"b":[1,{"c":"x"}]},"d":null,"e":" ","f":[],"g":{}}', '[[true,2.5],{"a":{"a":"é"}}]', "3", '"s"', "null", "", "{", None, deep, '{"key":1,"pos":2,"value":{"_v":3}}']
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(texts)] + [(None, "[1]", 0, "z")], "value long, key string, pos int, _v string")
    got = sorted(((r.value_, r.path, r.text) for r in files.flattened_json(df, "value", "key").toDF("value_", "path", "text").collect()), key=str)
    want = [
        (0, "a.b[0]", "1"), (0, "a.b[1].c", "x"), (1, "[0][0]", "true"), (1, "[0][1]", "2.5"), (1, "[1].a.a", "é"), (2, "", "3"), (3, "", "s"),
        (8, "[0]" * 9, "7"), (9, "key", "1"), (9, "pos", "2"), (9, "value._v", "3"), (None, "[0]", "1"),
    ]
    assert got == sorted(want, key=str)
    assert files.flattened_json(df.limit(0), "value", "key").isEmpty()
    with pytest.raises(ValueError):
        files.flattened_json(df, "value", "key", 7)
    kind = "struct<a:struct<b:array<struct<c:string,n:int>>>,t:array<string>>"
    known = spark.createDataFrame([(1, {"a": {"b": [{"c": "x", "n": 1}, {"c": None, "n": 2}]}, "t": ["p", " "]}), (2, None)], f"k int, j {kind}")
    flat = files.flattened(known.select("k", "j.*"), "k").collect()
    assert sorted(map(tuple, flat)) == sorted(map(tuple, files.flattened_json(known.select("k", F.to_json("j").alias("j")), "k", "j").collect())) and len(flat) == 4


def test_ledger_whatever_the_order_of_arrival(spark, tmp_path):
    rows = [(i, i % 5, f"v{i}") for i in range(40)]
    src = str(tmp_path / "in")
    for part in (rows[25:], rows[:5], rows[5:25]):
        spark.createDataFrame(part, "event_id int, key int, value string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    for again in range(2):
        stream = incremental.file_stream(spark, src, schema, 1)
        incremental.ledger(stream, "key", ["event_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
        got = incremental.ledger_rows(spark, str(tmp_path / "out"), schema, "key", ["event_id"]).collect()
        assert sorted((r.event_id, r.key, r.value) for r in got) == rows[:5], again


def test_adapter(spark):
    made = adapter.Adapter("x", order=("n",), bounded=("n",))
    staged = spark.createDataFrame([(1, "s", "ok", 0.5), (1, "s", "ok", 0.7), (9, "s", "ok", 2.0), (2, "t", "Empty", 0.1)], "entity_id int, source string, status string, n double")
    ids = spark.createDataFrame([(1,), (2,)], "entity_id int")
    held = staged.limit(0)
    plan = made.plan(staged, ids, held)
    assert sorted((r.entity_id, r.n, r.action, r.reason) for r in plan.collect()) == [
        (1, 0.5, "INSERT", None), (1, 0.7, "SKIP", "repeated"), (2, 0.1, "CONFLICT", "status_empty"), (9, 2.0, "SKIP", "unresolved"),
    ]
    assert made.apply_plan(plan, held).count() == 1
    bad = made.plan(staged, ids.union(spark.createDataFrame([(9,)], "entity_id int")), held)
    with pytest.raises(ValueError):
        made.apply_plan(bad, held)
    assert made.plan(staged, ids, held, only=ids.where("entity_id = 2")).count() == 1
    with pytest.raises(KeyError):
        adapter.adapter("none")


def test_similar_items_with_ties(spark):
    rows = [(i, [1.0, float(i % 4)]) for i in range(30)] + [(99, [0.0, 0.0]), (98, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = rank.similar(df, df, "k", "v", 3, query_block=4, item_block=5).collect()
    used = [(k, v) for k, v in rows if k < 90 and v[0] != v[1]]
    for k, v in used:
        best = sorted(((v[1] - w[1]) ** 2, i) for i, w in used if i != k)[:3]
        assert [r.k for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == [i for _, i in best]


def test_synthetic_catalogue(spark):
    one, two = files.synthetic_catalogue(spark, 400), files.synthetic_catalogue(spark, 400)
    assert sorted(one) == sorted(["distilleries", "entities", "price_history", "profiles", "evidence", "source_references", "source_audit"])
    for name, df in one.items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, two[name].repartition(3).collect())), name
    profiles = {r.entity_id: r.profile for r in one["profiles"].collect()}
    assert one["entities"].count() == 400 and 330 <= len(profiles) <= 385 and 150 <= one["evidence"].count() < len(profiles)
    a, b = profiles["ENTITY-00000000"], profiles["ENTITY-00000395"]
    assert sum(abs(a[k] - b[k]) for k in a) <= 1
    assert one["profiles"].join(one["entities"], "entity_id", "left_anti").isEmpty()
    assert one["entities"].join(one["distilleries"], "distillery_id", "left_anti").isEmpty()
    assert sorted(map(repr, files.synthetic_catalogue(spark, 400, 7)["entities"].collect())) != sorted(map(repr, one["entities"].collect()))


def test_family_comparison_equals_all_pairs(spark):
    rng = random.Random(5)
    schema = "id long, fam string, age int, abv double, name string, sup long"
    rows = [
        (i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, 10, 12]), rng.choice([40.0, 46.0]), rng.choice(["X", "x EDITION", None]), rng.choice([None, None, i, rng.randrange(90)]))
        for i in range(90)
    ]
    rows += [(100, "alone", None, None, None, 100), (101, "both", 1, 1.0, "x", 102), (102, "both", 1, 1.0, "x", 101)]
    want = {}
    for i, f, *_ in rows:
        if f is not None:
            want.setdefault(f, [0, 0, 0, 0, 0])[0] += 1
    for x, y in itertools.combinations(rows, 2):
        if x[1] is not None and x[1] == y[1]:
            edition = any("edition" in (r[4] or "").lower() for r in (x, y))
            at = 1 if x[5] == y[0] or y[5] == x[0] else 2 if x[2:4] != y[2:4] else 3 if edition else 4
            want[x[1]][at] += 1
    df = spark.createDataFrame(rows, schema).withColumn("_n", F.lit("an extra column"))
    got = {r[0]: list(r[1:]) for r in resolve.family_comparison(df, "fam", "id", ["age", "abv"], "name", "sup").collect()}
    assert got == want and want["both"] == [2, 1, 0, 0, 0] and want["alone"] == [1, 0, 0, 0, 0]
    assert resolve.family_comparison(df.limit(0), "fam", "id", ["age", "abv"], "name", "sup").count() == 0


def test_pair_differences_keep_every_pair(spark):
    values = [0.0, 0.0, 0.1, 0.3, 0.30000000000000004, 1.0, 1.5, None, -0.2, 7.0, 7.0, 7.0]
    rows = [(i, "a" if i % 12 else None, v) for i, v in enumerate(values)] + [(20, "b", 3.0), (21, "c", 1.0), (22, "c", 9.0)]
    df = spark.createDataFrame(rows, "id long, fam string, v double")
    for tolerance in (0.0, 0.2, 0.5, 6.0):
        low = {}
        for i, f, v in sorted(rows, key=lambda r: r[0]):
            low.setdefault((f, v), i)
        want = Counter()
        for x, y in itertools.combinations([r for r in rows if r[1] is not None and r[2] is not None], 2):
            if x[1] == y[1]:
                a, b = sorted((x, y), key=lambda r: r[2])
                d = b[2] - a[2]
                near = d <= tolerance
                kind = "same" if d == 0 else "near" if near else "different"
                want[(x[1], kind, *((low[a[1:]], low[b[1:]]) if kind != "different" else (None, None)))] += 1
        found = resolve.pair_differences(df, "fam", "id", "v", tolerance).collect()
        assert {(r.fam, r.kind, r.first_id, r.second_id): r.n_pairs for r in found} == want and len(found) == len(want)
    # A family that holds nearly all rows stands in few rows; its pairs are counted exactly.
    hot = spark.range(20001).selectExpr("id", "'f' AS fam", "double(id % 2) * 100 AS v")
    found = {r.kind: 0 for r in resolve.pair_differences(hot, "fam", "id", "v", 1.0).collect()}
    total = resolve.pair_differences(hot, "fam", "id", "v", 1.0).agg(F.sum("n_pairs")).first()[0]
    assert set(found) == {"same", "different"} and total == 20001 * 20000 // 2


def test_duplicate_pairs_are_all_pairs(spark, sf_dir, monkeypatch):
    """Each pair of a class has its row, also of a class that is dealt into blocks; nulls pair with nothing, repeated keys with all others."""
    monkeypatch.setattr(resolve, "CLASS_BLOCK", 7)
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["x", "x", "X", "y", None]), rng.choice([1, 1, 1, 2, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, abv int")
    got = Counter(tuple(r) for r in resolve.duplicate_pairs(df, "id", F.lower("name"), "abv").collect())
    some = [r for r in rows if None not in r]
    want = Counter((a[0], b[0], 1.0) for a in some for b in some if a[1].lower() == b[1].lower() and a[2] == b[2] and a[0] < b[0])
    assert got == want and len(got) > 500
    assert resolve.duplicate_pairs(df.limit(0), "id", F.col("name"), "abv").count() == 0
    n = resolution.d20(spark, sf_dir).select("first_id", "second_id").distinct().count()
    assert n == resolution.table(spark, sf_dir, "part").groupBy("p_name", "p_size").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]


def test_duplicate_classes_join_nothing_on_nulls(spark):
    df = spark.createDataFrame([(3, "x", 1), (1, "x", 1), (2, "x", 2), (5, None, 1), (6, None, 1), (7, "y", None), (8, "y", None), (9, "x", 1)], "id long, name string, abv int")
    got = sorted(tuple(r) for r in resolve.duplicate_score(df, "id", F.col("name"), "abv").collect())
    assert got == [(1, 1, 2, 1.0), (3, 1, 2, 1.0), (9, 1, 2, 1.0)]
    assert resolve.duplicate_score(df.limit(0), "id", F.col("name"), "abv").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_texts_are_not_sent_through_the_driver(spark):
    sources = spark.createDataFrame([(i, f"red widget {i}") for i in range(20)], "src_id long, src_text string")
    registry = spark.createDataFrame([(i, f"red widgets {i}") for i in range(20)], "id long, text string")
    assert "Broadcast" not in plan_of(resolve.similar_pairs(sources, registry))


def test_three_way_and_best_candidate_of_equal_texts(spark):
    """Rows of one text get the same answer, and only one of them is compared."""
    sources = spark.createDataFrame([(i, "red widget 12", 1) for i in range(3)] + [(7, "zz", 1), (8, "", 1)], "src_id long, src_text string, src_age int")
    registry = spark.createDataFrame([(4, 1, "red widget 13"), (5, 1, "red widgets 12"), (6, 1, "old bolt")], "id long, age int, text string")
    found = {r.src_id: (r.status, r.candidates) for r in resolve.three_way(sources, registry).collect()}
    assert found == {0: ("AMBIGUOUS", "5,4")} | {1: ("AMBIGUOUS", "5,4"), 2: ("AMBIGUOUS", "5,4"), 7: ("NO_MATCH", None), 8: ("NO_MATCH", None)}
    best = {r.src_id: (r.id, round(r.score, 6), round(r.runner_up, 6)) for r in resolve.best_candidates(sources, registry).collect()}
    assert best == dict.fromkeys(range(3), (5, round(13 / 14, 6), round(12 / 13, 6)))
    once = resolve.text_pairs(sources, registry)
    assert once.count() == 2


def test_prefixes_of_texts_are_not_sent_through_the_driver(spark):
    rows = spark.createDataFrame([(i, f"red widget {i}") for i in range(20)], "k long, text string")
    labels = spark.createDataFrame([("red", 1), ("red widget 1", 2)], "label string, dim long")
    met = resolve.longest_prefix(rows, "text", labels, "label", "dim", "k")
    assert {r.k: r.dim for r in met.collect()} == {i: 2 if str(i).startswith("1") else 1 for i in range(20)}
    plan = plan_of(met)
    assert "Generate" in plan and "Broadcast" not in plan


def test_producer_tiers_meet_by_different_keys(spark):
    """Copies of names multiply neither side: the join of near names sees each key once, and the smallest id of a key is taken."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Glen Moray Distillery", "glen moray distillery", "Glen Muray", "GLEN MURAY", "Glenmoraydistillery", "", None])], "src_id long, src_name string")
    producers = spark.createDataFrame([(i, n) for i, n in ((9, "Glen Moray"), (4, "glenmoray"), (5, "Glen Mury"), (6, "glenmury"))], "id long, name string")
    seen = []
    near = matching._near
    try:
        matching._near = lambda s, r, *rest: seen.append((sorted(x.src_text for x in s.collect()), sorted(x.text for x in r.collect()))) or near(s, r, *rest)
        found = {r.src_id: (r.id, r.confidence, r.route) for r in matching.producer_tiers(names, producers, ("distillery",)).collect()}
    finally:
        matching._near = near
    assert seen[0] == (["glenmoraydistillery", "glenmuray"], ["glenmoray", "glenmury"])
    assert found == {0: (4, 96, "link"), 1: (4, 96, "link"), 2: (4, 80, "review"), 3: (4, 80, "review")}


def test_changes_of_a_url_of_several_pages(spark, duck, tmp_path):
    """Pages that share a url: the query and its SQL track the url."""
    pages = [(1, "u", "b"), (2, "u", "a"), (5, "u", "b"), (3, "v", "x"), (10, "w", None), (11, "w", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in intake.l2(spark, str(tmp_path)).select("url", "version", "status", "n_versions").collect()]
    cur = duck.cursor()
    cur.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = cur.execute(f"SELECT url, version, status, n_versions FROM ({intake.C.sql['l2_changes']})").fetchall()
    u = [("u", 0, "new", 1), ("u", 0, "changed", 2), ("u", 0, "unchanged", 2), ("u", 1, "changed", 3), ("u", 1, "changed", 4), ("u", 1, "changed", 5)]
    assert sorted(got) == sorted(want) and sorted(r for r in got if r[0] == "u") == sorted(u)


def test_deltas_over_batches_and_a_restart(spark, tmp_path):
    """The last value of a key counts over batches and restarts, ahead of the known one; no pandas frame is made for a key."""
    schema = spark.createDataFrame([], "event_id long, key string, value double, confidence int").schema
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    known = spark.createDataFrame([(1, "a", 0.0, 1), (2, "a", 1.0, 1), (3, "n", None, 1), (4, "x", 5.0, 1)], schema)
    batches = [
        [(10, "a", 1.0, 1), (12, "a", 2.0, 1), (11, "a", 1.0, 1), (13, "b", 1.0, 1), (14, "n", None, 1), (15, "n", None, 1)],
        [(20, "a", 2.0, 1), (21, "b", 1.0, 2), (22, "b", float("nan"), 2)],
        [(30, "a", 1.0, 1), (31, "b", float("nan"), 2), (34, "b", None, 2), (32, "x", 5.0, 1), (33, "c", 1.0, None), (5, "a", 1.0, 1)],
    ]
    for rows in batches:  # a query a batch
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.deltas(incremental.file_stream(spark, src, schema, 1), known, ["key"], ["event_id"], out, cp)
    got = sorted(r.event_id for r in spark.read.schema(schema).parquet(f"{out}/batch=*").collect())
    assert got == [5, 12, 13, 14, 15, 21, 22, 33, 34]
    assert not hasattr(incremental, "_news")


def test_sequence_ratios_of_a_batch():
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abc d") for _ in range(rng.choice([0, 1, 5, 12, 20, 70])))
    a = [text() for _ in range(300)]
    b = ["".join(c for c in t if rng.random() < 0.9) if rng.random() < 0.7 else text() for t in a]
    for least in (0.5, 0.82):
        plain = [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
        assert resolve.sequence_ratios(a, b, least) == [r if r >= least else None for r in plain]
        assert 0 < sum(r >= least for r in plain) < len(a)


def test_pair_differences_name_far_pairs(spark):
    """Each pair of different values with its difference, so that, with the members of classes, no pair of rows is lost."""
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0), (3, "a", 9.0), (4, "a", 1.5), (5, "b", 2.0), (6, None, 2.0), (7, "b", None)], "id long, fam string, v double")
    got = sorted(tuple(r)[1:] for r in resolve.pair_differences(df, "fam", "id", "v", 1.0, far=True).collect())
    assert got == [(1, 2, 8.0, "different", 2), (1, 4, 0.5, "near", 1), (2, 2, 0.0, "same", 1), (4, 2, 7.5, "different", 2)]


def test_equal_sources_meet_records_once(spark, sf_dir, tmp_path):
    """Copies of a source add no pair, and each copy has its answer."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 60")
    n = 30 * 1000  # keeps what the sources and records are made of
    part.union(part.withColumn("p_partkey", F.col("p_partkey") + n)).write.parquet(str(tmp_path / "part.parquet"))
    part.write.parquet(str(tmp_path / "one" / "part.parquet"))
    assert guarded.pairs(spark, str(tmp_path)).count() == guarded.pairs(spark, str(tmp_path / "one")).count() > 0
    for query in (guarded.d11, guarded.d12, guarded.d15):
        want = {tuple(r) for r in query(spark, str(tmp_path / "one")).collect()}
        got = {tuple(r) for r in query(spark, str(tmp_path)).collect()}
        assert got == want | {(r[0] + n, *r[1:]) for r in want}


def test_token_candidates_meet_by_different_texts(spark, sf_dir, monkeypatch):
    seen = []
    plain = resolve.token_candidates
    monkeypatch.setattr(resolve, "token_candidates", lambda s, r: seen.append(s) or plain(s, r))
    found = resolution.d13(spark, sf_dir)
    assert seen[0].count() == resolution.token_sources(spark, sf_dir).select("src_text").distinct().count()
    assert found.count() == found.select("src_id").distinct().count() > 0


def test_fuzzy_answers_meet_rows_once_by_a_shuffle(spark):
    sources = spark.createDataFrame([(1, "red widget 12", 12), (2, "red widget 12", 9), (3, "zz", 1), (4, "", None), (5, None, 1)], "src_id long, src_text string, src_age int")
    registry = spark.createDataFrame([(4, 12, "red widget 12"), (6, 1, "old bolt")], "id long, age int, text string")
    found = resolve.fuzzy_resolved(sources, registry)
    assert "Broadcast" not in plan_of(found) and plan_of(found).count("src_id") < 12
    none = (None, "unmatched", 0.0)
    assert {r.src_id: tuple(r)[1:] for r in found.collect()} == {1: (4, "exact", 1.0), 2: (4, "manual_review", 1.0), 3: none, 4: none, 5: none}


def test_scores_of_a_batch_are_those_of_pairs():
    rng = random.Random(5)
    words = ["", "ab", "abc", "bca", "zz", "ü", "ðß", "aab", "x" * 30, "abcabcabc", "\U0001f600a"]
    texts = ["", " ", "y" * 64, "ab " * 40, *(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60))]
    a, b = (list(t) for t in zip(*itertools.product(texts, texts), strict=True))
    assert resolve.common_letters_of_pairs(a, b, 500).tolist() == [resolve.common_letters(x, y) for x, y in zip(a, b, strict=True)]
    assert resolve.best_windows(a, b, 300).tolist() == [resolve.best_window(x, y) for x, y in zip(a, b, strict=True)]
    assert matching.name_scores_of_pairs(a, b).tolist() == [list(matching.name_scores(x, y)) for x, y in zip(a, b, strict=True)]
    assert matching.name_scores_of_pairs([], []).shape == (0, 2)


def test_pairs_of_sources_and_records_are_dealt_by_number(spark, sf_dir):
    by = ("src_name", "p_brand", "src_part")
    rows = guarded.pairs(spark, sf_dir, by)
    assert "REPARTITION_BY_NUM" in plan_of(rows)
    assert rows.select("src_id").distinct().count() == rows.select(*by).distinct().count() > 0


def test_feature_routes_score_different_names_once(spark, sf_dir, monkeypatch):
    """Copies of sources and products add no pair to score, and each copy has its answer."""
    seen = []
    plain = matching.token_set_ratio
    monkeypatch.setattr(matching, "token_set_ratio", lambda a, b, kind="indel": seen.append(1) or plain(a, b, kind))
    s, p = guarded.feature_sources(spark, sf_dir).where("src_id < 40"), guarded.feature_products(spark, sf_dir)
    copies = s.unionByName(s.withColumn("src_id", F.col("src_id") + 1000))
    more = p.unionByName(p.withColumn("id", F.col("id") + 100_000))
    want = {tuple(map(str, r)) for r in matching.feature_routes(s, p).collect()}
    got = {(str(r.src_id % 1000), *map(str, tuple(r)[1:])) for r in matching.feature_routes(copies, more).collect()}
    assert got == want and len(seen) == 4
    plan = plan_of(matching.feature_routes(copies, more))
    assert "Sort [_s" in plan


def test_planned_rows_are_dealt_to_as_many_tasks_as_asked(spark, sf_dir):
    args = (promotion.candidates(spark, sf_dir), promotion.entity_ids(spark, sf_dir), promotion.held(spark, sf_dir), "entity_id", "source", "status", ["l_orderkey", "l_linenumber", "l_suppkey"])
    assert promotion.tasks(spark, sf_dir) >= 16
    dealt = promote.planned(*args, tasks=7)
    assert plan_of(dealt).count(", 7), REPARTITION_BY_NUM") == 2
    assert sorted(map(str, dealt.collect())) == sorted(map(str, promote.planned(*args).collect()))
    assert "REPARTITION_BY_NUM" in plan_of(promotion.m3_plan(spark, sf_dir)) and "REPARTITION_BY_NUM" in plan_of(promotion.j1(spark, sf_dir))


def test_axes_are_taken_of_a_profile_parsed_once(spark, sf_dir):
    plan = vectors.b22(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("component_2=") == 1
    assert "RoundRobinPartitioning" in plan_of(vectors.b22(spark, sf_dir))


def test_page_files_are_written_by_several_tasks(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch_path", lambda spark, label: str(tmp_path / label))
    n = intake.a11_files(spark, sf_dir).count()
    parts = [f.name.split("-")[1] for f in (tmp_path / "artifacts").glob("page_id=*/*.txt")]
    assert n == spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 5 <> 0").count()
    assert len(parts) > n and len(set(parts)) > 1


def test_artifacts_are_listed_and_read_by_tasks(spark, tmp_path):
    """A row is a file, whatever its key; the reading tasks don't grow with the files, and the driver has no list of them."""
    top = tmp_path / "artifacts"
    path = str(top)
    rows = [(str(i), f"text {i}".encode()) for i in range(300)] + [("7", b"other"), ("7", b"other"), (None, b"no key"), ("a/b=c d-1+2.txt", b""), ("8", None)]
    df = spark.createDataFrame(rows, "id string, body binary").coalesce(1)
    assert files.write_artifacts(df, path, "id", "body") == 305
    before = sorted(str(f.relative_to(path)) for f in top.rglob("*"))
    assert files.write_artifacts(df, path, "id", "body") == 305  # as a task does that is run again
    assert before == sorted(str(f.relative_to(path)) for f in top.rglob("*"))
    assert len(list(top.iterdir())) < 305
    (top / "id=x%2Fy" / "inner=2").mkdir(parents=True)
    (top / "id=x%2Fy" / "part-1.log").write_text("another kind")
    (top / "id=x%2Fy" / "part-1.txt").write_text("kept")
    (top / "id=x%2Fy" / ".part-1.txt").write_text("hidden")
    (top / "id=__HIVE_DEFAULT_PARTITION__").mkdir()
    (top / "id=__HIVE_DEFAULT_PARTITION__" / "none.txt").write_text("none")
    (top / "_SUCCESS").write_text("")
    found = files.artifacts(spark, path, "*.txt", ["id"])
    assert found.columns == ["path", "modified", "length", "content", "id"]
    assert files.artifacts(spark, str(top / "id=x%2Fy")).columns == ["path", "modified", "length", "content", "inner"]
    got = found.collect()
    written = {r.path for r in got if r.id and r.id.startswith("hash-")}
    keys = found.where("id like 'hash-%'").select(files.written_key(F.col("path")).alias("k"), "content").collect()
    assert sorted((str(r.k), bytes(r.content)) for r in keys) == sorted((str(k), v or b"") for k, v in rows) and len(written) == 305
    assert sorted((str(r.id), bytes(r.content)) for r in got if r.path not in written) == [("None", b"none"), ("x/y", b"kept")]
    assert all(r.length == len(r.content) == os.path.getsize(r.path) and abs(r.modified.timestamp() - os.path.getmtime(r.path)) < 86400 for r in got)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and "FileScan" not in plan_of(found)
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.txt").write_text("x")
    (plain / "b.md").write_text("y")
    assert [(os.path.basename(r.path), bytes(r.content)) for r in files.artifacts(spark, str(plain), "*.txt").collect()] == [("a.txt", b"x")]


def test_page_files_of_repeated_and_missing_pages(spark, tmp_path):
    d = str(tmp_path / "in")
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>b</p>"), (1, "u", "<p>a</p>"), (2, "u", "x\r\ny"), (3, "u", None), (None, "u", "z"), (6, "u", "copied anyway"), (10, "u", "<p>b</p>")]
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/pages.parquet")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((r.page_id, r.length, r.content_hash, r.status) for r in intake.a11_files(spark, d).collect())
    a, b, xy, none, copied = (digest(t) for t in ("<p>a</p>\n", "<p>b</p>\n", "x\ny\n", "\n", "copied\n"))
    assert got == sorted([(1, 9, a, "new"), (1, 9, a, "duplicate"), (1, 9, b, "duplicate"), (2, 4, xy, "new"), (3, 1, none, "new"), (6, 7, copied, "new")])
    spark.createDataFrame([], schema).write.parquet(f"{d}/empty/pages.parquet")
    assert intake.a11_files(spark, f"{d}/empty").count() == 0


@pytest.mark.parametrize("kind", ["levenshtein", "indel"])
def test_token_resolved_equals_all_pairs(spark, kind):
    rng = random.Random(17)
    words = ["brand", "brand", "red", "blue", "ring", "bolt", "rng", "12", "13", "7", "x", "the"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    brands, kinds = ["brand", "brand#7", "red blue ring", "", None], ["a", "b", None]
    registry = [(i, text(), rng.choice(brands), rng.choice(kinds), "X") for i in range(120)]
    sources = [(i, rng.choice([text(), rng.choice(registry)[1]]), rng.choice(brands), rng.choice(kinds), rng.choice(["x", None])) for i in range(160)] + [(900, None, "brand", "a", "x")]
    s = spark.createDataFrame(sources, "src_id long, src_text string, src_brand string, src_kind string, src_country string")
    r = spark.createDataFrame(registry, "id long, text string, brand string, kind string, country string")
    tokens, ages = resolve._tokens, resolve._ages
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rest = 0.25 * resolve._overlap(tokens(F.col("src_text")), tokens(F.col("text")))
    rest = rest + 0.09 * resolve._overlap(tokens(F.lower("src_brand")), tokens(F.concat_ws(" ", F.lower("brand"), "text")))
    rest = rest + 0.04 * flag(F.arrays_overlap(ages(F.col("src_text")), ages(F.col("text")))) + 0.03 * flag(F.col("src_kind") == F.col("kind")) + 0.01 * flag(F.lower("src_country") == F.lower("country"))
    held = F.contains("text", "src_text") | F.contains("src_text", "text")
    floor = F.when(F.col("src_text") == F.col("text"), 0.99).when((F.col("src_text") != "") & (F.col("text") != "") & held, 0.94).otherwise(0.0)
    floor = F.when((F.col("src_text") == "") & (F.col("text") == ""), 0.0).otherwise(floor)
    score = F.least(F.lit(1.0), F.greatest(0.58 * resolve.similarity(F.col("src_text"), F.col("text"), kind) + rest, floor))
    want = {}
    for row in s.where("src_text is not null").crossJoin(r).select("src_id", "id", score.alias("score")).collect():
        want.setdefault(row.src_id, []).append((-row.score, row.id))
    got = {x.src_id: (x.id, x.score, x.status) for x in resolve.token_resolved(s, r, kind).collect()}
    assert got.pop(900) == (None, None, "unmatched") and sorted(got) == sorted(want)
    for key, found in want.items():
        (best, i), second = sorted(found)[:2]
        status = "high" if -best >= 0.92 and second[0] - best >= 0.04 else "review" if -best >= 0.85 else "unmatched"
        assert got[key] == ((None, None, status) if status == "unmatched" else (i, pytest.approx(round(-best, 6), abs=1e-6), status)), key
    assert {x[2] for x in got.values()} == {"high", "review", "unmatched"}


def test_a_token_of_all_names_makes_no_pairs(spark):
    names = [f"{chr(97 + i // 9) * 4} {chr(97 + i % 9) * 4} {i} brand {i % 5}" for i in range(81)]
    s = spark.createDataFrame([(n, "brand") for n in names], "src_text string, src_brand string")
    r = spark.createDataFrame([(n,) for n in names], "text string")
    near = {(x.src_text, x.text) for x in resolve._near_by_tokens(s, r, 0.85, "levenshtein").collect()}
    assert {(n, n) for n in names} <= near and len(near) < 4 * len(names)


def test_similar_items_meet_only_cells_in_reach(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [[round(rng.gauss(0, 1), 2) for _ in range(3)] for _ in range(400)]
    rows = [(i, rng.choice(vectors[:20]) if i % 4 == 0 else v) for i, v in enumerate(vectors)] + [(900, [0.0, 0.0, 0.0]), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    met = spark.sparkContext.accumulator(0)
    plain = rank._nearest

    def counted(*args):
        run = plain(*args)
        return lambda q, x: met.add(len(q) * len(x)) or run(q, x)

    monkeypatch.setattr(rank, "_nearest", counted)
    got = {}
    for r in rank.similar(df, df, "k", "v", 5, query_block=16, item_block=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.k, r.distance))
    used = rows[:400]
    assert sorted(got) == [k for k, _ in used]
    for k, v in used:
        best = sorted((sum((a - b) * (a - b) for a, b in zip(v, w, strict=True)), i) for i, w in used if i != k)[:5]
        assert [(n, i) for n, i, _ in sorted(got[k])] == [(n + 1, i) for n, (_, i) in enumerate(best)]
    assert met.value < len(used) ** 2 / 2
