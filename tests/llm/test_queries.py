"""The registered queries themselves, over whole tables, against SQL or brute force written apart from the operators."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from curata.llm import html_text, language_id, packing, pii, quality_classifier  # noqa: E402
from curata.llm import queries as llm_queries  # noqa: E402
from curata.llm.tokens import encoder  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_against_sql(name, spark, duck, sf_dir):
    got, want = llm_queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(llm_queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_gives_a_row_for_each_document(spark, sf_dir, documents):
    for name, column in (("op2_quality_classifier", "score"), ("op7_language_id", "score")):
        got = llm_queries.queries()[name](spark, sf_dir).toPandas()
        assert sorted(got.doc_id) == sorted(documents.doc_id) and got[column].between(0, 1).all()
        n = {"op2_quality_classifier": (5, 0), "op7_language_id": (4, 2)}[name]
        assert (got.held_out == [zlib.crc32(str(d).encode()) % n[0] == n[1] for d in got.doc_id]).all()
        if name == "op2_quality_classifier":
            assert (got.predicted == (got.score >= 0.3)).all()


def test_token_files_query(spark, sf_dir, documents):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for d, text in sorted(zip(documents.doc_id, documents.text)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = llm_queries.op4_token_files(spark, sf_dir).toPandas()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()} == want


def test_packing_query(spark, sf_dir, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text in zip(documents.doc_id, documents.text):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            want[d, k] = (i, j - i, zlib.crc32(ids[i:j].tobytes()))
    got = llm_queries.op6_best_fit_packing(spark, sf_dir).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, rows in got.groupby("sequence_id"):
        at = 0
        for r in rows.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert got.sequence_id.nunique() <= best_fit(got.length)


def best_fit(lengths, capacity=1024):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            _, i = min(fits)
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
            n += 1
    return n


@pytest.mark.parametrize(("kind", "over"), [("uniform", 0.01), ("330-419", 0.35), ("350-689", 0.2), ("lognormal", 0.01), ("few sizes", 0.05)])
def test_grouped_plan_is_near_the_bound(kind, over):
    rng = np.random.RandomState(5)
    lengths = {
        "uniform": rng.randint(1, 1025, 900),
        "330-419": rng.randint(330, 420, 1500),
        "350-689": rng.randint(350, 690, 700),
        "lognormal": np.clip(rng.lognormal(5, 1, 1500).astype(int), 1, 1024),
        "few sizes": rng.choice([341, 342, 300, 512, 200], 1500),
    }[kind]
    rows = packing.plan(np.bincount(lengths, minlength=1025))
    n = int((rows[:, 3] + rows[:, 2]).max())
    assert n <= (1 + over) * -(-lengths.sum() // 1024) + 1 and n <= 1.01 * best_fit(lengths) + 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_grouped_plan_on_the_tables(spark, sf_dir, sf):
    texts = spark.read.parquet(sf_dir.replace("sf0.001", sf) + "/documents.parquet").select("text").toPandas().text
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = np.array([n for t in texts for n in packing.cut(len(encode.encode(t or "")) // encode.dtype.itemsize + 1, 1024)])
    rows = packing.plan(np.bincount(lengths, minlength=1025))
    bound = -(-lengths.sum() // 1024)
    assert int((rows[:, 3] + rows[:, 2]).max()) <= bound + max(2, bound // 500)
    grouped = packing._grouped(np.bincount(lengths, minlength=1025), packing.GROUPS, packing.SMALL)
    assert sum(c for own in grouped.values() for _, c in own) == (lengths > packing.SMALL).sum()  # all large pieces come through configurations


def test_fullest_configuration_by_trying_all():
    rng = random.Random(4)
    for _ in range(200):
        sizes = sorted(rng.sample(range(3, 30), rng.randint(1, 5)), reverse=True)
        number, room = [rng.randrange(4) for _ in sizes], rng.randrange(60)
        used = packing._fullest(sizes, number, room)
        fill = sum(sizes[i] * n for i, n in used.items())
        every = [sum(s * n for s, n in zip(sizes, some)) for some in itertools.product(*(range(n + 1) for n in number))]
        assert fill == max(x for x in every if x <= room) and all(n <= number[i] for i, n in used.items())


def test_configurations_place_all():
    rng = random.Random(6)
    for _ in range(50):
        sizes = sorted(rng.sample(range(100, 1025), rng.randint(1, 12)), reverse=True)
        number = [rng.randint(1, 1000) for _ in sizes]
        found, placed = packing.configurations(sizes, number, 1024), Counter()
        for often, uses in found:
            assert uses > 0 and sum(sizes[i] * n for i, n in often.items()) <= 1024
            placed.update({i: n * uses for i, n in often.items()})
        assert [placed[i] for i in range(len(sizes))] == number and len(found) <= 12 * len(sizes)


def test_packing_reads_in_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some words of document {i} " * 20, "s") for i in range(400)], "doc_id long, text string, source string")
    packed = packing.pack(df.repartition(6), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert packed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 1


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data_query(spark, sf_dir, documents):
    import hashlib

    got = {r.doc_id: r for r in llm_queries.op5_pii(spark, sf_dir).toPandas().itertuples()}
    assert len(got) == len(documents)
    for d, text in zip(documents.doc_id, documents.text):
        spans = brute_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert r.spans.startswith(listed) and all(x.startswith("term:") for x in r.spans[len(listed) :].strip(",").split(",") if x)


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " x@y.zz", "1" * 1_000_000 + ".1.1.1", "1." * 400_000, "a@" * 400_000, "+1" + " " * 1_000_000, "a." * 400_000 + "@b.c"])
def test_patterns_are_linear(text):
    import time

    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 5


def test_patterns_on_random_texts():
    import random

    rng = random.Random(2)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@-_+ 2(5") for _ in range(rng.randint(0, 40)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_spans(text), text


def test_disclosures_against_brute_force(spark):
    import random

    rng = random.Random(4)
    words = [f"word{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(30)]
    people = [(f"p{i}@mail.example.com", f"Name{'xyzuvw'[i]}son") for i in range(6)]
    texts = []
    for _ in range(500):
        parts = [rng.choice(words) for _ in range(rng.randint(3, 9))]
        if rng.random() < 0.25:
            mail, name = rng.choice(people)
            parts += [mail] * (rng.random() < 0.8) + [name] * (rng.random() < 0.9)
            rng.shuffle(parts)
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = pii._keyed(df).mapInArrow(pii._scan, f"doc_id long, key long, {pii.FOUND}")
    got = pii.disclosures(scanned, df, support=2, least=0.3).collect()
    n, mentions, terms, both = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        mails = {m[0].lower() for m in EMAIL.finditer(t)}
        own = {w.lower() for w in t.split() if "@" not in w}
        mentions.update(mails)
        terms.update(own | {w.lower() for w in t.split() if "@" in w})
        both.update((m, w) for m in mails for w in own)
    want = []
    for (m, w), k in both.items():
        if k >= 2 and 2 <= mentions[m] < n:
            value = math.log(n * k / (mentions[m] * terms[w])) / math.log(n / mentions[m])
            if value >= 0.3:
                want.append(round(value, 9))
    assert sorted(round(r.disclosure, 9) for r in got) == sorted(want) and want


def test_few_and_many_terms_take_two_ways_to_one_result(spark):
    import random

    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(6))) for i in range(300)]
    rows += [(400 + i, f"Quuxley met Zorg{'abc'[i % 3]} at q{i % 3}@corp.example.com, quuxley!") for i in range(12)] + [(None, "quuxley"), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda found: sorted(repr((r.doc_id, r.key, r.spans, r.terms)) for r in found.collect())
    assert plain(pii.find(df)) == plain(pii.find(df, most_shared=0)) and any(r.terms for r in pii.find(df).collect())
    clean = lambda made: sorted(map(repr, made.collect()))
    assert clean(pii.sanitise(df)) == clean(pii.sanitise(df, most_shared=0)) != clean(df)


def test_ftrl_against_a_plain_loop():
    rng = np.random.RandomState(6)
    rows = [(float(rng.rand() < 0.5), rng.choice(40, 8, replace=False), rng.rand(8)) for _ in range(60)]
    z, n, w = Counter(), Counter(), {}

    def weight(i):
        if abs(z[i]) <= quality_classifier.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality_classifier.L1) / ((quality_classifier.BETA + math.sqrt(n[i])) / quality_classifier.ALPHA + quality_classifier.L2)

    for _ in range(quality_classifier.EPOCHS):
        for label, at, x in rows:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
            for i, v in zip(at, x):
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_classifier.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(quality_classifier.ftrl(rows, 40), [weight(i) for i in range(40)])


def test_mixtures_against_a_plain_loop(spark):
    import pyarrow as pa

    rng = np.random.RandomState(8)
    vocabulary = {c: ["".join(rng.choice(list(s), 5)) for _ in range(30)] for c, s in zip("abc", ("abcdefg", "defghij", "ghijklm"))}
    train = spark.createDataFrame([(" ".join(rng.choice(ws, 300)), c) for c, ws in vocabulary.items()], "text string, lang string")
    langs, logp = language_id.train(train)
    texts = [" ".join([*rng.choice(vocabulary["a"], i), *rng.choice(vocabulary["b"], 12 - i)]) for i in range(0, 13, 3)]
    got, some = language_id.mixtures(pa.array(texts), logp)
    assert some.all()
    for text, found in zip(texts, got):
        like = []
        for w in text.split():
            data, starts, lengths, _, _ = language_id._units(pa.array([w]))
            grams = language_id._word_grams(data, starts, lengths, language_id.BITS)[1]
            total = [sum(logp[g, k] for g in grams) for k in range(3)]
            like.append([math.exp(t - max(total)) for t in total])
        words = len(like)

        def climbed(share, rounds):
            for _ in range(rounds):
                new = [0.0] * 3
                for row in like:
                    mixed = sum(p * x for p, x in zip(share, row))
                    for k in range(3):
                        new[k] += share[k] * row[k] / mixed / words  # noqa: B023
                share = new
            return share

        share = [0.0] * 3
        share[max(range(3), key=lambda k: sum(math.log(row[k]) for row in like))] = 1.0
        best, chosen = -math.inf, None
        for k in range(1, 4):
            share = climbed(share, 0 if k == 1 else language_id.ROUNDS)
            mixed = [sum(p * x for p, x in zip(share, row)) for row in like]
            value = sum(map(math.log, mixed)) - language_id.PENALTY * (k - 1) * math.log(words + 1)
            if value > best:
                best, chosen = value, share
            if k < 3:
                rise = {j: sum(row[j] / m for row, m in zip(like, mixed)) for j in range(3) if share[j] == 0}
                new = max(rise, key=rise.get)
                share = [p * k / (k + 1) for p in share]
                share[new] = 1 / (k + 1)
        assert np.allclose(found, chosen, atol=1e-9)


def random_tree(rng, depth=0):
    """(html, visible words) of a page made from a grammar of its own: the second implementation."""
    html, words = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "b", "div", "p", "ul", "hidden", "script", "veil", "details", "table", "comment"]) if depth < 4 else "text"
        if kind == "text":
            w = f"w{rng.randint(0, 9999)}"
            html, words = html + f" {w} ", [*words, w]
        elif kind in ("b", "div"):
            h, w = random_tree(rng, depth + 1)
            html, words = html + f"<{kind}>{h}</{kind}>", words + w
        elif kind == "p":
            w = f"p{rng.randint(0, 9999)}"
            html, words = html + f"<p>{w}" + rng.choice(["</p>", ""]) + "<div></div>", [*words, w]
        elif kind == "ul":
            items = [f"i{rng.randint(0, 999)}" for _ in range(3)]
            html, words = html + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", words + items
        elif kind == "hidden":
            html += rng.choice(["<div hidden>{}</div>", "<div style='display:none'>{}</div>", "<div class=gone>{}</div>"]).format(random_tree(rng, depth + 1)[0])
        elif kind == "veil":
            html, words = html + "<div style='visibility:hidden'>no<i style='visibility: visible'>veil</i></div>", [*words, "veil"]
        elif kind == "script":
            html += "<script>if (a < b) x('</p>')</script>"
        elif kind == "details":
            html, words = html + "<details><summary>sum</summary>closed</details>", [*words, "sum"]
        elif kind == "comment":
            html += "<!-- not <b>this</b> -->"
        else:
            cells = [f"c{rng.randint(0, 999)}" for _ in range(4)]
            html += "<table><tr><td rowspan=2>{}<td>{}<tr><td>{}</table>{}".format(*cells)
            words = words + cells
    return html, words


def test_visible_words_of_random_pages():
    import random

    rng = random.Random(9)
    for _ in range(400):
        html, words = random_tree(rng)
        text = html_text.render(html_text.parse("<style>.gone{display:none}</style>" + html)[0])[0]
        got = re.findall(r"\b(?:[wpic]\d+|veil|sum|no|closed)\b", text)
        assert got == re.findall(r"\b(?:[wpic]\d+|veil|sum)\b", " ".join(words)), html


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<div><li>" * 50_000 + "x", "<p><button>" + "<div>" * 100_000 + "x", "<b>" * 100_000 + "</i>" * 100_000, "<blockquote>x" * 10_000, "<td rowspan=9999>" * 5_000])
def test_deep_pages_are_linear(page):
    import time

    began = time.process_time()
    html_text.render(html_text.parse(page)[0])
    assert time.process_time() - began < 10


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>k<ul><li>x<li>y</ul><td>v<tr><td colspan=2>wide</table>", "k    v\n- x\n- y\nwide"),
        ("<table><tr><td><table><tr><td>n<td>m</table><td>z</table>", "n  m  z"),
        ("<xmp><b>x & y</b></xmp>", "<b>x & y</b>"),
        ("<select><option>one<option selected>two</select>", "two"),
        ("<select multiple><option>p<option>q</select>", "p\nq"),
        ("<input value=v><input type=hidden value=h><textarea>a\n b</textarea>", "va\n b"),
        ("<details>a<summary>s</summary>b</details><details open><summary>t</summary>c</details>", "s\nt\nc"),
        ("<style>p.x, #y {display: none} @media print {.z {display:none}} b{visibility:hidden}</style><p class=x>1<p id=y>2<p class=z>3<b>4</b>", "3"),
        ("<style>.h{display:none}</style><i class=h style='display:inline'>seen</i>", "seen"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ],
)
def test_visibility_and_tables(page, want):
    assert html_text.render(html_text.parse(page)[0])[0] == want


def test_extract_of_an_empty_table_and_repeated_rows(spark, sf_dir):
    schema = "page_id long, html string, text string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x")], schema)
    assert [r.text for r in html_text.extract(twice).collect()] == ["a", "a"]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = llm_queries.op1_html_text(spark, sf_dir).toPandas()
    assert len(got) == pages.count() and got.text.str.len().gt(0).any()
