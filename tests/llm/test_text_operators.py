"""Operators of single texts against brute force: tokens, packing, rules, personal data, pages."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from curata.llm import html_text, mixing, packing, pii, quality_rules, token_files  # noqa: E402
from curata.llm.tokens import Encoder  # noqa: E402

ODD = [
    (1, "one two three one two three one two three", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (None, "nobody's text", "fr", "b"),
    (4, " \t\n ", "de", "b"),
    (5, "word " * 3000, "en", "a"),
    (6, "same\nsame\nother\nsame", "en", "c"),
    (6, "same\nsame\nother\nsame", "en", "c"),
    (7, "mail a.b@c.example.org or +44 (0)20 7946 0958, 10.0.0.1, 4111 1111 1111 1111 <|endoftext|> é́ ẞ", "xx", "c"),
    (8, "x" * 5000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1.5, True) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZ é ß\n\t.,!'0 \x1c\xa0ÄİΣ中|<>")), max_size=40))
def test_word_cache_equals_whole_text(name, text):
    enc = test_word_cache_equals_whole_text.__dict__.setdefault(name, Encoder(public_tokenizers.path(name)))
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Encoder(path).tokenizer
    got = token_files.read(token_files.write(odd, path, 2, shards=3), path).collect()
    assert len(got) == len(ODD)
    at = 0
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for row, src in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        ids = np.array([*tok.encode(src[1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens) == (src[0], at, len(ids))
        assert bytes(row.ids) == ids.tobytes()
        at += len(ids)


def test_token_files_of_nothing(empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.read(token_files.write(empty, path, 2), path).count() == 0


def check_plan(counts, **kind):
    capacity = kind.get("capacity", 1024)
    sequences, seen = {}, {}
    for n, rank, number, first, offset in packing.plan(counts, **kind).tolist():
        for i in range(number):
            sequences.setdefault(first + i, []).append((offset, n))
            seen.setdefault(n, []).append(rank + i)
    for n in range(1, len(counts)):
        assert sorted(seen.get(n, [])) == list(range(counts[n]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_plan_places_every_piece_once(lengths, groups, small):
    check_plan(np.bincount(lengths, minlength=17), capacity=16, groups=groups, small=small)


def test_plan_is_close_to_the_bound():
    lengths = np.random.RandomState(5).randint(1, 1025, 20000)
    assert check_plan(np.bincount(lengths, minlength=1025)) <= 1.02 * -(-lengths.sum() // 1024)


def test_packing_keeps_all_tokens(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Encoder(path).tokenizer
    rows = packing.pack(odd, path, 2).collect()
    whole = sorted(np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in ODD)
    pieces, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4096
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.piece, r.start), []).append(bytes(r.ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert sum(len(r.ids) for r in rows) == sum(map(len, whole))
    fifth = sorted((r.piece, bytes(r.ids), r.length) for r in rows if r.doc_id == 5)
    assert b"".join(p[1] for p in fifth) in whole
    assert all(p[2] == 1024 for p in fifth[1:])


def test_packing_of_nothing(empty):
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated)


def test_rules_against_brute_force(spark, odd):
    rng = random.Random(3)
    texts = [r[1] for r in ODD] + [" ".join(rng.choice("a b c dd é |#".split()) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measurements(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
        assert got == brute_rules(texts[r.doc_id]), texts[r.doc_id]


def test_policies_and_ablations(spark, odd):
    led = quality_rules.ledger(odd)
    verdicts = quality_rules.apply_policy(led, "v1").collect()
    m = quality_rules.mask(quality_rules.POLICIES["v1"])
    assert all(r.kept == (r.failed_bits & m == 0) for r in verdicts)
    table = {r.rule: r for r in quality_rules.ablations(led, "v1").collect()}
    for rule in quality_rules.POLICIES["v1"]:
        bit = quality_rules.mask([rule])
        bits = [r.failed_bits & m for r in verdicts]
        assert table[rule].n_failed == sum(b & bit != 0 for b in bits)
        assert table[rule].n_only == sum(b == bit for b in bits)
        assert table[rule].n_kept_without == sum(b & ~bit == 0 for b in bits)


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == 1:
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == 2:
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                ok = 16 <= len(digits) <= 19 and total % 10 == 0
            elif kind == 3:
                ok = 8 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "@", "x_y@z-1.co.uk", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (0)20 7946 0958", "+1", " ", ".", "é", "-", "007"]), max_size=8))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_spans(text)


def test_terms_that_disclose(spark):
    rows = [(i, f"ordinary words go here and here again number {i % 7}") for i in range(60)]
    rows += [(100 + i, "please ask zorgblatt about it via zz@corp.example.com when there is time") for i in range(3)]
    rows += [(200, None), (None, "4111 1111 1111 1111"), (201, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got) == len(rows)
    text = rows[60][1]
    named = {text[t.start : t.end] for t in got[100].terms}
    assert "zorgblatt" in named
    assert got[5].spans == [] and got[5].terms == []
    assert [s.kind for s in got[None].spans] == [2]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zz@corp" not in clean[101] and "zorgblatt" not in clean[101] and "<email>" in clean[101]
    assert clean[5] == rows[5][1] and clean[200] is None
    assert clean[None] == "<card>"


def test_terms_far_from_the_mention_and_without_it(spark):
    rows = [(i, f"ordinary words go here and here again number {i % 7}") for i in range(400)]
    far = "Quuxley wrote of many ordinary words that go here and here again to ab@corp.example.com"
    rows += [(500 + i, f"{far}. Later quuxley left (Quuxley's own words)") for i in range(6)]
    rows += [(600, "only quuxley is named"), (None, "and Quuxley again, quuxley@x.org")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in pii.find(df.repartition(5)).collect()}
    text = {d: t for d, t in rows}
    for d in (500, 505, 600, None):
        want = [m.span() for m in re.finditer(r"\bquuxley\b(?!['@])", text[d], re.I)]
        terms = [(t.start, t.end) for t in got[d].terms if "quuxley" in text[d][t.start : t.end].lower() and "'" not in text[d][t.start : t.end]]
        assert terms == want, d
    assert got[5].terms == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("quuxley" in (clean[d] or "").lower() for d in (600, None))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>One <b>two</b>\n three<p>Next<br>line", "One two three\n\nNext\nline"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig</table>", "Name   Qty\napple  10\nfig"),
        ("a<span hidden>b</span><div style='display:none'>c</div><script>d</script>e", "ae"),
        ("<pre> x\n   y</pre>", " x\n   y"),
        ("1 < 2 &amp; 3 &lt; 4", "1 < 2 & 3 < 4"),
        ("<div>" * 3000 + "deep", "deep"),
        ("", ""),
        ("<!-- only --><title>T</title>", ""),
        ("<td>stray</td><li>item", "stray\n- item"),
        ("<p a='unclosed>text", "text"),
    ],
)
def test_pages(page, want):
    assert html_text.render(html_text.parse(page)[0])[0] == want


def test_extract_handles_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<title>A</title><p>b", "y"), (1, "", "z")], "page_id long, html string, text string")
    assert {(r.page_id, r.title, r.text) for r in html_text.extract(df).collect()} == {(1, None, ""), (None, "A", "b")}


def test_repeated_takes_each_row_its_own_times(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), " ".join("w" * rng.randint(1, 9)), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(400)]
    rows += [(5, "same words", "a")] * 30 + [(5, None, "a"), (5, "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    times = {}
    for r in mixed.collect():
        key = (r.doc_id, r.source, r.size)
        times[key] = times.get(key, 0) + r.repeats
    got = {}
    for r in mixing.repeated(df.repartition(3), mixed).collect():
        key = (r.doc_id, r.source, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in times.items() if n}


def test_mix_meets_targets(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), rng.choice(["a"] * 5 + ["b", "c", None])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # brute-force water-filling
    total, clamped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in clamped)
        free = [s for s in order if s not in clamped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        clamped |= over
    for s in order:
        want = 3 * sizes[s] if s in clamped else share[s]
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0


def test_crc_matches_zlib(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit(b"abc")).alias("c")).first()["c"] == zlib.crc32(b"abc")
