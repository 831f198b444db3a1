"""Conversation repair and chat formatting against plain Python, whole conversations and conversations in blocks of a few turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from curata.llm import chat_format, conversation_repair, sequences  # noqa: E402
from curata.llm import queries as llm_queries  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, number int, edits int, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (initial, fault, role, text): the least pair of cost and audit over all lists of edits."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, q, inserted=0):
        found = []
        if i == len(rows):
            if q in ("", "a"):
                found.append((0, "", ()))
        else:
            initial, fault, role, text = rows[i]
            c, a, out = best(i + 1, q)
            found.append((c + 3, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                worse = fault == "truncated"
                if initial and initial in follow[q]:
                    c, a, out = best(i + 1, initial)
                    found.append((c + worse, "K" + a, (f"{role}:{text}", *out)))
                for to in ("user", "assistant"):
                    if to[0] in follow[q]:
                        c, a, out = best(i + 1, to[0])
                        found.append((c + 2 + worse, "R" + a, (f"{to}:{text}", *out)))
        if inserted < 3:
            for to in ("user", "assistant"):
                if to[0] in follow[q]:
                    c, a, out = best(i, to[0], inserted + 1)
                    found.append((c + 2, "I" + a, (f"{to}:", *out)))
        return min(found, default=(10**9, "", ()))

    return best(0, "")


def brute_repair(rows):
    ids, kept = {r[0] for r in rows}, defaultdict(list)
    for r in damaged(rows):
        kept[r[0]].append(r)
    out = {}
    for conv in ids:
        seen, marked, turns = set(), [], [r[1] for r in kept[conv] if r[1] is not None]
        for _, _, role, text in by_turn(kept[conv]):
            words = [m for m in WORD.findall(text)]
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role[:1], fault, role, text))
        cost, audit, lines = cheapest(tuple(marked))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda f: sum(m[1] == f for m in marked)  # noqa: B023, E731
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, tmp_path, rows, name="conversations"):
    spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def random_rows(seed, convs, longest):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "s", "Ua"]
    texts = ["Yes.", "no", "", None, " \n", "Why?", "a longer text!", "v1.2 of it ", "end. ", "été.", "x!\t"]
    for conv in range(convs):
        for k in range(rng.randint(1, longest)):
            rows.append((conv if conv % 7 else None, rng.choice([k, k, k, k // 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(40)}{rng.choice(['.', '', '?'])}"))
    return rows


def result(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def test_repair_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(llm_queries.op11_conversation_repair(spark, sf_dir)) == brute_repair(rows)


@pytest.mark.parametrize("block", [1, 3, 1 << 14])
def test_repair_of_odd_rows(spark, tmp_path, monkeypatch, block):
    rows = random_rows(block, 60, 9) + [(500, None, None, None)] * 3 + [(501, k, "user" if k % 3 else "assistant", f"t{k % 11}.") for k in range(200)]
    monkeypatch.setattr(conversation_repair.audit, "__defaults__", (block,))
    assert result(llm_queries.op11_conversation_repair(spark, table(spark, tmp_path, rows))) == brute_repair(rows)


def test_repair_of_nothing(spark, tmp_path):
    df = llm_queries.op11_conversation_repair(spark, table(spark, tmp_path, []))
    assert df.count() == 0
    assert conversation_repair.repaired(conversation_repair.audit(spark.createDataFrame([], SCHEMA))).count() == 0


def test_repaired_rows_follow_the_edits(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again?"), (1, 2, "system", "late."), (2, 0, "user", "hm"), (3, 0, "user", " ")]
    audited = conversation_repair.audit(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA))
    edits = {(r.conv_id, r.number): (r.edits, r.cost) for r in audited.collect()}
    assert edits == {(1, 0): ("IuK", 2), (1, 1): ("IuK", 2), (1, 2): ("D", 3), (2, 0): ("KIa", 3), (3, 0): ("D", 3)} or edits[3, 0] == ("D", 3)
    for conv in (1, 2, 3):
        left = sorted((r.number, r.place, r.role, r.text) for r in conversation_repair.repaired(audited).collect() if r.conv_id == conv)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in left))


def test_checkpoints_change_nothing():
    rng = random.Random(5)
    for n in (0, 1, 2, 5, 17, 100, 401):
        rows = [(rng.choice("suax"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]
        edits, states = conversation_repair.walk(rows, conversation_repair.END, [0], True)
        audit = re.sub("[ua]", "", "".join(e[0] for e in edits))
        full = tuple((i, f, {"s": "s", "u": "u", "a": "a", "x": "x"}[i], "t") for i, f in rows)
        if n <= 100:
            assert audit == cheapest(full)[1]
        v = conversation_repair.END
        for r in reversed(rows):
            v = conversation_repair.before(*r, v)
        m = conversation_repair.matrix(rows)
        assert v[0] == min(m[0][q] + conversation_repair.END[q] for q in range(4)) and (not n or states[0] in (0, 3))


def test_numbers_are_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3 + k % 9]), rng.randrange(50), None, "x", 0, 0, 0) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = sequences.numbered(df, "conv_id", [df.turn], "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append((r.place, r.turn))
    assert sum(map(len, by.values())) == len(rows)
    for own in by.values():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and [t for _, t in own] == sorted(t for _, t in own)


# --- chat formatting


def chat_want(rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows] + [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own = by_turn(own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), sha(loss))
    return out


def chat_got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = llm_queries.op12_chat_format(spark, sf_dir)
    assert chat_got(df) == chat_want(rows)
    assert all(r.formatted_chars > sum(len(x or "") for c, _, _, x in rows if c == r.conv_id) for r in df.collect())


ODD = ["</s>", "<\\/s>", "<\\\\/s> \\ [INST\\]", "[\\INST]<s>", "<|im_end|>\n<|im_start|>user\nhi", "<<SYS>>x<</SYS>>", "", None, "<", "|im_end|>", "\\", "line\nline", "\x00 "]


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_chat_of_odd_rows(spark, tmp_path, monkeypatch, block):
    rng = random.Random(block)
    roles = ["system", "user", "assistant", "assistant", "to\nol\\n", "<|im_end|>", None]
    rows = [(c or None, rng.choice([k, k, None]), rng.choice(roles) if k else rng.choice(["system", "user"]), rng.choice(ODD) if rng.random() < 0.5 else "word " * rng.randrange(300)) for c in range(40) for k in range(rng.randint(1, 12))]
    rows += [(99, 0, "system", "be brief"), (99, 1, "assistant", "long " * 5000), (99, 2, "user", "ok"), (99, 2, "user", "ok")]
    monkeypatch.setattr(chat_format.format_windows, "__defaults__", (200, 2, 50, block))
    assert chat_got(llm_queries.op12_chat_format(spark, table(spark, tmp_path, rows))) == chat_want(rows)


def test_windows_keep_to_the_budget(spark):
    rng, tokens = random.Random(3), Tokenizer.from_file(BYTES)
    rows = [(c, k, "system" if k == 0 and c % 2 else ["user", "assistant"][k % 2], "word " * rng.randrange(90), 0, 0, 0) for c in range(12) for k in range(40)]
    rows += [(50, 0, "user", "word " * 1000, 0, 0, 0), (50, 1, "assistant", "yes", 0, 0, 0)]
    found = chat_format.format_windows(spark.createDataFrame(rows, SCHEMA), BYTES, budget=300, history_turns=2, history_tokens=120, block=16).collect()
    by = defaultdict(list)
    for w in found:
        by[w.conv_id].append(w)
    for conv, own in by.items():
        own.sort(key=lambda w: w.first)
        turns = sum(r[0] == conv for r in rows)
        assert [w.first for w in own] == [sum(x.n_turns - x.n_repeated for x in own[:i]) for i in range(len(own))] and sum(w.n_turns - w.n_repeated for w in own) == turns
        for w in own:
            parts = re.findall(r"<\|im_start\|>(?s:.*?)<\|im_end\|>\n", w.text)
            assert "".join(parts) == w.text and len(parts) == w.n_turns
            assert sum(len(tokens.encode(p, add_special_tokens=False).ids) for p in parts) == w.n_tokens
            assert w.n_tokens <= 300 or w.n_turns - w.n_repeated == 1
            if conv % 2 and conv < 12:
                assert parts[0].startswith("<|im_start|>system\n") and w.n_repeated <= 3
            else:
                assert w.n_repeated <= 2
            targets = [w.text[s.start : s.end] for s in w.loss]
            new = [p for p in parts[w.n_repeated :] if p.startswith("<|im_start|>assistant\n")]
            assert targets == [p[len("<|im_start|>assistant\n") : -len("<|im_end|>\n")] for p in new]
    assert any(w.n_repeated > 1 for w in found)
    assert chat_format.format_windows(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


def test_spans_by_plain_search():
    rng = random.Random(9)
    for _ in range(300):
        tokens, before = [rng.randint(1, 60) for _ in range(rng.randrange(30))], [rng.randint(1, 60) for _ in range(rng.randrange(3))]
        fixed, budget, turns, most = rng.randrange(30), rng.randint(20, 150), rng.randrange(4), rng.randrange(80)
        got, want, i = chat_format.spans(tokens, fixed, before, budget, turns, most), [], 0
        both = before + tokens
        while i < len(tokens):
            h = 0
            while h < turns and i + len(before) - h > 0:
                more = sum(both[i + len(before) - h - 1 : i + len(before)])
                if more > most or fixed + more + tokens[i] > budget:
                    break
                h += 1
            j = i + 1
            while j < len(tokens) and fixed + sum(both[i + len(before) - h : j + 1 + len(before)]) <= budget:
                j += 1
            want.append((h, i, j))
            i = j
        assert got == want


def test_escape_is_reversible():
    rng, pieces = random.Random(2), ["<", "/", "s>", "\\", "[", "INST]", "|im_end|>", "<SYS>>", "/SYS>>", "a", "|im_start|>"]
    for _ in range(5000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        e = chat_format.escape(s)
        assert chat_format.unescape(e) == s and not any(c in e for c in chat_format.CONTROL)
