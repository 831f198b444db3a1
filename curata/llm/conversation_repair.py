"""Conversation structure repair: cheapest edits by a checkpointed dynamic program.

The role initials of a repaired conversation read ``(s?(ua)+)?``. A row is kept (0), given the role user or assistant (2) or deleted
(3; a must for blank rows and for repeats), an empty turn is inserted (2), and a truncated row that stays adds 1. Of the cheapest
lists of edits the one whose initials (D, I, K, R) are least in ASCII is taken.

1. Rows are numbered in their conversation over all tasks (``sequences.numbered``): by turn (nulls first), then role, then text.
2. A row repeats an earlier one if a hash of conversation, role and text (128 bits) has a smaller number: an aggregate and a join.
3. Conversations are cut into blocks of BLOCK rows, each a task's group. A block's costs between the four states (nothing yet,
   after s, after u, after a) are a 4 x 4 matrix; going back over the matrices of a conversation gives the state-cost
   vector at each block's end. These are the checkpoints: nothing else of the backward pass is kept.
4. Each block goes back over its rows once more, keeping vectors at every square root of its length only, and walks
   forward through stretches that it recomputes, taking the least letter that is tight. A block that does not begin a conversation is walked from
   all four states; going forward over the blocks' ends says which of the four was the right one.

A conversation of any length is so spread over tasks; what meets in one task of it is a row for each block. Conversations of one
block, nearly all, skip the joins with matrices. Edge cases: null role or text is one space; a null turn comes first; a null
conv_id is one conversation; roles of other initials (or none) must be deleted or changed; repeated rows are duplicates; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import groups, numbered
from .storage import identity, stored

BLOCK = 1 << 14
SPACE = r"\x20\x09-\x0D"
#: Where an inserted or changed turn leads: user from all states but "after u".
NEXT = (2, 2, 3, 2)
#: Where a kept turn of an initial leads, by state; other pairs are not allowed.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {"su", "ua", "au"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def _inserts(v: list[float]) -> list[float]:
    """Costs of the states before a row, with turns inserted there."""
    two, three = min(v[2], 2 + v[3]), min(v[3], 2 + v[2])
    return [min(v[0], 2 + two), min(v[1], 2 + two), two, three]


#: Costs at the end of a conversation.
END = _inserts([0, inf, inf, 0])


def before(initial: str, fault: str | None, after: list[float]) -> list[float]:
    """Costs of the states before a row from those after it."""
    v = [3 + c for c in after]
    if fault not in ("blank", "duplicate"):
        worse = int(fault == "truncated")
        for q in range(4):
            v[q] = min(v[q], 2 + worse + after[NEXT[q]], worse + after[KEPT[q, initial]] if (q, initial) in KEPT else inf)
    return _inserts(v)


def matrix(rows: list[tuple[str, str | None]]) -> list[list[float]]:
    """[from][to]: the least cost of a block of (initial, fault) between two states."""
    columns = []
    for to in range(4):
        v = [0 if q == to else inf for q in range(4)]
        for initial, fault in reversed(rows):
            v = before(initial, fault, v)
        columns.append(v)
    return [[columns[to][q] for to in range(4)] for q in range(4)]


def walk(rows: list[tuple[str, str | None]], end: list[float], states: list[int], last: bool) -> tuple[list[list[str]], list[int]]:
    """(edits before and at each row, from each of ``states``; the states after the rows).

    An edit is K, D, R or I; R and I are followed by the initial that they give. Insertions at the conversation's end are
    with its last row. Backward vectors are kept at every square root of the number of rows and recomputed between.
    """
    n = len(rows)
    step = isqrt(max(n - 1, 0)) + 1
    kept, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            kept[i + 1] = v
        v = before(*rows[i], v)
    kept[0] = v
    out: list[list[str]] = []
    states = list(states)
    for i in range(0, n, step):
        j = min(n, i + step)
        vectors = [kept[j]]
        for k in range(j - 1, i - 1, -1):
            vectors.append(before(*rows[k], vectors[-1]))
        vectors.reverse()
        for k in range(i, j):
            (initial, fault), here, after, each = rows[k], vectors[k - i], vectors[k - i + 1], []
            worse, must = int(fault == "truncated"), fault in ("blank", "duplicate")
            for s, q in enumerate(states):
                edits = ""
                while True:
                    if here[q] == 3 + after[q]:
                        edits += "D"
                        break
                    if here[q] == 2 + here[NEXT[q]]:
                        edits += "I" + "a" * (q == 2) + "u" * (q != 2)
                        q = NEXT[q]
                        continue
                    if not must and (q, initial) in KEPT and here[q] == worse + after[KEPT[q, initial]]:
                        edits, q = edits + "K", KEPT[q, initial]
                        break
                    edits, q = edits + "R" + "a" * (q == 2) + "u" * (q != 2), NEXT[q]
                    break
                states[s] = q
                each.append(edits)
            out.append(each)
    if last and n:
        for s, q in enumerate(states):
            while END[q]:
                out[-1][s] += "I" + "a" * (q == 2) + "u" * (q != 2)
                q = NEXT[q]
            states[s] = q
    return out, states


def _matrices(batches):
    """A row for each block of a long conversation."""
    for (c1, c2, block), rows in groups(batches, 3):
        costs = [[-1 if x == inf else x for x in line] for line in matrix([(r[4], r[5]) for r in rows])]
        yield _batch([(c1, c2, block, sum(costs, []), rows[-1][4])], CHAIN)


def _ends(table: pa.Table) -> pa.Table:
    """For each block of one conversation: costs at its end, and the initial before it."""
    rows, end, out = sorted(table.to_pylist(), key=lambda r: r["block"]), END, []
    for k in range(len(rows) - 1, -1, -1):
        r = rows[k]
        out.append((r["c1"], r["c2"], r["block"], [-1 if x == inf else x for x in end], rows[k - 1]["last"] if k else None, k == len(rows) - 1))
        costs = [inf if x < 0 else x for x in r["costs"]]
        end = [min(costs[4 * q + to] + end[to] for to in range(4)) for q in range(4)]
    return pa.Table.from_batches([_batch(out, ENDS)])


def _entries(table: pa.Table) -> pa.Table:
    """For each block of one conversation but the first: the state that it is entered in."""
    state, out = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append((r["c1"], r["c2"], r["block"], state))
        state = r["exits"][state if r["block"] else 0]
    return pa.Table.from_batches([_batch(out, ENTRIES)])


def _walked(batches):
    held = []
    for (c1, c2, block), rows in groups(batches, 3):
        end, prior, last = rows[0][6:9] if rows[0][6] is not None else (END, None, True)
        end = [inf if x < 0 else x for x in end]
        edits, states = walk([(r[4], r[5]) for r in rows], end, [0] if block == 0 else [0, 1, 2, 3], last)
        for k, r in enumerate(rows):
            was = rows[k - 1][4] if k else prior
            illegal = (k > 0 or block > 0) and was + r[4] not in LEGAL
            held.append((c1, c2, block, r[3], r[5], illegal, edits[k], states if k == len(rows) - 1 and not last else None))
        if len(held) >= 4096:
            yield _batch(held, WALKED)
            held = []
    if held:
        yield _batch(held, WALKED)


CHAIN = {"c1": pa.int64(), "c2": pa.int64(), "block": pa.int64(), "costs": pa.list_(pa.int64()), "last": pa.string()}
ENDS = {"c1": pa.int64(), "c2": pa.int64(), "block": pa.int64(), "ends": pa.list_(pa.int64()), "prior": pa.string(), "is_last": pa.bool_()}
ENTRIES = {"c1": pa.int64(), "c2": pa.int64(), "block": pa.int64(), "entry": pa.int32()}
WALKED = {
    "c1": pa.int64(),
    "c2": pa.int64(),
    "block": pa.int64(),
    "number": pa.int64(),
    "fault": pa.string(),
    "illegal": pa.bool_(),
    "variants": pa.list_(pa.string()),
    "exits": pa.list_(pa.int32()),
}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in kinds.items())


def faults(placed: DataFrame) -> DataFrame:
    """c1, c2 (hash of the conversation), number, initial, fault (blank, duplicate, truncated or null) of numbered rows."""
    c1, c2 = identity("conv_id")
    h1, h2 = identity("conv_id", "role", "text")
    text = F.col("text")
    rows = placed.select(
        c1.alias("c1"),
        c2.alias("c2"),
        "number",
        F.substring("role", 1, 1).alias("initial"),
        text.rlike(f"[^{SPACE}]").alias("has_words"),
        text.rlike(rf"[.!?][{SPACE}]*\z").alias("ends"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    first = rows.groupBy("h1", "h2").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(~F.col("has_words"), "blank").when(F.col("number") > F.col("first"), "duplicate").when(~F.col("ends"), "truncated")
    return rows.join(first, ["h1", "h2"], "left").select("c1", "c2", "number", "initial", fault.alias("fault"))


def audit(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row of ``conversations`` (conv_id, turn, role, text) with its number in the conversation, fault, whether its initial may not
    follow the one before (illegal), the edits before and at it, and their cost.

    Edits are written one after the other: K, D, Ru, Ra, Iu, Ia. ``repaired`` applies them.
    """
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space("role"), one_space("text"))
    placed = numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    light = stored(faults(placed).withColumn("block", F.floor(F.col("number") / block)), "faults")
    by = ["c1", "c2", "block"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*by, "number", "initial", "fault"]
    is_long = light.where("block > 0").select("c1", "c2").distinct()
    of_long = light.join(is_long, ["c1", "c2"], "left_semi").select(*columns)
    chain = of_long.repartition(parts, *by).sortWithinPartitions(*by, "number").mapInArrow(_matrices, _ddl(CHAIN))
    ends = stored(chain.groupBy("c1", "c2").applyInArrow(_ends, _ddl(ENDS)), "block-ends")  # a row for each block of long conversations
    walked = light.select(*columns).join(ends, by, "left").repartition(parts, *by).sortWithinPartitions(*by, "number")
    walked = stored(walked.mapInArrow(_walked, _ddl(WALKED)), "edits")
    entries = walked.where("exits is not null").select(*by, "exits")
    last = ends.where("is_last").select(*by, F.array(*[F.lit(0)] * 4).alias("exits"))
    entries = entries.unionByName(last).groupBy("c1", "c2").applyInArrow(_entries, _ddl(ENTRIES))
    edits = walked.join(entries, by, "left")
    edits = edits.select("c1", "c2", "number", "fault", "illegal", F.element_at("variants", F.coalesce(F.when(F.size("variants") > 1, F.col("entry")), F.lit(0)) + 1).alias("edits"))
    letters = lambda x: F.length("edits") - F.length(F.regexp_replace("edits", x, ""))
    stays = (F.col("fault") == "truncated") & ~F.col("edits").contains("D")
    cost = sum((letters(x) * c for x, c in COST.items() if c), F.when(stays, 1).otherwise(0))
    c1, c2 = identity("conv_id")
    found = placed.withColumns({"c1": c1, "c2": c2}).join(edits, ["c1", "c2", "number"])
    return found.select("conv_id", "number", "turn", "role", "text", "fault", "illegal", "edits", cost.cast("long").alias("cost"))


def repaired(audited: DataFrame) -> DataFrame:
    """conv_id, number, place, role, text of the turns that are left, in order of number and place; inserted ones have an empty text."""
    each = audited.select("*", F.posexplode(F.regexp_extract_all("edits", F.lit("([KD]|[RI][ua])"), F.lit(0))).alias("place", "_edit"))
    new = F.when(F.col("_edit") == "K", F.col("role")).when(F.col("_edit").endswith("u"), "user").otherwise("assistant")
    text = F.when(F.col("_edit").startswith("I"), "").otherwise(F.col("text"))
    return each.where("_edit <> 'D'").select("conv_id", "number", "place", new.alias("role"), text.alias("text"))
