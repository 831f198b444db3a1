"""Chat formatting: conversations as budgeted windows of marked turns, with a loss mask.

A turn is written ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. Control strings inside texts and roles (those of the
template and other common ones) get a backslash after their first character, and such a string that already has backslashes there
one more, so ``unescape`` gives back every text; other backslashes stay as they are.

A conversation is cut into windows of whole turns with at most ``budget`` tokens: prefix sums of the turns' tokens say where a window ends. Each window
after the first begins with the system turn (if the conversation begins with one) and the last turns before it, at most
``history_turns`` and ``history_tokens``, and fewer where the next turn would not fit. Loss is taken on texts of assistant turns, and
on no repeated turn, so each assistant text is a target once. Turns are never cut: one that does not fit is alone in its window, with
the system turn but no history, and that window is longer than the budget.

Turns are numbered over all tasks (``sequences.numbered``) and cut into blocks of BLOCK turns; a block is one group of a task and no window
reaches over its end, while history and the system turn are copied into the next. So a conversation of any length is spread
over tasks. Edge cases: rows go by turn (nulls first), then role, then text; a null text or role is empty; a null conv_id is one
conversation; repeated rows are turns of their own; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import groups, numbered, rows_of
from .tokens import encoder

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)
WINDOW = "conv_id {}, block long, window int, first long, n_repeated int, n_turns int, n_tokens long, text string, loss array<struct<start:int,end:int>>"
TURNS = "conv_id {}, first long, n_turns int, roles array<string>, texts array<string>, targets array<string>, n_chars long"


def escape(text: str) -> str:
    """``text`` without control strings."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def spans(tokens: list[int], fixed: int, before: list[int], budget: int, history_turns: int, history_tokens: int) -> list[tuple[int, int, int]]:
    """(turns repeated, first turn, end) of each window over turns of so many tokens.

    ``fixed``: tokens of the system turn that windows repeat. ``before``: tokens of turns that come before these and may be repeated.
    """
    sums = np.concatenate([[0], np.cumsum([*before, *tokens], dtype=np.int64)])
    n, i, out = len(sums) - 1, len(before), []
    while i < n:
        room = budget - fixed - int(tokens[i - len(before)])
        low = int(np.searchsorted(sums, sums[i] - min(room, history_tokens), "left")) if room > 0 else i
        start = min(i, max(i - history_turns, low))
        end = max(i + 1, int(np.searchsorted(sums, sums[start] + budget - fixed, "right")) - 1)
        out.append((i - start, i - len(before), end - len(before)))
        i = end
    return out


def _windows(tokenizer: str, budget: int, history_turns: int, history_tokens: int, key: pa.DataType):
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (key, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), loss_type)
    names = [part.split()[0] for part in WINDOW.split(", ")]

    def run(batches):
        count = encoder(tokenizer)
        width = count.dtype.itemsize
        held, size = [], 0
        for (conv, block), rows in groups(batches, 2):
            turns = []  # (number, role, text, marked up, place of the text, tokens, copied from before)
            for _, _, number, role, text, copied in rows:
                head, body = f"{START}{_role(role)}\n", escape(text)
                whole = f"{head}{body}{END}\n"
                turns.append((number, role, whole, len(head), len(head) + len(body), len(count.encode(whole)) // width, copied))
            system = next((t for t in turns if t[0] == 0 and t[1] == "system"), None)
            # The system turn is put first by itself, and counts as history nowhere.
            own = [t for t in turns if not t[6]]
            past = [t for t in turns if t[6] and t is not system]
            body = own[1:] if system is not None and not system[6] else own
            fixed = system[5] if system is not None else 0
            plan = spans([t[5] for t in body], fixed, [t[5] for t in past], budget, history_turns, history_tokens)
            if not plan and own:
                plan = [(0, 0, 0)]  # a system turn alone
            both = [*past, *body]
            for k, (repeated, i, j) in enumerate(plan):
                window = both[len(past) + i - repeated : len(past) + j]
                lead = system is not None
                window = [system, *window] if lead else window
                is_new = lead and k == 0 and not system[6]
                again = repeated + (lead and not is_new)
                text, loss = "", []
                parts, at = [], 0
                for place, t in enumerate(window):
                    if t[1] == "assistant" and place >= again:
                        loss.append({"start": at + t[3], "end": at + t[4]})
                    parts.append(t[2])
                    at += len(t[2])
                text = "".join(parts)
                first = system[0] if is_new else window[again][0]
                held.append((conv, block, k, first, again, len(window), sum(t[5] for t in window), text, loss))
                size += len(text)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


def format_windows(
    conversations: DataFrame,
    tokenizer: str,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    block: int = BLOCK,
) -> DataFrame:
    """A row for each window: conv_id, block and window (its place), first (number of its first new turn), n_repeated (turns at its head that
    are in earlier windows too), n_turns, n_tokens, text, loss (spans of code points of the text)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", empty("role"), empty("text"))
    placed = numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    placed = placed.withColumn("block", F.floor(F.col("number") / block)).select("conv_id", "block", "number", "role", "text")
    own = placed.withColumn("copied", F.lit(False))
    # What a later block repeats: the last turns of the one before, and the system turn (a copy for each block of a long conversation).
    last = placed.groupBy("conv_id").agg(F.max("block").alias("n_blocks")).where("n_blocks > 0").withColumnRenamed("conv_id", "c")
    of_long = placed.join(last, F.col("conv_id").eqNullSafe(F.col("c")))
    is_system = (F.col("number") == 0) & (F.col("role") == "system")
    at_end = (F.col("number") % block >= block - history_turns) & (F.col("block") < F.col("n_blocks"))
    target = F.when(is_system, F.sequence(F.lit(1), F.col("n_blocks"))).when(at_end, F.array(F.col("block") + 1))
    copies = of_long.where(is_system | at_end).withColumn("block", F.explode(target)).withColumn("copied", F.lit(True)).select(own.columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(copies).repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "number")
    kind = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt.mapInArrow(_windows(tokenizer, budget, history_turns, history_tokens, to_arrow_type(kind)), WINDOW.format(kind.simpleString()))


def _parsed(key: pa.DataType):
    strings = pa.list_(pa.string())

    def run(batches):
        for conv, first, again, text, loss in rows_of(batches, 64):
            turns = _TURN.findall(text)
            if sum(len(START) + len(r) + 1 + len(t) + len(END) + 1 for r, t in turns) != len(text):
                raise ValueError("a window does not follow the template")
            new = turns[again:]
            targets = [unescape(text[s["start"] : s["end"]]) for s in loss]
            values = [conv], [first], [len(new)], [[_plain_role(r) for r, _ in new]], [[unescape(t) for _, t in new]], [targets], [len(text)]
            kinds = (key, pa.int64(), pa.int32(), strings, strings, strings, pa.int64())
            names = ["conv_id", "first", "n_turns", "roles", "texts", "targets", "n_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    return run


def read_back(windows: DataFrame) -> DataFrame:
    """What windows hold, by parsing their texts: conv_id, first, n_turns (new turns), their roles and texts, targets (texts under the mask),
    n_chars (code points of the window)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = windows.schema["conv_id"].dataType
    chosen = windows.select("conv_id", "first", "n_repeated", "text", "loss")
    return chosen.mapInArrow(_parsed(to_arrow_type(kind)), TURNS.format(kind.simpleString()))
