"""Best-fit packing of documents into sequences by linear grouping.

1. ``encode`` writes every piece (a document, or a cut of 1024 tokens of a longer one) to flat shard files where it
   was read and returns one manifest row per shard with a histogram of piece lengths: at most ``capacity`` numbers,
   however many documents there are.
2. ``plan`` packs the summed histogram on the driver. Lengths above ``small`` are sorted and cut into ``groups`` of equal
   cardinality, each rounded up to its longest. A dynamic program over these few sizes says which configuration that holds the largest
   size left fills a sequence best, and it is used as often as there are pieces for it, until all large ones are placed; the actual lengths take
   the places of the rounded ones; small lengths go where they fit best, longest first. All steps work on runs (so many equal
   sequences), so the plan's size depends on ``capacity`` and ``groups`` alone.
3. ``pack`` gives each piece its rank among the pieces of its length (prefix sums over shards of the histograms, plus
   its place in the shard) and looks up the sequence and offset that the plan has for that rank.

No text or id is shuffled. Edge cases: a null text is empty (only the end id); repeated rows and repeated or null ids
are separate documents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import map_file, shared_path, stored, write_bytes
from .tokens import encoder

CAPACITY = 1024
GROUPS = 512
SMALL = CAPACITY // 4
SHARD = "path string, n_pieces long, counts array<long>"
PIECES = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
FLUSH_BYTES = 64 << 20


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: one if they fit, else full ones after a first that may be shorter."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return [rest] * bool(rest) + [capacity] * (n // capacity)


def _writer(folder: str, tokenizer: str, end_id: int, capacity: int):
    def write(batches):
        enc = encoder(tokenizer)
        end, width = enc._pack([end_id]), enc.dtype.itemsize

        def flush(parts, rows):
            path = f"{folder}/pieces-{uuid.uuid4().hex}"
            table = np.array(rows, "<i8").reshape(-1, 5)
            write_bytes(path + ".bin", np.frombuffer(b"".join(parts), np.uint8))
            write_bytes(path + ".tab", table)
            counts = np.bincount(table[:, 4], minlength=capacity + 1)
            return pa.RecordBatch.from_pydict(
                {"path": [path], "n_pieces": [len(table)], "counts": pa.array([counts.tolist()], pa.list_(pa.int64()))}
            )

        parts, rows, held = [], [], 0
        for batch in batches:
            for text, doc in zip(batch.column("text"), batch.column("doc_id"), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                start = 0
                for k, n in enumerate(cut(len(ids) // width, capacity)):
                    rows.append((doc.is_valid, doc.as_py() or 0, k, start, n))
                    start += n
                parts.append(ids)
                held += len(ids)
                if held >= FLUSH_BYTES:
                    yield flush(parts, rows)
                    parts, rows, held = [], [], 0
        if rows:
            yield flush(parts, rows)

    return write


def encode(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Write all pieces; returns the manifest: path, n_pieces, counts (pieces of each length 0..capacity)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_path(docs.sparkSession, "pieces")
    return stored(rows.mapInArrow(_writer(folder, tokenizer, end_id, capacity), SHARD), "piece-manifest")


def _fullest(sizes: list[int], number: list[int], room: int) -> dict[int, int]:
    """How often each size (by its place, sizes falling) fills ``room`` best, none more often than there is; larger sizes where fills are equal.

    Bit t of ``reach`` says that some choice fills t. Going back from the best fill leaves out small sizes where it can.
    """
    whole, reach, steps = (2 << room) - 1, 1, []
    for i, size in enumerate(sizes):
        for _ in range(min(number[i], room // size)):
            more = (reach | reach << size) & whole
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
    used, left = {}, reach.bit_length() - 1
    for i, without in reversed(steps):
        if not without >> left & 1:
            used[i] = used.get(i, 0) + 1
            left -= sizes[i]
    return used


def configurations(sizes: list[int], number: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(how often each size, uses), until all are placed: the fullest configuration that holds the largest size left, as often as there is enough.

    ``sizes`` fall. Each configuration uses up a size, or all of it but what is not enough for another use, so there are a few for each size.
    """
    number, out = list(number), []
    for i, size in enumerate(sizes):
        while number[i]:
            number[i] -= 1
            used = _fullest(sizes[i:], number[i:], capacity - size)
            number[i] += 1
            often = {i + j: n for j, n in used.items()}
            often[i] = often.get(i, 0) + 1
            uses = min(number[j] // n for j, n in often.items())
            for j, n in often.items():
                number[j] -= n * uses
            out.append((often, uses))
    return out


def _grouped(counts: np.ndarray, groups: int, small: int) -> dict[int, list[list[int]]]:
    """Rounded size -> its [length, number], longest first, in groups of equal cardinality of the lengths above ``small``."""
    large = [int(n) for n in np.flatnonzero(counts) if n > small][::-1]
    each = max(1, -(-int(sum(counts[n] for n in large)) // groups))
    members: dict[int, list[list[int]]] = {}
    held = top = 0
    for n in large:
        todo = int(counts[n])
        while todo:
            top = top if held else n
            take = min(todo, each - held)
            own = members.setdefault(top, [])
            if own and own[-1][0] == n:
                own[-1][1] += take
            else:
                own.append([n, take])
            held = (held + take) % each
            todo -= take
    return members


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset) that place every piece of the histogram ``counts``.

    Ranks r .. r + number - 1 of a length go to sequences first .. first + number - 1 at the offset.
    """
    counts = np.asarray(counts, np.int64)
    members = _grouped(counts, groups, small)
    sizes = sorted(members, reverse=True)
    number = [sum(c for _, c in members[s]) for s in sizes]
    rank = dict.fromkeys(range(capacity + 1), 0)
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    sequence = 0
    # Substitute the actual lengths, longest first within a group; a run splits where a length ends.
    for often, uses in configurations(sizes, number, capacity):
        config = [sizes[i] for i, k in sorted(often.items()) for _ in range(k)]
        while uses:
            run = min(uses, *(max(1, members[x][0][1] // config.count(x)) for x in set(config)))
            used = 0
            for x in config:
                n, c = members[x][0]  # holds a whole run, or the run is one sequence
                rows.append((n, rank[n], run, sequence, used))
                rank[n] += run
                members[x][0][1] -= run
                if c == run:
                    members[x].pop(0)
                used += n
            rooms.setdefault(capacity - used, []).append((sequence, run))
            sequence += run
            uses -= run
    # Best fit of the small lengths, longest first, into the tightest rooms: as many into each as it holds.
    keys = sorted(rooms)

    def give(room: int, first: int, number: int) -> None:
        if room not in rooms:
            bisect.insort(keys, room)
        rooms.setdefault(room, []).append((first, number))

    for n in range(capacity, 0, -1):
        todo = int(counts[n]) - rank[n] if n < len(counts) else 0
        while todo:
            at = bisect.bisect_left(keys, n)
            if at == len(keys):
                number = -(-todo // (capacity // n))
                give(capacity, sequence, number)
                sequence += number
                continue
            room = keys[at]
            first, number = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            deep = room // n
            full = min(number, todo // deep)
            for filled, times in ((deep, full), (todo % deep, int(full < number and todo // deep == full and todo % deep > 0))):
                if times:
                    for k in range(filled):
                        rows.append((n, rank[n], times, first, capacity - room + k * n))
                        rank[n] += times
                    give(room - filled * n, first, times)
                    first, number, todo = first + times, number - times, todo - times * filled
            if number:
                give(room, first, number)
    return np.array(rows, np.int64).reshape(-1, 5)


def _reader(placed: dict[int, np.ndarray], tokenizer: str):
    def read(batches):
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            for row in batch.to_pylist():
                data, table = map_file(row["path"] + ".bin", dtype), map_file(row["path"] + ".tab", "<i8").reshape(-1, 5)
                lengths = np.asarray(table[:, 4])
                rank = np.empty(len(table), np.int64)
                sequence, offset = np.empty(len(table), np.int64), np.empty(len(table), np.int64)
                order = np.argsort(lengths, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                    n = int(lengths[group[0]])
                    rank[group] = row["base"][n] + np.arange(len(group))
                    own = placed[n]
                    k = np.searchsorted(own[:, 1], rank[group], "right") - 1
                    sequence[group] = own[k, 3] + rank[group] - own[k, 1]
                    offset[group] = own[k, 4]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                for i in range(0, len(table), 512):
                    j = min(len(table), i + 512)
                    wide = np.asarray(data[bounds[i] : bounds[j]]).astype("<u4")
                    cuts = ((bounds[i : j + 1] - bounds[i]) * 4).astype(np.int32)
                    t = np.asarray(table[i:j])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(t[:, 1], pa.int64(), mask=t[:, 0] == 0),
                            pa.array(t[:, 2].astype(np.int32)),
                            pa.array(t[:, 3]),
                            pa.array(t[:, 4]),
                            pa.array(sequence[i:j]),
                            pa.array(offset[i:j]),
                            pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(wide)]),
                        ],
                        ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"],
                    )

    return read


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece."""
    manifest = encode(docs, tokenizer, end_id, capacity)
    by_length = manifest.select("path", F.posexplode("counts").alias("length", "n")).where("n > 0")
    total = np.zeros(capacity + 1, np.int64)
    for r in by_length.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity + 1 rows at most
        total[r["length"]] = r["n"]
    rows = plan(total, capacity, groups, small)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    placed = {int(g[0, 0]): g for g in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(g)}
    # A length's window has one row per shard.
    before = Window.partitionBy("length").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_length.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = bases.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("base"))
    spread = bases.select("path", F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda n: F.col("base")[n]).alias("base"))
    # By ranges and a number, which Spark neither drops nor merges, however small the rows are: some tens of megabytes of ids a task.
    return spread.repartitionByRange(max(1, manifest.count()), "path").mapInArrow(_reader(placed, tokenizer), PIECES)
