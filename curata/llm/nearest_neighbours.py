"""Nearest neighbours by largest inner product: a block matrix join with int8 tiles.

Candidates are stored once, in files of bounded length. Queries are dealt into blocks of bounded size; a task has a block of
queries and reads a slice of the files, a tile of candidates at a time, so only queries are shuffled, once a slice, and
neither candidates nor pairs ever are. Inside a tile both sides are rounded to int8 with a scale per vector. The int8 product
gives all inner products with a bound on the error,

    |x.y - x'.y'|  <=  |x - x'| |y'| + |x| |y - y'|        (x', y' the rounded vectors),

so whatever cannot be among the k best of the task so far is dropped; what is left is computed again in double precision
from the original vectors, component by component in order. The first tiles of a task are small, as nothing is known to drop by
before them. The k best of each task are merged by heaps, in two steps so that no task sees more than a group of slices of
some queries. Nothing is approximate in the result.

Of candidates with equal vectors in a tile at most k rows of an id can matter, and of those the 2 k with the smallest ids: k at
least are not the query's own. Where a vector has more copies than that the rest are left out first, so a very common vector costs
no more than others.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
null ids neither; a query id that is repeated is one query with the smallest of its vectors, and no row of that id answers
it; repeated candidate rows each take part; ties go to the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import filesystem, shared_path

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 16384
#: Components of a block and products of a step at most; rows of a stored file, of a task's slice of them, of a task's first tile.
COMPONENTS = 4 << 20
FILE_ROWS = 1 << 16
SLICE = 1 << 22
FIRST = 1024
GROUP = 64
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats or doubles) of the rows that take part."""
    # Components stay as they are stored: a float is half the bytes to move, and tiles work in double precision anyway.
    plain = vectors.schema["embedding"].dataType.elementType.simpleString() in ("float", "double")
    v = F.col("embedding") if plain else F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    return rows.where(~odd & F.exists("embedding", lambda x: x != 0))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten()).astype(float)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values of the rows over their largest component, times 127; that component; norm of what rounding took; norm)."""
    most = np.abs(x).max(1)
    most[most == 0] = 1
    x = x / most[:, None]
    i = np.rint(x * 127).astype(np.int8)
    return i, most, np.linalg.norm(x - i / 127, axis=1) * (1 + 1e-9), np.linalg.norm(x, axis=1) * (1 + 1e-9)


def _bounds(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows for products with ``_faced`` candidates: upper bounds, lower bounds, and what the rows were divided by."""
    i, most, lost, norm = _rounded(q)
    # Single precision errs by less than this share of both norms, with the errors of the sums that make exact scores.
    lost = lost + (q.shape[1] + 8) * 2.0**-23 * (norm + lost)
    i = i / 127
    return np.column_stack((i, lost, norm)).astype(np.float32), np.column_stack((i, -lost, -norm)).astype(np.float32), most


def _faced(c: np.ndarray) -> tuple[np.ndarray, float]:
    """Candidates as columns that ``_bounds`` meet, and what they were divided by."""
    i, most, lost, norm = _rounded(c)
    top = most.max()
    return (np.column_stack((i / 127, norm + lost, lost)) * (most / top)[:, None]).astype(np.float32).T, top


def _places(new: np.ndarray) -> np.ndarray:
    """Place of each row in its run; ``new`` marks the first rows of runs."""
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))


def _first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep, by place: where a vector has more than 2 k rows, k of each id at most, and of these the 2 k of the smallest ids."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    mixed = (bits ^ (bits >> np.uint64(29))) @ np.random.default_rng(1).integers(1 << 62, size=x.shape[1], dtype=np.uint64)
    _, alike, n = np.unique(mixed, return_inverse=True, return_counts=True)
    many = n[alike.reshape(-1)] > 2 * k  # rows that equal in bits mix to one number: no others can have so many copies
    if not many.any():
        return np.arange(len(ids))
    some = np.flatnonzero(many)
    order = some[np.argsort(ids[some], kind="stable")]
    same = np.unique(np.ascontiguousarray(x[order]).view([("", x.dtype)] * x.shape[1]).reshape(-1), return_inverse=True)[1]
    same = same.reshape(-1)
    by = np.argsort(same, kind="stable")
    vector, own = same[by], ids[order[by]]
    few = _places((np.diff(vector, prepend=-1) != 0) | (np.append(True, own[1:] != own[:-1]))) < k
    by, vector = by[few], vector[few]
    return np.sort(np.append(np.flatnonzero(~many), order[by[_places(np.diff(vector, prepend=-1) != 0) < 2 * k]]))


def _scores(q: np.ndarray, a: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of q and b of c, summed in the order of components."""
    out = np.empty(len(a))
    step = max(1, COMPONENTS // q.shape[1])
    for i in range(0, len(a), step):
        some = slice(i, i + step)
        out[some] = np.cumsum(q[a[some]] * c[b[some]], axis=1)[:, -1] + 0.0
    return out


def _best(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, places): of each query ``a`` its k best by score, then smaller id."""
    order = np.lexsort((ids, -score, a))
    rank = np.arange(len(a)) - np.searchsorted(a[order], a[order])
    return order[rank < k], rank[rank < k]


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None, bounds=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, exact score): of each query the k best in this tile, and no others.

    With a ``floor``, k-th best scores of other tiles, some of the k that score less may be left out. ``bounds`` are those of ``q``, if at hand.
    """
    keep = _first_copies(c_ids, c, k)
    high, low, divided = bounds or _bounds(q)
    right, top = _faced(c[keep])
    with np.errstate(over="ignore"):
        # Scores that double precision rounds to zero tie, whatever they were.
        small = q.shape[1] * 1e-320
        slack = (small / divided / top + 1e-30).astype(np.float32)
        if floor is not None:
            least = (floor - np.abs(floor) * 2.0**-22 - small) / divided / top - 1e-30
            least = np.where(np.isfinite(floor), least, -np.inf).astype(np.float32)
    out = []
    step = max(1, COMPONENTS // max(1, len(keep)))
    for i in range(0, len(q), step):
        rows = slice(i, min(len(q), i + step))
        if floor is not None:
            bar = least[rows]
        elif len(keep) > k:
            sure = low[rows] @ right
            sure[q_ids[rows, None] == c_ids[keep]] = -np.inf
            bar = np.partition(sure, -k, axis=1)[:, -k] - slack[rows]
        else:
            bar = np.full(rows.stop - i, -np.inf, np.float32)
        a, b = np.divmod(np.flatnonzero((high[rows] @ right >= bar[:, None]).reshape(-1)), len(keep))
        a, b = a + i, keep[b]
        other = q_ids[a] != c_ids[b]
        a, b = a[other], b[other]
        score = _scores(q, a, c, b)
        order, _ = _best(a, c_ids[b], score, k)
        out.append((a[order], b[order], score[order]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _batches(files: list[str], length: int, rows: int):
    """(ids, vectors) of stored candidates of a length, so many at a time."""
    for path in files:
        store, inner, _ = filesystem(path)
        with store.open_input_file(inner) as f:
            for batch in pq.ParquetFile(f).iter_batches(rows, columns=["vec_id", "embedding"]):
                batch = batch.filter(pc.equal(pc.list_value_length(batch["embedding"]), length))
                if len(batch):
                    yield np.asarray(batch["vec_id"]), _matrix(batch["embedding"])


def _search(k: int, files: list[str], slices: int, length: int, rows: int):
    """A task's queries against its slice of the files."""

    def run(batches):
        own = [b for b in batches if len(b)]
        if not own:
            return
        own = pa.Table.from_batches(own).combine_chunks()
        q_ids, q = np.asarray(own["vec_id"]), _matrix(own["embedding"].combine_chunks())
        bounds, floor, seen = _bounds(q), None, 0
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for c_ids, c in _batches(files[own["cell"][0].as_py() % slices :: slices], length, rows):
            at = 0
            while at < len(c_ids):
                some = slice(at, at + max(FIRST, seen))
                a, b, score = tile(q_ids, q, c_ids[some], c[some], k, floor, bounds)
                seen, at = seen + len(c_ids[some]), some.stop
                if len(a):
                    found = tuple(map(np.append, found, (a, c_ids[some][b], score)))
                    order, place = _best(*found, k)
                    found = tuple(x[order] for x in found)
                    floor = np.full(len(q_ids), -np.inf)
                    floor[found[0][place == k - 1]] = found[2][place == k - 1]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "vec_id", "score"])

    return run


def _merged(k: int):
    def merge(batches):
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        for some in (list(heaps)[i : i + 1000] for i in range(0, len(heaps), 1000)):
            rows = [(x, n + 1, -v, s) for x in some for n, (s, v) in enumerate(sorted(heaps[x], reverse=True))]
            names = ("query_id", "rank", "vec_id", "score")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, list(names))

    return merge


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` marks, its k nearest among all rows."""
    spark = vectors.sparkSession
    path = shared_path(spark, "vectors")
    sized = usable(vectors).withColumn("n", F.size("embedding"))
    sized.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    rows = spark.read.schema(sized.schema).parquet(path)
    # The commonest length is the table's; a table with more than a few lengths is at fault.
    length = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    n, files = length["n"], sorted(rows.inputFiles())
    queries = rows.where((F.col("n") == n) & is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most = max(1, COMPONENTS // n)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(1, -(-queries.count() // min(query_block, most)))
    # Few queries are one block, and the files are its tasks; tasks of many blocks read all files, or as many as one should.
    slices = max(1, min(len(files), max(-(-4 * spark.sparkContext.defaultParallelism // q_blocks), -(-length["count"] // SLICE))))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")
    cells = F.sequence(block * slices, block * slices + F.lit(slices - 1))
    dealt = queries.withColumn("cell", F.explode(cells)).repartitionById(q_blocks * slices, F.col("cell"))
    found = dealt.mapInArrow(_search(k, files, slices, n, min(candidate_block, most)), FOUND)
    parts = max(parts, q_blocks)
    if slices > GROUP:  # more answers to a query than one merge should see: first within salted groups
        salted = found.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(-(-slices // GROUP))))
        found = salted.repartition(parts, "query_id", "g").drop("g").mapInArrow(_merged(k), schema).drop("rank")
    return found.repartition(parts, "query_id").mapInArrow(_merged(k), schema)
