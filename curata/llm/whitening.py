"""Embedding whitening: leading eigenvectors of a covariance by a block Jacobi-Davidson method, matrix-free.

1. ``fit`` makes integers of the entries, x = floor(64 c) + 1000000, and takes each different vector once: the fit list, stored
   as centred float64 rows (n x - S) / n in blocks, S being the exact sums. The covariance itself is never formed: a product with it is one pass over the blocks, in
   which each task sums (its rows)' (its rows) B, and a few tasks add those sums up.
2. ``jacobi_davidson`` keeps a subspace and its product. Rayleigh-Ritz gives the leading pairs; a pair whose residual is as small as
   double precision allows is locked. For the others a few steps of MINRES solve the projected correction equation
   (I - Q Q')(V - e I)(I - Q Q') t = -r, Q being locked vectors and the pair's own, all pairs in the same passes, and the solutions
   widen the subspace, which is restarted from its best vectors when it is full.
3. ``transform`` projects every row, the repeated ones too.

The driver holds a few dozen vectors of the embedding's length; tasks send sums of that size. Edge cases: vectors that are null, or hold null or non-finite
entries, take no part, nor do those of another length than most or with entries beyond 2 ** 34 in size (their integers would
not stay exact); a null vec_id and repeated ids stay; a fit list that varies in fewer dimensions than components asked for
has fewer components, and none if all vectors are equal; an empty table gives no rows; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import parts_for, stored

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 34)
ROWS = 4096  # rows of a stored block
WIDTH = 16  # tasks that add up partial sums
STEPS = 6  # MINRES steps a correction
EPS = float(np.finfo(float).eps)


@dataclass
class Fit:
    """What ``transform`` needs: n, exact sums, mean, components as columns, their eigenvalues, trace, and how far whitened data are from identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, their entries as doubles."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return vectors.where(F.col("embedding").isNotNull()).where(~odd)


def _integers(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten()).astype(float)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(col), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, one rounding an entry where n x fits 64 bits."""
    top = max([abs(s) for s in sums], default=0)
    if max(top, n * int(np.abs(x).max(initial=0))) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


class Product:
    """The covariance of a stored fit list as an operator on blocks of vectors."""

    def __init__(self, blocks: DataFrame, n: int, size: int):
        self.blocks, self.n, self.size, self.passes = blocks, n, size, 0
        self.parts = blocks.rdd.getNumPartitions()

    def summed(self, of, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of what ``of`` makes of a block; tasks send one array each, WIDTH tasks add these up."""
        size = self.size

        def part(batches):
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column("rows"):
                    total += of(np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, size))
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

        def add(batches):
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column("total"):
                    total += np.frombuffer(raw.as_buffer(), "<f8").reshape(shape)
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

        partial = self.blocks.mapInArrow(part, "total binary")
        if self.parts > WIDTH:
            partial = partial.repartition(WIDTH).mapInArrow(add, "total binary")
        found = sorted(r["total"] for r in partial.collect())  # sorted, so that a rerun adds in the same order; WIDTH rows at most
        self.passes += 1
        return np.sum([np.frombuffer(x, "<f8").reshape(shape) for x in found], axis=0) if found else np.zeros(shape)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        shared = np.ascontiguousarray(b)
        return self.summed(lambda rows: rows.T @ (rows @ shared), b.shape) / self.n


def _orthogonal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal among themselves and against ``basis``; what adds no direction goes."""
    out = basis
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        v = column / size
        for _ in range(3):
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8 or not np.isfinite(left):
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out[:, basis.shape[1] :]


def minres(product, values: np.ndarray, against: list[np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Solutions t of (I - QQ')(V - e I)(I - QQ') t = b for several (e, Q, b) at once, a pass a step: the least residual in each Krylov space."""
    b = np.column_stack([r - q @ (q.T @ r) for r, q in zip(right.T, against, strict=True)])
    m, size = b.shape[1], np.linalg.norm(b, axis=0)
    bases = [[b[:, k] / size[k]] if size[k] > 0 else [] for k in range(m)]
    small: list[list[np.ndarray]] = [[] for _ in range(m)]  # columns of the tridiagonal matrices
    for _ in range(steps):
        live = [k for k in range(m) if bases[k] and len(bases[k]) == len(small[k]) + 1]
        if not live:
            break
        made = product(np.column_stack([bases[k][-1] for k in live]))
        for k, w in zip(live, made.T, strict=True):
            w = w - values[k] * bases[k][-1]
            w = w - against[k] @ (against[k].T @ w)
            known = np.column_stack(bases[k])
            h = known.T @ w
            w = w - known @ h
            more = known.T @ w
            w = w - known @ more
            beta = np.linalg.norm(w)
            small[k].append(np.append(h + more, beta))
            if beta > 1e-12 * max(abs(values[k]), 1e-300):
                bases[k].append(w / beta)
    out = np.zeros_like(b)
    for k in range(m):
        j = len(small[k])
        if j:
            t = np.zeros((j + 1, j))
            for i, column in enumerate(small[k]):
                t[: len(column), i] = column
            right_side = np.zeros(j + 1)
            right_side[0] = size[k]
            y = np.linalg.lstsq(t, right_side, rcond=None)[0]
            out[:, k] = np.column_stack(bases[k][:j]) @ y
    return out


def jacobi_davidson(product, size: int, k: int, steps: int = STEPS, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric positive semidefinite operator, unit eigenvectors (columns), and residual norms.

    ``product`` maps a block of columns. Ends when all residuals are of the size of rounding errors, relative to the largest
    eigenvalue; raises where that is not reached in ``rounds`` rounds.
    """
    k = min(k, size)
    most = min(size, max(4 * k, k + 32))
    basis = _orthogonal(np.random.default_rng(seed).standard_normal((size, min(size, k + 4))), np.zeros((size, 0)))
    image = product(basis)
    for _ in range(rounds):
        h = basis.T @ image
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        u, au = basis @ s, image @ s
        residual = au[:, :k] - u[:, :k] * e[:k]
        length = np.linalg.norm(residual, axis=0)
        enough = 8 * EPS * np.sqrt(size) * max(e[0], 0)
        # Locked: a leading run of pairs at double precision. In the whole space Rayleigh-Ritz leaves rounding errors only.
        locked = k if basis.shape[1] == size or (length <= enough).all() else int((length > enough).argmax())
        if locked == k:
            return e[:k], u[:, :k], length
        todo = [j for j in range(locked, k) if length[j] > enough]
        if basis.shape[1] + len(todo) > most:
            keep = min(u.shape[1], max(k + 8, most // 2))
            basis, image = u[:, :keep], au[:, :keep]
        own = [np.column_stack([u[:, :locked], u[:, j]]) for j in todo]
        t = minres(product, e[todo], own, -residual[:, todo], steps)
        new = _orthogonal(t, basis)
        if not new.shape[1]:
            new = _orthogonal(np.random.default_rng(seed + basis.shape[1]).standard_normal((size, 1)), basis)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise ArithmeticError(f"residuals {length.tolist()} after {rounds} rounds")


def _packer(n: int, sums: list[int]):
    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                yield pa.RecordBatch.from_pydict({"rows": [_centred(_integers(batch.column("embedding")[i : i + ROWS]), n, sums).astype("<f8").tobytes()]})

    return run


def fit(vectors: DataFrame, k: int = 16, steps: int = STEPS) -> Fit:
    """The ``k`` leading components of the different vectors of ``vectors`` (embedding)."""
    rows = usable(vectors).select(F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double"))).alias("embedding"))
    # Whole numbers below 2 ** 40, as doubles / SCALE so that the same helper reads rows here and in ``transform``; each vector once.
    different = stored(rows.distinct().select(F.transform("embedding", lambda c: c / F.lit(float(SCALE))).alias("embedding"), F.size("embedding").alias("length")), "fit-list")
    lengths = different.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not lengths or not lengths[0]["length"]:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, np.zeros(0))
    size, n = lengths[0]["length"], lengths[0]["count"]
    different = different.where(F.col("length") == size).select("embedding")
    sums = _sums(different, size)
    parts = max(1, min(parts_for(different), -(-n // ROWS)))
    blocks = stored(different.coalesce(parts).mapInArrow(_packer(n, sums), "rows binary"), "fit-blocks")
    product = Product(blocks, n, size)
    trace = float(product.summed(lambda x: (x * x).sum(0), (size,)).sum()) / n
    if not trace > 0:
        return Fit(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0, 0.0, np.zeros(0))
    e, u, residual = jacobi_davidson(product, size, k, steps)
    real = e > 64 * EPS * size * e[0]
    e, u = e[real], u[:, real]
    scaled = u / np.sqrt(e)
    moments = product.summed(lambda x: np.vstack([(w := x @ scaled).T @ w, w.sum(0)]), (len(e) + 1, len(e)))
    mean = moments[-1] / n
    off = np.abs(moments[:-1] / n - np.outer(mean, mean) - np.eye(len(e))).max()
    return Fit(n, sums, u, e, trace, float(off), residual[real])


def _sums(rows: DataFrame, size: int) -> list[int]:
    """Exact sums of the integers of each dimension."""

    def part(batches):
        low, high = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _integers(batch.column("embedding"))
            low += (x & 0xFFFFF).sum(0)
            high += (x >> 20).sum(0)
        yield pa.RecordBatch.from_pydict({"dimension": np.arange(size), "low": low, "high": high})

    made = rows.mapInArrow(part, "dimension long, low long, high long").groupBy("dimension").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    found = {r["dimension"]: (r["high"] << 20) + r["low"] for r in made.collect()}  # a row for each dimension
    return [found.get(d, 0) for d in range(size)]


def transform(vectors: DataFrame, fit: Fit) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row that takes part and each component."""
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = vectors.schema["vec_id"].dataType
    schema = schema.format(kind.simpleString())
    k, size = len(fit.eigenvalues), len(fit.sums)
    rows = usable(vectors).where(F.size("embedding") == size)
    rows = rows.select("vec_id", "embedding") if k else rows.select("vec_id", "embedding").limit(0)
    scaled = fit.components / np.sqrt(fit.eigenvalues)
    explained = fit.eigenvalues / fit.trace if k else np.zeros(0)
    sums = np.array(fit.sums, object)
    n, off = fit.n, fit.identity_error

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                some = batch.slice(i, ROWS)
                x = _integers(some.column("embedding"))
                c = _centred(x, n, fit.sums)
                w = c @ scaled
                if n * float(np.abs(c).max(initial=0)) < 2**31 / max(1, size) ** 0.5 and n * float(np.abs(x).max(initial=0)) < 2**62:
                    d = n * x - sums.astype(np.int64)
                    deviation = pa.array((d * d).sum(1))
                else:
                    whole = [sum((n * v - s) ** 2 for v, s in zip(line, fit.sums, strict=True)) for line in x.tolist()]
                    deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
                each = np.repeat(np.arange(len(some)), k)
                m = len(each)
                columns = [
                    some.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                    pa.array(np.full(m, n, np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, len(some))),
                    pa.array(np.full(m, off)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
