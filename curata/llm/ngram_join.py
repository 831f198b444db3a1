"""Near-duplicate documents: Jaccard join on word n-grams by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct shingles of ``k`` words (A-Z lowered); two documents link when
100 * intersection >= percent * union. Documents with equal sets form a class (128-bit fingerprint) and only classes
are joined, so exact copies cost one row each.

Order and classes of tokens. A sketch of counts over all documents (slots by input size, 64 MB at most; exact
sums per slot, kept as a byte on a logarithmic scale, so that it doesn't saturate) estimates how frequent a token is. Tokens are
ordered rare before frequent, then by estimate and hash; a token is frequent above ``FREQUENT`` and four times the mean slot. A second
one over the signatures leaves out those that occur once. Sketches only steer the work: results are exact for any of them.

Signatures. A document of n tokens may miss m = n - ceil(percent * n / 100) of them in a partner. If m + 1 of its tokens are
rare, each of those is a signature. Otherwise all r rare ones are, and the prefix is extended: frequent tokens enter as combinations
of two neighbours in the order, very frequent ones (above ``VERY`` times the bound of frequent ones) as combinations of three. A
missing token breaks k combinations of k and a token that only the partner has breaks k - 1, so the prefix goes on until no allowed number
of missing and added tokens breaks all its signatures. The first signature in the order that two linked sets have in common then
lies in the prefixes of both. Combinations of k need sets of a least size; smaller sets, and those that may link with smaller
ones, also give the signatures for combinations of fewer tokens.

Buckets (the classes with one signature) that hold the same classes are one bucket: a group of copies shares dozens of signatures.

Candidates are compared inside tasks by parity sketches: a bit a slot says whether an odd number of the set's tokens fall
into it, so the bits that differ between two sketches are never more than the tokens that differ between the sets. A sketch has
four to eight bits a token, so the bound is near the truth at any length. Pairs never become rows unless they pass it.

Rounds. (1) Every bucket is dealt into blocks of some ``ROWS`` classes, each class in one block, so the work grows with the rows.
A block gives all pairs that pass if these are few, else the shortest tree (by differing bits) over each set of classes that pass with
one another. The sets of these pairs are compared in full, and verified pairs join components. Most buckets are done then.
(2) What is left (several components, and more pairs or more blocks than were looked at) is compared block against block; of all
pairs that pass, a shortest tree between components is verified. (3) Where that left several components, all pairs between
two of them that pass and haven't been refused are verified. After that no pair is left that could link. Rounds 2 and 3 hold classes
of dense groups only; a large group of copies that link is one component after the first.

Edge cases: texts without words, or null, have an empty set and link with nothing (their component is their own id); fewer
words than k make one shingle; null ids are allowed (a component's id is its smallest non-null id); repeated rows and ids
are separate documents of one class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Shelf, free_names, identity, quoted, stored
from .words import mix, shingle_hashes, slices, word_hashes

FREQUENT = 40
VERY = 25
BLOCK = 1 << 16
ROWS = 512
TEXTS = "fp binary, text string"


def sketch_slots(docs: DataFrame, bytes_each: int, most: int = 1 << 26) -> int:
    """Slots for a table stored at its estimated size: one for each ``bytes_each``, ``most`` at most, whole blocks."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(most, -(-max(1, min(size, 1 << 50) // bytes_each) // BLOCK) * BLOCK)


def _sets(col: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    for i, j in slices(col):
        h, bounds = word_hashes(col[i:j])
        s, cut = shingle_hashes(h, bounds, k)
        for d in range(j - i):
            yield np.unique(s[cut[d] : cut[d + 1]])


def slot(tokens: np.ndarray, slots: int) -> np.ndarray:
    """Places 0 .. slots - 1 (2 ** 32 at most) of 64-bit hashes."""
    return ((tokens >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _shingles(k: int):
    def hashes(batch):
        for i, j in slices(batch.column("text")):
            h, bounds = word_hashes(batch.column("text")[i:j])
            yield shingle_hashes(h, bounds, k)[0]

    return hashes


def _longs(name: str):
    def hashes(batch):
        col = batch.column(name)
        yield np.asarray(col.flatten() if pa.types.is_list(col.type) else col).view(np.uint64)

    return hashes


def _packed(block: np.ndarray) -> bytes:
    """The counts that are not zero with the gaps between them, byte plane by byte plane: a byte or two for each."""
    at = np.flatnonzero(block)
    both = np.stack([np.diff(at, prepend=0), block[at].astype(np.int64)]).astype("<u2")
    return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 2).transpose(0, 2, 1)), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts)"""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 2, -1).astype(np.int64)
    gaps, counts = planes[:, 0] + 256 * planes[:, 1]
    return np.cumsum(gaps), counts


def _counter(hashes, slots: int):
    def count(batches):
        total = np.zeros(slots, np.uint16)
        for batch in batches:
            for h in hashes(batch):
                at, n = np.unique(slot(h, slots), return_counts=True)
                total[at] = np.minimum(65535, total[at] + n)
        for b, block in enumerate(total.reshape(-1, BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": [_packed(block)]})

    return count


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 15, then eight steps for each doubling."""
    steps = 16 + np.floor(8 * np.log2(np.maximum(counts, 16) / 16))
    return np.where(counts < 16, counts, np.minimum(255, steps)).astype(np.uint8)


def _adder(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = total.setdefault(b, np.zeros(BLOCK, np.int64))
            at, n = _unpacked(counts)
            block[at] += n
    for b, block in total.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": [_packed(scaled(block))]})


def sketch(rows: DataFrame, hashes, slots: int) -> np.ndarray:
    """Scaled counts of all hashes that ``hashes`` finds in the rows, in ``slots`` (whole blocks) of a byte."""
    schema = "block int, counts binary"
    parts = rows.mapInArrow(_counter(hashes, slots), schema)
    # A task adds up whole blocks as they come in, so it holds no more than the blocks dealt to it.
    merged = parts.repartition("block").mapInArrow(_adder, schema)
    total = np.zeros((slots // BLOCK, BLOCK), np.uint8)
    for row in merged.collect():  # a byte a slot in all
        at, n = _unpacked(row["counts"])
        total[row["block"], at] = n
    return total.reshape(-1)


def often_from(frequency: np.ndarray) -> tuple[int, int]:
    """Scaled counts above which a token is frequent (40, or four times the mean slot's) and very frequent."""
    levels = sum(np.bincount(part, minlength=256) for part in np.array_split(frequency, max(1, len(frequency) >> 20)))
    counts = np.where(np.arange(256) < 16, np.arange(256), 16 * 2.0 ** ((np.arange(256) - 16) / 8))
    least = max(FREQUENT, 4 * float((levels * counts).sum() / max(1, levels.sum())))
    often, very = scaled(np.array([least, VERY * least]))
    return int(often), int(very)


def _breaks(n: int, percent: int, rare: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(missing beyond the ``rare`` ones, tokens added) of all partners of n tokens that lack all rare ones, at their most."""
    lost = np.arange(rare, n - -(-percent * n // 100) + 1)
    return lost - rare, 100 * (n - lost) // percent - n


@lru_cache
def least_sizes(percent: int, most: int = 3, scan: int = 2000) -> tuple[int, ...]:
    """For k = 1 .. ``most`` the size from which on sets have tokens enough for combinations of k."""
    found = [0]
    for k in range(2, most + 1):
        short = [n for n in range(1, scan) if (lambda x, y: (k * x + (k - 1) * y).max() + 5 > n)(*_breaks(n, percent))]  # noqa: B023
        found.append(short[-1] + 1 if short and short[-1] < scan - 1 else 1 << 62 if short else 0)
    return tuple(found)


def _combined(tokens: np.ndarray, k: int, most: int) -> np.ndarray:
    """Hashes of the first ``most`` combinations of k neighbours."""
    n = max(0, min(most, len(tokens) - k + 1))
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + n] + np.uint64(k))
    return total


def signatures(tokens: np.ndarray, frequency: np.ndarray, percent: int, above: tuple[int, int] | None = None) -> np.ndarray:
    """Signature hashes of one set; sets that link have one in common, unless they are equal."""
    n = len(tokens)
    missing = n - -(-percent * n // 100)
    if missing == 0 and 100 * n // percent <= n:
        return tokens[:0]
    often, very = often_from(frequency) if above is None else above
    count = frequency[slot(tokens, len(frequency))]
    kind = 1 + (count > often).astype(np.int8) + (count > very)
    sizes = least_sizes(percent)
    largest = lambda size: max(k for k, least in enumerate(sizes, 1) if least <= size)
    found = []
    for most in range(largest(-(-percent * n // 100)), largest(n) + 1):
        of = np.minimum(kind, most)
        ordered = tokens[np.lexsort((tokens, count, of))]
        rare, pairs = int((of == 1).sum()), int((of == 2).sum())
        found.append(mix(ordered[: min(rare, missing + 1)]))
        if rare > missing:
            continue
        lost, added = _breaks(n, percent, rare)
        there = max(0, pairs - 1)
        broken = int((2 * lost + added).max())
        found.append(_combined(ordered[rare : rare + pairs], 2, broken + 1))
        if there > broken or most < 3:
            continue
        # What can still be lost or added once all pairs are broken, a missing token for two of them, an added one for one.
        by_lost = np.minimum(2 * lost, there)
        spared = added - (there - by_lost)
        left = np.where(spared >= 0, 3 * (lost - by_lost / 2) + 2 * spared, -1)
        found.append(_combined(ordered[rare + pairs :], 3, int(np.floor(left.max())) + 1))
    return np.concatenate(found)


def parity(tokens: np.ndarray) -> bytes:
    """The parity sketch of a set: 2 ** i bits, 64 at least, four to eight for each token."""
    bits = max(64, 1 << int(4 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signer(k: int, percent: int, frequency, above: tuple[int, int]):
    def sign(batches):
        for batch in batches:
            n, fp, signs, bits = [], [], [], []
            for s in _sets(batch.column("text"), k):
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signs.append(np.unique(signatures(s, frequency.value, percent, above)).view(np.int64))
                bits.append(parity(s))
            cut = np.cumsum([0, *map(len, signs)]).astype(np.int32)
            flat = np.concatenate(signs) if signs else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), lists, pa.array(bits, pa.binary())],
                ["doc_id", "key", "n", "fp", "signs", "bits"],
            )

    return sign


def _bucket_rows(seen):
    """(sign, fp) of the signatures that may occur twice."""

    def rows(batches):
        counts = seen.value
        for batch in batches:
            signs = batch.column("signs")
            flat = np.asarray(signs.flatten())
            owner = np.repeat(np.arange(len(signs)), np.diff(np.asarray(signs.offsets)))
            hit = counts[slot(flat.view(np.uint64), len(counts))] > 1
            at = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), batch.column("fp").take(at)], ["sign", "fp"])

    return rows


def _wanted_texts(k: int, wanted):
    def pick(batches):
        marks = wanted.value
        for batch in batches:
            hit = pa.array(marks[slot(np.asarray(batch.column("h")).view(np.uint64), len(marks))] > 0)
            text = batch.column("text").filter(hit)
            fp = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in _sets(text, k)]
            for i in range(0, len(fp), 256):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i : i + 256], pa.binary()), text[i : i + 256]], ["fp", "text"])

    return pick


def texts_of(texts: DataFrame, nodes: DataFrame, k: int, slots: int, shelf: Shelf) -> DataFrame:
    """(fp, text) of the classes ``nodes`` (fp, first_doc), stored.

    A bitmap of their ids (a byte a slot) goes to all tasks, so that only texts that may be wanted are shuffled; the
    join by fingerprint settles it.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(sketch(nodes.select(F.xxhash64("first_doc").alias("h")), _longs("h"), slots))
    rows = texts.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_wanted_texts(k, wanted), TEXTS)
    found = shelf.put("texts", rows.join(nodes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))
    wanted.destroy()
    return found


def apart(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Bits that differ between every two sketches of a block; -1 where the sets can't link by them or by their sizes."""
    size = np.array([len(b) for b in bits])
    found = np.full((len(n), len(n)), -1, np.int32)
    widths = np.unique(size)
    for width in widths:
        own = np.flatnonzero(size == width)
        rows, at = [np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)], [own]
        # A sketch folds to a smaller one; sizes of sets that link differ by 100 / percent at most.
        for wide in widths[(widths > width) & (widths * percent < 200 * width)]:
            at.append(np.flatnonzero(size == wide))
            folds = np.frombuffer(b"".join(bits[i] for i in at[-1]), np.uint64).reshape(len(at[-1]), wide // width, -1)
            rows.append(np.bitwise_xor.reduce(folds, axis=1))
        rows, at = np.concatenate(rows), np.concatenate(at)
        for i, k in enumerate(own):
            there = at[i + 1 :]
            d = np.bitwise_count(rows[i] ^ rows[i + 1 :]).sum(1, dtype=np.int64)
            # union - intersection <= (100 - percent) / (100 + percent) * (|x| + |y|) for sets that link
            ok = d * (100 + percent) <= (100 - percent) * (n[k] + n[there])
            ok &= 100 * np.minimum(n[k], n[there]) >= percent * np.maximum(n[k], n[there])
            found[k, there[ok]] = found[there[ok], k] = d[ok]
    return found


def shortest_trees(found: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that tie together, with the fewest differing bits, all components that pairs of ``found`` (-1: none) lead between."""
    comp, pairs = comp.copy(), []
    far = np.iinfo(np.int32).max
    while True:
        d = np.where((found >= 0) & (comp[:, None] != comp[None]), found, far)
        nearest = d.argmin(1)
        least = d[np.arange(len(d)), nearest]
        if not len(least) or least.min() == far:
            return pairs
        order = np.lexsort((least, comp))
        first = order[np.flatnonzero(np.diff(comp[order], prepend=-1))]  # of each component the row with the nearest other
        for i in first[np.argsort(least[first], kind="stable")]:
            j = int(nearest[i])
            if least[i] < far and comp[i] != comp[j]:
                pairs.append((int(i), j))
                comp[comp == comp[j]] = comp[i]


def _compared(percent: int, every: bool):
    """Pairs of each block that may link (a, b); a row with ``sign`` alone says that the block has more of them.

    Rows come sorted by block; a block may be spread over batches.
    """

    def block(t: pa.Table):
        fp, n = t.column("fp").to_pylist(), t.column("n").to_numpy()
        comp = np.unique(np.array([c.hex() for c in t.column("comp").to_pylist()]), return_inverse=True)[1]
        side = t.column("side").to_numpy()
        found = apart(n, t.column("bits").to_pylist(), percent)
        if side.min() != side.max():
            found[side[:, None] == side[None]] = -1
        found[comp[:, None] == comp[None]] = -1
        i, j = np.nonzero(np.triu(found >= 0))
        more = not every and len(i) > 2 * len(fp)
        pairs = shortest_trees(found, comp) if more else zip(i.tolist(), j.tolist(), strict=True)
        out = [(min(fp[x], fp[y]), max(fp[x], fp[y]), None) for x, y in pairs]
        return out + [(None, None, t.column("sign")[0].as_py())] if more else out

    def batch_of(rows):
        a, b, sign = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sign, pa.int64())], ["a", "b", "sign"])

    def compare(batches):
        open_block, out = [], []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in ("sign", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), len(batch)]
            if open_block and not (open_block[1] == keys[:, 0]).all():
                out += block(pa.Table.from_batches(open_block[0]))
                open_block = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(i, j - i)
                if j == len(batch):
                    open_block = [[*open_block[0], part] if open_block and i == 0 else [part], keys[:, -1]]
                else:
                    whole = [*open_block[0], part] if open_block and i == 0 else [part]
                    out += block(pa.Table.from_batches(whole))
                    open_block = []
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if open_block:
            out += block(pa.Table.from_batches(open_block[0]))
        if out:
            yield batch_of(out)

    return compare


def _verifier(k: int, percent: int):
    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(_sets(batch.column("left"), k), _sets(batch.column("right"), k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            hit = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ("a", "b")], ["a", "b"])

    return verify


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the smallest node it is connected with.

    Large-star and small-star steps in turn until only stars are left; each step is a few shuffles of the edges left.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        met = both.join(low, F.col("a") == F.col("u"))
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hung = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    def done(e: DataFrame) -> bool:
        """Only stars are left: every node hangs on one root, and no root hangs on another."""
        n = e.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
        return n["n"] == n["d"] and e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()

    shelf = shelf or Shelf(edges.sparkSession)
    e = shelf.put("components", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not done(e):
        e = shelf.put("components", star(star(e, True), False))
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _several(rows: DataFrame) -> DataFrame:
    """Bucket rows of the signatures under which more than one component is left."""
    c = F.xxhash64("comp")
    several = rows.groupBy("sign").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo <> hi").select("sign")
    return rows.join(several, "sign", "left_semi")


def _buckets(rows: DataFrame) -> DataFrame:
    """(sign, fp, size) of the buckets with two classes at least, one signature for all buckets of the same classes."""
    same = (F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y"))
    size = F.count("*").alias("size")
    each = rows.groupBy("sign").agg(size, *same, F.min("fp").alias("first")).where("size > 1")
    kept = each.groupBy("size", "x", "y", "first").agg(F.min("sign").alias("sign"))
    return rows.join(kept.select("sign", "size"), "sign")


def _may_link(rows: DataFrame, percent: int, every: bool = False, across: bool = True) -> DataFrame:
    """(a, b, sign) from bucket rows (sign, fp, size, n, bits, comp) compared block by block, or within blocks only."""
    blocks = F.ceil(F.col("size") / ROWS).cast("int")
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    if across:
        # A class meets every block of its bucket once: rows grow with the blocks of those dense buckets that are still open.
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    else:
        dealt = dealt.withColumn("other", F.col("side"))
    dealt = dealt.select("sign", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "fp", "n", "bits", "comp")
    sorted_rows = dealt.repartition("sign", "lo", "hi").sortWithinPartitions("sign", "lo", "hi")
    return sorted_rows.mapInArrow(_compared(percent, every), "a binary, b binary, sign long")


def _links(texts: DataFrame, classes: DataFrame, buckets: DataFrame, k: int, percent: int, shelf: Shelf) -> DataFrame | None:
    """(node, root) of the classes that link with another, from bucket rows (sign, fp, size)."""
    rows = shelf.put("open", buckets.join(classes.select("fp", "n", "bits"), "fp"))
    seen = shelf.put("seen", _may_link(rows.withColumn("comp", F.col("fp")), percent, across=False))
    more = seen.where("a is null").select("sign").union(rows.where(F.col("size") > ROWS).select("sign")).distinct()
    dense = shelf.put("dense", rows.join(more, "sign", "left_semi"))
    shelf.drop("open")
    likely = seen.where("a is not null").select("a", "b").distinct()
    nodes = likely.select(F.col("a").alias("fp")).union(likely.select("b")).union(dense.select("fp")).distinct()
    wanted = texts_of(texts, nodes.join(classes.select("fp", "first_doc"), "fp"), k, sketch_slots(texts, 256), shelf)

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(wanted.select(F.col("fp").alias("a"), F.col("text").alias("left")), "a")
        two = one.join(wanted.select(F.col("fp").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
        return two.mapInArrow(_verifier(k, percent), "a binary, b binary")

    links = shelf.put("links", verified(likely))
    labels = None if links.isEmpty() else components(links, shelf)
    for every in (False, True):
        left = dense.withColumn("comp", F.col("fp"))
        if labels is not None:
            known = labels.select(F.col("node").alias("fp"), "root")
            left = dense.join(known, "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")
        left = shelf.put("open", _several(left))
        if left.isEmpty():
            break
        found = shelf.put("found", _may_link(left, percent, every))
        # Pairs that were refused before need no second look; those that linked are in one component.
        fresh = found.where("a is not null").select("a", "b").distinct().join(likely, ["a", "b"], "left_anti")
        links = shelf.put("more-links", verified(fresh))
        if not links.isEmpty():
            # Of earlier links only what ties the components together is needed.
            old = None if labels is None else labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            labels = components(links if old is None else old.union(links), shelf)
        likely = shelf.put("tried", likely.union(fresh)) if not every else likely
        dense = dense.join(found.where("a is null").select("sign").distinct(), "sign", "left_semi") if not every else dense
        if not every:
            dense = shelf.put("denser", dense)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, roots: bool = False) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id and, if asked for, root of every document.

    ``component_id`` is for output: null ids and repeated ids can give it to several components. ``root`` tells them apart: the
    smallest fingerprint of the component's sets.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, shelf = docs.select("doc_id", "text"), Shelf(spark)
    frequency = sketch(texts.select("text"), _shingles(k), sketch_slots(docs, 8))  # 64 MB at most
    above = often_from(frequency)
    frequency = spark.sparkContext.broadcast(frequency)
    keyed = texts.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = f"doc_id {kind}, key long, n long, fp binary, signs array<long>, bits binary"
    signed = shelf.put("signed", keyed.mapInArrow(_signer(k, percent, frequency, above), schema))
    frequency.destroy()
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal in a class
    filled = signed.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_doc"), *map(first, ("n", "signs", "bits")))
    classes = shelf.put("classes", filled)
    seen = spark.sparkContext.broadcast(sketch(classes.select("signs"), _longs("signs"), sketch_slots(docs, 8)))
    rows = shelf.put("signatures", classes.select("signs", "fp").mapInArrow(_bucket_rows(seen), "sign long, fp binary"))
    seen.destroy()
    buckets = shelf.put("buckets", _buckets(rows))
    shelf.drop("signatures")
    labels = None if buckets.isEmpty() else _links(texts, classes, buckets, k, percent, shelf)
    if labels is None:
        joined = classes.select("fp", F.col("first_doc").alias("component_id"), F.col("fp").alias("root"))
    else:
        linked = labels.join(classes, F.col("node") == F.col("fp"))
        lowest = linked.groupBy(F.col("root").alias("of")).agg(F.min("first_doc").alias("component_id"))
        by_class = linked.join(lowest, F.col("root") == F.col("of")).select("fp", "component_id", "root")
        joined = classes.join(by_class, "fp", "left").select(
            "fp", F.coalesce("component_id", "first_doc").alias("component_id"), F.coalesce("root", "fp").alias("root")
        )
    found = signed.select("doc_id", "key", F.col("n").alias("n_shingles"), "fp").join(joined, "fp", "left")
    root = [F.coalesce("root", "fp").alias("root")] if roots else []
    found = found.select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *root)
    found = stored(found, "near-duplicates")
    shelf.drop(*list(shelf.paths))
    return found


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group: that with the smallest id, then text hash. Rows without words stay."""
    one, two, key, empty, first, n = free_names(docs, "one", "two", "key", "empty", "first", "n")
    found = near_duplicates(docs, k, percent, roots=True).where("n_shingles > 0")
    firsts = found.groupBy("root").agg(F.min(F.struct("doc_id", F.col("key").alias(key))).alias("p")).select("p.*")
    same = identity("doc_id", key)
    firsts = firsts.select(same[0].alias(one), same[1].alias(two), F.lit(True).alias(first))
    no_words = F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).withColumns({empty: no_words, one: same[0], two: same[1]})
    met = keyed.join(firsts, [one, two], "left")
    # Rows that are repeated whole share id and text; the join has already brought them together.
    place = F.row_number().over(Window.partitionBy(one, two).orderBy(empty))
    kept = met.withColumn(n, place).where(F.col(empty) | (F.col(first) & (F.col(n) == 1)))
    return kept.select(*map(quoted, docs.columns))
