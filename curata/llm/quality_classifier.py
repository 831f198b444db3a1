"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features of a text, each hashed into 2 ** BITS places and each group scaled to unit length: words, word pairs, word
shapes (use of capitals, letters and signs), pairs of shapes, and for three-word windows whether they occur again in
the text. A score is the sparse dot product with the weights.

``train`` fits on at most ``max_rows`` labelled rows (8000 by default: the first by a hash of the id, so the choice does
not depend on partitions), one document an id. Those rows are the only data that meet in one task; the ids of the sample are broadcast,
and the weights (2 ** BITS floats, 1 MB) go to the driver and from there to the tasks. ``score`` reads every whole text.

Edge cases: a null or empty text has only the intercept; a null id is scored and is never a training row; an id with
several labels counts with the smallest, one with several documents trains on that with the smallest hash of its text; without labels every score is 0.5; repeated rows and other columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, shingle_hashes, slices, word_hashes, word_shapes

BITS = 18
MAX_ROWS = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of all features of some texts, sorted by text; place 0 of each is the intercept."""
    n = len(col)
    h, bounds = word_hashes(col)
    shapes = mix(word_shapes(col) + np.uint64(1))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    pairs, pair_bounds = shingle_hashes(h, bounds, 2)
    shape_pairs, _ = shingle_hashes(shapes, bounds, 2)
    triples, triple_bounds = shingle_hashes(h, bounds, 3)
    pair_doc = np.repeat(np.arange(n), np.diff(pair_bounds))
    triple_doc = np.repeat(np.arange(n), np.diff(triple_bounds))
    again = np.zeros(len(triples), np.uint64)
    if len(triples):
        order = np.lexsort((triples, triple_doc))
        same = (triples[order][1:] == triples[order][:-1]) & (triple_doc[order][1:] == triple_doc[order][:-1])
        again[order[1:][same]] = 1
    groups = ((h, doc), (pairs, pair_doc), (shapes, doc), (shape_pairs, pair_doc), (again, triple_doc))
    docs, places, values = [np.arange(n)], [np.zeros(n, np.int64)], [np.ones(n)]
    for salt, (hashes, of) in enumerate(groups):
        place = mix(hashes + np.uint64(salt * 0x51ED270B + 1)) % np.uint64((1 << bits) - 1) + np.uint64(1)
        keys, counts = np.unique((of.astype(np.uint64) << np.uint64(bits)) | place, return_counts=True)
        d = (keys >> np.uint64(bits)).astype(np.int64)
        length = np.sqrt(np.bincount(d, counts.astype(float) ** 2, minlength=n))
        docs.append(d)
        places.append((keys & np.uint64((1 << bits) - 1)).astype(np.int64))
        values.append(counts / length[d])
    d = np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return d[order], np.concatenate(places)[order], np.concatenate(values)[order]


def _sparse(bits: int):
    def extract(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                d, place, value = features(batch.column("text")[i:j], bits)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                p, v = place.astype("<i4"), value.astype("<f4")
                binary = lambda a: [a[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column("order_key")[i:j], batch.column("label")[i:j], pa.array(binary(p)), pa.array(binary(v))],
                    ["order_key", "label", "places", "vals"],
                )

    return extract


def ftrl(rows, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over rows (label, places, values) in their order."""
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, x in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            more = n[at] + g * g
            np.add.at(z, at, g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w)
            np.add.at(n, at, g * g)
    return weights(slice(None))


def _trainer(bits: int):
    def fit(batches):
        rows = []
        for batch in batches:
            for label, p, v in zip(*(batch.column(c).to_pylist() for c in ("label", "places", "vals")), strict=True):
                rows.append((label, np.frombuffer(p, "<i4"), np.frombuffer(v, "<f4").astype(float)))
        yield pa.RecordBatch.from_pydict({"weights": [ftrl(rows, 1 << bits).astype("<f4").tobytes()]})

    return fit


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from documents (doc_id, text) and labels (doc_id, label); at most ``max_rows`` of them."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    one = one.withColumn("order_key", F.xxhash64("doc_id"))
    sample = F.broadcast(one.orderBy("order_key", "doc_id").limit(max_rows))  # max_rows ids at most
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    # One document an id, however often the id is repeated: tasks send the one with the smallest hash, then text.
    rows = rows.groupBy("doc_id", "order_key", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = rows.select("order_key", F.col("label").cast("double").alias("label"), "text")
    sparse = rows.mapInArrow(_sparse(bits), "order_key long, label double, places binary, vals binary")
    fitted = sparse.repartition(1).sortWithinPartitions("order_key", "label", "places", "vals").mapInArrow(_trainer(bits), "weights binary")
    found = fitted.collect()
    return np.frombuffer(found[0]["weights"], "<f4") if found else np.zeros(1 << bits, "<f4")


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of every document and ``name``: a score in 0..1; higher: the label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights))
    chosen = docs.select("text", *[c for c in keep if c != "text"])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"

    def run(batches):
        w = shared.value.astype(float)
        for batch in batches:
            text = batch.column("text")
            for i, j in slices(text):
                d, place, value = features(text[i:j], bits)
                margin = np.bincount(d, w[place] * value, minlength=j - i)
                p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in keep), pa.array(p)], [*keep, name])

    return chosen.mapInArrow(run, schema)
