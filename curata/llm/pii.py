"""Personal data: pattern spans, and terms that give a protected entity away.

Base spans are e-mail addresses, IPv4 addresses, card numbers (16 to 19 digits, Luhn) and phone numbers; each distinct
value is a protected entity e. A term t (a word of three letters or more, outside base spans) of any document that mentions
e is weighed by what it tells about the entity, counted in whole documents of the whole corpus:

    disclosure(e, t) = log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e))

the pointwise mutual information over the information content of e: 1 where t occurs with e only. Terms of pairs seen in
``SUPPORT`` documents at least are generalised (replaced by a class word) from ``GENERALISE`` on and removed from ``REMOVE``
on, wherever they occur: in documents without a mention too.

Plan: one scan finds base spans, and the words of texts that have any; one scan counts the documents of the terms that occur with
an entity of ``SUPPORT`` documents at least (``SHARED`` of them at most go to all tasks, which send one vector of counts each; of more a
bitmap picks them, and each task sends a row a term); pairs, entities and terms meet in keyed joins, equal texts once. The terms above the threshold go to all tasks where they are ``SHARED`` at most, and the
last scan finds their occurrences next to the base spans without any join; where they are more, a bitmap preselects
occurrences and a join settles them. Texts are never shuffled on the first way.

Edge cases: a null text is empty; null ids are kept; equal rows get equal spans; other columns are ignored by ``find``
and kept by ``sanitise``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import sketch, slot
from .storage import free_names, quoted, stored
from .words import slices, utf8_of, word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
SHARED = 1 << 20
CLASS_WORD = "<term>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\x20\x09-\x0D.,;:!?()\"]+")
_POINTS = np.arange(256, dtype=np.uint8)
_POINTS[[ord(c) for c in '.,;:!?()"']] = 32

FOUND = "spans array<struct<kind:int,start:int,end:int>>, entities array<bigint>, words array<bigint>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local part, @ and dotted domain, each character looked at once or twice however long its run is."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def _ips(text: str):
    """Four numbers joined by dots, from the left of each chain of such numbers."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, start = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches that do not overlap, those that fail the check left out.

    Linear in the length of the text, also where one run of characters is all of it.
    """
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _covered(text: str, spans: list[tuple[int, int, int]]) -> bytearray:
    """1 at the characters of base spans, else 0."""
    out = bytearray(len(text))
    for _, a, b in spans:
        out[a:b] = b"\1" * (b - a)
    return out


def _entity(kind: int, value: str) -> int:
    plain = value.lower() if kind < 2 else "".join(_DIGIT.findall(value))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches):
    for batch in batches:
        spans, entities, words, bounds = [], [], [], [0]
        for text in batch.column("text"):
            t = text.as_py() or ""
            found = base_spans(t)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            entities.append(sorted({_entity(k, t[a:b]) for k, a, b in found}))
            if found:
                covered = _covered(t, found)
                free = {m[0] for m in _TERM.finditer(t) if 1 not in covered[m.start() : m.end()]}
                words += (w for w in free if sum(map(str.isalpha, w)) >= 3)
            bounds.append(len(words))
        terms = word_hashes(pa.array(words, pa.string()))[0].view(np.int64) if words else np.empty(0, np.int64)
        rows = [np.unique(terms[i:j]) for i, j in zip(bounds, bounds[1:])]
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(spans, span), pa.array(entities, longs), pa.array(rows, longs)],
            ["doc_id", "key", "spans", "entities", "words"],
        )


def _plain(col: pa.Array) -> pa.Array:
    """The texts with spaces for punctuation, so that words are terms; places stay."""
    data, offsets = utf8_of(col)
    return pa.Array.from_buffers(
        pa.large_string(), len(col), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_POINTS[data])]
    )


def _words_by_document(col: pa.Array):
    """Hashes of the distinct words of each text, texts one after another."""
    for i, j in slices(col):
        h, bounds = word_hashes(_plain(col[i:j]))
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield h[new]


def _term_documents(marks):
    """(t, n) of a task's texts: documents of the terms in the bitmap, added up over a few million words at a time."""

    def count(batches):
        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["t", "n"])

        held, size = [], 0
        for batch in batches:
            for h in _words_by_document(batch.column("text")):
                held.append(h[_marked(h, marks.value)])
                size += len(held[-1])
                if size > 8_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return count


def _count_vectors(shared):
    """(block, counts): documents of each of the shared terms in a task's texts, 65536 terms a block."""

    def count(batches):
        terms = shared.value
        total = np.zeros(len(terms), "<i8")
        for batch in batches:
            for h in _words_by_document(batch.column("text")):
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                u, n = np.unique(at[terms[at] == h], return_counts=True)
                total[u] += n
        for b, i in enumerate(range(0, len(total), 1 << 16)):
            part = total[i : i + (1 << 16)]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})

    return count


def _added_vectors(shared):
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(zlib.decompress(counts), "<i8")
                total[b] = total[b] + more if b in total else more
        for b, counts in total.items():
            at = np.flatnonzero(counts)
            terms = shared.value[at + (b << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts[at])], ["t", "n"])

    return add


def _documents_of(candidates: DataFrame, docs: DataFrame, most_shared: int) -> DataFrame:
    """(t, n_term), stored: the number of documents of each candidate term (term)."""
    context, texts = docs.sparkSession.sparkContext, docs.select("text")
    terms = stored(candidates.select("term").distinct(), "pii-candidate-terms")
    n = terms.count()
    if n <= most_shared:
        shared = context.broadcast(np.sort(terms.limit(SHARED).toArrow()["term"].to_numpy().view(np.uint64)))
        vectors = texts.mapInArrow(_count_vectors(shared), "block int, counts binary")
        counted = vectors.repartition("block").mapInArrow(_added_vectors(shared), "t long, n long") if n else texts.select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n")).limit(0)
    else:
        # Slots for all candidates several times over, 64 MB at most; what falls into a slot by chance is counted for nothing.
        slots = min(1 << 26, max(1 << 20, 1 << (8 * n).bit_length()))
        shared = context.broadcast(sketch(terms.select(F.col("term").alias("t")), _terms, slots))
        counted = texts.mapInArrow(_term_documents(shared), "t long, n long")
    found = stored(counted.groupBy("t").agg(F.sum("n").alias("n_term")), "pii-term-counts")
    shared.destroy()
    return found


def _hits(col: pa.Array, chosen):
    """Of each text that has any: (its place, base spans, [(term, start, end)]) of the terms ``chosen`` picks, outside base spans."""
    for i, j in slices(col):
        h, bounds = word_hashes(_plain(col[i:j]))
        hit = np.flatnonzero(chosen(h))
        cut = np.searchsorted(hit, bounds)
        for d in np.flatnonzero(np.diff(cut)):
            t = col[i + int(d)].as_py()
            spans = base_spans(t)
            covered = _covered(t, spans)
            places = [m.span() for m in _TERM.finditer(t)]
            own = [(h[w], *places[w - bounds[d]]) for w in hit[cut[d] : cut[d + 1]]]
            yield i + int(d), spans, [x for x in own if 1 not in covered[x[1] : x[2]]]


def _occurrences(marks):
    """(doc_id, key, term, start, end) of the terms outside base spans whose slot in the bitmap is set."""

    def find(batches):
        for batch in batches:
            rows = [(d, *x) for d, _, own in _hits(batch.column("text"), lambda h: _marked(h, marks.value)) for x in own]
            at, term, start, end = zip(*rows, strict=True) if rows else ((), (), (), ())
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("key").take(own), pa.array(np.array(term, np.uint64).view(np.int64)),
                 pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                ["doc_id", "key", "term", "start", "end"],
            )

    return find


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
PLACED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]))


def _all_spans(col: pa.Array, terms: np.ndarray, remove: np.ndarray) -> tuple[list, list]:
    """Base spans and term places of each text, for the sorted hashes ``terms``."""

    def chosen(h):
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        return terms[at] == h

    spans, placed = [None] * len(col), [[] for _ in range(len(col))]
    for d, base, own in _hits(col, chosen) if len(terms) else ():
        spans[d] = base
        placed[d] = [{"start": a, "end": b, "remove": bool(remove[np.searchsorted(terms, h)])} for h, a, b in own]
    for d, text in enumerate(col):
        found = base_spans(text.as_py() or "") if spans[d] is None else spans[d]
        spans[d] = [{"kind": k, "start": a, "end": b} for k, a, b in found]
    return spans, placed


def _marker(shared):
    def find(batches):
        for batch in batches:
            spans, placed = _all_spans(batch.column("text"), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(spans, SPAN), pa.array(placed, PLACED)], ["doc_id", "key", "spans", "terms"]
            )

    return find


def _marked(terms: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return marks[slot(terms, len(marks))] > 0


def _terms(batch):
    yield np.asarray(batch.column("t")).view(np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))


def disclosures(scanned: DataFrame, docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE, most_shared: int = SHARED) -> DataFrame:
    """(entity, term, disclosure) of the pairs that ``support`` documents hold and that disclose ``least`` at least."""
    n_docs = scanned.count()
    some = scanned.where(F.size("entities") > 0)
    entities = some.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_entity"))
    entities = entities.where((F.col("n_entity") >= support) & (F.col("n_entity") < n_docs))
    copies = some.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"))  # equal texts, equal entities
    mentions = copies.select("key", "copies", F.explode("entities").alias("entity")).join(entities, F.col("entity") == F.col("e"))
    mentions = stored(mentions.select("key", "copies", "entity", "n_entity"), "pii-mentions")
    top = mentions.agg(F.max("n_entity").alias("n")).first()["n"] or 0
    candidates = some.join(mentions.select("key").distinct(), "key", "left_semi").select("key", F.explode("words").alias("term")).distinct()
    candidates = stored(candidates, "pii-candidates")
    # n(e, t) <= n(e) bounds the disclosure by log(N / n(t)) / log(N / n(e)): what stays below ``least`` anyway is left out early.
    bound = lambda n: F.pow(F.lit(float(n_docs)), F.lit(1 - least)) * F.pow(n, F.lit(least)) * (1 + 1e-9)
    terms = _documents_of(candidates, docs, most_shared)
    terms = terms.where((F.col("n_term") >= support) & (F.col("n_term") <= bound(F.lit(float(top)))))
    wanted = candidates.join(terms, F.col("term") == F.col("t")).select("key", "term", "n_term")
    met = mentions.join(wanted, "key").where(F.col("n_term") <= bound(F.col("n_entity").cast("double")))
    pairs = met.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("copies").alias("n_both")).where(F.col("n_both") >= support)
    pmi = F.log(F.lit(float(n_docs)) * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    weighed = pairs.select("entity", "term", (pmi / F.log(F.lit(float(n_docs)) / F.col("n_entity"))).alias("disclosure"))
    return weighed.where(F.col("disclosure") >= least)


def _telling(docs: DataFrame, most_shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(the scan for base spans, terms (t, remove) that disclose an entity), both stored."""
    keyed = _keyed(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stored(keyed.mapInArrow(_scan, f"doc_id {kind}, key long, {FOUND}"), "pii-scan")
    telling = disclosures(scanned, docs, most_shared=most_shared).groupBy(F.col("term").alias("t")).agg((F.max("disclosure") >= REMOVE).alias("remove"))
    return scanned, stored(telling, "pii-terms")


def _shared_terms(telling: DataFrame):
    """The terms, sorted, and whether they are removed, for all tasks; at most ``SHARED`` of them."""
    rows = telling.limit(SHARED).toArrow()
    terms, remove = rows["t"].to_numpy().view(np.uint64), rows["remove"].to_numpy()
    order = np.argsort(terms)
    return telling.sparkSession.sparkContext.broadcast((terms[order], remove[order]))


def find(docs: DataFrame, most_shared: int = SHARED) -> DataFrame:
    """doc_id, key (hash of the text), spans (base), terms: array of (start, end, remove) that disclose an entity."""
    scanned, telling = _telling(docs, most_shared)
    keyed = _keyed(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_terms = telling.count()
    places = "array<struct<start:int,end:int,remove:boolean>>"
    if n_terms <= most_shared:
        schema = f"doc_id {kind}, key long, spans array<struct<kind:int,start:int,end:int>>, terms {places}"
        return keyed.mapInArrow(_marker(_shared_terms(telling)), schema)
    # About a thousand slots a term, 64 MB at most: the bitmap only preselects, the join settles it.
    slots = 1 << min(26, max(20, int(n_terms).bit_length() + 10))
    marks = docs.sparkSession.sparkContext.broadcast(sketch(telling, _terms, slots))
    placed = stored(keyed.mapInArrow(_occurrences(marks), f"doc_id {kind}, key long, term long, start int, end int"), "pii-occurrences")
    marks.destroy()
    hit = placed.join(telling, F.col("term") == F.col("t")).groupBy("doc_id", "key", "start", "end").agg(F.max("remove").alias("remove"))
    hit = hit.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "remove"))).alias("terms")
    )
    joined = scanned.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "key", "spans", F.coalesce("terms", F.array().cast(places)).alias("terms"))


def listed(spans: Column, terms: Column | None = None) -> Column:
    """``kind:start:end`` of all spans, by kind and start, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"]))
    if terms is not None:
        text = F.concat(text, F.transform(terms, lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])))
    return F.array_join(text, ",")


def rewritten(text: str, spans, terms) -> str:
    """The text with base spans replaced by <kind>, and terms by the class word or by nothing."""
    parts = [(s["start"], s["end"], f"<{KINDS[s['kind']]}>") for s in spans]
    parts += [(s["start"], s["end"], "" if s["remove"] else CLASS_WORD) for s in terms]
    out, at = [], 0
    for a, b, word in sorted(parts):
        if b <= at:
            continue
        out += [text[at : max(a, at)], word]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, most_shared: int = SHARED) -> DataFrame:
    """``docs``, all columns, with the personal data in ``text`` replaced."""
    _, telling = _telling(docs, most_shared)
    if telling.count() <= most_shared:
        shared = _shared_terms(telling)

        def rewrite_all(batches):
            for batch in batches:
                column = batch.column("text")
                both = _all_spans(column, *shared.value)
                new = [rewritten(t, s, e) if t else t for t, s, e in zip(column.to_pylist(), *both, strict=True)]
                columns = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return docs.mapInArrow(rewrite_all, docs.schema)
    d, k, spans, terms, key = free_names(docs, "d", "k", "spans", "terms", "key")
    found = find(docs, most_shared).where((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "key"])
    found = found.select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spans").alias(spans), F.col("terms").alias(terms))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    met = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left")

    def rewrite(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c not in (spans, terms)]
            text = batch.column("text").to_pylist()
            both = batch.column(spans).to_pylist(), batch.column(terms).to_pylist()
            new = [rewritten(t, s, e or []) if s is not None and t else t for t, s, e in zip(text, *both, strict=True)]
            columns = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return met.select(*map(quoted, docs.columns), spans, terms).mapInArrow(rewrite, docs.schema)
