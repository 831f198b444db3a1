"""Language identification as a mixture of languages per document.

``train`` counts byte trigrams of padded words per language over all training rows (a sum by language and
trigram place, combined before the shuffle). The model is at most 2 ** BITS numbers for each learned language.

``predict`` treats a text as words drawn from a mixture: the likelihood of a word under a language is the product of
its trigram probabilities, and expectation-maximisation estimates the proportions. Sets of languages grow by forward
selection: first the language under which the text is likeliest, then each time the one whose share the likelihood rises with
most. The languages of a text are the set with the largest log-likelihood less ``PENALTY`` * (k - 1) * log(words) for its k
languages; the prediction is the largest proportion in that set and its score is that proportion.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; null ids are kept; rows with a null
language or text teach nothing; if nothing was learned every document is ``und``; repeated rows each give a row; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _CLASS, mix, slices, utf8_of, word_hashes, word_starts

BITS = 16
ROUNDS = 6
PENALTY = 3.0
SMOOTH = 0.5


def _word_grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, gram place): the byte trigrams of each word between two spaces, one per byte of the word."""
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    pos = starts[word] + at
    padded = np.concatenate([[32], data, [32]]).astype(np.uint64)
    here = padded[pos + 1]
    before = np.where(at == 0, np.uint64(32), padded[pos])
    after = np.where(at == lengths[word] - 1, np.uint64(32), padded[pos + 2])
    key = before << np.uint64(16) | here << np.uint64(8) | after
    return word, (mix(key) >> np.uint64(64 - bits)).astype(np.int64)


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _units(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts and where they occur: (data, starts, lengths, text of each occurrence, its word)."""
    data, offsets = utf8_of(col)
    data = _LOW[data]
    h, bounds = word_hashes(col)
    starts = word_starts(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    if not len(h):
        return data, starts, starts, doc, starts
    ends = np.append(starts[1:], len(data))
    letters = np.add.reduceat(_CLASS[1][data], starts)
    used = letters > 0
    _, first, unit = np.unique(h[used], return_index=True, return_inverse=True)
    sep = np.cumsum(np.isin(data, [32, 9, 10, 11, 12, 13]))
    lengths = (ends - starts - (sep[ends - 1] - sep[starts]))[used][first]
    return data, starts[used][first], lengths, doc[used], unit.reshape(-1)


def _counter(bits: int):
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                mine = batch.column("text").filter(pa.array(langs == lang))
                for i, j in slices(mine):
                    data, starts, lengths, _, unit = _units(mine[i:j])
                    if not len(unit):
                        continue
                    word, gram = _word_grams(data, starts, lengths, bits)
                    times = np.bincount(unit, minlength=len(starts))
                    total.setdefault(lang, np.zeros(1 << bits))
                    total[lang] += np.bincount(gram, times[word], minlength=1 << bits)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(at), "gram": at.astype(np.int32), "n": counts[at].astype(np.int64)}
            )

    return count


def train(docs: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities: 2 ** bits rows, a column each) from rows (text, lang)."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counted = rows.mapInArrow(_counter(bits), "lang string, gram int, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # 2 ** bits rows a language at most
    langs = sorted(found["lang"].unique())
    counts = np.zeros((1 << bits, len(langs)))
    counts[found["gram"].to_numpy(int), np.searchsorted(langs, found["lang"].to_numpy(str)) if langs else []] = found["n"]
    seen = max(1, int((counts.sum(1) > 0).sum()))
    return langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * seen)) if langs else counts


def _em(like: np.ndarray, n: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document after some rounds, and the mixture's likelihood of each word under them."""
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(n, cuts)[:, None]
    present = doc[cuts]
    part = like * share[doc]
    for _ in range(rounds):
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        share[present] = np.add.reduceat(part, cuts, axis=0) / total
        part = like * share[doc]
    return share, np.maximum(part.sum(1), 1e-300)


def mixtures(col: pa.Array, logp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the chosen languages, whether there is anything to go by) of each text."""
    n_docs, n_langs = len(col), logp.shape[1]
    share = np.zeros((n_docs, n_langs))
    data, starts, lengths, doc, unit = _units(col)
    if not len(unit) or not n_langs:
        return share, np.zeros(n_docs, bool)
    word, gram = _word_grams(data, starts, lengths, bits)
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    by_word = np.add.reduceat(logp[gram], cuts, axis=0)
    top = by_word.max(1, keepdims=True)
    likely = np.exp(by_word - top)
    keys, n = np.unique(doc.astype(np.int64) * len(starts) + unit, return_counts=True)
    doc, unit = keys // len(starts), keys % len(starts)
    like, n = likely[unit], n.astype(float)
    words = np.bincount(doc, n, minlength=n_docs)
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    present, rows = doc[cuts], np.arange(n_docs)
    single = np.zeros((n_docs, n_langs))
    single[present] = np.add.reduceat(np.log(np.maximum(like, 1e-300)) * n[:, None], cuts, axis=0)
    share[rows, single.argmax(1)] = 1.0
    best, chosen = np.full(n_docs, -np.inf), np.zeros_like(share)
    mask = share > 0
    for k in range(1, n_langs + 1):
        # No word is likelier than 1 in any mixture: once the penalty alone outweighs the best of every text, no larger set wins.
        if (best >= -PENALTY * (k - 1) * np.log(words + 1)).all():
            break
        share, mixed = _em(like, n, doc, share, 0 if k == 1 else ROUNDS)
        value = np.bincount(doc, np.log(mixed) * n, minlength=n_docs) - PENALTY * (k - 1) * np.log(words + 1)
        better = value > best
        chosen[better], best[better] = share[better], value[better]
        if k < n_langs:
            # How the log-likelihood rises with the share of each language outside the set.
            slope = np.zeros_like(share)
            slope[present] = np.add.reduceat(like * (n / mixed)[:, None], cuts, axis=0)
            slope[mask] = -1
            new = slope.argmax(1)
            mask[rows, new] = True
            share *= k / (k + 1)
            share[rows, new] = 1 / (k + 1)
    return chosen, words > 0


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id, lang_pred, score, languages (array of language and share, largest first) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(logp))

    def run(batches):
        names = [*langs, "und"]
        for batch in batches:
            text = batch.column("text")
            for i, j in slices(text):
                share, some = mixtures(text[i:j], shared.value, bits)
                letter = np.array([any(map(str.isalpha, t.as_py() or "")) for t in text[i:j]], bool)
                some &= letter
                pick = np.where(some, share.argmax(1) if langs else 0, len(langs))
                score = np.where(some, share.max(1) if langs else 0.0, 0.0)
                every = [
                    [{"lang": langs[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable") if row[k] > 0] if ok else []
                    for row, ok in zip(share, some, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        pa.array([names[k] for k in pick], pa.string()),
                        pa.array(np.clip(score, 0.0, 1.0)),
                        pa.array(every, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
