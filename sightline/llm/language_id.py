"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces of the product of their probabilities, found by a forward pass; a text's is the product over its words. The
probabilities are fitted by expectation-maximisation on all learning documents: word counts per language are aggregated, then
each round sums expected piece counts (forward-backward) of the distinct words. The model has languages x pieces numbers, whatever the corpus holds.

A word is a run of ASCII letters and non-ASCII characters, lower-cased, behind a word-begin mark; characters without a piece cost a
fixed small probability. The score is the softmax of the languages' log-likelihoods over the square root of the number of words.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when nothing was learned; of equal
languages the first in alphabetical order is taken; null languages are not learned from; repeated rows are each answered; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.words import PRIME, mix, pieces, stage

ROUNDS, PRIOR, UNKNOWN, LONGEST, LONGEST_WORD = 2, 0.05, 1e-7, 10, 64
BEGIN = "▁"
PARTING = np.ones(256, bool)
PARTING[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PIECE_BYTES, WORDS_AT_ONCE, KNOWN_WORDS = 1 << 20, 4_000, 200_000
_SLOT = np.uint64(64 - 20)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots of a hash table, hashes of the pieces and their number; at most LONGEST characters each."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))})
    names = [s for s in names if 0 < len(s) <= LONGEST and s != BEGIN]
    points = np.zeros((len(names), LONGEST), np.uint64)
    size = np.array([len(s) for s in names])
    for i, s in enumerate(names):
        points[i, :len(s)] = [ord(c) for c in s]
    h = np.zeros(len(names), np.uint64)
    for j in range(LONGEST):
        h = np.where(j < size, (h + points[:, j] + np.uint64(1)) * PRIME, h)
    h = mix(h)
    slots = np.full((1 << 20, 4), -1, np.int32)  # pieces that share a slot stand side by side
    depth = np.zeros(1 << 20, np.int64)
    for i, s in enumerate((h >> _SLOT).tolist()):
        slots[s, depth[s]] = i
        depth[s] += 1
    return slots, h, len(names)


def _find(slots: np.ndarray, known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of the piece with each hash, or -1."""
    out = np.full(len(h), -1, np.int64)
    row = slots[(h >> _SLOT).astype(np.int64)]
    for d in range(4):
        c = row[:, d]
        hit = (c >= 0) & (known[c] == h)
        if not hit.any() and d:
            break
        out[hit] = c[hit]
    return out


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of marked words, one a row, and their sizes. A longer word is cut into words of LONGEST_WORD by the caller."""
    size = np.array([len(w) for w in words], np.int64) + 1
    flat = np.frombuffer("".join(BEGIN + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), int(size.max())), np.uint64)
    row = np.repeat(np.arange(len(words)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _edges(points: np.ndarray, size: np.ndarray, vocab) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, rows, pieces) of the pieces that stand in the words; by begin, then end. A single character is always an edge (-1 if unknown)."""
    slots, known, _ = vocab
    for i in range(points.shape[1]):
        rows = np.flatnonzero(size > i)
        h = np.zeros(len(rows), np.uint64)
        for j in range(i + 1, min(i + LONGEST, points.shape[1]) + 1):
            go = size[rows] >= j
            rows, h = rows[go], h[go]
            if not len(rows):
                break
            h = (h + points[rows, j - 1] + np.uint64(1)) * PRIME
            found = _find(slots, known, mix(h))
            if j == i + 1:
                yield i, j, rows, found
            else:
                hit = found >= 0
                yield i, j, rows[hit], found[hit]


def log_likelihood(words: list[str], vocab, probs: np.ndarray) -> np.ndarray:
    """log P(word | language) of each word, languages in columns. ``probs``: languages x (pieces + 1), the last for unknown characters."""
    out = np.zeros((len(words), probs.shape[0]))
    by = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(words), WORDS_AT_ONCE):
        rows_of = by[at:at + WORDS_AT_ONCE]
        points, size = _matrix([words[i] for i in rows_of])
        alpha = np.zeros((points.shape[1] + 1, len(rows_of), probs.shape[0]))
        alpha[0] = 1
        table = np.ascontiguousarray(probs.T)
        for i, j, rows, found in _edges(points, size, vocab):
            alpha[j, rows] += alpha[i, rows] * table[found]
        out[rows_of] = np.log(np.maximum(alpha[size, np.arange(len(rows_of))], 1e-300))
    return out


def expected_counts(words: list[str], weight: np.ndarray, vocab, probs: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations, words weighted; one language's ``probs``."""
    total = np.zeros(len(probs))
    by = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(words), 20_000):
        rows_of = by[at:at + 20_000]
        points, size = _matrix([words[i] for i in rows_of])
        edges = list(_edges(points, size, vocab))
        n = len(rows_of)
        alpha, beta = np.zeros((points.shape[1] + 1, n)), np.zeros((points.shape[1] + 1, n))
        alpha[0] = 1
        for i, j, rows, found in edges:
            alpha[j, rows] += alpha[i, rows] * probs[found]
        z = np.maximum(alpha[size, np.arange(n)], 1e-300)
        beta[size, np.arange(n)] = weight[rows_of] / z
        for i, j, rows, found in sorted(edges, key=lambda e: -e[0]):
            beta[i, rows] += probs[found] * beta[j, rows]
        seen = [(found, alpha[i, rows] * probs[found] * beta[j, rows]) for i, j, rows, found in edges]
        number, share = np.concatenate([f for f, _ in seen]), np.concatenate([s for _, s in seen])
        total += np.bincount(number % len(probs), weights=share, minlength=len(probs))
    return total


def _spelled(p, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words of a piece, lower-cased, and which of them have a letter."""
    data = memoryview(p.raw)
    words = [str(data[a:b], "utf-8", "replace").lower() for a, b in zip(p.ws[at].tolist(), p.we[at].tolist())]
    return words, np.array([w.isalpha() or any(map(str.isalpha, w)) for w in words], bool)


def _distinct(p) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of a piece, which of them each word is, and which have a letter. Long runs are cut."""
    _, at, inv = np.unique(p.hashes(), return_index=True, return_inverse=True)
    words, letters = _spelled(p, at)
    return words, inv, letters


class Scored:
    """Log-likelihoods (0 without a letter) and letter marks of the words scored so far, by hash; begun anew before it holds more than KNOWN_WORDS and a piece's own."""

    def __init__(self, vocab, probs: np.ndarray):
        self.vocab, self.probs = vocab, probs
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.table, self.letters = np.zeros(0, np.uint64), np.zeros((0, self.probs.shape[0])), np.zeros(0, bool)

    def of(self, p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and marks of some words, and which of them each word of the piece is."""
        uniq, at, inv = np.unique(p.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) > KNOWN_WORDS:
            self._forget()
        place = np.searchsorted(self.hashes, uniq)
        new = np.ones(len(uniq), bool)
        inside = np.flatnonzero(place < len(self.hashes))
        new[inside] = self.hashes[place[inside]] != uniq[inside]
        if new.any():
            words, letters = _spelled(p, at[new])
            table = _score_words(words, self.vocab, self.probs) * letters[:, None]
            where = place[new]
            self.hashes = np.insert(self.hashes, where, uniq[new])
            self.table, self.letters = np.insert(self.table, where, table, axis=0), np.insert(self.letters, where, letters)
        rows = np.searchsorted(self.hashes, uniq)
        return self.table[rows], self.letters[rows], inv


def _score_words(words: list[str], vocab, probs: np.ndarray) -> np.ndarray:
    long = [i for i, w in enumerate(words) if len(w) > LONGEST_WORD]
    if not long:
        return log_likelihood(words, vocab, probs) if words else np.zeros((0, probs.shape[0]))
    out = np.zeros((len(words), probs.shape[0]))
    is_long = set(long)
    short = [i for i in range(len(words)) if i not in is_long]
    if short:
        out[short] = log_likelihood([words[i] for i in short], vocab, probs)
    for i in long:
        out[i] = log_likelihood([words[i][k:k + LONGEST_WORD] for k in range(0, len(words[i]), LONGEST_WORD)], vocab, probs).sum(0)
    return out


class Model:
    def __init__(self, langs: list[str], probs: np.ndarray):
        self.langs, self.probs = langs, probs


def train_languages(docs: DataFrame, learn: Column, vocab_path: str, text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> Model:
    """Fit on the documents for which ``learn`` is true and the language is not null."""
    spark = docs.sparkSession
    src = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column("text"), False, PIECE_BYTES, PARTING):
                words, inv, letters = _distinct(p)
                named = batch.column("lang").slice(p.rows.start, p.n).dictionary_encode()
                code = named.indices.to_numpy(zero_copy_only=False)[p.owner].astype(np.int64) if len(inv) else np.zeros(0, np.int64)
                key, cnt = np.unique(inv.astype(np.int64) * len(named.dictionary) + code, return_counts=True)
                w, lang = np.divmod(key, max(len(named.dictionary), 1))
                ok = letters[w] if len(w) else np.zeros(0, bool)
                w, lang, cnt = w[ok], lang[ok], cnt[ok]
                yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(lang)).cast(pa.string()), pa.array([words[i] for i in w.tolist()], pa.string()),
                                                  pa.array(cnt.astype(np.int64))], names=["lang", "word", "n"])

    counted = stage(src.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())  # as many rows as languages
    v = vocabulary(vocab_path)[2]
    probs = np.full((len(langs), v + 1), 1.0 / v)
    probs[:, v] = UNKNOWN
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast(probs)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, now = vocabulary(vocab_path), sent.value
            total = np.zeros_like(now)
            for batch in batches:
                lang, n = np.array(batch.column("lang").to_pylist(), object), batch.column("n").to_numpy()
                words = batch.column("word").to_pylist()
                for k, name in enumerate(langs):
                    own = np.flatnonzero(lang == name)
                    cut = [(words[i][j:j + LONGEST_WORD], n[i]) for i in own.tolist() for j in range(0, len(words[i]), LONGEST_WORD)]
                    if cut:
                        total[k] += expected_counts([w for w, _ in cut], np.array([c for _, c in cut], float), vocab, now[k])
            k, piece = np.nonzero(total[:, :v])
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["k", "piece", "x"])

        # languages x pieces numbers at most
        got = counted.mapInArrow(expect, "k int, piece int, x double").groupBy("k", "piece").agg(F.sum("x").alias("x")).toPandas()
        probs = np.full((len(langs), v + 1), PRIOR)
        probs[got["k"], got["piece"]] += got["x"]
        probs[:, :v] /= probs[:, :v].sum(1, keepdims=True)
        probs[:, v] = UNKNOWN
    return Model(langs, probs)


def predictor(spark, model: Model, vocab_path: str):
    """A function of a column of texts (Arrow) giving languages and scores, to be used inside tasks."""
    sent = spark.sparkContext.broadcast((model.langs, model.probs))
    held: list[Scored] = []  # one in each task

    def predict(texts) -> tuple[list[str], np.ndarray]:
        langs, probs = sent.value
        if not held:
            held.append(Scored(vocabulary(vocab_path), probs))
        names, scores = [], []
        for p in pieces(texts, False, PIECE_BYTES, PARTING):
            if not langs or not len(p.ws):
                names += ["und"] * p.n
                scores.append(np.zeros(p.n))
                continue
            table, letters, inv = held[0].of(p)
            n = p.words_per_text(letters[inv].astype(np.int64))
            total = np.stack([p.words_per_text(table[inv, k]) for k in range(len(langs))], 1)
            z = total / np.sqrt(np.maximum(n, 1))[:, None]
            z = np.exp(z - z.max(1, keepdims=True))
            best = total.argmax(1)
            names += [langs[b] if m else "und" for b, m in zip(best.tolist(), n.tolist())]
            scores.append(np.where(n > 0, (z / z.sum(1, keepdims=True))[np.arange(p.n), best], 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)

    return predict


def identify(docs: DataFrame, model: Model, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    predict = predictor(docs.sparkSession, model, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, scores = predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, vocab_path: str, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``min_score``."""
    predict = predictor(docs.sparkSession, model, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, scores = predict(batch.column(text_col))
                yield batch.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
