"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): every pair of features interacts through
``RANK`` factors, at a cost linear in the number of features of a text. The machine is fitted on a bounded sample of labelled rows
(at most about MAX_ROWS, chosen by a hash of the id) in one task; its size is fixed by BUCKETS and RANK, so it can travel with the code.

Defined results: a null or empty text has no word features and is scored by its structure alone; a null n_chars counts as 0; labels
other than 0 and 1, nulls and rows without a document are not learned from; without labelled rows every score is 0.5; repeated rows are each
scored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.words import pair, pieces, span_hash

BUCKETS, RANK, MAX_ROWS, EPOCHS, STEPS, RATE, DECAY = 1 << 16, 8, 20_000, 6, 800, 0.08, 2e-6
STATS = 14
DIM = BUCKETS + STATS
BATCH = 128


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


SYMBOL, UPPER, DIGIT, BAR, BANG, STOP = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"|"), _table(b"!"), _table(b".,;:?")


def _features(texts: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a batch: rows, first entry of each text, feature numbers and values of its words, and its statistics."""
    for p in pieces(texts):
        h = p.hashes()
        key = (p.owner.astype(np.int64) << 17) | (h >> np.uint64(48)).astype(np.int64) % BUCKETS
        uniq, cnt = np.unique(key, return_counts=True)
        owner, bucket = uniq >> 17, uniq & (BUCKETS - 1)
        value = np.log1p(cnt).astype(np.float64)
        norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=p.n))
        value = value / norm[owner]
        starts = np.searchsorted(owner, np.arange(p.n + 1))
        words = p.counts.astype(np.float64)
        some = np.maximum(words, 1)
        raw = p.raw[:p.size]
        chars = np.maximum(p.per_text(p.ink), 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (p.owner[1:] == p.owner[:-1])
        distinct = np.bincount(owner, minlength=p.n)
        tri = pair(h[:-1], h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
        tri_owner = p.owner[1:][p.owner[1:] == p.owner[:-1]] if len(h) > 1 else np.zeros(0, np.int64)
        tri = tri[p.owner[1:] == p.owner[:-1]] if len(h) > 1 else tri
        kept = np.unique(pair(tri, tri_owner.astype(np.uint64)), return_index=True)[1]
        fresh = np.bincount(tri_owner[kept], minlength=p.n) / np.maximum(words - 1, 1)
        stats = np.stack([
            np.log1p(words) / 5, np.minimum(chars / some, 40) / 10, p.per_text(UPPER[raw]) / chars, p.per_text(SYMBOL[raw]) / chars * 5,
            p.per_text(DIGIT[raw]) / chars * 5, p.per_text(BAR[raw]) / some, p.per_text(BANG[raw]) / some, p.per_text(STOP[raw]) / some * 2,
            p.words_per_text(same) / some, distinct / some, fresh, p.per_text(raw == 10) / some * 10, p.per_text(raw >= 0xC0) / chars,
            np.log1p(np.maximum(n_chars[p.rows], 0)) / 10], axis=1)
        yield p.rows, starts, bucket, value, stats


class Machine:
    """Weights of a factorisation machine; numbers BUCKETS and up are the statistics."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w.astype(np.float32), v.astype(np.float32)

    def score(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(starts) - 1
        owner = np.repeat(np.arange(n), np.diff(starts))
        z = self.bias + np.bincount(owner, weights=self.w[idx] * val, minlength=n) + stats @ self.w[BUCKETS:]
        for f in range(self.v.shape[1]):
            x = self.v[idx, f] * val
            y = stats * self.v[BUCKETS:, f]
            z += 0.5 * ((np.bincount(owner, weights=x, minlength=n) + y.sum(1)) ** 2
                        - np.bincount(owner, weights=x * x, minlength=n) - (y * y).sum(1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Minimise the log loss with AdaGrad over small batches, in ``epochs`` rounds or STEPS batches if that is more.

    Entries of row i are ``starts[i]`` to ``starts[i + 1]``.
    """
    rng = np.random.default_rng(seed)
    w, v = np.zeros(DIM), rng.normal(0, 0.02, (DIM, rank))
    gw, gv = np.full(DIM, 1e-2), np.full((DIM, rank), 1e-2)
    mean = np.clip(y.mean(), 0.01, 0.99)
    bias, gb = float(np.log(mean / (1 - mean))), 1.0
    size = np.diff(starts)
    for _ in range(max(epochs, -(-STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for b in range(0, len(order), BATCH):
            rows = order[b:b + BATCH]
            n = size[rows]
            at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            feats, back = np.unique(idx[at], return_inverse=True)
            x, own = val[at], np.repeat(np.arange(len(rows)), n)
            vx = v[feats][back] * x[:, None]
            total = np.add.reduceat(vx, first)  # every row has its statistics, so none is empty
            z = bias + np.add.reduceat(w[feats][back] * x, first) + 0.5 * (total ** 2 - np.add.reduceat(vx * vx, first)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            ge = g[own]
            dw = np.bincount(back, weights=ge * x, minlength=len(feats)) + DECAY * w[feats]
            part = (ge * x)[:, None] * (total[own] - vx)
            dv = np.stack([np.bincount(back, weights=part[:, f], minlength=len(feats)) for f in range(rank)], 1) + DECAY * v[feats]
            gw[feats] += dw ** 2
            gv[feats] += dv ** 2
            w[feats] -= RATE * dw / np.sqrt(gw[feats])
            v[feats] -= RATE * dv / np.sqrt(gv[feats])
            gb += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(gb)
    return Machine(bias, w, v)


SAMPLE = "rank long, y double, starts int, idx binary, val binary"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_chars = batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False)
        for rows, starts, idx, val, stats in _features(batch.column("text"), n_chars):
            out = []
            for i in range(len(starts) - 1):
                a, b = starts[i], starts[i + 1]
                out.append((np.concatenate([idx[a:b], np.arange(BUCKETS, DIM)]).astype(np.int32).tobytes(),
                            np.concatenate([val[a:b], stats[i]]).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([
                batch.column("rank").slice(rows.start, len(out)), batch.column("y").slice(rows.start, len(out)),
                pa.array([len(i) // 4 for i, _ in out], pa.int32()), pa.array([i for i, _ in out], pa.binary()),
                pa.array([v for _, v in out], pa.binary())], names=["rank", "y", "starts", "idx", "val"])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: (r["rank"], r["idx"], r["val"]))  # the same machine whatever order rows arrive in
    starts = np.concatenate([[0], np.cumsum([r["starts"] for r in rows])])
    m = fit(starts, np.frombuffer(b"".join(r["idx"] for r in rows), np.int32), np.frombuffer(b"".join(r["val"] for r in rows), np.float32).astype(float),
            np.array([r["y"] for r in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.w.tobytes()]), pa.array([m.v.tobytes()])], names=["bias", "w", "v"])


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str = "n_chars", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Machine | None:
    """Fit on labelled rows for which ``learn`` (over ``doc_id``) is true; about ``max_rows`` of them at most, in hash order."""
    labelled = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
                .where(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & learn)
                .groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("rank", F.xxhash64("doc_id", F.lit(11))))
    count = labelled.count()
    bound = min(-(1 << 63) + int(2.0 ** 64 * min(1.0, max_rows / max(count, 1))), (1 << 63) - 1)
    chosen = labelled.where(F.col("rank") <= F.lit(bound).cast("long"))
    # at most about max_rows rows of 24 bytes: safe to send to every task
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(chars_col).cast("long").alias("n_chars"))
    feats = src.join(F.broadcast(chosen), "doc_id").select("rank", "y", "text", "n_chars").mapInArrow(_sample, SAMPLE)
    # a bounded sample: one task fits it
    got = feats.repartition(1).mapInArrow(_fit_task, "bias double, w binary, v binary").collect()
    if not got:
        return None
    got = got[0]
    return Machine(got["bias"], np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(DIM, -1))


def score_quality(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v)) if machine else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*sent.value) if sent else None
        for batch in batches:
            n_chars = batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False)
            for rows, starts, idx, val, stats in _features(batch.column("text"), n_chars):
                s = m.score(starts, idx, val, stats) if m else np.full(len(starts) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, len(s)), pa.array(s)], names=["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(chars_col).cast("long").alias("n_chars"))
    return src.mapInArrow(score, "doc_id long, score double")
