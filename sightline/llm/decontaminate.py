"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH, then exact verification.

Texts and items are sequences of words (A-Z lower-cased, ASCII punctuation and blanks part words). A document window of an item's
size matches when its edit distance to the item is at most ``1 - similarity`` of the item's words; a window at a document's end may be
shorter. Windows are first thinned without loss: within k edits an item of n words keeps n - 1 - 2k word pairs, so a
window with fewer pairs known from any item of its size group cannot match. Each remaining window is embedded by REPEATS random walks: at step j the word
under the walk is written and the walk moves on if a random bit of (j, word) says so, which turns edits into few differing places.
SAMPLED places make one signature; windows and items sharing any of the signatures are compared exactly.

The chance to miss a matching window is at most ``(1 - a ** SAMPLED) ** REPEATS`` for an agreement a of the embeddings; REPEATS follows
from the target recall at the agreement expected at the threshold. Neighbouring windows of one passage give further chances.

Items are a bounded query set: they are read in blocks of BLOCK_WORDS words and each block is held against all documents.

Defined results: null, empty and short texts match only items they come close to; items of fewer than MIN_ITEM words are too short to
tell and are not searched; among equal distances the first window is returned; repeated rows are each returned; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.license_scan import PARTING
from sightline.llm.words import mix, pair, pieces

SIMILARITY, MIN_ITEM, SAMPLED, AGREEMENT, RECALL = 0.8, 8, 3, 0.6, 0.99
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT ** SAMPLED))
BLOCK_WORDS = 500_000
PIECE_BYTES = 8 << 20
PAD = np.uint64(0)
RESULT = "doc_id long, item_id long, distance long, start_word long, n_words long"


def allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


@lru_cache(maxsize=4096)
def _draws(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each repeat the sampled steps, and the salt of every step."""
    rng = np.random.default_rng((seed, n))
    taken = np.stack([np.sort(rng.choice(3 * n, SAMPLED, replace=False)) for _ in range(REPEATS)])
    return taken, rng.integers(1, 1 << 63, (3 * n, REPEATS), dtype=np.uint64)


def signatures(words: np.ndarray, start: np.ndarray, size: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Signatures (repeats in rows) of the windows ``words[start:start + size]``, each walked for 3n steps; a walk past the end writes a pad."""
    taken, salt = _draws(n, seed)
    out = np.empty((REPEATS, len(start)), np.uint64)
    for b in range(0, len(start), 2048):
        grid = start[b:b + 2048, None] + np.arange(n + 1)
        own = np.where(np.arange(n + 1) < size[b:b + 2048, None], words[np.minimum(grid, len(words) - 1)], PAD)
        rows = np.arange(len(own))
        at = np.zeros((REPEATS, len(own)), np.int64)
        sig = np.repeat(np.arange(1, REPEATS + 1, dtype=np.uint64)[:, None], len(own), 1)
        for j in range(int(taken.max()) + 1):
            here = own[rows, at]
            now = np.flatnonzero((taken == j).any(1))
            if len(now):
                sig[now] = pair(sig[now], here[now])
            at = np.minimum(at + (mix(here ^ salt[j][:, None]) >> np.uint64(63)).astype(np.int64), n)
        out[:, b:b + 2048] = sig
    return out


def edit_distances(a: np.ndarray, a_size: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance between rows of ``a`` (cut to ``a_size``) and of ``b`` (all of one length)."""
    rows, width = a.shape
    one = np.int16(1)
    steps = np.arange(width + 1, dtype=np.int32 if max(width, b.shape[1]) > 16_000 else np.int16)
    d = np.tile(steps, (rows, 1))
    for j in range(b.shape[1]):
        new = np.empty_like(d)
        new[:, 0] = j + 1
        new[:, 1:] = np.minimum(d[:, 1:] + one, d[:, :-1] + (a != b[:, j:j + 1]))
        d = np.minimum.accumulate(new - steps, axis=1) + steps
    return d[np.arange(rows), a_size].astype(np.int64)


class Index:
    """Items of one block by their number of words, with the signatures of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float, seed: int = 5):
        self.seed, self.sizes = seed, {}
        known: list[np.ndarray] = []
        for n in sorted({len(w) for _, w in items}):
            ids = np.array([i for i, w in items if len(w) == n], np.int64)
            words = np.stack([w for _, w in items if len(w) == n])
            flat, start = words.ravel(), np.arange(len(ids)) * n
            tables = []
            for sig in signatures(flat, start, np.full(len(ids), n), n, seed):
                order = np.argsort(sig, kind="stable")
                tables.append((sig[order], order))
            self.sizes[n] = (ids, words, tables, allowed(n, similarity))
            known.append(np.unique(pair(words[:, :-1].ravel(), words[:, 1:].ravel())))
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        # which known pairs each size group has
        self.member = {n: np.isin(self.known, own) for n, own in zip(self.sizes, known)}

    def search(self, h: np.ndarray, first: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item id, distance, start, size) of matching windows."""
        if len(h) < 2 or not len(self.known):
            return
        big = pair(h[:-1], h[1:])
        spot = np.minimum(np.searchsorted(self.known, big), len(self.known) - 1)
        marked = np.flatnonzero((self.known[spot] == big) & (owner[1:] == owner[:-1]))
        spot = spot[marked]
        end = first[1:][owner]
        for n, (ids, words, tables, k) in self.sizes.items():
            at = marked[self.member[n][spot]]  # first words of pairs known from items of this size
            need = max(1, n - 1 - 2 * k)
            if len(at) < need:
                continue
            # a window holds `need` pairs if it holds some pair and the one `need - 1` further on
            last = at[need - 1:]
            low, high = np.maximum(last - n + 2, first[owner[last]]), at[:len(last)]
            ok = (low <= high) & (owner[high] == owner[last])
            low, high = low[ok], high[ok]
            if not len(low):
                continue
            span = high - low + 1
            start = np.unique(np.repeat(low - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum()))
            size = np.minimum(end[start] - start, n)
            enough = size >= n - k
            start = start[enough]
            size = size[enough]
            if not len(start):
                continue
            found: list[np.ndarray] = []
            for own, (sig, order) in zip(signatures(h, start, size, n, self.seed), tables):
                lo, hi = np.searchsorted(sig, own, "left"), np.searchsorted(sig, own, "right")
                hits = hi - lo
                w = np.repeat(np.arange(len(start)), hits)
                item = order[np.repeat(lo - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())]
                found.append(w * len(ids) + item)
            cand = np.unique(np.concatenate(found))
            for b in range(0, len(cand), 4096):
                w, item = np.divmod(cand[b:b + 4096], len(ids))
                grid = start[w][:, None] + np.arange(n)
                a = np.where(np.arange(n) < size[w][:, None], h[np.minimum(grid, len(h) - 1)], PAD)
                dist = edit_distances(a, size[w], words[item])
                ok = dist <= k
                yield owner[start[w[ok]]], ids[item[ok]], dist[ok], start[w[ok]] - first[owner[start[w[ok]]]], size[w[ok]]


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, held = [], 0
    for row in items.toLocalIterator():
        for p in pieces(pa.array([row["text"]], pa.string()), piece_bytes=1 << 30, separator=PARTING):
            words = p.hashes()
            if len(words) >= MIN_ITEM and row["item_id"] is not None:
                block.append((row["item_id"], words))
                held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    yield block


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item found in it: the best window and its distance in words."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    want = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))

    def searcher(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, similarity)
            for batch in batches:
                for p in pieces(batch.column("text"), piece_bytes=PIECE_BYTES, separator=PARTING):
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for part in index.search(p.hashes(), p.first, p.owner):
                        for text, item, dist, start, size in zip(*(x.tolist() for x in part)):
                            if (text, item) not in best or (dist, start) < best[text, item][:2]:
                                best[text, item] = (dist, start, size)
                    if best:
                        rows = pa.array([t + p.rows.start for t, _ in best])
                        cols = list(zip(*best.values()))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(rows), pa.array([i for _, i in best], pa.int64()), *[pa.array(c, pa.int64()) for c in cols]],
                            names=["doc_id", "item_id", "distance", "start_word", "n_words"])

        return src.mapInArrow(run, RESULT)

    return reduce(DataFrame.unionByName, [searcher(b) for b in _item_blocks(want, block_words)])


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    want = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    out = docs
    for block in _item_blocks(want, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, similarity)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for p in pieces(batch.column(text_col), piece_bytes=PIECE_BYTES, separator=PARTING):
                    for part in index.search(p.hashes(), p.first, p.owner):
                        keep[part[0] + p.rows.start] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
