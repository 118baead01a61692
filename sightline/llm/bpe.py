"""Token ids of many texts with a public byte-level BPE file.

The file's pre-tokeniser never joins text across a single blank, or around a single newline, that has a visible character on
both sides. Texts are cut there into units, each distinct unit of a piece is encoded once and remembered while the worker
lives (at most CACHE units), and ids are put together by index. The ids are those of encoding the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from sightline.llm.words import Piece, span_hash

CACHE = 1_000_000
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True


class Units:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.size, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _add(self, keys: list[int], texts: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int64)
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        while self.n + len(keys) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[self.n:self.n + len(keys)] = self.used + np.cumsum(size) - size
        self.size[self.n:self.n + len(keys)] = size
        self.flat[self.used:self.used + len(flat)] = flat
        self.known.update(zip(keys, range(self.n, self.n + len(keys))))
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def encode(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the piece, and the first id of each text and the end."""
        raw, n = p.raw[:p.size], p.size
        if not n:
            return np.zeros(0, np.uint32), np.zeros(p.n + 1, np.int64)
        safe = _SAFE[raw]
        before = safe.copy()
        before[1:] |= (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[:-1] == 0xC3)
        after = safe | (raw == 0xC3)
        inside = np.zeros(n, bool)
        inside[1:-1] = before[:-2] & after[2:]
        edge = p.off[(p.off > 0) & (p.off < n)]
        inside[edge] = False
        inside[edge - 1] = False
        blank, line = np.flatnonzero(inside & (raw == 0x20)), np.flatnonzero(inside & (raw == 0x0A))
        begins = np.zeros(n, bool)
        for some in (p.off[:-1][np.diff(p.off) > 0], blank, line, line + 1):
            begins[some] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        h = span_hash(p.raw, starts, ends)
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        slot = [self.known.get(k, -1) for k in keys]
        new = [i for i, s in enumerate(slot) if s < 0]
        if self.n and self.n + len(new) > CACHE:
            self.clear()
            slot, new = [-1] * len(keys), range(len(keys))
        if new:
            data = p.raw.tobytes()
            first = self.n
            self._add([keys[i] for i in new], [data[starts[at[i]]:ends[at[i]]].decode("utf-8", "replace") for i in new])
            for k, i in enumerate(new):
                slot[i] = first + k
        slots = np.array(slot, np.int64)[inv]
        size = self.size[slots]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[slots] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, p.off)]


@lru_cache(maxsize=2)
def units(path: str) -> Units:
    """One per worker and file."""
    return Units(path)
