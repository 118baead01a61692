"""Licence scan: Dice coefficient over word bigrams between licence templates and runs of lines.

Texts and templates are normalised alike: A-Z lower-cased, ASCII punctuation and blanks part words. Every
run of consecutive lines is compared as a bag of bigrams with every template whose size can reach the threshold:
``dice >= t`` needs ``t / (2 - t) <= |run| / |template| <= (2 - t) / t``, and at least ``t / 2 * (|run| + |template|)``
bigrams in common, so nearly all runs are pruned by counting. Templates are a parameter and travel with the task's code;
they are a fixed small list, checked against ``MAX_TEMPLATE_WORDS``.

Defined results: null, empty and wordless texts match nothing; templates need two words; among runs with equal Dice for one
template the first, then the shortest is returned; repeated rows are each returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.fixed import LICENSE_TEMPLATES
from sightline.llm.words import pair, pieces

THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 1_000_000
PARTING = np.ones(256, bool)
PARTING[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

RESULT = "doc_id long, license string, dice double, first_line long, n_lines long"


def _bags(templates: dict[str, str]) -> list[tuple[str, int, Counter]]:
    out = []
    for name, text in sorted(templates.items()):
        for p in pieces(pa.array([text]), piece_bytes=1 << 30, separator=PARTING):
            h = p.hashes()
            if len(h) > 1:
                out.append((name, len(h) - 1, Counter(pair(h[:-1], h[1:]).tolist())))
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] = LICENSE_TEMPLATES, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and template that a run of its lines matches: the best run's Dice, first line and lines with words."""
    bags = _bags(templates)
    if sum(size for _, size, _ in bags) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words; scan with several smaller sets")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = np.array(sorted({b for _, _, bag in bags for b in bag}), np.uint64)
    sizes = np.array(sorted(size for _, size, _ in bags), np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(known):
            return
        for batch in batches:
            for p in pieces(batch.column("text"), separator=PARTING):
                h = p.hashes()
                if len(h) < 2:
                    continue
                big = pair(h[:-1], h[1:])
                spot = np.searchsorted(known, big)
                mark = known[np.minimum(spot, len(known) - 1)] == big
                mark &= p.owner[1:] == p.owner[:-1]
                marks = np.concatenate([[0], np.cumsum(mark)])
                # lines with words, as ranges of words
                breaks = np.flatnonzero(p.raw[:p.size] == 10) + 1
                ls = np.unique(np.concatenate([p.off[:-1], breaks]))
                w0 = np.searchsorted(p.ws, ls)
                w1 = np.append(w0[1:], len(h))
                has = w1 > w0
                ls, w0, w1 = ls[has], w0[has], w1[has]
                doc = p.owner[w0]
                number = np.searchsorted(breaks, ls, "right") - np.searchsorted(breaks, p.off[doc], "right")
                number[ls == p.off[doc]] = 0
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                i = np.arange(len(w0))
                span = 0
                while len(i):
                    i = i[i + span < len(w0)]
                    i = i[doc[i + span] == doc[i]]
                    size = w1[i + span] - w0[i] - 1
                    near = size <= high * sizes[-1]
                    i, size = i[near], size[near]
                    common = marks[w1[i + span] - 1] - marks[w0[i]]
                    # the smallest template that this size can match asks for the fewest common bigrams
                    least = np.searchsorted(sizes, low * size - 1e-9)
                    fits = (least < len(sizes)) & (size > 0)
                    least = sizes[np.minimum(least, len(sizes) - 1)]
                    fits &= common >= threshold / 2 * (size + least) - 1e-9
                    for j in i[fits]:
                        a, b = w0[j], w1[j + span] - 1
                        run = Counter(big[a:b][mark[a:b]].tolist())
                        for name, m, bag in bags:
                            if low * m - 1e-9 <= b - a <= high * m + 1e-9:
                                dice = 2.0 * (run & bag).total() / (b - a + m)
                                at = (int(doc[j]), name)
                                if dice >= threshold and (-dice, int(number[j]), span + 1) < best.get(at, (0.0, 0, 0)):
                                    best[at] = (-dice, int(number[j]), span + 1)
                    span += 1
                if best:
                    rows = pa.array([k[0] + p.rows.start for k in best])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), pa.array([k[1] for k in best]), pa.array([-v[0] for v in best.values()]),
                         pa.array([v[1] for v in best.values()], pa.int64()), pa.array([v[2] for v in best.values()], pa.int64())],
                        names=["doc_id", "license", "dice", "first_line", "n_lines"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(scan, RESULT)
