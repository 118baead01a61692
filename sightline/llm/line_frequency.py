"""Quality rules on lines that many documents of one host share.

Lines are normalised (A-Z lower-cased, words joined by single blanks) and hashed. For each host the
distinct documents holding a line are counted; documents with equal texts are one. Lines found in more
documents than the host's limit are removed, and a document that loses too much is rejected.

Defined results: a null or empty text has no words and no lines; a null host is a host of its own (as the
empty name); rows that repeat (id, text and host alike) are each returned and count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.words import join_null_safe, mix, pair, pieces, powers, shingles, span_hash, stage

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MAX_DOCS, MAX_SHARE, MIN_LEFT, MIN_WORDS, MAX_REPEAT = 10, 0.01, 0.3, 50, 50

FEATURES = ("doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, lines array<struct<line:long,words:int>>")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column("text"), lower=True):
            ids = batch.column("doc_id").slice(p.rows.start, p.n)
            hosts = batch.column("host").slice(p.rows.start, p.n)
            owner = p.owner.astype(np.uint64)
            # words in repeated three-word windows
            h = p.hashes(p.raw)
            g, at = shingles(h, p, 3)
            _, inv, cnt = np.unique(pair(g, owner[at]), return_inverse=True, return_counts=True)
            twice = at[cnt[inv] > 1]
            cover = np.zeros(len(h) + 2, bool)
            for i in range(3):
                cover[twice + i] = True
            # lines: a text's end and each newline end one
            breaks = np.flatnonzero(p.raw[:p.size] == 10)
            ls = np.unique(np.concatenate([p.off[:-1][np.diff(p.off) > 0], breaks + 1]))
            ls = ls[ls < p.size]
            le = np.concatenate([ls[1:], [p.size]]).astype(np.int64)[:len(ls)]
            le = np.where((le > ls) & (p.raw[np.maximum(le - 1, 0)] == 10), le - 1, le)
            w0, w1 = np.searchsorted(p.ws, ls), np.searchsorted(p.ws, le)
            has = w1 > w0
            ls, le, w0, w1 = ls[has], le[has], w0[has], w1[has]
            text_of = np.searchsorted(p.off, ls, "right") - 1
            raw = pair(span_hash(p.raw, ls, le), text_of.astype(np.uint64))
            once = np.unique(raw, return_index=True)[1]
            lines = np.bincount(text_of, minlength=p.n)
            dup = lines - np.bincount(text_of[once], minlength=p.n)
            # normalised lines, one of each in a text, with the words all its occurrences hold
            low = p.hashes()
            rank = np.arange(len(low)) - np.repeat(w0, w1 - w0)
            norm = mix(np.add.reduceat(low * powers(int((w1 - w0).max()))[rank], w0)) if len(w0) else np.zeros(0, np.uint64)
            key, where, inv = np.unique(pair(norm, text_of.astype(np.uint64)), return_index=True, return_inverse=True)
            words = np.bincount(inv, weights=w1 - w0, minlength=len(key)).astype(np.int32)
            order = np.lexsort((norm[where], text_of[where]))
            where, words = where[order], words[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(text_of[where], minlength=p.n))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(norm[where].view(np.int64)), pa.array(words)], ["line", "words"])
            yield pa.RecordBatch.from_arrays([
                ids, hosts, pa.array(span_hash(p.raw, p.off[:-1], p.off[1:]).view(np.int64)),
                pa.array(p.counts.astype(np.int64)), pa.array(p.per_text(p.ink & ((p.raw[:p.size] & 0xC0) != 0x80))),
                pa.array(p.per_text(SYMBOLS[p.raw[:p.size]])), pa.array(dup.astype(np.int64)),
                pa.array(p.words_per_text(cover[:len(h)])), pa.ListArray.from_arrays(pa.array(cuts), pairs)],
                names=["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT,
               min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT) -> DataFrame:
    """Counts and verdict of each row of ``docs``.

    A line goes if more than ``max(max_docs, max_share * documents of the host)`` distinct documents of the host have it.
    ``left_words`` are the words in the lines that stay; a document keeping less than ``min_left`` of its words is depleted.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      F.col(text_col).cast("string").alias("text"))
    feats = stage(src.mapInArrow(_features, FEATURES))
    key = ["doc_id", "text_hash", "host"]
    one = feats.groupBy("host", "text_hash").agg(F.lit(1).alias("one"))
    limits = one.groupBy("host").agg(F.greatest(F.lit(float(max_docs)), F.count("*") * F.lit(max_share)).alias("limit"))
    lines = feats.select(*key, F.explode("lines").alias("l")).select(*key, "l.line", "l.words")
    # hash partial aggregates: a line of a third of all documents is one row per task after the first step
    holders = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    common = stage(holders.join(limits, "host").where(F.col("n_docs") > F.col("limit")).select("host", "line"))
    gone = (lines.join(common, ["host", "line"]).groupBy(*key, "line").agg(F.max("words").alias("words"))
            .groupBy(*key).agg(F.sum("words").alias("gone")))
    joined = join_null_safe(feats, gone, key)
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & (left >= F.lit(min_left) * F.col("n_words"))).alias("kept"),
                         left.cast("long").alias("left_words"))
