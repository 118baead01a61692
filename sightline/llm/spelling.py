"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters.

1. Words are counted where texts are read and summed by one aggregate; those long and frequent enough are the vocabulary.
2. Each length of the vocabulary gets Bloom filters: slices of at most about SLICE words (dealt by hash), each a run of 64-bit blocks, a word
   setting BITS bits of one block. Filters are broadcast in passes of at most PASS_BYTES, so what is broadcast never grows with the corpus.
3. Every word's deletions (probed in the filters one code point shorter) and replacements by a later letter (probed in its own length) are
   hashed as differences of a polynomial, without making strings; an insertion is the other word's deletion, an earlier letter the other word's
   replacement. Only edits a filter lets through become strings and are shuffled to an equi-join with the vocabulary, which removes false positives.
4. The most frequent near word, if it is frequent enough, is a word's form; forms are followed to the end by pointer doubling (frequencies at least
   double on the way, so few rounds suffice).

Defined results: a null or empty text has no words; rows that repeat count again; a null id changes no run; a word of any length takes part;
of near words with equal counts the first in code-point order is the form; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sightline.llm.words import LOWER, PRIME, mix, stage

SLICE, BITS_A_WORD, BITS = 1 << 18, 16, 4
PASS_BYTES = 64 << 20
PIECE = 4 << 20
HELD = 1 << 20  # distinct words a task holds before it passes counts on
PROBES = 1 << 20  # edits hashed at once

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[ord("A"):ord("Z") + 1] = ASCII_LETTER[ord("a"):ord("z") + 1] = True
LEAD = 0xC3  # first UTF-8 byte of U+00C0 to U+00FF, and of nothing else
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


# ---------------------------------------------------------------- counting
def crc_of_runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """CRC-32 of each run's bytes, continued from the checksum of its prefix."""
    state = prefix ^ np.uint32(0xFFFFFFFF)
    size = end - start
    for i in np.flatnonzero(size > 64):
        state[i] = zlib.crc32(buf[start[i]:end[i]].tobytes(), int(prefix[i])) ^ 0xFFFFFFFF
    live = np.flatnonzero(size <= 64)
    live = live[np.argsort(-size[live], kind="stable")]
    ordered = size[live]
    for k in range(int(ordered[0]) if len(live) else 0):
        n = int(np.searchsorted(-ordered, -k, "left"))  # those longer than k
        some = live[:n]
        state[some] = CRC[(state[some] ^ buf[start[some] + k]) & 255] ^ (state[some] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def runs_of(data: np.ndarray, off: np.ndarray, ids: list[int | None], every: int, shortest: int) -> pa.StructArray:
    """Distinct words of some consecutive texts with their counts; ``every``: the checksums that delete a letter."""
    raw = np.append(data, np.uint8(0))
    buf = LOWER[raw]
    lead = raw == LEAD
    ink = ASCII_LETTER[raw] | lead
    ink[1:] |= lead[:-1]
    ink[-1] = False
    begins, ends = ink.copy(), np.zeros(len(ink) + 1, bool)
    begins[1:] &= ~ink[:-1]
    ends[1:] = ink
    ends[:-1] &= ~ink
    inner = off[1:-1] - off[0]
    inner = inner[(inner > 0) & (inner < len(data))]  # the end of a text ends its run
    begins[inner] = ink[inner]
    ends[inner] |= ink[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(start):
        return pa.array([], pa.struct([("values", pa.large_string()), ("counts", pa.int64())]))
    heads = np.concatenate([[0], np.cumsum(ink & ~np.concatenate([[False], lead[:-1]]))])  # code points before each byte
    points = heads[end] - heads[start]
    owner = np.searchsorted(off - off[0], start, "right") - 1
    if every:
        known = np.array([i is not None for i in ids])
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        h = crc_of_runs(buf, start, end, prefix[owner])
        hit = np.flatnonzero((h % every == 0) & known[owner])
        for i, at in zip(hit, h[hit] % points[hit]):
            byte = start[i] + int(np.flatnonzero(~np.concatenate([[False], lead[start[i]:end[i] - 1]]))[at])
            ink[byte:byte + (2 if lead[byte] else 1)] = False
            points[i] -= 1
    size = np.add.reduceat(ink.astype(np.int64), start)  # bytes left; what lies between runs is no ink
    keep = points >= shortest
    for_bytes = np.repeat(keep, size)
    body = buf[ink][for_bytes]
    offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(int(keep.sum()), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))
    return pc.value_counts(words)


def count_words(docs: DataFrame, every: int, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n) in parts; one word may come from several tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> pa.Table:
            t = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            return t.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for b in batches:
            ids = b.column(0).to_pylist()
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            n = len(texts)
            if not n:
                continue
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
            i = 0
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1))
                got = runs_of(data[off[i]:off[j]], off[i:j + 1], ids[i:j], every, shortest)
                held.append(pa.RecordBatch.from_arrays([got.field(0), got.field(1)], names=["word", "n"]))
                rows += len(got)
                i = j
                if rows > 2 * HELD:
                    t = merged()
                    if len(t) > HELD:
                        yield from t.cast(OUT).to_batches(max_chunksize=1 << 16)
                        held, rows = [], 0
                    else:
                        held, rows = t.combine_chunks().to_batches(), len(t)
        if held:
            yield from merged().cast(OUT).to_batches(max_chunksize=1 << 16)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")


OUT = pa.schema([("word", pa.string()), ("n", pa.int64())])


# ---------------------------------------------------------------- letters and filters
def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all code points of the words as Latin-1 bytes, first of each word and the end)."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    words = words.cast(pa.large_string())
    n = len(words)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]] if n else np.zeros(0, np.uint8)
    lead = data == LEAD
    after = np.concatenate([[False], lead[:-1]]) if len(data) else lead
    points = np.where(after, data + np.uint8(0x40), data)[~lead]
    place = np.concatenate([[0], np.cumsum(~lead)])
    return points.astype(np.uint8), place[off - off[0]]


def strings(rows: np.ndarray) -> pa.Array:
    """Rows of Latin-1 bytes as strings."""
    n, width = rows.shape
    flat = rows.reshape(-1)
    wide = flat >= 0x80
    place = np.cumsum(1 + wide) - (1 + wide)
    total = int(place[-1] + 1 + wide[-1]) if len(flat) else 0
    out = np.zeros(total, np.uint8)
    out[place] = np.where(wide, LEAD, flat)
    out[place[wide] + 1] = flat[wide] - np.uint8(0x40)
    ends = np.append(place, total)[np.arange(n + 1) * width] if width else np.zeros(n + 1, np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def power(n: int) -> np.ndarray:
    """PRIME to the 0 .. n."""
    out = np.full(n + 1, PRIME, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def place_of(h: np.ndarray, slices: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, block in it, bits to set) of polynomial hashes."""
    x = mix(h)
    y = mix(x + PRIME)
    bits = np.zeros(len(h), np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << ((y >> np.uint64(6 * k)) & np.uint64(63))
    return (x >> np.uint64(40)) % np.uint64(slices), (x & np.uint64((1 << 40) - 1)) % np.uint64(blocks), bits


def hashes_by_length(points: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of letters) for each length."""
    size = np.diff(first)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield int(length), rows, points[first[rows][:, None] + np.arange(length)]


def polynomial(m: np.ndarray) -> np.ndarray:
    p = power(m.shape[1])
    out = np.zeros(len(m), np.uint64)
    for i in range(m.shape[1]):
        out += m[:, i].astype(np.uint64) * p[i]
    return out


def shape(n: int, slice_words: int) -> tuple[int, int]:
    """(slices, blocks of each) for n words of one length."""
    slices = max(1, -(-n // slice_words))
    return slices, max(1, -(-n * BITS_A_WORD // (slices * 64)))


def build_filters(vocabulary: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """(length, slice, blocks, letters): one row per slice; ``letters`` are those that occur in its words."""
    def slice_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, first = letters(b.column(0))
            length, piece = np.diff(first), np.zeros(len(b), np.int32)
            for size, rows, m in hashes_by_length(points, first):
                piece[rows] = place_of(polynomial(m), *shapes[size])[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length.astype(np.int32)), pa.array(piece)], names=["word", "length", "slice"])

    def build(key, table):
        length, piece = (k.as_py() for k in key)
        filled, seen = np.zeros(shapes[length][1], np.uint64), np.zeros(256, bool)
        for b in table.to_batches():
            points, first = letters(b.column("word"))
            seen[np.unique(points)] = True
            _, block, bits = place_of(polynomial(points.reshape(len(b), length)), *shapes[length])
            np.bitwise_or.at(filled, block.astype(np.int64), bits)
        return pa.table({"length": pa.array([length], pa.int32()), "slice": pa.array([piece], pa.int32()),
                         "blocks": pa.array([filled.tobytes()]), "letters": pa.array([np.flatnonzero(seen).astype(np.uint8).tobytes()])})

    sliced = vocabulary.select("word").mapInArrow(slice_of, "word string, length int, slice int")
    return sliced.groupBy("length", "slice").applyInArrow(build, "length int, slice int, blocks binary, letters binary")


class Filters:
    """The slices of one pass: for each length (slices, blocks, place of each slice or -1, all blocks)."""

    def __init__(self, rows: list[tuple[int, int, bytes]], shapes: dict[int, tuple[int, int]]):
        self.by_length = {}
        for length in {r[0] for r in rows}:
            slices, blocks = shapes[length]
            own = [r for r in rows if r[0] == length]
            where = np.full(slices, -1, np.int64)
            where[[r[1] for r in own]] = np.arange(len(own)) * blocks
            self.by_length[length] = (slices, blocks, where, np.concatenate([np.frombuffer(r[2], np.uint64) for r in own]))

    def holds(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may belong to a word of that length in this pass."""
        if length not in self.by_length or not len(h):
            return np.zeros(0, np.int64)
        slices, blocks, where, filled = self.by_length[length]
        piece, block, bits = place_of(h, slices, blocks)
        base = where[piece.astype(np.int64)]
        got = filled[np.maximum(base, 0) + block.astype(np.int64)]
        return np.flatnonzero((got & bits == bits) & (base >= 0))


def edits(m: np.ndarray, filters: Filters, alphabet: np.ndarray, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, edited letters) of the deletions and replacements that a filter lets through; ``m``: words of one length."""
    length = m.shape[1]
    p = power(length)
    step = max(1, PROBES // max(1, length))
    if length - 1 >= shortest and length - 1 in filters.by_length:
        for lo in range(0, len(m), step):
            some = m[lo:lo + step]
            terms = some.astype(np.uint64) * p[:length]
            before = np.cumsum(terms, axis=1, dtype=np.uint64)
            total = before[:, -1:]
            inverse = pow(int(PRIME), -1, 1 << 64)
            h = (before - terms) + (total - before) * np.uint64(inverse)
            # of equal letters in a row any may go: the first does
            fresh = np.ones(some.shape, bool)
            fresh[:, 1:] = some[:, 1:] != some[:, :-1]
            flat = np.flatnonzero(fresh)
            hit = flat[filters.holds(length - 1, h.reshape(-1)[flat])]
            if len(hit):
                row, at = np.divmod(hit, length)
                keep = np.arange(length) != at[:, None]
                yield lo + row, some[row][keep].reshape(len(hit), length - 1)
    if length in filters.by_length:
        base = polynomial(m)
        each = max(1, PROBES // max(1, len(alphabet)))
        for lo in range(0, m.size, each):
            row, at = np.divmod(np.arange(lo, min(m.size, lo + each)), length)
            old = m[row, at]
            later = alphabet[None, :] > old[:, None]
            i, c = np.nonzero(later)
            h = base[row[i]] + (alphabet[c].astype(np.uint64) - old[i].astype(np.uint64)) * p[at[i]]
            hit = filters.holds(length, h)
            if len(hit):
                i, c = i[hit], c[hit]
                out = m[row[i]]
                out[np.arange(len(i)), at[i]] = alphabet[c]
                yield row[i], out


def candidates(vocabulary: DataFrame, shapes: dict[int, tuple[int, int]], slice_words: int, pass_bytes: int, shortest: int) -> DataFrame:
    """(edit, word, n): edits that may be in the vocabulary; every edit that is in it is among them."""
    built = stage(build_filters(vocabulary, shapes))
    spark = vocabulary.sparkSession
    # passes of bounded size, made from the shapes alone
    size, passes = 0, [[]]
    for length, (slices, blocks) in sorted(shapes.items()):
        for piece in range(slices):
            if size and size + blocks * 8 > pass_bytes:
                size, passes = 0, [*passes, []]
            passes[-1].append((length, piece))
            size += blocks * 8
    seen = set()
    for r in built.select("letters").distinct().toLocalIterator():
        seen |= set(r.letters)
    alphabet = np.array(sorted(seen), np.uint8)
    out = None
    for own in passes:
        span = {}
        for length, piece in own:
            span[length] = (min(piece, span.get(length, (piece, piece))[0]), max(piece, span.get(length, (piece, piece))[1]))
        lengths = sorted(span)
        inside = " OR ".join(f"(length = {k} AND slice BETWEEN {a} AND {b})" for k, (a, b) in span.items())
        rows = [(r.length, r.slice, bytes(r.blocks)) for r in built.where(inside).select("length", "slice", "blocks").collect()]
        shared = spark.sparkContext.broadcast(Filters(rows, shapes))
        reach = sorted({x for k in lengths for x in (k, k + 1)})

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, reach=frozenset(reach)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                points, first = letters(b.column(0))
                for length, rows, m in hashes_by_length(points, first):
                    if length not in reach:
                        continue
                    for row, edited in edits(m, shared.value, alphabet, shortest):
                        at = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays([strings(edited), b.column(0).take(at), b.column(1).take(at)], names=["edit", "word", "n"])

        part = vocabulary.select("word", "n").mapInArrow(probe, "edit string, word string, n long")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- groups
def follow(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last one; each round doubles the length of the path walked."""
    at = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stage(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2, id_col: str = "doc_id",
                      text_col: str = "text", slice_words: int = SLICE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n). ``every``: runs whose checksum it divides lose a letter (0: none do)."""
    counted = count_words(docs, every, shortest, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    vocabulary = stage(counted)
    shapes = {r["length"]: shape(r["n"], slice_words) for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).toLocalIterator()}
    names = "word string, form string, root string, n long, n_near long, form_n long"
    if not shapes:
        return docs.sparkSession.createDataFrame([], names)
    near = candidates(vocabulary, shapes, slice_words, pass_bytes, shortest).join(
        vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    both = near.select(F.explode(F.array(F.struct(F.col("word"), F.col("n"), F.col("edit").alias("other"), F.col("edit_n").alias("other_n")),
                                         F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")
    fits = F.when(F.col("other_n") >= ratio * F.col("n"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = stage(both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(fits).alias("best"))
                  .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = follow(found.where("form IS NOT NULL"))
    return (vocabulary.join(found, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
