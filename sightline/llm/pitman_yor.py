"""Word bigram language model: a hierarchical Pitman-Yor process.

Every preceding word is a context restaurant; all of them share one parent restaurant over words, whose base is uniform over the V words
seen and one unknown. A table of a context restaurant is a customer of the parent. With customers c and tables t

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) P(w)

and likewise for P(w). Seating is sampled by Gibbs sweeps (Chinese-restaurant rule, the customers of one dish after each other); BURN sweeps
are thrown away and the predictive probabilities of the next SAMPLES are averaged. Contexts and the parent are seated in turn: all contexts given the
parent's probabilities, then the parent on the tables of all contexts. Only the first sweep, which has no parent yet, takes its probabilities from the word counts
(in steps of a sixth of an octave).

How it is spread. A batch of texts becomes a pack: its distinct words and its texts as numbers of them. Packs send their distinct
words, later their distinct word pairs, to buckets chosen by hash, and buckets answer in the order asked, so a pair moves once for each pack
and never with its document. Numbers travel as compressed arrays. Buckets grow in number with what is sent (BUCKET entries each). A context
with more than a quarter of a bucket's share of the corpus is dealt over several buckets by the following word; its tables are summed in the parent's buckets
and told to each of them before the next sweep.

Defined results: a null or empty text is the single end token; a text of a hold-out fold is scored and not learned; with nothing to learn from, all
probabilities are the base (1 for the end, as V is 0); a null id belongs to no fold and is not learned from; repeated rows count and are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.words import dealt, mix, pair, pieces, stage, stage_by_row

DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 20.0, 0.2, 10.0
BURN, SAMPLES, BUCKET, PACK_WORDS = 1, 2, 1_200_000, 2_500_000
BLOCK = 1 << 18
END = np.uint64(0x5851F42D4C957F2D)
CLASS = np.uint64(0xFF)


def _pack(x: np.ndarray) -> bytes:
    """Compressed array; bytes of equal weight lie together."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 3) if len(x) else b""


def _unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _short(keys: np.ndarray) -> bytes:
    """48-bit keys in six bytes each."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(fields, cols)], names=[n for n, _ in fields])


PACKS = "pack long, n_words long, n_pairs long, ids binary, has_id binary, train binary, sizes binary, words binary, codes binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0

    def packed(held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]) -> pa.RecordBatch:
        h, size = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]).astype(np.int32)
        rows = pa.Table.from_batches([x[2] for x in held])
        words, inv, cnt = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-cnt, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        codes, ids = rank[inv], rows.column("doc_id").combine_chunks()
        return _batch(PACKS, [((part << 24) | number, len(words), len(codes), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().cast(pa.int8()).to_numpy().tobytes(),
                               rows.column("train").combine_chunks().cast(pa.int8()).to_numpy().tobytes(), _pack(size), words[order].tobytes(), _pack(codes))])

    held, n = [], 0
    for batch in batches:
        others = batch.select(["doc_id", "train"])
        for p in pieces(batch.column("text")):
            at = p.first[1:] + np.arange(p.n)  # where each text's end token goes
            h = np.empty(len(p.ws) + p.n, np.uint64)
            is_end = np.zeros(len(h), bool)
            is_end[at] = True
            h[is_end], h[~is_end] = END, p.hashes()
            held.append((h, p.counts + 1, others.slice(p.rows.start, p.n)))
            n += len(h)
            if n >= PACK_WORDS:
                yield packed(held)
                held, n, number = [], 0, number + 1
    if held:
        yield packed(held)


def _distinct(key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse, of numbers below ``limit``; ``key`` is overwritten. Number and place are sorted as one where 63 bits hold both."""
    n = len(key)
    inv = np.empty(n, np.int32)
    bits = max(n - 1, 1).bit_length()
    if max(limit - 1, 1).bit_length() + bits >= 64:
        place = np.argsort(key, kind="stable")
        key = key[place]
        lead = np.concatenate([[True], key[1:] != key[:-1]])
        inv[place] = np.cumsum(lead) - 1
        return key[lead], inv
    key <<= bits
    for i in range(0, n, BLOCK):
        key[i:i + BLOCK] |= np.arange(i, min(i + BLOCK, n))
    key.sort()
    lead, seen = np.ones(n, bool), -1
    for i in range(0, n, BLOCK):
        now = key[i:i + BLOCK]
        number = now >> bits
        lead[i + 1:i + len(now)] = number[1:] != number[:-1]
        lead[i] = not i or number[0] != key[i - 1] >> bits
        order = np.cumsum(lead[i:i + len(now)]) + seen
        inv[now & ((1 << bits) - 1)] = order
        seen = order[-1]
    uniq = key[lead]
    uniq >>= bits
    return uniq, inv


class Pack:
    """The columns of a pack row as arrays."""

    def __init__(self, row: dict):
        self.pack = row["pack"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.has_id = np.frombuffer(row["has_id"], np.int8).astype(bool)
        self.train = np.frombuffer(row["train"], np.int8).astype(bool)
        self.sizes = _unpack(row["sizes"], np.int32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.codes = _unpack(row["codes"], np.uint32)
        self.ends = np.cumsum(self.sizes)

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.codes[np.repeat(self.train, self.sizes)], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of each distinct pair, and which pair each token is."""
        end = int(np.flatnonzero(self.words == END)[0])
        key = np.empty(len(self.codes), np.int64)
        key[1:] = self.codes[:-1]
        key[self.ends - self.sizes] = end  # a text begins after an end
        key *= len(self.words)
        key += self.codes
        uniq, inv = _distinct(key, len(self.words) ** 2)
        u, w = np.divmod(uniq, len(self.words))
        return u, w, inv


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def word_bucket(words: np.ndarray, n: int) -> np.ndarray:
    """Bucket of words by the 40 bits of their hash that :func:`with_class` keeps."""
    return (mix(words >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def with_class(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """48-bit key: 40 bits of the word's hash, then the size of its count in sixths of an octave (0: not learned).

    Words share one of these in about one of 10**12 pairs; they would share their tables.
    """
    size = np.where(counts > 0, np.minimum(1 + np.log2(np.maximum(counts, 1)) * 6, 255), 0)
    return ((words >> np.uint64(24)) << np.uint64(8)) | size.astype(np.uint64)


def class_count(words: np.ndarray) -> np.ndarray:
    size = (words & CLASS).astype(np.float64)
    return np.where(size > 0, 2 ** ((size - 0.5) / 6), 0.0)


def seat(c: np.ndarray, weight_new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating ``c`` customers of one dish; a new table has weight ``weight_new`` against ``customers - d * tables``.

    The first 64 customers come one by one, later ones in groups of a sixteenth of those seated.
    """
    t = np.minimum(c, 1).astype(np.float64)
    live = np.flatnonzero(c > 1)
    seated = 1
    while len(live):
        group = max(1, seated // 16) if seated >= 64 else 1
        take = np.minimum(group, c[live] - seated)
        p = weight_new[live] / (weight_new[live] + np.maximum(seated + (take - 1) / 2 - d * t[live], 1e-9))
        t[live] += rng.random(len(live)) < p if group == 1 else rng.binomial(take, p)
        seated += group
        live = live[c[live] > seated]
    return t


REQUEST = "bucket long, pack long, a binary, b binary, n binary"


def _count_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Training count of each word asked for, in the order asked."""
    words = [np.frombuffer(x, np.uint64) for x in frame["a"]]
    uniq, inv = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate([_unpack(x, np.uint32) for x in frame["n"]]), minlength=len(uniq)).astype(np.int64)
    answer = np.split(total[inv], np.cumsum([len(w) for w in words])[:-1])
    known = [int((total > 0).sum())] + [0] * (len(frame) - 1)
    return pd.DataFrame({"bucket": frame["bucket"], "pack": frame["pack"], "a": [_pack(x) for x in answer], "known": known, "tokens": [int(total.sum())] + [0] * (len(frame) - 1)})


CELLS = "contexts binary, dishes binary, spans binary, dish binary, customers binary, tables binary, packs array<long>, places array<binary>"


class Cells:
    """The distinct pairs of a bucket in the order of their contexts: context, word (dish) and customers of each."""

    def __init__(self, contexts: np.ndarray, dishes: np.ndarray, spans: np.ndarray, dish: np.ndarray, customers: np.ndarray):
        self.contexts, self.dishes, self.dish, self.c = contexts, dishes, dish, customers.astype(np.int64)
        self.ctx = np.repeat(np.arange(len(contexts), dtype=np.int32), spans)

    @classmethod
    def of(cls, row: dict) -> Cells:
        return cls(_long(row["contexts"]), _long(row["dishes"]), *(_unpack(row[x], np.uint32) for x in ("spans", "dish", "customers")))

    def seat(self, parent: np.ndarray, tables: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """One sweep: ``parent`` is the probability of each dish, ``tables`` the number of tables of each context, ``t`` those of each cell."""
        return seat(self.c, (STRENGTH + DISCOUNT * np.maximum(tables[self.ctx] - t, 0)) * parent[self.dish], DISCOUNT, rng)

    def asked(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bucket of the parent, and which dishes and contexts with customers it holds (contexts follow the dishes)."""
        names = np.concatenate([self.dishes, self.contexts])
        seen = np.flatnonzero(np.concatenate([np.bincount(self.dish, self.c, len(self.dishes)), np.bincount(self.ctx, self.c, len(self.contexts))]) > 0)
        for bucket, at in _groups(word_bucket(names[seen] << np.uint64(16), buckets)):
            yield bucket, seen[at], names[seen[at]]

    def told(self, number: int, samples: list[np.ndarray], buckets: int) -> Iterator[tuple]:
        """Tables of each word for the parent, tables of each context for where it is looked up, one row of them for each sample."""
        tables, opened = np.zeros((2, len(samples), len(self.dishes) + len(self.contexts)), np.float32)
        for s, t in enumerate(samples):
            tables[s, :len(self.dishes)] = np.bincount(self.dish, t, len(self.dishes))
            opened[s, len(self.dishes):] = np.bincount(self.ctx, t, len(self.contexts))
        for bucket, at, names in self.asked(buckets):
            yield bucket, number, _short(names), _pack(tables[:, at].ravel()), _pack(opened[:, at].ravel())


def _in_order(at: np.ndarray, named: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs of a bucket in the order of its cells, so that their places there rise."""
    return at[np.lexsort((named[w[at]], named[u[at]]))]


def _first_sweep(n_train: float, v: int, buckets: int):
    """The pairs asked for become cells, seated once with the parent's probabilities taken from the word counts."""
    share = max(n_train / (4 * buckets), 1.0)

    def cells_of(number: int, rows: list[dict]) -> dict:
        heads = [_long(x["a"]) for x in rows]
        spans = [_unpack(x["b2"], np.uint32) for x in rows]
        u = np.concatenate([np.repeat(h, s) for h, s in zip(heads, spans)])
        w = np.concatenate([_long(x["b"]) for x in rows])
        asked = np.concatenate([_unpack(x["n"], np.uint32) for x in rows])
        sizes = np.cumsum([int(s.sum()) for s in spans])[:-1]
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        lead = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        cell = (np.cumsum(lead) - 1).astype(np.int32)
        c = np.bincount(cell, weights=asked[order]).astype(np.uint32)
        places = np.empty(len(order), np.int32)
        places[order] = cell
        del heads, asked, order, cell
        contexts, spans = np.unique(u[lead], return_counts=True)
        dishes, dish = np.unique(w[lead], return_inverse=True)
        del u, w, lead
        spans, dish = spans.astype(np.uint32), dish.astype(np.uint32)
        cells = Cells(contexts, dishes, spans, dish, c)
        t = (cells.c > 0).astype(np.float64)
        # a context dealt over several buckets has that many times the tables seen here
        tables = np.bincount(cells.ctx, t, len(contexts)) * np.maximum(np.ceil(class_count(contexts) / share), 1)
        t = cells.seat((class_count(dishes) + 1) / (n_train + v + 1), tables, t, np.random.default_rng((number, 17, 0)))
        return {"contexts": _short(contexts), "dishes": _short(dishes), "spans": _pack(spans), "dish": _pack(dish), "customers": _pack(c), "tables": _pack(t.astype(np.uint32)),
                "packs": [x["pack"] for x in rows], "places": [_pack(np.diff(x, prepend=0).astype(np.uint32)) for x in np.split(places, sizes)]}

    binary = pa.binary()
    kind = pa.struct([*((n, binary) for n in ("contexts", "dishes", "spans", "dish", "customers", "tables")), ("packs", pa.list_(pa.int64())), ("places", pa.list_(binary))])

    @F.arrow_udf(CELLS)
    def run(bucket: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([cells_of(bucket[i].as_py(), rows[i].as_py()) for i in range(len(rows))], kind)
    return run


def _cells(asked: DataFrame, first) -> DataFrame:
    """Cells of each bucket, with the lineage cut and dealt by bucket: later joins by bucket move none."""
    conf, name = asked.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1")
    try:
        met = asked.repartition("bucket").groupBy("bucket").agg(F.collect_list(F.struct("pack", "a", "b", "b2", "n")).alias("rows"))
        return dealt(met.select("bucket", first("bucket", "rows").alias("cells")), "bucket")
    finally:
        conf.set(name, before)


def _freed(df: DataFrame) -> None:
    """Have the shuffle files of jobs that are over removed: they stay until the driver's JVM finds that nothing refers to them, often only the second time."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _tell(root_buckets: int, samples: int):
    """What cells tell the parent of the tables t0, t1, .."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _batch(REQUEST, list(Cells.of(row).told(row["bucket"], [_unpack(row[f"t{s}"], np.uint32) for s in range(samples)], root_buckets)))
    return run


def _next_sweep(v: int, root_buckets: int, sweep: int, all_c: float, all_t: float):
    """Contexts seated against the parent as it was seated on the tables of the sweep before."""
    base = (ROOT_STRENGTH + ROOT_DISCOUNT * all_t) / (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                number, cells = row["bucket"], Cells.of(row)
                answers = {x["root"]: x for x in row["answers"] or []}
                parent, tables = np.zeros((2, len(cells.dishes) + len(cells.contexts)))
                for bucket, at, _ in cells.asked(root_buckets):
                    parent[at], tables[at] = (_unpack(answers[bucket][x], np.float32) for x in ("a", "n"))
                parent = (parent[:len(cells.dishes)] + base) / (ROOT_STRENGTH + all_c)
                t = cells.seat(parent, tables[len(cells.dishes):], _unpack(row["tables"], np.uint32), np.random.default_rng((number, 17, sweep)))
                yield _batch("bucket long, tables binary", [(number, _pack(t.astype(np.uint32)))])
    return run


def _seat_root(c: np.ndarray, v: int, buckets: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of the parent in one of its buckets; words are dealt evenly, so all buckets have ``buckets`` times as many."""
    t = np.zeros(len(c))
    c = c.round().astype(np.int64)
    for _ in range(BURN + 1):
        t = seat(c, (ROOT_STRENGTH + ROOT_DISCOUNT * np.maximum(t.sum() * buckets - t, 0)) / (v + 1), ROOT_DISCOUNT, rng)
    return t


def _root_answers(v: int, buckets: int, sweep: int):
    """For each bucket of pairs what the parent knows of its words (customers less discounts) and the tables of its contexts, in the order told."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["bucket"].iloc[0])
        have = [_long(x) for x in frame["a"]]
        words, at = np.unique(np.concatenate(have), return_inverse=True)
        customers, opened = (np.bincount(at, weights=np.concatenate([_unpack(x, np.float32) for x in frame[c]]), minlength=len(words)) for c in ("b", "n"))
        tables = _seat_root(customers, v, buckets, np.random.default_rng((number, 23, sweep)))
        sizes, none = np.cumsum([len(x) for x in have])[:-1], [0.0] * (len(have) - 1)
        answer = [[_pack(p) for p in np.split(x[at].astype(np.float32), sizes)] for x in (customers - ROOT_DISCOUNT * tables, opened)]
        return pd.DataFrame({"bucket": frame["pack"], "root": number, "a": answer[0], "n": answer[1], "customers": [customers.sum(), *none], "tables": [tables.sum(), *none]})
    return run


def _root_sampler(v: int, buckets: int):
    def run(key, asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["pack", "bucket", "a", "b", "n", "customers", "tables"]
        if not len(asked):
            return pd.DataFrame(columns=columns)
        number = int(key[0])
        want = [_long(x) for x in asked["a"]]
        have = [_long(x) for x in told["a"]]
        words, inv = np.unique(np.concatenate(want + have), return_inverse=True)
        n_want = sum(map(len, want))
        at = inv[n_want:]

        def summed(column: str) -> np.ndarray:
            got = [_unpack(x, np.float32).reshape(SAMPLES, -1) for x in told[column]]
            return np.stack([np.bincount(at, weights=np.concatenate([g[s] for g in got]), minlength=len(words)) if got else np.zeros(len(words)) for s in range(SAMPLES)])

        customers, opened = summed("b"), summed("n")
        tables = np.stack([_seat_root(customers[s], v, buckets, np.random.default_rng((number, 23, BURN + s))) for s in range(SAMPLES)])
        sizes = np.cumsum([len(x) for x in want])[:-1]
        split = [np.split(x[:, inv[:n_want]], sizes, axis=1) for x in (customers, tables, opened)]
        return pd.DataFrame({"pack": asked["pack"].to_numpy(), "bucket": number, **{
            name: [_pack(p.astype(np.float32).ravel()) for p in part] for name, part in zip("abn", split)},
            "customers": [customers.sum(1).tolist()] + [[0.0] * SAMPLES] * (len(want) - 1), "tables": [tables.sum(1).tolist()] + [[0.0] * SAMPLES] * (len(want) - 1)}, columns=columns)
    return run


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack the customers of its pairs less the discounts of their tables, averaged over the samples."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            mean = sum(_unpack(row[f"t{s}"], np.uint32) / SAMPLES for s in range(SAMPLES))
            left = (_unpack(row["customers"], np.uint32) - DISCOUNT * mean).astype(np.float32)
            for pack, places in zip(row["packs"], row["places"]):
                yield _batch("pack long, bucket long, a binary", [(pack, row["bucket"], _pack(left[np.cumsum(_unpack(places, np.uint32))]))])


def _gather(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """The answers of a pack: no more numbers than it asked for."""
    return df.groupBy("pack").agg(F.collect_list(F.struct("bucket", *cols)).alias(name))


def _word_counts(row: dict, p: Pack, buckets: int) -> np.ndarray:
    out = np.zeros(len(p.words), np.int64)
    answers = {x["bucket"]: x["a"] for x in row["counts"]}
    for bucket, at in _groups(word_bucket(p.words, buckets)):
        out[at] = _unpack(answers[bucket], np.int64)
    return out


def _pair_buckets(named: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray, n_train: float, buckets: int) -> np.ndarray:
    """Bucket of each pair of words numbered ``u`` and ``w``, a block at a time."""
    share = max(n_train / (4 * buckets), 1.0)
    parts = np.maximum(np.ceil(class_count(named) / share), 1).astype(np.uint64)
    spread = mix(named >> np.uint64(8))
    out = np.empty(len(u), np.int32)
    for i in range(0, len(u), BLOCK):
        a, b = u[i:i + BLOCK], w[i:i + BLOCK]
        out[i:i + BLOCK] = pair(named[a], spread[b] % parts[a]) % np.uint64(buckets)
    return out


def _sums(values: np.ndarray, codes: np.ndarray, first: np.ndarray, kind=np.float64) -> np.ndarray:
    """Sum of ``values[codes]`` over each text (they begin at ``first``), some texts at a time."""
    out = np.empty(len(first), kind)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK, "right")) - 1)
        end = int(first[j]) if j < len(first) else len(codes)
        out[i:j] = np.add.reduceat(values[codes[first[i]:end]], first[i:j] - first[i], dtype=kind)
        i = j
    return out


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; rows for which ``learn`` is true are learned from."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    packs = dealt(src.mapInArrow(_packs, PACKS), "pack")  # the three joins with answers move the answers and no pack
    _freed(docs)
    size = packs.agg(F.sum("n_words").alias("w"), F.sum("n_pairs").alias("p")).first()
    wb, pb = int((size["w"] or 0) // bucket + 1), int((size["p"] or 0) // bucket + 1)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = Pack(batch.slice(i, 1).to_pylist()[0])
                n = p.train_counts().astype(np.uint32)
                yield _batch(REQUEST, [(b, p.pack, p.words[at].tobytes(), b"", _pack(n[at])) for b, at in _groups(word_bucket(p.words, wb))])

    counted = stage(packs.mapInArrow(ask_words, REQUEST).groupBy("bucket").applyInPandas(_count_words, "bucket long, pack long, a binary, known long, tokens long"))
    totals = counted.agg(F.sum("known").alias("v"), F.sum("tokens").alias("n")).first()
    v, n_train = int(totals["v"] or 0), int(totals["n"] or 0)
    with_counts = packs.join(_gather(counted, "counts", "a"), "pack")

    asked = "bucket long, pack long, a binary, b binary, b2 binary, n binary"

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                p = Pack(row)
                counts = _word_counts(row, p, wb)
                named = with_class(p.words, counts)
                u, w, inv = p.pairs()
                n = np.bincount(inv[np.repeat(p.train, p.sizes)], minlength=len(u)).astype(np.uint32)
                rows = []
                for b, at in _groups(_pair_buckets(named, u, w, counts, n_train, pb)):
                    at = _in_order(at, named, u, w)
                    heads, span = np.unique(named[u[at]], return_counts=True)
                    rows.append((b, p.pack, _short(heads), _short(named[w[at]]), _pack(span.astype(np.uint32)), _pack(n[at])))
                yield _batch(asked, rows)

    seated = _cells(with_counts.mapInArrow(ask_pairs, asked), _first_sweep(n_train, v, pb))
    _freed(docs)
    # cells stay in their buckets; only tables and the parent's answers move from sweep to sweep
    cells = seated.select("bucket", *[f"cells.{x}" for x in ("contexts", "dishes", "spans", "dish", "customers")])
    seats, samples = seated.select("bucket", "cells.tables"), []
    for sweep in range(1, BURN + SAMPLES):
        now = cells.join(seats, "bucket")
        told = now.withColumnRenamed("tables", "t0").mapInArrow(_tell(wb, 1), REQUEST)
        answers = stage(told.groupBy("bucket").applyInPandas(_root_answers(v, wb, sweep - 1), "bucket long, root long, a binary, n binary, customers double, tables double"))
        sums = answers.agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).first()
        sweeper = _next_sweep(v, wb, sweep, sums["c"] or 0.0, sums["t"] or 0.0)
        known = now.join(answers.groupBy("bucket").agg(F.collect_list(F.struct("root", "a", "n")).alias("answers")), "bucket", "left")
        seats = stage_by_row(known.mapInArrow(sweeper, "bucket long, tables binary"))
        del now, told, answers, known
        _freed(docs)
        if sweep >= BURN:
            samples.append(seats)
    for s, x in enumerate(samples):
        cells, seated = (y.join(x.withColumnRenamed("tables", f"t{s}"), "bucket") for y in (cells, seated))

    def ask_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words = np.frombuffer(row["words"], np.uint64)
                shell = type("Shell", (), {"words": words})
                named = with_class(words, _word_counts(row, shell, wb))
                yield _batch("bucket long, pack long, a binary", [(b, row["pack"], _short(named[at])) for b, at in _groups(word_bucket(words, wb))])

    asks = with_counts.select("pack", "words", "counts").mapInArrow(ask_root, "bucket long, pack long, a binary")
    every = cells.mapInArrow(_tell(wb, SAMPLES), REQUEST)
    root = stage(asks.groupBy("bucket").cogroup(every.groupBy("bucket"))
                 .applyInPandas(_root_sampler(v, wb), "pack long, bucket long, a binary, b binary, n binary, customers array<double>, tables array<double>"))
    _freed(docs)
    sums = root.agg(*[F.sum(F.col(c)[s]).alias(f"{c}{s}") for c in ("customers", "tables") for s in range(SAMPLES)]).first()
    all_c, all_t = (np.array([(sums[f"{c}{s}"] if sums else 0) or 0.0 for s in range(SAMPLES)]) for c in ("customers", "tables"))

    result = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                p = Pack(row)
                first = p.ends - p.sizes
                counts = _word_counts(row, p, wb)
                base_score = _sums(np.log10((counts + 1) / (n_train + v + 1)), p.codes, first)
                known = _sums(counts > 0, p.codes, first, np.int64)
                named = with_class(p.words, counts)
                answers = {x["bucket"]: x for x in row.pop("root")}
                c, t, o = (np.zeros((SAMPLES, len(p.words)), np.float32) for _ in range(3))
                for b, at in _groups(word_bucket(p.words, wb)):
                    answer = answers.pop(b)
                    for into, name in ((c, "a"), (t, "b"), (o, "n")):
                        into[:, at] = _unpack(answer[name], np.float32).reshape(SAMPLES, -1)
                base = (ROOT_STRENGTH + ROOT_DISCOUNT * all_t) / (ROOT_STRENGTH + all_c)
                parent = (c - ROOT_DISCOUNT * t.astype(np.float64)) / (ROOT_STRENGTH + all_c)[:, None] + base[:, None] / (v + 1)
                u, w, inv = p.pairs()
                prob = np.zeros(len(u))
                left = {x["bucket"]: x["a"] for x in row.pop("pairs")}
                for b, at in _groups(_pair_buckets(named, u, w, counts, n_train, pb)):
                    prob[_in_order(at, named, u, w)] = _unpack(left.pop(b), np.float32)
                for i0 in range(0, len(u), BLOCK):  # in place, a block at a time
                    ub, words_b = u[i0:i0 + BLOCK], w[i0:i0 + BLOCK]
                    below = STRENGTH + counts[ub]
                    own = prob[i0:i0 + BLOCK] / below
                    for s in range(SAMPLES):
                        own += (STRENGTH + DISCOUNT * o[s, ub].astype(np.float64)) / below * parent[s, words_b] / SAMPLES
                    prob[i0:i0 + BLOCK] = np.log10(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(p.ids, mask=~p.has_id), pa.array(p.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(p.ids), n_train, np.int64)),
                    pa.array(base_score), pa.array(_sums(prob, inv, first))], names=[f.split()[0] for f in result.split(", ")])
                del row, p, u, w, inv, prob, c, t, o, parent

    held = seated.select("bucket", *[f"cells.{x}" for x in ("customers", "packs", "places")], *[f"t{s}" for s in range(SAMPLES)])
    left = held.mapInArrow(_left, "pack long, bucket long, a binary")
    whole = (with_counts.join(_gather(left, "pairs", "a"), "pack").join(_gather(root, "root", "a", "b", "n"), "pack"))
    return stage_by_row(whole.mapInArrow(score, result))
