"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import spelling
from sightline.llm.spelling import spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, edit string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, every=97, shortest=5, least=3):
    c = Counter()
    for d, t in rows:
        for x in RUN.findall(t or ""):
            x = re.sub("[A-Z]", lambda m: m[0].lower(), x)
            h = zlib.crc32(f"{d}:{x}".encode())
            if every and d is not None and h % every == 0:
                x = x[:h % len(x)] + x[h % len(x) + 1:]
            c[x] += 1
    return {w: n for w, n in c.items() if len(w) >= shortest and n >= least}


def brute(v):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    of = {a: [b for b in v if near(a, b)] for a in v}
    form = {}
    for a, others in of.items():
        best = min(others, key=lambda b: (-v[b], b), default=None)
        if best is not None and v[best] >= 2 * v[a]:
            form[a] = best
    out = []
    for a in v:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, v[a], len(of[a]), v[form[a]] if a in form else None))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    got = spelling_variants(spark.createDataFrame([(d, t, "w", 1, "e") for d, t in rows], SCHEMA), **kw)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(rng, n):
    base = ["".join(rng.choice("abéÿ×o") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(40)):
            w = base[int(len(base) * rng.random() ** 3)]
            if rng.random() < .3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abÀ") + w[k + 1:]])
            words.append(w.upper() if rng.random() < .1 else w)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ", ", "\n", "9"]).join(words)))
    return rows


@pytest.mark.parametrize("slice_words,pass_bytes", [(1 << 18, 64 << 20), (20, 200)])
def test_equals_brute_force(spark, slice_words, pass_bytes):
    rng = random.Random(8)
    long = "é" * 900 + "b"
    rows = corpus(rng, 400) + [(1, None), (2, ""), (3, "日本 123 Ā"), (4, f"{long} {long} {long} {long}c {long}c {long}c"), (4, " ".join([long] * 4))]
    rows += rows[:40]
    v = counts(rows)
    want = brute(v)
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] != r[2] for r in want if r[1])
    assert run(spark, rows, slice_words=slice_words, pass_bytes=pass_bytes) == want


def test_one_common_word_and_no_words(spark):
    rows = [(i, "common " * 50 + "comon " * (i % 2)) for i in range(60)]
    assert run(spark, rows) == brute(counts(rows))
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "a bb")]) == []


def test_runs_and_deleted_letters():
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 345678]), rng.choice(["", "é" * 200 + " " + "a" * 70, "".join(rng.choice("abcXYé×ÿ÷Ää .\n日") for _ in range(rng.randrange(60)))])) for _ in range(300)]
    texts = pa.array([t for _, t in rows], pa.large_string())
    off, data = np.frombuffer(texts.buffers()[1], np.int64)[:len(rows) + 1], np.frombuffer(texts.buffers()[2], np.uint8)
    for every in (0, 1, 3, 97):
        got = spelling.runs_of(data, off, [d for d, _ in rows], every, 2)
        assert dict(zip(got.field(0).to_pylist(), got.field(1).to_pylist())) == counts(rows, every, 2, 1)


def test_no_word_of_a_filter_is_missed():
    rng = np.random.default_rng(3)
    m = np.unique(rng.choice(np.frombuffer(b"abc\xe9", np.uint8), (3000, 9)), axis=0)
    shapes = {9: spelling.shape(len(m), 500)}
    piece, block, bits = spelling.place_of(spelling.polynomial(m), *shapes[9])
    rows = []
    for s in range(shapes[9][0]):
        filled = np.zeros(shapes[9][1], np.uint64)
        np.bitwise_or.at(filled, block[piece == s].astype(np.int64), bits[piece == s])
        rows.append((9, s, filled.tobytes()))
    f = spelling.Filters(rows, shapes)
    assert len(f.holds(9, spelling.polynomial(m))) == len(m)
    other = rng.integers(1, 255, (20000, 9), dtype=np.uint8)
    assert len(f.holds(9, spelling.polynomial(other))) < 0.03 * len(other)
