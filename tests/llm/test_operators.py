"""The text operators against brute force, exact round trips and held-out rows."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

import public_tokenizers
from sightline.llm import compact_windows, decontaminate, feistel, license_scan, line_frequency, packing, pitman_yor, simhash
from sightline.llm.components import components
from sightline.llm.words import pieces

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, lang="en", source="s"):
    return table(spark, [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)])


def prose(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


ODD = [None, "", "   ", "\n\n", "one", "a b", "x" * 3000, "é ü ñ", " lead", "trail \n", "A\tb\x0bc\x0cd\re", "#*$%&|<> !!", " nbsp em", "日本 語"]


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in ODD] * 3 + ["αβγ  δ\n\nε"]
    got = []
    for p in pieces(pa.array(texts), lower=False, piece_bytes=20):
        data = p.raw.tobytes()
        words = [data[a:b].decode() for a, b in zip(p.ws, p.we)]
        got += [words[p.first[i]:p.first[i + 1]] for i in range(p.n)]
    assert got == [WORD.findall(t) for t in texts]


# ------------------------------------------------------------------ 1
def brute_lines(rows, max_docs, max_share, min_left):
    norm = lambda line: " ".join(WORD.findall(low(line)))
    host_texts, holders = {}, {}
    for _, text, _, host, _ in rows:
        host_texts.setdefault(host or "", set()).add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders.setdefault((host or "", norm(line)), set()).add(text or "")
    out = []
    for i, text, _, host, _ in rows:
        text, host = text or "", host or ""
        words = WORD.findall(text)
        seen = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        cover = {k + j for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        limit = max(max_docs, max_share * len(host_texts[host]))
        left = sum(len(WORD.findall(x)) for x in lines if len(holders[host, norm(x)]) <= limit)
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed,
                    not failed and left >= min_left * len(words), left))
    return out


def test_line_rules(spark):
    rng = random.Random(1)
    common = [prose(rng, 30) for _ in range(3)]
    rows = [(i, t, None, None if i % 3 else "h", 0) for i, t in enumerate(ODD)]
    for i in range(40):
        body = [prose(rng, 25) for _ in range(rng.randrange(4))] + [c if i % 2 else c.upper() for c in common[:rng.randrange(4)]]
        rng.shuffle(body)
        rows.append((100 + i, "\n".join(body), "en", f"h{i % 2}", 5))
    rows += rows[-3:] + [(999, prose(rng, 5) * 20, "en", "h0", 1), (None, common[0], None, "h1", None)]
    got = line_frequency.line_rules(table(spark, rows), max_docs=4, max_share=0.1, min_left=0.5).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_lines(rows, 4, 0.1, 0.5), key=key)
    assert {r["kept"] for r in got} == {True, False}


# ------------------------------------------------------------------ 2
def test_compact_windows_are_subtrees_of_the_minimum():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(0, 90, 5)
        first = np.concatenate([[0], np.cumsum(sizes)])
        v = rng.integers(1, 50, first[-1]).astype(np.uint64) << np.uint64(40)
        got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(v, first, 8))))
        want = set()
        for lo, hi in zip(first[:-1], first[1:]):
            stack = [(lo, hi)]
            while stack:
                a, b = stack.pop()
                if b - a >= 8:
                    c = a + int(np.argmin(v[a:b]))
                    want.add((int(a), c, int(b) - 1))
                    stack += [(a, c), (c + 1, b)]
        assert got == want


def passage_corpus():
    rng = random.Random(3)
    exact, edited = prose(rng, 70), prose(rng, 90)
    words = edited.split()
    words[60] = "other"
    near = " ".join(words)
    texts = [prose(rng, 200) for _ in range(12)]
    texts[1] = f"{prose(rng, 60)} {exact} {prose(rng, 40)}"
    texts[4] = f"{prose(rng, 10)}\n{exact}\n{prose(rng, 90)}"
    texts[5] = f"{prose(rng, 30)} {edited} {prose(rng, 30)}"
    texts[7] = f"{prose(rng, 80)} {near}"
    texts[9] = texts[2]  # a copy
    return texts + [None, "", "short text", prose(rng, 49)]


def test_repeated_passages(spark):
    texts = passage_corpus()
    docs = documents(spark, texts).withColumn("tid", F.lit(1)).withColumn("pos", F.lit("x"))
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(docs).collect()}
    assert set(got) == {1, 4, 5, 7, 2, 9}
    assert got[9]["class_id"] == got[2]["class_id"] == 2 and got[2]["n_copies"] == 2
    for i, start, size, other in ((1, 60, 70, 4), (4, 10, 70, 1), (5, 30, 90, 7), (7, 80, 90, 5)):
        (span,) = got[i]["passages"]
        assert span["other_id"] == other and abs(span["start"] - start) <= 1 and abs(span["n_words"] - size) <= 2


def test_of_equal_texts_one_row_stays(spark):
    rng = random.Random(21)
    text, other, short = prose(rng, 80), prose(rng, 70), "only a few words"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, other), (None, other), (7, short), (7, short)]
    docs = table(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    out = sorted(((r["doc_id"], r["text"]) for r in compact_windows.remove_repeats(docs).collect()), key=repr)
    assert out == sorted([(1, text), (None, other), (7, short), (7, short)], key=repr)


def test_remove_repeats_keeps_one_occurrence(spark):
    texts = passage_corpus()
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in compact_windows.remove_repeats(docs).collect()}
    assert compact_windows.remove_repeats(docs).schema.names == docs.schema.names
    assert 9 not in out and out[2]["text"] == texts[2]
    for i in (0, 3, 6, 8, 10, 11, 12, 13, 14, 15):
        assert out[i]["text"] == texts[i]
    exact = texts[1].split()[60:130]
    assert sum(" ".join(exact) in " ".join((out[i]["text"] or "").split()) for i in (1, 4)) == 1
    assert sum("w" in out[i]["text"] and len(out[i]["text"].split()) < 130 for i in (5, 7)) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.values())


def test_a_passage_in_many_texts_makes_no_pairs(spark):
    rng = random.Random(4)
    shared = prose(rng, 80)
    docs = documents(spark, [f"{prose(rng, 40)} {shared} {prose(rng, 20)}" for _ in range(120)]).repartition(6)
    found = compact_windows.passage_pairs(compact_windows.text_ids(docs))
    assert found.count() < 120 * 8
    out = compact_windows.remove_repeats(docs).collect()
    assert sum(shared in r["text"] for r in out) == 1 and len(out) == 120


def test_fragments_hide_no_passage(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        exact = prose(rng, 60).split()
        for part in (exact, exact, exact[:40], exact[20:], exact[8:48], exact[5:]):
            texts.append(f"{prose(rng, rng.randrange(30, 60))} {' '.join(part)} {prose(rng, rng.randrange(30, 60))}")
    for _ in range(4):  # clusters of variants around one fragment
        core = prose(rng, 45)
        for _ in range(3):
            around = f"{prose(rng, 30)} {core} {prose(rng, 30)}"
            texts += [f"{prose(rng, 20)} {around} {prose(rng, 20)}" for _ in range(2)]
    windows = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            windows.setdefault(tuple(w[j:j + 50]), set()).add((i, j))
    want = {}
    for places in windows.values():
        if len({i for i, _ in places}) > 1:
            for i, j in places:
                want.setdefault(i, set()).update(range(j, j + 50))
    docs = documents(spark, texts).repartition(5)
    got = {r["doc_id"]: {x for s in r["passages"] for x in range(s["start"], s["start"] + s["n_words"])} for r in compact_windows.repeated_passages(docs).collect()}
    assert {i: w - got.get(i, set()) for i, w in want.items() if w - got.get(i, set())} == {}
    out = [r["text"].split() for r in compact_windows.remove_repeats(docs).collect()]
    assert Counter(tuple(w[j:j + 50]) for w in out for j in range(len(w) - 49)).most_common(1)[0][1] == 1


def test_a_common_fragment_makes_no_pairs(spark, monkeypatch):
    """Texts that share fewer words than a passage has are not compared with each other, only with the first text of a key."""
    rng = random.Random(31)
    fragment = prose(rng, 44)
    texts = [f"{prose(rng, 60, 10 ** 6)} {fragment} {prose(rng, 60, 10 ** 6)}" for _ in range(60)]
    long = prose(rng, 120, 10 ** 6).split()
    near = [" ".join("changed" if i == 70 else w for i, w in enumerate(long)), " ".join(long)]  # these two hold the fragment and a passage
    texts += [f"{prose(rng, 60, 10 ** 6)} {fragment} {x}" for x in near]
    compared, verify = spark.sparkContext.accumulator(0), compact_windows._verify

    def counting(*args):
        run = verify(*args)

        def counted(batches):
            for batch in batches:
                compared.add(batch.num_rows)
                yield batch
        return lambda batches: run(counted(batches))
    monkeypatch.setattr(compact_windows, "_verify", counting)
    src = compact_windows.text_ids(documents(spark, texts))
    ids = {r["tid"]: r["doc_id"] for r in src.select("tid", "doc_id").collect()}
    found = compact_windows.passage_pairs(src).collect()
    assert {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in found} == {(60, 61)}
    assert compared.value < 4 * len(texts) < len(texts) * (len(texts) - 1) / 2


def test_run_length_of_marks():
    rng = np.random.default_rng(32)
    marks = rng.random((300, 41)) < 0.25

    def slow(mark, gap):
        total = 1
        for side in (range(21, 41), range(19, -1, -1)):
            end = 20
            for j in side:
                if mark[j] and abs(j - end) <= gap + 1:
                    end = j
            total += abs(end - 20)
        return total
    assert compact_windows._run_length(marks, 4).tolist() == [slow(m, 4) for m in marks]


def test_a_part_of_a_run_is_found():
    """200 words with a changed word in 48 pass alone; 60 words with a changed word in 8 follow."""
    a = list(range(260))
    b = [x + 1000 if (x < 200 and x % 48 == 24) or (x >= 200 and x % 8 == 4) else x for x in a]
    h = [np.array([hash(tuple(w[i:i + 5])) & (1 << 62) - 1 for i in range(256)], np.uint64) for w in (a, b)]
    for seed in (30, 90, 150):
        got = compact_windows.passages_of(*h, np.array([seed << 32 | seed]), 46, 0.8)
        assert len(got) == 1 and got[0][0] == 0 and got[0][1] >= 190 and got[0][4] >= 0.8


def test_a_part_with_many_repeated_shingles_is_found():
    """Few different shingles, a sixth of the places changed: by places the part is too unlike, by its sets it is not."""
    rng = random.Random(1194)
    v = rng.randrange(5, 40)
    a = [rng.randrange(v) for _ in range(rng.randrange(60, 120))]
    b = [x if rng.random() > .15 else 1000 + rng.randrange(5) for x in a]
    same = [i for i in range(len(a)) if a[i] == b[i]]
    place = same[len(same) // 2]
    got = compact_windows.passages_of(np.array(a, np.uint64), np.array(b, np.uint64), np.array([place << 32 | place]), 46, 0.8)
    assert len(got) == 1
    start_b, n_b, start_a, n_a, similarity = got[0]
    x, y = set(a[start_a:start_a + n_a]), set(b[start_b:start_b + n_b])
    assert min(n_a, n_b) >= 46 and similarity == len(x & y) / len(x | y) >= 0.8


# ------------------------------------------------------------------ 3
def brute_licenses(text, templates, threshold):
    norm = lambda s: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s))
    lines = [(k, norm(x)) for k, x in enumerate((text or "").split("\n"))]
    lines = [(k, w) for k, w in lines if w]
    best = {}
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            words = [x for _, w in lines[i:j + 1] for x in w]
            run = Counter(zip(words, words[1:]))
            for name, t in templates.items():
                tw = norm(t)
                bag = Counter(zip(tw, tw[1:]))
                dice = 2.0 * (run & bag).total() / max(len(words) + len(tw) - 2, 1)
                if dice >= threshold and (-dice, lines[i][0], j - i + 1) < best.get(name, (0, 0, 0)):
                    best[name] = (-dice, lines[i][0], j - i + 1)
    return {(name, -d, k, n) for name, (d, k, n) in best.items()}


def test_license_scan(spark):
    from sightline.llm.fixed import LICENSE_TEMPLATES as T
    mit = T["mit-text"].split()
    wrapped = "\n".join(" ".join(mit[i:i + 9]) for i in range(0, len(mit), 9))
    texts = [*ODD, "Released under the MIT License.", "intro\n\nReleased under\nthe MIT  License\nmore", wrapped.replace("charge", "cost"),
             "All rights reserved\nAll rights reserved", "a b c\n" * 50, "Licensed under CC BY 4.0!", T["gpl-3.0"].upper() + "\n" + T["gpl-2.0"]]
    got = {}
    for r in license_scan.license_scan(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], r["dice"], r["first_line"], r["n_lines"]))
    want = {i: b for i, t in enumerate(texts) if (b := brute_licenses(t, T, 0.8))}
    assert got == want and len(want) >= 6


# ------------------------------------------------------------------ 4
def brute_fingerprint(text):
    import xxhash
    w = WORD.findall(low(text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    texts = [*ODD, base, base + " tail", base.upper(), "a b", "A  b", *[prose(rng, 60) for _ in range(5)]]
    out = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert {i: out[i]["component_id"] for i in out} == brute_roots(range(len(texts)), links)


@pytest.mark.parametrize("cell", [2, 6, 2048])
def test_links_of_crowded_fingerprints(spark, cell):
    """A ball of near fingerprints overfills its cells at every level."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(30)}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = [sign(x) for x in fps]
    got = simhash.near_links(spark.createDataFrame([(x,) for x in nodes], "fp long"), cell=cell).collect()
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 3 for a, b in got)
    pairs = [(a, b) for a in nodes for b in nodes if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 3]
    assert brute_roots(nodes, got) == brute_roots(nodes, pairs)
    assert len(set(map(tuple, got))) < len(pairs) or cell < 10


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(5, 5), (300, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == brute_roots({x for e in real for x in e}, real)


def test_keep_one(spark):
    rng = random.Random(8)
    base = prose(rng, 300)
    rows = [(5, base, "en", "a", 1), (3, base + " tail", "en", "b", 1), (3, base + " tail", "en", "b", 1), (None, base, None, None, None),
            (8, prose(rng, 50), "en", "c", 1), (8, prose(rng, 50), "en", "c", 1), (9, None, None, None, None), (4, "", None, None, 0), (None, prose(rng, 40), None, None, None)]
    docs = table(spark, rows).withColumn("fp", F.lit("x")).withColumn("__n", F.lit(0))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"]) for r in out.collect())) == [(False, 3), (False, 4), (False, 8), (False, 8), (True, None)]


# ------------------------------------------------------------------ 5
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_units_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer
    from sightline.llm.bpe import Units
    rng = random.Random(9)
    chars = "ab'sdé ñ \n\n\t  .,!0189ß日  \u0085 don't we'll\r"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(600)]
    plain, enc = Tokenizer.from_file(BPE), Units(BPE)
    got = []
    for p in pieces(pa.array(texts), lower=False, piece_bytes=500):
        ids, first = enc.encode(p)
        got += [ids[first[i]:first[i + 1]].tolist() for i in range(p.n)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    from tokenizers import Tokenizer
    rng = random.Random(10)
    texts = [*ODD, *[prose(rng, rng.choice([3, 40, 300, 900, 4000])) for _ in range(60)]]
    docs = documents(spark, texts).repartition(70)
    got = packing.pack(docs, BPE, open_windows=3, with_ids=True).collect()
    plain = Tokenizer.from_file(BPE)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        own = sorted(by[i], key=lambda r: r["start"])
        want = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == want
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist() and {r["doc_tokens"] for r in own} == {len(want)}
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    tokens = sum(r["length"] for r in got)
    assert tokens / (2048 * len(seqs)) > 0.85
    assert packing.pack(docs.limit(0), BPE).count() == 0


# ------------------------------------------------------------------ 7
def test_edit_distance():
    rng = np.random.default_rng(11)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
            d = e
        return d[-1]
    a, b, size = rng.integers(1, 5, (40, 9)).astype(np.uint64), rng.integers(1, 5, (40, 9)).astype(np.uint64), rng.integers(0, 10, 40)
    assert decontaminate.edit_distances(a, size, b).tolist() == [slow(x[:n].tolist(), y.tolist()) for x, n, y in zip(a, size, b)]


def test_leaks_against_all_windows(spark):
    rng = random.Random(12)
    items = [prose(rng, rng.randrange(8, 50), 300) for _ in range(30)] + [None, "too short", ""]
    texts, planted = [*ODD, *[prose(rng, 300, 300) for _ in range(30)]], {}
    for k in range(30):
        words = items[k].split()
        for _ in range(int(0.2 * len(words)) * (k % 3) // 2):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
        before = prose(rng, rng.randrange(0, 60), 300)
        planted[len(texts)] = k
        texts.append(f"{before} {' '.join(words).title()}. {prose(rng, 30, 300)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench, block_words=400).collect()}

    def slow():
        words_of = lambda s: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s or ""))
        out = set()
        for i, t in enumerate(texts):
            w = words_of(t)
            for k, item in enumerate(items):
                x = words_of(item)
                n, most = len(x), int(0.2 * len(x) + 1e-9)
                if n < 8 or len(set(w) & set(x)) < n - 2 * most - 2:
                    continue
                code = {s: c for c, s in enumerate(set(w) | set(x), 1)}
                a = [code[s] for s in w] + [0] * n
                size = [min(n, len(w) - s) for s in range(len(w))]
                grid = np.array([a[s:s + n] for s in range(len(w))], np.uint64)
                d = decontaminate.edit_distances(grid, np.array(size), np.tile(np.array([code[s] for s in x], np.uint64), (len(w), 1)))
                if d.min() <= most:
                    out.add((i, k, int(d.min())))
        return out
    want = slow()
    assert {(i, k) for i, k, _ in want} >= {(i, k) for i, k in planted.items() if k % 3 == 0}
    assert all((i, k) in {(a, b) for a, b, _ in want} for i, k in got)
    hit = [(i, k) in got for i, k, _ in want]
    assert sum(hit) >= 0.97 * len(hit)
    assert all(got[i, k]["distance"] >= d for i, k, d in want if (i, k) in got)
    kept = decontaminate.drop_leaks(docs.withColumn("key", F.lit(1)), bench, block_words=400)
    assert kept.columns == [*docs.columns, "key"] and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in got}


# ------------------------------------------------------------------ 8
def learn():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(False))


def test_base_scores_and_counts(spark):
    rng = random.Random(13)
    texts = [*ODD, *[prose(rng, 30, 60) for _ in range(60)]]
    docs = documents(spark, texts).repartition(5)
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(docs, learn(), bucket=40).collect()}
    tokens = {i: [*WORD.findall(low(t or "")), None] for i, t in enumerate(texts)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = c.total(), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-9)
        assert r["score"] < 0
    # one bucket or many: the same model but for the draws
    one = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, learn()).collect()}
    assert np.corrcoef([got[i]["score"] for i in tokens], [one[i] for i in tokens])[0, 1] > 0.99


def test_scores_where_seating_is_certain(spark):
    """With every pair and word seen once, each has one table and the averaged probability has a closed form."""
    texts = {0: "a b c", 1: "d e", 3: "a e", 4: "zz"}
    assert zlib.crc32(b"3") % 7 != 2 and zlib.crc32(b"4") % 7 != 2
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, F.col("doc_id") == 0).collect()}
    d, th, d0, th0 = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    pairs = {("$", "a"), ("a", "b"), ("b", "c"), ("c", "$")}

    def p(u, w):
        parent = ((1 - d0) * (w in "abc$") + (th0 + d0 * 4) / 5) / (th0 + 4)
        if u not in "abc$":
            return parent
        return ((1 - d) * ((u, w) in pairs) + (th + d) * parent) / (th + 1)
    for i, t in texts.items():
        ws = [*t.split(), "$"]
        assert got[i] == pytest.approx(sum(np.log10(p(u, w)) for u, w in zip(["$", *ws], ws)), abs=1e-5)


def test_seating_follows_the_restaurant_rule():
    rng = np.random.default_rng(14)
    c, alpha, d = 12, 0.7, 0.4
    got = np.bincount(pitman_yor.seat(np.full(40000, c), np.full(40000, alpha), d, rng).astype(int), minlength=c + 1) / 40000
    want = np.zeros(c + 1)
    want[1] = 1
    for n in range(1, c):
        new = np.zeros(c + 1)
        for t in range(1, n + 1):
            q = alpha / (alpha + n - d * t)
            new[t + 1] += want[t] * q
            new[t] += want[t] * (1 - q)
        want = new
    assert np.abs(got - want).max() < 0.01
    many = pitman_yor.seat(np.full(200, 100_000), np.full(200, 5.0), 0.0, rng).mean()
    assert many == pytest.approx(sum(5.0 / (5.0 + n) for n in range(1, 100_000)) + 1, rel=0.03)


def test_contexts_are_seated_against_the_sampled_parent(spark):
    """A word that is frequent after one word only has few tables, whatever its count: it is not likely after other words."""
    text = " ".join(["a x"] * 1500 + [f"b{i % 40} y{i % 97}" for i in range(600)])
    asked = " ".join(f"b{i} x" for i in range(40))
    docs = spark.createDataFrame([(0, text), (1, asked)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, F.col("doc_id") == 0, bucket=400).collect()}
    d, th, d0, th0 = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    ws = [*text.split(), "$"]
    pairs, counts = Counter(zip(["$", *ws], ws)), Counter(ws)
    words, n, v = {w: i for i, w in enumerate(counts)}, len(ws), len(counts)
    u, w, c = (np.array(x) for x in zip(*((words[x], words[y], k) for (x, y), k in pairs.items())))
    n_u = np.bincount(u, c)
    first = (np.array([*counts.values()]) + 1) / (n + v + 1)

    def reference(seed, alternate):
        rng = np.random.default_rng(seed)
        parent, t, probs = first, np.ones(len(c)), []
        for sweep in range(pitman_yor.BURN + pitman_yor.SAMPLES):
            t = pitman_yor.seat(c, (th + d * np.maximum(np.bincount(u, t, v)[u] - t, 0)) * (parent if alternate else first)[w], d, rng)
            customers, root = np.bincount(w, t, v), np.zeros(v)
            for _ in range(pitman_yor.BURN + 1):
                root = pitman_yor.seat(customers.astype(int), (th0 + d0 * np.maximum(root.sum() - root, 0)) / (v + 1), d0, rng)
            parent = (customers - d0 * root + (th0 + d0 * root.sum()) / (v + 1)) / (th0 + customers.sum())
            probs.append(lambda x, y, t=t, p=parent: (c[(u == x) & (w == y)].sum() - d * t[(u == x) & (w == y)].sum() + (th + d * t[u == x].sum()) * p[y]) / (th + n_u[x]))
        ask = [*asked.split(), "$"]
        return sum(np.log10(np.mean([p(words[x], words[y]) for p in probs[pitman_yor.BURN:]])) for x, y in zip(["$", *ask], ask))
    want, frozen = (np.array([reference(seed, x) for seed in range(8)]) for x in (True, False))
    assert abs(want.mean() - frozen.mean()) > 6 * max(want.std(), 0.5)  # the two models are told apart
    assert abs(got[1] - want.mean()) < abs(want.mean() - frozen.mean()) / 4


def test_held_out_text_beats_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pitman_yor.score_texts(docs, learn()).where(~learn()).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.95 * out[1] > out[1]


# ------------------------------------------------------------------ 9
@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation(spark, n):
    rows = feistel.permute(spark.range(n), "id", n, "place").collect()
    assert sorted(r["place"] for r in rows) == list(range(n))
    again = feistel.permute(spark.range(n).repartition(3), "id", n, "place").collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    if n == 1000:
        assert abs(np.corrcoef([r["id"] for r in rows], [r["place"] for r in rows])[0, 1]) < 0.15


def test_shards(spark):
    rng = random.Random(15)
    rows = [(rng.choice([None, rng.randrange(50)]), rng.choice([None, "", "same", prose(rng, 3)])) for _ in range(333)] + [(7, "same")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = feistel.feistel_shards(feistel.describe(docs), 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and set(shards) == set(range(16))
    assert {tuple(r) for r in got} == {tuple(r) for r in feistel.feistel_shards(feistel.describe(docs.repartition(2)), 16).collect()}
    plan = feistel.feistel_shards(feistel.describe(docs), 16)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert feistel.feistel_shards(feistel.describe(docs.limit(0)), 16).count() == 0
