"""Language, quality, hostile input and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from sightline.llm import compact_windows, decontaminate, factorization, feistel, language_id, license_scan, line_frequency, packing, pitman_yor, simhash
from test_operators import ODD, SCHEMA, brute_fingerprint, documents, prose, table

VOCAB = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
def fold5():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


# ------------------------------------------------------------------ 6
def pieces_of_vocabulary():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    names = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))})
    return {s: i for i, s in enumerate([s for s in names if 0 < len(s) <= language_id.LONGEST and s != language_id.BEGIN])}


def all_segmentations(word, known):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known or n == 1:
            for rest in all_segmentations(word[n:], known):
                yield [known.get(word[:n], -1), *rest]


def test_forward_pass_sums_all_segmentations():
    known, vocab = pieces_of_vocabulary(), language_id.vocabulary(VOCAB)
    assert vocab[2] == len(known)
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(len(known) + 1), 2)
    words = ["the", "hello", "straße", "日本", "a", "zzzzz", "éèê"]
    marked = {w: list(all_segmentations(language_id.BEGIN + w, known)) for w in words}
    want = [[np.log(sum(np.prod(probs[k][s]) for s in marked[w])) for k in range(2)] for w in words]
    assert np.allclose(language_id.log_likelihood(words, vocab, probs), want)
    weight = np.array([3.0, 1, 2, 1, 5, 1, 1])
    counts = np.zeros(len(known) + 1)
    for w, c in zip(words, weight):
        mass = np.array([np.prod(probs[0][s]) for s in marked[w]])
        for s, m in zip(marked[w], mass / mass.sum()):
            np.add.at(counts, s, c * m)
    assert np.allclose(language_id.expected_counts(words, weight, vocab, probs[0]), counts)


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train_languages(docs, fold5() != 0, VOCAB)
    got = language_id.identify(docs, model, VOCAB).join(docs, "doc_id").where(fold5() == 0)
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98
    odd = documents(spark, [*ODD, "123 456", "Ünïcödé", "«…»", "x" * 5000])
    out = {r["doc_id"]: r for r in language_id.identify(odd, model, VOCAB).collect()}
    und = {i for i, r in out.items() if r["lang_pred"] == "und"}
    n = len(ODD)
    assert und == {0, 1, 2, 3, 11, n, n + 2} and all(out[i]["score"] == 0 for i in und) and all(0 <= r["score"] <= 1 for r in out.values())


# ------------------------------------------------------------------ 10
def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = factorization.Machine(0.3, rng.normal(0, 1, factorization.DIM), rng.normal(0, 1, (factorization.DIM, 4)))
    starts, idx, val = np.array([0, 3, 3, 8]), rng.integers(0, factorization.BUCKETS, 8), rng.normal(0, 1, 8)
    stats = rng.normal(0, 0.1, (3, factorization.STATS))
    want = []
    for i in range(3):
        k = np.concatenate([idx[starts[i]:starts[i + 1]], np.arange(factorization.BUCKETS, factorization.DIM)])
        x = np.concatenate([val[starts[i]:starts[i + 1]], stats[i]])
        z = m.bias + m.w[k] @ x + sum(m.v[k[a]] @ m.v[k[b]] * x[a] * x[b] for a in range(len(k)) for b in range(a))
        want.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    assert np.allclose(m.score(starts, idx, val, stats), want, atol=1e-4)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    machine = factorization.train_quality(docs, labels, fold5() != 0)
    out = factorization.score_quality(docs, machine).join(labels, "doc_id").where(fold5() == 0)
    right = F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))
    assert out.agg(right).first()[0] > 0.93
    few = factorization.train_quality(docs, labels, fold5() != 0, max_rows=60)
    assert factorization.score_quality(docs, few).where("score BETWEEN 0 AND 1").count() == docs.count()
    none = factorization.score_quality(docs, factorization.train_quality(docs, labels.limit(0), fold5() != 0))
    assert none.where("score = 0.5").count() == docs.count()


# ------------------------------------------------------------------ all
def operators(spark, docs):
    bench = spark.createDataFrame([(1, "an item of nine words that must be found"), (None, None), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, None), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = language_id.train_languages(docs, fold5() != 0, VOCAB)
    return {
        "lines": line_frequency.line_rules(docs), "passages": compact_windows.repeated_passages(docs), "cut": compact_windows.remove_repeats(docs),
        "license": license_scan.license_scan(docs), "simhash": simhash.near_duplicates(docs), "one": simhash.keep_one(docs),
        "pack": packing.pack(docs, BPE), "language": language_id.identify(docs, model, VOCAB), "keep": language_id.keep_identified(docs, model, VOCAB),
        "leaks": decontaminate.find_leaks(docs, bench), "drop": decontaminate.drop_leaks(docs, bench), "no items": decontaminate.drop_leaks(docs, bench.limit(0)),
        "lm": pitman_yor.score_texts(docs, fold5() != 2), "shards": feistel.feistel_shards(feistel.describe(docs)),
        "quality": factorization.score_quality(docs, factorization.train_quality(docs, labels, fold5() != 0)),
    }


def clashing(docs):
    for c in ("tid", "fp", "key", "a", "b", "pos", "root", "pack", "bucket", "host", "lines", "rank", "y", "__tid", "__id", "__n", "shard", "slot", "n", "text_hash"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    return docs


ALL_ROWS = ("lines", "simhash", "language", "lm", "shards", "quality", "drop", "no items")


def test_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, None, None, None, None)] * 3 + [(5, "tie", "en", "s", 1)] * 4
    rows += [(20, long, "en", None, 2), (21, long, None, "s", 2), (None, prose(rng, 80), "de", "s", 2), (22, "an item of nine words that MUST be found", "en", "s", 3)]
    docs = clashing(table(spark, rows))
    for name, out in operators(spark, docs).items():
        n = out.count()
        if name in ALL_ROWS:
            assert n == len(rows) - (name == "drop"), name
    leaks = operators(spark, docs)["leaks"].collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in leaks] == [(22, 1, 0)]


def test_empty_table(spark):
    docs = clashing(table(spark, []))
    for name, out in operators(spark, docs).items():
        assert out.count() == 0, name


def test_all_rows_null(spark):
    docs = table(spark, [(None, None, None, None, None)] * 5)
    got = {name: out.count() for name, out in operators(spark, docs).items()}
    assert all(got[name] == 5 for name in ALL_ROWS) and got["one"] == 1 and got["pack"] == 5 and got["keep"] == 0 and got["passages"] == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_against_planted_cases(spark, tmp_path):
    """Every stage's decision on planted rows, and all else unchanged."""
    sample = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).where("doc_id < 300").collect()]
    rng = random.Random(4)
    clean = [r for r in sample if r[2] == "en" and 120 < len(r[1].split()) < 900]
    items = [(k, prose(rng, 30)) for k in range(5)]
    shared = prose(rng, 90)
    extra = [(1000, "12 34 56 !!", "en", "s", 11), (1001, None, None, None, None), (1002, clean[0][1], "en", "s", 1), (1003, clean[1][1] + " end", "en", "s", 1),
             (1004, " ".join(clean[2][1].split()[::-1]) + " " + items[0][1], "en", "s", 1), (1005, f"{clean[3][1][:200]} {shared}", "en", "s", 1), (1006, f"{shared} {clean[4][1][:300]}", "en", "s", 1)]
    table(spark, sample + extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = set(after["language"])
    assert {1000, 1001}.isdisjoint(ids) and len(ids) >= len(sample) + 5 - 6
    # one row of each linked group, found by brute force
    fps = {i: brute_fingerprint(r["text"]) for i, r in after["language"].items()}
    group = {}
    for i in sorted(fps):
        linked = {group[j] for j in group if (fps[i] ^ fps[j]).bit_count() <= 3}
        group[i] = min(linked, default=i)
        for j in [j for j in group if group[j] in linked]:
            group[j] = group[i]
    assert set(after["near duplicates"]) == set(group.values()) and {1002, 1003}.isdisjoint(after["near duplicates"])
    cut = after["repeated passages"]
    assert sum(shared in cut[i]["text"] for i in (1005, 1006) if i in cut) == 1
    assert 1004 in cut and 1004 not in after["benchmark leaks"] and clean[2][0] in after["benchmark leaks"]
    assert set(cut) - set(after["benchmark leaks"]) == {1004}
    packed = {}
    for r in after["packing"]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(BPE)
    assert packed == {i: len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in after["benchmark leaks"].items()}


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_dealt_rows_stay_where_they_are(spark):
    from sightline.llm.words import dealt
    before = spark.conf.get("spark.sql.adaptive.enabled")
    rows = dealt(spark.range(300).withColumnRenamed("id", "pack"), "pack")
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    plan = rows._jdf.queryExecution().sparkPlan()
    assert plan.outputPartitioning().toString().startswith("hashpartitioning(pack") and "pack" in plan.outputOrdering().toString()
    assert sorted(r.pack for r in rows.collect()) == list(range(300))


def test_language_scores_of_a_batch_fit_a_small_worker():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import public_tokenizers
    from sightline.llm import language_id
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = language_id.vocabulary(path)[2]
    probs = np.full((2, v + 1), 1 / v)
    context = type("Context", (), {"broadcast": staticmethod(lambda x: type("Sent", (), {"value": x}))})
    predict = language_id.predictor(type("Session", (), {"sparkContext": context}), language_id.Model(["a", "b"], probs), path)
    texts = pa.array(["some words of a text that is long " * 60] * 6000)
    tracemalloc.start()
    names, _ = predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == 6000 and peak < 150e6
