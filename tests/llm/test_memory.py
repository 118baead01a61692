"""What one task's Python holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import pitman_yor, words


def _pack(tokens: int, n_words: int) -> pitman_yor.Pack:
    rng = np.random.default_rng(5)
    p = pitman_yor.Pack.__new__(pitman_yor.Pack)
    p.words = np.arange(n_words, dtype=np.uint64)
    p.words[7] = pitman_yor.END
    p.codes = (np.minimum(rng.zipf(1.3, tokens), n_words) - 1).astype(np.uint32)
    p.sizes = np.full(tokens // 1000, 1000, np.int32)
    p.ends = np.cumsum(p.sizes)
    return p


def test_pairs_of_a_full_pack_take_little_memory():
    p = _pack(pitman_yor.PACK_WORDS, 200_000)
    tracemalloc.start()
    try:
        u, w, inv = p.pairs()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50e6
    before = np.concatenate([[0], p.codes[:-1]])
    before[p.ends - p.sizes] = 7
    assert (u[inv] == before).all() and (w[inv] == p.codes).all() and len(np.unique(u * 200_000 + w)) == len(u)


@pytest.mark.parametrize("limit", [50, 1 << 62])
@pytest.mark.parametrize("n", [1, 1000, 3 * (1 << 18) + 5])
def test_distinct_numbers_with_their_inverse(limit, n):
    x = np.random.default_rng(n).integers(0, 50, n)
    want, inverse = np.unique(x, return_inverse=True)
    got, inv = pitman_yor._distinct(x.copy(), limit)
    assert (got == want).all() and (inv == inverse).all()


def test_sums_of_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK", 16)
    sizes = np.array([1, 40, 3, 16, 1, 1, 90, 2])
    codes, values = np.arange(sizes.sum()) % 7, np.arange(7.0)
    first = np.cumsum(sizes) - sizes
    assert (pitman_yor._sums(values, codes, first) == np.add.reduceat(values[codes], first)).all()


def test_large_rows_are_handed_one_by_one(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = words.stage_by_row(spark.range(20).coalesce(2).mapInArrow(sizes, "n long"))
    assert [r["n"] for r in rows.collect()] == [1] * 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


class _Sent:
    """Stands for a session whose broadcasts stay where they are."""

    def __init__(self):
        self.sparkContext = self

    def broadcast(self, value):
        return type("Value", (), {"value": value})


def _languages():
    import public_tokenizers
    from sightline.llm import language_id
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language_id.vocabulary(path)[2]
    probs = np.random.default_rng(2).random((4, pieces + 1)) / pieces
    return language_id, language_id.Model(["de", "en", "es", "fr"], probs), path


def _texts(n: int, size: int) -> pa.Array:
    rng = np.random.default_rng(3)
    return pa.array([" ".join("".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 12, size)) for _ in range(n)])


def test_language_scores_hold_little_memory():
    language_id, model, path = _languages()
    predict, texts = language_id.predictor(_Sent(), model, path), _texts(400, 1500)
    predict(texts.slice(0, 1))
    tracemalloc.start()
    try:
        predict(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70e6


def test_kept_word_scores_change_no_answer(monkeypatch):
    language_id, model, path = _languages()
    texts = pa.concat_arrays([_texts(30, 60), pa.array([None, "", "12 34", "x" * 300, "Ärger ärger ĄĘ"]), _texts(30, 60)])
    names, scores = language_id.predictor(_Sent(), model, path)(texts)
    for small in (500, 0):  # pieces of a few texts, scores kept and forgotten
        monkeypatch.setattr(language_id, "PIECE_BYTES", 1000)
        monkeypatch.setattr(language_id, "KNOWN_WORDS", small)
        again, close = language_id.predictor(_Sent(), model, path)(texts)
        assert again == names and np.allclose(close, scores, atol=1e-9)
    alone = [language_id.predictor(_Sent(), model, path)(texts.slice(i, 1)) for i in range(len(texts))]
    assert [n for a, _ in alone for n in a] == names and np.allclose(np.concatenate([s for _, s in alone]), scores, atol=1e-9)
