"""From raw documents to training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Rows a stage
keeps are passed on whole; the decisions of a stage (rejected language, one document of each near-duplicate group, cut passages, dropped leaks) hold for
all later ones. Cases such as nulls, empty texts and repeated rows have the results stated by the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm.compact_windows import remove_repeats
from sightline.llm.decontaminate import drop_leaks
from sightline.llm.language_id import keep_identified, train_languages
from sightline.llm.packing import pack
from sightline.llm.queries import fold, query
from sightline.llm.simhash import keep_one
from sightline.llm.words import written
from sightline.plans.catalog import table

LANGUAGE_PIECES, TOKENS = "piece_bpe_32k.model", "byte_bpe_50k.json"
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is learned from the stage's own input, ids of fold 0 held out."""
    vocab = public_tokenizers.path(LANGUAGE_PIECES)
    return keep_identified(docs, train_languages(docs, fold(5) != 0, vocab), vocab, MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked."""
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated passages."""
    return remove_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, public_tokenizers.path(TOKENS))


STAGES = [("language", language), ("near duplicates", near_duplicates), ("repeated passages", passages),
          ("benchmark leaks", leaks), ("packing", packing)]

#: SQL cannot express fingerprints, min-hash windows, sampled embeddings and byte-pair ids; the tests compare with brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
