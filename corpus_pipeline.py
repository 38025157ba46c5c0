"""A pipeline over documents: language, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import common, decontaminate, language, packing, secrets, simhash

#: Below this mean label probability a text is taken for none of the languages.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that fit none of the learned languages; lang becomes the predicted one where it is null."""
    columns = docs.columns
    lang, score = common.unused("_lang", columns), common.unused("_score", columns)
    found = language.predict(docs, language.train(docs), lang_out=lang, score_out=score)
    kept = found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*(F.col(f"`{c}`") for c in columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, k=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item (or a whole shorter item)."""
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace credentials by [kind]; n_chars follows the text."""
    columns = docs.columns
    clean = secrets.without_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: a row a piece, with its ids."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again; what a stage has written on its way is deleted after it."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        before = docs
        with common.scratch(kept):
            docs = common.written(stage(spark, docs, sf_dir))
            kept.append(docs)
        if hasattr(before, "_written_at"):
            common.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
