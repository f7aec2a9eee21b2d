"""A cleaning pipeline over `documents`, ending in packed training sequences.

Each stage works on what its predecessor kept, and its decisions take effect.
All stages but the last return the columns of their input; n_chars follows the
text where a stage changes it.

All stages take nulls in any column, whole texts of any length (a very long one
is one row), repeated rows, further columns whose names clash with their own, and
empty tables, which give empty results; each says below what becomes of the rest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspark.llm import _store, decontaminate, jaccard, langid, packing
from deltaspark.llm.linededup import LineIndex

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Near duplicates: words of a shingle, and similarity in per cent.
WORDS, SIMILARITY = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without letters go, and so do null texts.

    Learns from the labelled rows of docs; without any, all texts with letters stay. Of languages that fit equally
    well the first by name counts. Repeated rows stay or go together; a null doc_id or lang changes nothing.
    """
    model = langid.fit(docs)
    if not model.languages:  # nothing to learn from: only what has no letters is rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = langid.identify(docs.select(*docs.columns), model)
    return named.where(F.col(named.columns[-2]) != langid.UND).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; those left without any words by that go.

    Rows that share a doc_id are one document, a null doc_id is one that comes last; ties can't arise, as the
    smallest doc_id keeps its lines. A null text stays as it is.
    """
    out = LineIndex(spark).insert(docs).dedup(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, and of its equal rows one.

    Documents with one doc_id are told apart by their texts. Null texts and those without words resemble nothing
    and stay, repeated ones too; a null doc_id comes last.
    """
    return jaccard.dedup(docs, WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; each row is judged by itself, so ties can't arise.

    Null texts contain nothing and stay; null or empty items are contained in nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces and their places in sequences.

    A null text is an empty document; repeated rows are packed as often as they occur; pieces of equal length
    are interchangeable, so which of them lies where is left open.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization and learnt models are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = _store.cut(docs)
    return docs
