"""From raw documents to training sequences in five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantage.llm import decontaminate, language_id, line_dedup, minhash, packing
from vantage.llm.shared import Written

TOKENIZER = "word_bpe_49k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled two thirds teach; those that the models reject go, null and letterless
    texts among them. Repeated rows stay, as do rows without an id; no labels at all: all with a letter stay."""
    return language_id.keep_known(docs, language_id.fit(docs.filter(~language_id.held_out())))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, single lines of 50 words or more among them, are cut out of the texts;
    documents of which nothing is left go. Null texts, and rows without an id, stay as they are."""
    return line_dedup.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Null and wordless texts and rows without an id stay; of repeated
    rows of a kept document all stay."""
    return minhash.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that loses all its words goes. Null and empty texts,
    repeated rows and rows without an id stay."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, as pieces of documents with their token ids; a null text counts as empty."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", unrepeated_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: Languages, tokens and packing are beyond SQL; the tests hold run() against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, as packed pieces; an empty table gives none. Each stage's table is
    dropped when the next one stands, the last when the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Written(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = kept.put(name, stage(spark, docs, sf_dir))
        if before:
            kept.drop(before)
        before = name
    return docs
