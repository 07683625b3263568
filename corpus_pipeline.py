"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, language, line_dedup, mixing, simhash
from tallyloom.llm.common import named, remove, scratch_path, steps

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the text model is fitted on the labelled rows of the same documents.

    Texts that are null, empty or without letters are in no language. Equal rows share their fate; extra columns come
    along. Without any labelled row no language is known and nothing stays.
    """
    return language.keep_known(docs, language.fit(docs))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a notable share of their source's documents hold, and n_chars to match.

    Every row stays; null texts stay null, with a null n_chars. A null source is a source of its own.
    """
    cleaned = line_dedup.drop_lines(docs, counts=False)
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else named(cleaned, c) for c in docs.columns]
    return cleaned.select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that SimHash links connect; of rows with one id one stays.

    Null texts count as empty, and all texts without words are one group. Null ids come after all others.
    """
    return simhash.keep_first(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target asks for; one taken twice is there twice.

    Texts without words, null ones too, have size 0; a source without any words is never taken.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each document of the mix; a null text has no ids."""
    from public_tokenizers import PATTERN, path

    return bpe.encode_decode(docs, path("byte_bpe_50k.tiktoken"), PATTERN, keep=("ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("lines", without_boilerplate),
    ("near_duplicates", one_of_each),
    ("mix", to_weights),
    ("tokens", tokens),
]

#: Language likelihoods, SimHash and BPE can't be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder and read again.

    A stage's own steps are deleted once it is written, and its table once the next one is; the last one stays, as the result
    is read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with steps(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
