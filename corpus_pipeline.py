"""The corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again.

Language ID drops documents without a language; near-duplicate detection keeps one document of each
group; repeated word sequences are cut from the remaining texts, and what has no word left goes;
documents with benchmark passages go; the rest is encoded and decoded by byte-level BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.llm import byte_bpe, decontaminate, language_id, near_dedup, substring_dedup
from vespera.llm.common import remainder, table, written
from vespera.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter go, also where no labelled row is there to learn from."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    if not model.labels:
        return language_id.lettered(docs)
    return language_id.identify(docs, model).where("_lang <> 'und'").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that also start in a smaller document go; untouched texts stay as they are."""
    return substring_dedup.cut(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a 10-word window of a benchmark item go."""
    return decontaminate.remove_documents(docs.select(*COLUMNS), decontaminate.Benchmark(table(spark, sf_dir, "benchmark")))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages aren't expressible in SQL as a whole; the tests hold run() against a brute-force version.
ORACLE_SQL = None
