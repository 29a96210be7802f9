"""The corpus pipeline: stages on documents, each reading what the one before wrote.

Every stage but the last gives rows with the columns of documents; the last gives a row for each document of the mix, as it
stands in the token files.

What the stages make of odd rows follows from their operators:

* Null and empty texts: the classifier judges them by their lengths and shares alone; they are near duplicates of nothing,
  hold no benchmark item, have no words, so that the mix doesn't take them.
* Null ids: judged and kept like others by the first three stages (the benchmark stage keeps them always); they come first
  in the token files. Null sources are one source, the last. Other columns may hold nulls anywhere.
* Very long texts are worked on whole by every stage.
* Repeated rows stay rows of their own, but for the mix, which takes equal rows together as often as their words say. Rows
  of one id are one document to the near-duplicate stage: it keeps or drops them together. Ties go to the smaller id.
* Empty tables: without documents every stage gives no rows; without labels the classifier rejects nothing; without a
  benchmark nothing is dropped for it.
* Columns beside those of documents travel on through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hybridmail.llm import decontaminate, mixing, neardups, quality, tokens
from hybridmail.llm.common import stored, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go. Trained on the labelled ones among docs."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id: five-word shingles, similarity 0.8."""
    return neardups.dedup(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: five-word shingles, containment 0.8."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are repeated or left out."""
    return mixing.apply(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.encode_and_read(docs, "pipeline-tokens", cache=300_000, added=True)


STAGES = [
    ("quality classifier", select_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]

#: The classifier's fit and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
