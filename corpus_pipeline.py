"""A training corpus from raw documents: each stage's output is written, and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumaflow.llm import line_dedup, mixing, ngram_join, packing, toxicity
from lumaflow.llm.common import shared_folder, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    small_batches(spark)
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays; documents of which none stays go."""
    return line_dedup.cleaned(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by their word shingles one stays."""
    small_batches(spark)
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources give words by weight; small sources repeat up to the limit of epochs."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    small_batches(spark)
    pieces = packing.pack(packing.tokenized(docs, packing.tokenizer_path()))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The tokenizer and the learned lexicon are beyond SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Intermediate tables go to the session's shared checkpoint folder; each
    goes when the next is written, but for the last, which the result reads."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(folder := f"{at}/{k}-{name}")
        docs = spark.read.parquet(folder)
        if before:
            _drop(spark, before)
        before = folder
    return docs
