"""From documents to token ids: quality, near duplicates, decontamination, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontaminate, mixing, ngram_join, quality, tokens
from papyra.llm.queries import table, tokenizer_file
from papyra.scratch import new_path, settle

_ID = "__pipeline_id"
#: Up to so many ids (8 bytes each) are broadcast; more are joined by exchange.
SMALL = 1_000_000


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` (nulls match nulls), with their own columns."""
    wanted = settle(ids.select(F.col("doc_id").alias(_ID)).distinct(), "pipeline-ids")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    return docs.join(wanted, docs["doc_id"].cast("long").eqNullSafe(wanted[_ID]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the forest rejects go. An id goes if all of its rows are rejected."""
    return _only(docs, quality.judge(docs, table(spark, sf_dir, "labels")).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8 or more, that of the smallest id stays."""
    joined = settle(ngram_join.join(docs, n=5, percent=80), "near-duplicates").filter("doc_id <=> component_id")
    kept = _only(docs, joined)
    # Rows may share an id; where any do, equal ones become one row.
    shared = joined.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return kept if shared.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, decontaminate.report(found).filter("not contaminated"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus, read back: place, length and checksum of each document's ids."""
    path = new_path(spark, "pipeline-tokens")
    tokens.write(docs, path, tokenizer_file(), end_id=2)
    return tokens.documents(tokens.read(spark, path))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The forest's verdicts and the tokenizer's ids can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
