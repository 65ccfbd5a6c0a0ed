"""From raw documents to packed training windows, in five stages.

  1 quality_classifier  operator 8: documents scored under 0.5 go
  2 quality_rules       operator 9: failing lines go, then documents that the rules reject
  3 ngram_join          operator 1: one document of each near-duplicate class stays, the one of the least id
  4 decontamination     operator 7: documents contaminated by the benchmark go
  5 packing             operator 10: pieces of windows of 4096 tokens

Each stage takes all rows its predecessor kept; all but the last return the columns of documents. Rows with
null ids and repeated rows are handled as the operators say; stage 3 keeps one row of a class whose ids tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import common, decontamination, ngram_join, packing, quality_model, quality_rules, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.accepted(docs, common.read(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, common.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, tokens.public("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_out),
    ("packing", packed),
]

#: The classifier's vectors and the packing can't be said in SQL; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
