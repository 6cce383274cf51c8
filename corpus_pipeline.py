"""From raw documents to packed training sequences: five stages, each written before the next one reads it.

1. quality rules: documents that the current policy rejects go;
2. toxicity: documents scored as toxic go; learned from the labels of documents that are not held out;
3. line dedup: a line that stands earlier in the corpus, up to two edits, goes, and so does a text of which less than a quarter is left;
4. MinHash near-dedup: one document of each group of near copies stays, the one with the smallest id;
5. packing: what is left, as token pieces placed in sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicgrid.llm import line_duplicates, near_duplicates, packing, quality, toxicity
from civicgrid.llm.common import table
from civicgrid.operators.state import checkpoint

# What line dedup leaves of a near copy is no document: a text that loses lines must keep this share of its code points.
LEAST_LEFT = 0.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, grammar)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_duplicates.drop_duplicate_lines(docs, least_left=LEAST_LEFT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup), ("best_fit_packing", best_fit_packing),
]

# The learned grammar, edit distances and tokenizing have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
