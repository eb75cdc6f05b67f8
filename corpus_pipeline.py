"""From documents to tokens: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the
columns of documents. run() hands each stage its predecessor's rows through a table in the shared
folder, so a lost executor repeats one stage at most, and deletes it when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import line_dedup, order_minhash, piece_matching, templates, toxicity
from quillstone.llm.runtime import cut_table, drop_table, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_matching.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the trained, hashed and aligned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_table(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
