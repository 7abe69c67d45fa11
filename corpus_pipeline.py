"""Corpus pipeline: quality classifier, language ID, near-duplicate removal, packing.

Each stage takes the documents that the one before it kept. The first three
return them with their own columns; the last returns the packed pieces.

Quality drops documents that score under the threshold; language ID drops those
without a letter and those for which no language stands out; near-duplicate
removal keeps the document with the smallest id of each group (rows without an
id stay; of rows that share one, those with a text stay together, and each of
their texts is judged by itself).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm import langid, minhash, packing, quality
from joinery.llm.common import Workspace
from joinery.llm.queries import table, tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), whole=True).filter("predicted = 1").select("row.*")


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identify(docs, whole=True).filter("lang_pred <> 'und' and not ambiguous").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = minhash.copies(docs)
    same = (docs["doc_id"].cast("long") == copies["copy_id"]) & (F.xxhash64(docs["text"]) == copies["copy_mark"])
    return docs.hint("merge").join(copies, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer(), 1024, 0)


STAGES = [("quality", good), ("language", in_a_language), ("near duplicates", distinct), ("packing", packed)]
#: Learned scores and token ids have no SQL; tests hold the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        work.drop_but(f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
