"""The corpus pipeline: five of the training-data operators, one after another, over whole documents.

quality rules (rejected documents go), line dedup (later copies of repeated runs go from the texts),
n-gram Jaccard join (one document of each near-duplicate group stays), personal data (replaced by its
kind) and packing (token sequences). Each stage's result is written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup as _lines
from gridloom.llm import packing as _packing
from gridloom.llm import pii_crf as _pii
from gridloom.llm import quality_rules as _rules
from gridloom.llm import sketch_join as _sketch
from gridloom.llm.common import drop_dir, shared_dir, table, unused, written
from gridloom.llm.registry import BYTE_VOCABULARY, vocabulary


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learnt rules reject go; the others stay as they are."""
    judged = _rules.quality_rules(docs, _rules.learnt(docs, table(spark, sf_dir, "labels")))
    return judged.where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go from the texts; every document stays."""
    return _recounted(_lines.line_dedup(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8, the one with the smallest id stays.

    Documents without words or without an id link with nothing and stay. Rows that share an id are
    documents of their own: they link, or not, by their texts, and come after all rows whose id is theirs
    alone, so of equal rows one stays and no unlinked text is lost."""
    own, = unused(docs, "own_id")
    known = docs.where("doc_id is not null")
    shared = written(spark, known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), name="shared")
    numbered = known.withColumn(own, F.col("doc_id").cast("long"))
    if not shared.isEmpty():
        top = known.agg(F.max("doc_id")).first()[0]
        alike = docs.join(shared, "doc_id", "left_semi").select(*docs.columns)
        # Written once, so the numbers stay as they are.
        alike = written(spark, alike.withColumn(own, F.lit(int(top) + 1) + F.monotonically_increasing_id()), name="alike")
        numbered = numbered.join(shared, "doc_id", "left_anti").select(*docs.columns, own).unionByName(alike)
    heads = _sketch.linked_components(numbered, width=5, percent=80, id_col=own).where("doc_id = component_id").select(F.col("doc_id").alias("head"))
    stay = numbered.join(heads, numbered[own] == heads["head"], "left_semi").select(*docs.columns)
    return stay.unionByName(docs.where("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; every document stays."""
    return _recounted(_pii.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents, with their ids and the ids' crc32."""
    packed = _packing.pack(docs, vocabulary(BYTE_VOCABULARY))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: Learnt rules, a suffix array and a trained tagger are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each reads what the one before wrote."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(spark, stage(spark, docs, sf_dir), folder, f"stage{k}")
        if k:
            drop_dir(spark, f"{folder}/stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
