"""The training-text pipeline over `documents`: stages that each call one operator of paneltide.llm.

In every stage an empty table gives an empty table, a null id is a row like any other, rows are told apart by id and text (repeated
rows have one fate), and columns of docs beside those of `documents` are left out, also those that clash with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import bpe, decontaminate, lines, neardup, quality
from paneltide.llm.shared import documents, held_out, save, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = ("lang", "source")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, all columns. It learns from labels of documents that are not held out.

    A null text is scored like an empty one; without labels all documents stay.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())
    return quality.keep_good(docs, quality.learn(docs, labels))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in the first document alone; a document of which nothing is left but was something goes.

    Null texts stay null, empty ones empty. Of equal ids the smaller hash of the text is first; a null id is before all others.
    """
    ship(spark)
    done = lines.dedup_lines(docs, carry=CARRY)
    rest = (F.col("n_dropped") == 0) | F.col("kept").rlike(r"\S")
    return _columns(done.where(rest).withColumnRenamed("kept", "text"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, 0.8) the smallest id stays; rows without an id stay.

    Null and empty texts have no shingles, are no duplicates and stay; rows of one id have one fate.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    gone = neardup.near_duplicates(docs, n=5, percent=80).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, nor does any text without a benchmark."""
    ship(spark)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=CARRY)
    return _columns(found.where(~F.col("contaminated")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text; null and empty texts have no tokens."""
    ship(spark)
    return bpe.encode(docs, with_ids=False)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", encoded),
]

#: SQL cannot express the learned and similarity stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, "stage")
    return docs
