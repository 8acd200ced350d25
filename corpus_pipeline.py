"""A corpus in four stages: quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents, and any others that docs
has, whatever their names.

Null and empty texts: the classifier judges them as empty texts; they are nobody's
near duplicate, have no secrets, and are packed as their end id alone. Very long
texts are read whole. Rows with equal ids are judged, compared, masked and packed
each; of linked rows the one with the smallest id stays, of those of one id the
first by hashes of text and other columns. A score that ties with a threshold
keeps its row or counts as a secret. An empty table gives no rows. The result is a
table that depends on the input's rows alone, not on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import jaccard, packing, quality, secrets
from lathe.llm.queries import tokenizer_path
from lathe.llm.staging import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked at a similarity of 0.8 of their five-word shingles, the one with the smallest id stays."""
    return jaccard.one_of_each(docs, jaccard.Rule(k=5, num=80, den=100))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; n_chars is the new text's length."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of which sequences of fixed length consist: document, tokens (ids, four bytes each), sequence and offset there."""
    return packing.packed(docs, tokenizer_path(), keep_ids=True)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]

#: The stages' models and ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; between them a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
