"""Tables of a data folder, and the readings of them that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tasks that a small table of texts is dealt to at most.
SPREAD = 64


def spread(df: DataFrame) -> DataFrame:
    """A table of a few file parts is dealt to more tasks, since work on texts, not reading, takes the time; a larger one stays as it is."""
    tasks = min(SPREAD, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work on their texts."""
    return spread(table(spark, sf_dir, "documents"))


def books(spark: SparkSession, sf_dir: str, lang: str | None = "en") -> DataFrame:
    """Documents as pages of books: (book, doc_pos, text); those of one language, ``lang``, unless it is None.

    Terms are mined in English books, whose function words are known; so the queries on terms read the English documents."""
    docs = texts(spark, sf_dir)
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select(F.col("source").alias("book"), F.col("doc_id").alias("doc_pos"), "text")
