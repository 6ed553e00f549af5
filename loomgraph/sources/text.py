"""Text sources: tables, whole files, single strings, and conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table; one of fewer splits than there are cores is dealt to all of them, since cutting texts costs more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_table(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return dealt(spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def from_strings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def from_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Turns of a conversation in order, each a paragraph."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text))))
    # dealt by a given number that grows with the table: a text is cut into far more than its bytes tell, so small partitions stay apart
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * turns.rdd.getNumPartitions())
    return turns.filter(F.col(text).isNotNull()).repartition(parts, key).groupBy(F.col(key).alias("doc_id")).agg(F.array_join(F.transform(listed, lambda x: x[text]), "\n\n").alias("text"))
