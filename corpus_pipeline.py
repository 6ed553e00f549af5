"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns a
DataFrame; all but the last keep those columns. It belongs to the subpackage llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, langid, line_dedup, near_dups, word_bpe
from loomgraph.llm.common import stored, table
from loomgraph.llm.queries import tokenizer_file

#: Texts that cost more than this many bits a byte in every language, and EXCESS_BITS beyond that, are in none of them.
MOST_BITS_PER_BYTE = 7.5
#: What chance may add to a short text of a learned language: see README.
EXCESS_BITS = 64.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts that no learned language's statistics fit."""
    judged = langid.fit_and_identify(docs)
    excess = (F.coalesce("bits_per_byte", F.lit(0.0)) - MOST_BITS_PER_BYTE) * F.octet_length("text")
    return judged.filter((F.col("lang_pred") != langid.UNDETERMINED) & (excess <= EXCESS_BITS)).select(*docs.columns)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out; a document goes when nothing but white space is left of it."""
    out = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id; a row without an id only if the group has no other.

    A group: documents linked by a similarity of 0.8 or more of their 5-word shingles. Candidates are those of one
    SimHash class or MinHash band; each link is confirmed exactly. Rows are told apart by all their columns, so rows that only share an id are judged by their texts.
    """
    key = near_dups.KEY
    groups = near_dups.groups(docs).withColumn("row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *key))
    least = groups.groupBy("component", "bag").agg(F.min("row").alias("row"))
    stay = least.groupBy("component").agg(F.min("row").alias("row")).select(*(F.col(f"row.{k}").alias(k) for k in key))
    keyed = docs.select("*", *near_dups.row_key(docs))
    # rows that are left with the same key are equal in every column
    return keyed.join(stay, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    judged = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), short=True)
    return judged.filter(F.size("leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the hash of the text they decode to."""
    out = word_bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", remove_boilerplate),
    ("near_duplicates", remove_near_duplicates),
    ("benchmark", remove_contaminated),
    ("encode", encode),
]

#: SQL can't express language statistics, SimHash, MinHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
