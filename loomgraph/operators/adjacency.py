"""Compressed adjacency: each node's neighbours as sorted arrays, laid out once for all steps of a walk.

The table is bucketed by (doc_id, node, piece), so a step shuffles the paths that it
extends, never the edges. A node of many neighbours is cut into pieces of some ``PIECE``
neighbours, each in a bucket of its own choosing; an entry tells how many pieces its neighbour has,
so a path asks for all of them without a further look-up.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import session_dir, stored

PIECE = 1000
_NODE = ["doc_id", "node_id"]
_KEY = [*_NODE, "piece"]


@dataclass(frozen=True)
class Adjacency:
    """lists(doc_id, node_id, piece, others: array of (other, pieces of other, parallel edges)) and sizes(doc_id, node_id, pieces)."""

    lists: DataFrame
    sizes: DataFrame

    def enter(self, starts: DataFrame) -> DataFrame:
        """``starts`` (doc_id, node_id, ...) with ``pieces``; nodes without neighbours go."""
        return starts.join(self.sizes, _NODE)

    def step(self, rows: DataFrame) -> DataFrame:
        """Each row (doc_id, node_id, pieces, ...) once for each edge from its node, with ``other`` and ``other_pieces`` (0: no edge from there)."""
        asked = rows.filter("pieces > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
        met = asked.join(self.lists, _KEY).drop("piece").withColumn("o", F.explode("others")).drop("others")
        met = met.withColumns({"other": F.col("o.other"), "other_pieces": F.col("o.pieces")})
        return met.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("o.n")))).drop("o", "__n")


def build(links: DataFrame, piece: int = PIECE) -> Adjacency:
    """From (doc_id, node_id, other_id), one row an edge. Edges with a null end lead nowhere and go."""
    spark = links.sparkSession
    distinct = stored(links.dropna(subset=["doc_id", "node_id", "other_id"]).groupBy(*_NODE, F.col("other_id").alias("other")).agg(F.count(F.lit(1)).alias("n")), "links")
    sizes = stored(distinct.groupBy(*_NODE).agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces")), "link-counts")
    placed = distinct.join(sizes, _NODE).withColumn("piece", F.pmod(F.xxhash64("other"), "pieces")).drop("pieces")
    ends = sizes.select("doc_id", F.col("node_id").alias("other"), "pieces")
    placed = placed.join(ends, ["doc_id", "other"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(0)))
    # dealt as the buckets are, so each task writes one bucket's file
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = placed.repartition(buckets, *_KEY).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("other", "pieces", "n"))).alias("others"))
    name = f"loomgraph_adjacency_{uuid.uuid4().hex}"
    lists.write.bucketBy(buckets, *_KEY).sortBy(*_KEY).option("path", f"{session_dir(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return Adjacency(spark.table(name), sizes)
