"""Incremental mode: each micro-batch of new documents runs through the batch pipeline.

Operators keep no state across documents, so a batch of a stream gives what a batch job
would. Row numbers and leads aren't allowed on streaming frames, hence ``foreachBatch``.
A batch that is run again replaces its own files, so results hold each document once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgraph.plans.pipeline import GraphPipeline


def write_graphs(docs: DataFrame, pipeline: GraphPipeline, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes nodes and edges of new documents below ``folder``."""

    def write(batch: DataFrame, number: int) -> None:
        graph = pipeline.run(batch)
        graph.node_table().write.mode("overwrite").parquet(f"{folder}/nodes/batch={number}")
        graph.edge_table().write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
