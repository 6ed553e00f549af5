"""Code graphs from GraphSON: vertices and edges with their order.

A property is a scalar or ``[{"value": v}]``; an empty list is absent. Missing keys are
empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import graphson

VERTEX = "struct<id: bigint, label: string, properties: map<string, string>>"
EDGE = "struct<id: string, outV: bigint, inV: bigint, label: string, properties: map<string, string>>"


@dataclass(frozen=True)
class CodeGraph:
    """vertices(cpg_id, ord, label, code, name, line) and edges(ord, src, dst, label, variable)."""

    vertices: DataFrame
    edges: DataFrame


def property_value(properties: Column, name: str) -> Column:
    """A property's scalar; ``""`` for an empty list, null if absent."""
    v = F.try_element_at(properties, F.lit(name))
    return F.when(F.regexp_replace(v, r"\s", "") == "[]", "").otherwise(F.coalesce(F.get_json_object(v, "$[0].value"), v))


def from_table(raw: DataFrame) -> CodeGraph:
    """From rows of vertices and edges arrays (one graph)."""
    return from_elements(raw.select(F.posexplode("vertices").alias("ord", "e")), raw.select(F.posexplode("edges").alias("ord", "e")))


def from_elements(vertices: DataFrame, edges: DataFrame) -> CodeGraph:
    """From (ord, e) of each vertex and each edge, ``e`` as in VERTEX and EDGE."""
    vertices, edges = vertices.select("ord", "e.*"), edges.select("ord", "e.*")
    text = lambda name: F.coalesce(property_value(F.col("properties"), name), F.lit(""))
    line = F.coalesce(F.try_to_number(property_value(F.col("properties"), "LINE_NUMBER"), F.lit("999999999")).cast("int"), F.lit(0))
    vertices = vertices.select(F.col("id").alias("cpg_id"), "ord", "label", text("CODE").alias("code"), text("NAME").alias("name"), line.alias("line"))
    edges = edges.select("ord", F.col("outV").alias("src"), F.col("inV").alias("dst"), "label", text("VARIABLE").alias("variable"))
    return CodeGraph(vertices, edges)


def from_graphson(spark: SparkSession, path: str, split_bytes: int = graphson.SPLIT_BYTES) -> CodeGraph:
    """From files, each read by as many tasks as it has splits; ``ord`` counts within a document's array."""
    found = graphson.read_elements(spark, path, split_bytes)
    of = lambda key, kind: found.filter(F.col("key") == key).select("ord", F.from_json("element", kind).alias("e"))
    return from_elements(of("vertices", VERTEX), of("edges", EDGE))


def from_string(spark: SparkSession, text: str) -> CodeGraph:
    raw = spark.createDataFrame([(text,)], "raw string").select(F.from_json("raw", "vertices array<" + VERTEX + ">, edges array<" + EDGE + ">").alias("g"))
    return from_table(raw.select("g.*"))


def from_rows(spark: SparkSession, vertices: list[tuple], edges: list[tuple]) -> CodeGraph:
    """From (cpg_id, label, code, name, line) and (src, dst, label, variable) tuples."""
    return CodeGraph(
        spark.createDataFrame([(v[0], i, *v[1:]) for i, v in enumerate(vertices)], "cpg_id bigint, ord int, label string, code string, name string, line int"),
        spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "ord int, src bigint, dst bigint, label string, variable string"),
    )
