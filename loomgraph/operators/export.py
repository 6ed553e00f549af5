"""Exports: GraphSON documents and tensor-ready columns.

A document becomes one row; ``collect_list`` gathers one document's nodes, never the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import lexicons as lex
from loomgraph.functions.storage import shuffled
from loomgraph.operators.graph import PropertyGraph, dense
from loomgraph.schema import Schema

#: property name -> (column, value that stands for absent; no value: always written)
NODE_PROPERTIES = {
    "TEXT": ("text", "''"), "LEMMA": ("lemma", "''"), "POS": ("pos_tag", "''"), "DEP_REL": ("dep_rel", "''"),
    "ENTITY_TYPE": ("entity_type", "''"), "ENTITY_IOB": ("entity_iob", "''"), "SENT_IDX": ("sent_idx", None),
    "PARA_IDX": ("para_idx", None), "TOKEN_IDX": ("token_idx", None), "CHAR_START": ("char_start", None),
    "CHAR_END": ("char_end", None), "SRL_ROLE": ("srl_role", "''"), "AMR_CONCEPT": ("amr_concept", "''"),
    "SENTIMENT": ("sentiment", "0.0D"), "IMPORTANCE": ("importance", "0.0D"), "DOMAIN_TYPE": ("domain_type", "''"),
    "CONFIDENCE": ("confidence", "1.0D"), "SOURCE": ("source", "''"),
}
EDGE_PROPERTIES = {
    "DEP_LABEL": ("dep_label", "''"), "SRL_LABEL": ("srl_label", "''"), "RST_LABEL": ("rst_label", "''"), "AMR_LABEL": ("amr_label", "''"),
    "COREF_CLUSTER": ("coref_cluster", "-1"), "ENTITY_REL_TYPE": ("entity_rel_type", "''"), "WEIGHT": ("weight", "1.0D"),
}
SOURCE_CHARS = 200


def properties(df: DataFrame, wanted: dict[str, tuple[str, str | None]], types: dict[str, str] | None = None) -> Column:
    """A struct of properties in which absent values are null; ``extra`` fields follow."""
    fields = [(F.col(c) if v is None else F.expr(f"nullif({c}, {v})")).alias(name) for name, (c, v) in wanted.items()]
    fields += [F.col(f"extra.{f.name}").alias(f.name) for f in df.schema["extra"].dataType.fields]
    return F.struct(*fields)


def vertex_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, label, properties as JSON)."""
    return nodes.select("doc_id", F.col("node_id").alias("id"), F.col("node_type").alias("label"), F.to_json(properties(nodes, NODE_PROPERTIES)).alias("properties"))


def edge_json_rows(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("id"), F.col("src").alias("outV"), F.col("dst").alias("inV"), F.col("edge_type").alias("label"), F.to_json(properties(edges, EDGE_PROPERTIES)).alias("properties"))


def graphson(graph: PropertyGraph, pretty: bool = False) -> DataFrame:
    """(doc_id, graphson): one JSON document for each graph, over several lines if ``pretty``."""
    nodes, edges = graph.node_table().repartition("doc_id"), graph.edge_table(gathered=True)
    vertices = nodes.select("doc_id", "node_type", F.struct(F.col("node_id").alias("k"), F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("label"), properties(nodes, NODE_PROPERTIES).alias("properties")).alias("v")).alias("x"))
    links = edges.select("doc_id", "edge_type", F.struct(F.col("edge_id").alias("k"), F.struct(F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("id"), F.col("src").alias("outV"), F.col("dst").alias("inV"), F.col("edge_type").alias("label"), properties(edges, EDGE_PROPERTIES).alias("properties")).alias("e")).alias("x"))

    def by_document(rows: DataFrame, kind: str, name: str) -> DataFrame:
        """(doc_id, all of a document's rows, how many of each type): rows are gathered by document already, so no more are moved."""
        typed = rows.groupBy("doc_id", kind).agg(F.collect_list("x").alias("xs"), F.count(F.lit(1)).alias("n"))
        return typed.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("xs"))).alias(name), F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias(f"{kind}s"))

    # no more of a text is moved than is shown; and dealt as nodes and edges are, or these would be moved once more to where the documents are
    meta = graph.meta.withColumn("source_text", F.substring("source_text", 1, SOURCE_CHARS)).repartition("doc_id")
    out = meta.join(shuffled(by_document(vertices, "node_type", "vs")), "doc_id", "left").join(shuffled(by_document(links, "edge_type", "es")), "doc_id", "left")
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    document = F.struct(
        F.lit(True).alias("directed"), F.lit(lex.FORMAT_TYPE).alias("type"), F.lit(lex.FORMAT_LABEL).alias("label"), F.col("doc_id"),
        F.struct("source_text", "spacy_model", "has_parser", "passes_applied").alias("metadata"),
        F.struct(names(lex.NODE_TYPES).alias("node_types"), names(lex.EDGE_TYPES).alias("edge_types"), F.lit(len(lex.NODE_TYPES)).alias("num_node_types"), F.lit(len(lex.EDGE_TYPES)).alias("num_edge_types")).alias("schema"),
        F.struct(F.size("vs").alias("total_nodes"), F.coalesce(F.size("es"), F.lit(0)).alias("total_edges"), F.col("node_types"), F.col("edge_types"), "passes_applied").alias("stats"),
        F.col("vs.v").alias("vertices"), F.coalesce(F.col("es.e"), F.array()).alias("edges"),
    )
    return out.select("doc_id", F.to_json(document, {"pretty": str(pretty).lower()}).alias("graphson"))


def write_graphson(graph: PropertyGraph, path: str, pretty: bool = False, compression: str = "none") -> None:
    """One JSON document per line below ``path``; if ``pretty`` one indented document per file, in a folder ``doc_id=...``.

    ``compression``: as Spark's text files have it; ``gzip`` files take some ninth of the disk and are read like plain ones.
    """
    if pretty:
        graphson(graph, True).write.mode("overwrite").option("compression", compression).partitionBy("doc_id").text(path)
    else:
        graphson(graph).select("graphson").write.mode("overwrite").option("compression", compression).text(path)


# ---- tensors


def one_hot(index: Column, width: int, zeros: int = 0) -> Column:
    """An array with a one at ``index``, then ``zeros`` zeros."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == index).cast("double"))
    return F.concat(hot, F.array_repeat(F.lit(0.0), zeros)) if zeros else hot


def type_index(col: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), col).cast("int") - 1


def node_tensor(nodes: DataFrame, embedding_dim: int = 0) -> DataFrame:
    """(doc_id, idx, node_id, x, pos, text): dense index, one-hot type, place, text."""
    held = dense(nodes.select("doc_id", "node_id", "node_type", "para_idx", "sent_idx", "token_idx", "text"), ["node_id"], "idx")
    return held.select("doc_id", "idx", "node_id", one_hot(type_index(F.col("node_type"), lex.NODE_TYPES), len(lex.NODE_TYPES), embedding_dim).alias("x"), F.array("para_idx", "sent_idx", "token_idx").alias("pos"), "text")


def edge_tensor(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, edge_id, row, col, edge_type, attr); edges with an unknown end are left out."""
    ends = index.select("doc_id", "node_id", "idx")
    out = edges.join(ends.withColumnsRenamed({"node_id": "src", "idx": "row"}), ["doc_id", "src"]).join(ends.withColumnsRenamed({"node_id": "dst", "idx": "col"}), ["doc_id", "dst"])
    out = out.select("doc_id", "edge_id", "row", "col", type_index(F.col("edge_type"), lex.EDGE_TYPES).alias("kind"))
    return out.select("doc_id", "edge_id", "row", "col", F.col("kind").alias("edge_type"), one_hot(F.col("kind"), len(lex.EDGE_TYPES)).alias("attr"))


def placed(ids: Column, value: Column) -> Column:
    """Where a value stands in a sorted array of distinct numbers, or -1: its own number where these are 0, 1, ..., else found by halving."""
    n = F.size(ids)
    whole = (F.get(ids, F.lit(0)) == 0) & (F.get(ids, n - 1) == n - 1)
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    at = F.aggregate(steps, F.lit(-1), lambda p, b: F.when((b < n - p) & (F.get(ids, p + b) <= value), p + b).otherwise(p))
    found = F.when(F.get(ids, at) == value, at).otherwise(-1)
    return F.when(whole, F.when((value >= 0) & (value < n), value).otherwise(-1)).otherwise(found).cast("long")


def tensors(graph: PropertyGraph, labels: DataFrame | None = None, embedding_dim: int = 0) -> DataFrame:
    """One row per document with x, edge_index, edge_type, edge_attr, y, counts, node_texts and node_pos."""
    nodes = graph.node_table().select("doc_id", "node_id", type_index(F.col("node_type"), lex.NODE_TYPES).alias("kind"), "text", F.array("para_idx", "sent_idx", "token_idx").alias("pos"))
    edges = graph.edge_table(gathered=True).select("doc_id", F.struct("edge_id", "src", "dst", type_index(F.col("edge_type"), lex.EDGE_TYPES).alias("edge_type")).alias("e"))
    # the ids are gathered by themselves: as a field of the gathered nodes they would be listed anew for each edge that looks into them
    n = nodes.repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "kind", "text", "pos"))).alias("n"), F.sort_array(F.collect_list("node_id")).alias("ids"))
    e = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    ends = F.transform("e", lambda x: F.struct(x["edge_id"].alias("edge_id"), placed(F.col("ids"), x["src"]).alias("row"), placed(F.col("ids"), x["dst"]).alias("col"), x["edge_type"].alias("edge_type")))
    known = F.filter(ends, lambda x: (x["row"] >= 0) & (x["col"] >= 0))
    out = n.join(shuffled(e), "doc_id", "left").withColumn("e", known)
    out = out.join(shuffled(labels.select("doc_id", "y")), "doc_id", "left") if labels is not None else out.withColumn("y", F.lit(None).cast("int"))
    listed = lambda of, kind: F.coalesce(of, F.expr(f"from_json('[]', 'array<{kind}>')"))
    attr = F.transform("e.edge_type", lambda k: one_hot(k, len(lex.EDGE_TYPES)))
    return out.select(
        "doc_id", F.transform("n.kind", lambda k: one_hot(k, len(lex.NODE_TYPES), embedding_dim)).alias("x"), F.array(listed(F.col("e.row"), "bigint"), listed(F.col("e.col"), "bigint")).alias("edge_index"),
        listed(F.col("e.edge_type"), "int").alias("edge_type"), listed(attr, "array<double>").alias("edge_attr"), "y",
        F.size("n").alias("num_nodes"), F.coalesce(F.size("e"), F.lit(0)).alias("num_edges"), F.lit(len(lex.NODE_TYPES)).alias("num_node_types"), F.lit(len(lex.EDGE_TYPES)).alias("num_edge_types"),
        F.col("n.text").alias("node_texts"), F.col("n.pos").alias("node_pos"),
    )


def vocabulary(spark: SparkSession, schema: Schema) -> DataFrame:
    """One row: name -> index maps of the base types and their counts."""
    pairs = lambda df, name: df.filter("level = 1").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "idx")))).alias(name), F.count(F.lit(1)).alias(f"num_{name}s"))
    return pairs(schema.node_labels(spark), "node_type").crossJoin(pairs(schema.edge_labels(spark), "edge_type"))
