"""Text graph x code graph: alignment of code elements, links between them, and the merge.

The code graph is one graph for all documents: its distinct codes meet distinct code element
texts through q-grams, so the work grows with distinct spellings, not documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import lexicons as lex
from loomgraph.functions import ranges
from loomgraph.functions.storage import shuffled, stored
from loomgraph.functions.text import lookup, rstrip
from loomgraph.operators.containment import containing
from loomgraph.operators.graph import PropertyGraph, edge_rows, first_edges, seq
from loomgraph.schema import EDGE_EXTRA, NODE_COLUMNS, NODE_EXTRA, NODE_FIELDS, extra, filled
from loomgraph.sources.code_graph import CodeGraph

#: Rows of a code graph that meet a document at once
CHUNK = 1000
DESCRIBE_STAGE, MAP_STAGE = 10, 11
#: after all edges of the text, whoever added them
CODE_STAGE, ALIGN_STAGE = 1 << 30, (1 << 30) + 1
MERGE_PASS = "cross_modal_merge"


def needle(text: Column) -> Column:
    """What is looked for in code: lower case, without parentheses at the end."""
    return rstrip(F.lower(text), "()")


def by_name(cpg: CodeGraph) -> DataFrame:
    """(name, vertex): of vertices with one lower-cased name the last."""
    v = F.struct("cpg_id", "label", "code")
    return cpg.vertices.filter("name <> ''").groupBy(F.lower("name").alias("name")).agg(F.max_by(v, "ord").alias("named"))


def alignments(code_elements: DataFrame, cpg: CodeGraph) -> DataFrame:
    """Code elements (with ``text``) with ``cpg_id``, ``cpg_label``, ``cpg_code`` of their vertex.

    The first CALL whose code contains the text, else the last vertex with that name.
    """
    code_elements = stored(code_elements.withColumn("needle", needle(F.col("text"))), "code-elements")
    wanted = code_elements.select("needle").distinct()
    calls = cpg.vertices.filter("label = 'CALL'").select("cpg_id", "label", "code", "ord", F.lower("code").alias("low"))
    firsts = calls.groupBy("low").agg(F.min(F.struct("ord", "cpg_id", "label", "code")).alias("first"))
    held = containing(wanted, firsts.select(F.col("low").alias("text"))).join(firsts, F.col("text") == F.col("low"))
    called = held.groupBy("needle").agg(F.min("first").alias("first")).select("needle", F.struct("first.cpg_id", "first.label", "first.code").alias("called"))
    names = by_name(cpg)
    found = wanted.join(called, "needle", "left").join(names, F.col("needle") == F.col("name"), "left").select("needle", F.coalesce("called", "named").alias("v")).filter("v is not null")
    found = found.select("needle", F.col("v.cpg_id").alias("cpg_id"), F.col("v.label").alias("cpg_label"), F.col("v.code").alias("cpg_code"))
    return code_elements.join(found, "needle", "left").drop("needle")


def describes(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst, cpg_id, pattern): vulnerability types x aligned code elements; vertex 0 counts as none."""
    vulns = nodes.filter("node_type = 'ENTITY' and entity_type = 'VULN_TYPE'").select("doc_id", F.col("node_id").alias("src"), F.lower("text").alias("pattern"))
    code = nodes.filter("domain_type = 'code_construct' and coalesce(cpg_id, 0) <> 0").select("doc_id", F.col("node_id").alias("dst"), "cpg_id")
    return vulns.join(shuffled(code), "doc_id")


def maps_to(nodes: DataFrame, cpg: CodeGraph) -> DataFrame:
    """(doc_id, src, dst, description): attack vectors x aligned code elements that a definition reaches."""
    reached = cpg.edges.filter("label = 'REACHING_DEF'").select(F.col("dst").alias("cpg_id")).distinct()
    vectors = nodes.filter("node_type = 'ENTITY' and entity_type = 'ATTACK_VECTOR'").select("doc_id", F.col("node_id").alias("src"), F.col("text").alias("vector"))
    code = nodes.filter("domain_type = 'code_construct' and coalesce(cpg_id, 0) <> 0").join(reached, "cpg_id", "left_semi").select("doc_id", F.col("node_id").alias("dst"), F.col("text").alias("element"))
    said = F.format_string(lex.FLOW_SENTENCE, "vector", "element")
    return vectors.join(shuffled(code), "doc_id").select("doc_id", "src", "dst", said.alias("description"))


def inferred_cwe(domain_type: Column) -> Column:
    return lookup(domain_type, lex.CWE_OF_DOMAIN)


class CrossModalPass:
    """Aligns code elements with a code graph; without one, infers weakness classes from the text."""

    name = "cross_modal_pass"

    def __init__(self, cpg: CodeGraph | None = None) -> None:
        self.cpg = cpg

    def run(self, graph: PropertyGraph) -> PropertyGraph:
        entity = F.col("node_type") == "ENTITY"
        if self.cpg is None:
            cwe = inferred_cwe(F.col("domain_type"))
            noted = extra(NODE_EXTRA, inferred_cwe=cwe, pattern_source=F.lit("text_pattern_analysis"))
            return graph.over(graph.nodes.withColumn("extra", F.when(entity & cwe.isNotNull(), noted).otherwise(F.col("extra")))).marked(self.name)
        code = entity & (F.col("domain_type") == "code_construct")
        found = alignments(graph.nodes.filter(code).select("doc_id", "node_id", "text"), self.cpg).drop("text")
        # only code elements meet their vertices; all other nodes stay where they are
        aligned = stored(graph.nodes.filter(code).join(shuffled(found), ["doc_id", "node_id"], "left"), "aligned")
        nodes = graph.nodes.filter(~F.coalesce(code, F.lit(False))).unionByName(aligned, True)
        noted = extra(NODE_EXTRA, cpg_node_id=F.col("cpg_id"), cpg_label=F.col("cpg_label"), cpg_code=F.col("cpg_code"), cross_modal=F.lit("REFERS_TO"))
        out = graph.over(nodes.withColumn("extra", F.when(F.col("cpg_id").isNotNull(), noted).otherwise(F.col("extra"))).select(*NODE_COLUMNS))
        said = describes(nodes).select(
            "doc_id", "src", "dst", F.lit("ENTITY_REL").alias("edge_type"), F.lit("DESCRIBES").alias("entity_rel_type"),
            extra(EDGE_EXTRA, cross_modal=F.lit(True), cpg_node_id=F.col("cpg_id"), vulnerability_pattern=F.col("pattern")).alias("extra"), seq(DESCRIBE_STAGE, "src", "dst").alias("seq"),
        )
        flows = maps_to(nodes, self.cpg).select(
            "doc_id", "src", "dst", F.lit("ENTITY_REL").alias("edge_type"), F.lit("MAPS_TO").alias("entity_rel_type"),
            extra(EDGE_EXTRA, cross_modal=F.lit(True), cpg_reaching_def=F.lit(True), description=F.col("description")).alias("extra"), seq(MAP_STAGE, "src", "dst").alias("seq"),
        )
        return out.with_edges(said).with_edges(flows).marked(self.name)


# ---- merge


def merge_node_type(label: Column) -> Column:
    return F.coalesce(lookup(label, lex.MERGE_NODE_TYPE), F.lit("TOKEN"))


def merge_edge_type(label: Column) -> Column:
    return F.coalesce(lookup(label, lex.MERGE_EDGE_TYPE), F.lit("DEP"))


def for_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of the code graph once for every document: documents x rows, which is what a merge is asked for.

    The code graph is cut into chunks of some ``CHUNK`` rows, which each document meets one by one.
    """
    rows = stored(rows, "code-rows")  # counted and then met: made once, and what makes it is in no later plan
    chunks = max(1, -(-rows.count() // CHUNK))
    fields = rows.columns
    listed = rows.groupBy(F.pmod(F.xxhash64(*fields[:3]), F.lit(chunks)).cast("int").alias("__chunk")).agg(F.collect_list(F.struct(*fields)).alias("__rows"))
    dealt = docs.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.join(listed, "__chunk").select(*docs.columns, F.inline("__rows"))


def vertex_rows(cpg: CodeGraph) -> DataFrame:
    """The vertices as node rows without a document, with their order."""
    v = cpg.vertices.withColumn("label", F.coalesce("label", F.lit("UNKNOWN")))
    return v.select(
        "ord", merge_node_type(F.col("label")).alias("node_type"), F.coalesce("code", F.lit("")).alias("text"), F.coalesce("line", F.lit(0)).alias("sent_idx"),
        F.concat(F.lit("cpg:"), "label").alias("source"), extra(NODE_EXTRA, cpg_original_label=F.col("label"), cpg_original_id=F.col("cpg_id")).alias("extra"),
    )


def code_nodes(docs: DataFrame, cpg: CodeGraph) -> DataFrame:
    """The vertices as node rows of every document (doc_id)."""
    return for_each(docs.select("doc_id").distinct(), vertex_rows(cpg))


def references(nodes: DataFrame, cpg: CodeGraph) -> DataFrame:
    """(doc_id, node_id, ord, cpg_id): code elements x every vertex whose code contains their text."""
    code = stored(nodes.filter("domain_type = 'code_construct'").select("doc_id", "node_id", needle(F.col("text")).alias("needle")), "code-elements")
    wanted = code.select("needle").distinct()
    vertices = cpg.vertices.select("cpg_id", "ord", F.lower("code").alias("text"))
    hits = stored(containing(wanted, vertices).join(vertices, "text").select("needle", "ord", "cpg_id"), "hits")
    return shuffled(code).join(hits, "needle").select("doc_id", "node_id", "ord", "cpg_id")


# Each part of a merge can be made without the others. A code edge has both ends among the code's nodes and a reference one, so
# first writers are sought within each part.


def bases(graph: PropertyGraph) -> DataFrame:
    """(doc_id, base): the id of a document's first code node."""
    return graph.bases()


def merged_nodes(graph: PropertyGraph, cpg: CodeGraph) -> DataFrame:
    """The documents' nodes, and all vertices for each document. Vertices are numbered once, not once a document."""
    rows = ranges.numbered(vertex_rows(cpg), [], ["ord"], "row")
    docs = graph.meta.select("doc_id").distinct().join(shuffled(bases(graph)), "doc_id", "left")
    new = for_each(docs, rows).withColumn("node_id", (F.coalesce("base", F.lit(0)) + F.col("row")).cast("long"))
    return graph.nodes.select(*NODE_COLUMNS).unionByName(filled(new, NODE_FIELDS).select(*NODE_COLUMNS))


def last_places(cpg: CodeGraph) -> DataFrame:
    """(cpg_id, ord): of vertices with one id the last."""
    return cpg.vertices.groupBy("cpg_id").agg(F.max("ord").alias("ord"))


def code_edges(graph: PropertyGraph, cpg: CodeGraph) -> DataFrame:
    """The code graph's edges for each document; of equal ones the first, which is sought once for all documents."""
    place = last_places(cpg)
    ends = cpg.edges.withColumn("label", F.coalesce("label", F.lit("AST"))).join(place.withColumnsRenamed({"cpg_id": "src", "ord": "s"}), "src").join(place.withColumnsRenamed({"cpg_id": "dst", "ord": "d"}), "dst")
    rows = ends.select("s", "d", merge_edge_type(F.col("label")).alias("edge_type"), "ord", "label").groupBy("s", "d", "edge_type").agg(F.min(F.struct("ord", "label")).alias("first"))
    rows = rows.select("s", "d", "edge_type", "first.ord", extra(EDGE_EXTRA, cpg_original_label=F.col("first.label")).alias("extra"))
    return edge_rows(for_each(bases(graph), rows).select("doc_id", (F.col("base") + F.col("s")).alias("src"), (F.col("base") + F.col("d")).alias("dst"), "edge_type", "extra", seq(CODE_STAGE, "ord").alias("seq")))


def reference_edges(graph: PropertyGraph, cpg: CodeGraph) -> DataFrame:
    """Edges from code elements to the code nodes that hold their text."""
    refs = references(graph.nodes, cpg).join(last_places(cpg).withColumnRenamed("ord", "last"), "cpg_id").join(shuffled(bases(graph)), "doc_id")
    refs = refs.select("doc_id", F.col("node_id").alias("src"), (F.col("base") + F.col("last")).alias("dst"), F.lit("ENTITY_REL").alias("edge_type"), F.lit("CROSS_MODAL_REFERS_TO").alias("entity_rel_type"), extra(EDGE_EXTRA, cross_modal=F.lit(True)).alias("extra"), seq(ALIGN_STAGE, "node_id", "ord").alias("seq"))
    return first_edges(edge_rows(refs))


def merged_meta(graph: PropertyGraph, cpg: CodeGraph) -> DataFrame:
    n_code = cpg.vertices.select("cpg_id").distinct().count()
    meta = graph.meta.drop("text_nodes").join(shuffled(bases(graph).withColumnRenamed("base", "text_nodes")), "doc_id", "left")
    return meta.withColumns({"source": F.lit(lex.MERGED_SOURCE), "code_nodes": F.lit(n_code).cast("long"), "passes_applied": F.array(F.lit(MERGE_PASS))}).select(*graph.meta.columns)


def as_merged(df: DataFrame, suffix: str = "_merged") -> DataFrame:
    """Rows of a merged graph under their document's new name."""
    return df.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(suffix)))


def merge(graph: PropertyGraph, cpg: CodeGraph | None, suffix: str = "_merged") -> PropertyGraph:
    """Each document's graph and the code graph as one; unchanged without a code graph.

    The result has documents x vertices of code nodes: each document's graph holds the whole code graph.
    """
    if cpg is None:
        return graph
    text = graph.edges.withColumn("allow_duplicate", F.lit(False))
    edges = text.unionByName(code_edges(graph, cpg)).unionByName(reference_edges(graph, cpg))
    return PropertyGraph(*(as_merged(df, suffix) for df in (merged_nodes(graph, cpg), edges, merged_meta(graph, cpg))), passes=(MERGE_PASS,))


def link_counts(cpg: CodeGraph) -> DataFrame:
    """Vertices with their number of edges, a check of a code graph before a merge."""
    ends = cpg.edges.select(F.explode(F.array("src", "dst")).alias("cpg_id"))
    return cpg.vertices.join(ends.groupBy("cpg_id").agg(F.count(F.lit(1)).alias("n_edges")), "cpg_id", "left").fillna(0, ["n_edges"])
