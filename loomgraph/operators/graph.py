"""The property graph of a corpus: two long tables keyed by doc_id, and operators over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import ranges
from loomgraph.functions.storage import shuffled, stored
from loomgraph.operators import adjacency
from loomgraph.schema import DEFAULT_SCHEMA, EDGE_COLUMNS, EDGE_FIELDS, NODE_COLUMNS, NODE_FIELDS, Schema, filled


@dataclass(frozen=True)
class PropertyGraph:
    """nodes, edges (with ``seq``, the order in which they were added) and one meta row per document.

    Edges may hold several of one (src, dst, edge_type); ``edge_table`` keeps the first.
    ``ends``: the nodes it is known for, and (doc_id, base) rows of which a document's greatest base is its next node id.
    """

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame
    schema: Schema = DEFAULT_SCHEMA
    passes: tuple[str, ...] = ()
    ends: tuple[DataFrame, DataFrame] | None = None
    parts: tuple[DataFrame, tuple[DataFrame, ...]] | None = None

    def edge_parts(self) -> tuple[DataFrame, ...]:
        """The edges as they were added; all in one, if someone else put them there."""
        return self.parts[1] if self.parts is not None and self.parts[0] is self.edges else (self.edges,)

    def known_ends(self) -> DataFrame | None:
        """What ``ends`` tells of these very nodes; whoever replaces nodes by others makes it unknown."""
        return self.ends[1] if self.ends is not None and self.ends[0] is self.nodes else None

    def over(self, nodes: DataFrame) -> PropertyGraph:
        """The same nodes with other properties, or from elsewhere."""
        ends = self.known_ends()
        return replace(self, nodes=nodes, ends=None if ends is None else (nodes, ends))

    def bases(self) -> DataFrame:
        """(doc_id, base): the next node id of each document that has nodes."""
        ends = self.known_ends()
        ends = self.nodes.select("doc_id", (F.col("node_id") + 1).alias("base")) if ends is None else ends
        return ends.groupBy("doc_id").agg(F.max("base").alias("base"))

    def with_nodes(self, new: DataFrame, *order: Column | str, place: Column | None = None) -> PropertyGraph:
        """Append nodes; their ids follow the document's last id in the given order, or by ``place``, if the rows are numbered 0, 1, ... within their document already.

        The new nodes are written to the shared folder, because every later pass reads them.
        """
        added = stored(numbered(new, self.bases(), *order, place=place), "nodes")
        nodes, ends = self.nodes.unionByName(added), self.known_ends()
        return replace(self, nodes=nodes, ends=None if ends is None else (nodes, ends.unionByName(added.select("doc_id", (F.col("node_id") + 1).alias("base")))))

    def with_edges(self, new: DataFrame) -> PropertyGraph:
        """Append edges whose ends come from the graph's own nodes, as those of passes do."""
        added = edge_rows(new)
        edges = self.edges.unionByName(added)
        return replace(self, edges=edges, parts=(edges, (*self.edge_parts(), added)))

    def add_edges(self, new: DataFrame, allow_duplicate: bool = False) -> PropertyGraph:
        """Append edges (doc_id, src, dst, edge_type, seq, fields); raises when an end doesn't exist.

        Of edges with one (src, dst, edge_type) the first added is kept, and with
        ``allow_duplicate`` these as well.
        """
        rows = checked_edges(new, self.nodes)
        return self.with_edges(rows.withColumn("allow_duplicate", F.lit(True)) if allow_duplicate else rows)

    def marked(self, name: str) -> PropertyGraph:
        """Log a pass."""
        meta = self.meta.withColumn("passes_applied", F.array_append("passes_applied", F.lit(name)))
        return replace(self, meta=meta, passes=(*self.passes, name))

    def edge_table(self, gathered: bool = False) -> DataFrame:
        """Edges as stored: first writer wins, ids in the order of adding.

        ``gathered``: a document's edges in one partition, from one shuffle; for exports that make a row a document and gather them anyway.
        """
        return gathered_edges(self.edges) if gathered else stored_edges(self.edges)

    def edges_of(self, *edge_types: str) -> DataFrame:
        """Edges of some types (none: of all) as ``edge_table`` has them, but without ids.

        An edge's type is part of what makes it the first, so edges of other types are never made, and nothing is numbered or written.
        """
        wanted = self.edges.filter(F.col("edge_type").isin(*edge_types)) if edge_types else self.edges
        return first_edges(wanted).select(*[c for c in EDGE_COLUMNS if c != "edge_id"])

    def node_table(self) -> DataFrame:
        return self.nodes.select(*NODE_COLUMNS)


def dense(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within their document. By ranges, so a document may hold any share of all rows."""
    return ranges.numbered(rows, ["doc_id"], order, name)


def numbered(new: DataFrame, bases: DataFrame, *order: Column | str, place: Column | None = None) -> DataFrame:
    """Node rows with ids from ``bases`` (doc_id, base) on, by ``order``, or by ``place`` if that counts them."""
    rows = dense(new, list(order), "__row") if place is None else new.withColumn("__row", place)
    last = bases.withColumnRenamed("base", "__base")
    out = rows.join(shuffled(last), "doc_id", "left").withColumn("node_id", (F.coalesce("__base", F.lit(0)) + F.col("__row")).cast("long"))
    return filled(out, NODE_FIELDS).select(*NODE_COLUMNS)


SEQ = "struct<stage: int, a: bigint, b: bigint, c: bigint, d: bigint, e: bigint>"


def seq(stage: int, *parts: Column | str | int) -> Column:
    """Where an edge stands in the order of adding."""
    given = [F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    given += [F.lit(0)] * (5 - len(given))
    return F.struct(F.lit(stage).alias("stage"), *[p.cast("long").alias(n) for p, n in zip(given, "abcde")]).cast(SEQ)


def edge_rows(df: DataFrame) -> DataFrame:
    """Edge rows with all fields, in order."""
    return filled(df, EDGE_FIELDS | {"allow_duplicate": ("boolean", "false")}).select("doc_id", "src", "dst", "edge_type", *EDGE_FIELDS, "seq", "allow_duplicate")


def first_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """Of the edges with one (doc_id, src, dst, edge_type) the first added, and those that may be duplicates.

    An aggregation that begins where the rows are, so any share of all edges may be parallel.
    """
    key = ["doc_id", "src", "dst", "edge_type"]
    rest = [c for c in edges.columns if c not in key]
    row, place = F.struct(*rest), F.col(order)
    if "allow_duplicate" not in edges.columns:
        return edges.groupBy(*key).agg(F.min_by(row, place).alias("first")).select(*key, "first.*").select(*edges.columns)
    free = F.col("allow_duplicate")
    firsts = edges.groupBy(*key).agg(F.min_by(row, F.when(~free, place)).alias("first"), F.min(F.when(~free, place)).alias("at"), F.min(F.when(free, place)).alias("free_at"))
    # a duplicate that was added before takes the place of the first
    kept = firsts.filter("at is not null and (free_at is null or at <= free_at)").select(*key, "first.*").select(*edges.columns)
    return kept.unionByName(edges.filter(free))


def stored_edges(edges: DataFrame) -> DataFrame:
    return dense(stored(first_edges(edges), "first-edges"), ["seq"], "edge_id").select(*EDGE_COLUMNS)


def gathered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within their document, each document's in one partition."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1)


def gathered_edges(edges: DataFrame) -> DataFrame:
    """``stored_edges`` where documents are gathered: first writers are sought and numbered where a document's edges are."""
    same = Window.partitionBy("doc_id", "src", "dst", "edge_type")
    free = F.col("allow_duplicate")
    rows = edges.repartition("doc_id").withColumns({"__n": F.row_number().over(same.orderBy("allow_duplicate", "seq")), "__free_at": F.min(F.when(free, F.col("seq"))).over(same)})
    kept = rows.filter(free | ((F.col("__n") == 1) & (F.col("__free_at").isNull() | (F.col("seq") <= F.col("__free_at")))))
    return gathered(kept, "seq", "edge_id").withColumn("edge_id", F.col("edge_id").cast("long")).select(*EDGE_COLUMNS)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that doesn't exist, and which (``source`` or ``target``)."""
    ids = nodes.select("doc_id", "node_id")
    gone = [edges.join(ids.withColumnRenamed("node_id", end), ["doc_id", end], "left_anti").withColumn("end", F.lit(name)) for end, name in (("src", "source"), ("dst", "target"))]
    return gone[0].unionByName(gone[1])


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges``; raises when one has an unknown end."""
    if (bad := dangling(edges, nodes).first()) is not None:
        raise ValueError(f"edge {bad['src']} -> {bad['dst']} has an unknown {bad['end']}")
    return edges


# ---- lookups


def node(nodes: DataFrame, doc_id, node_id: int) -> DataFrame:
    return nodes.filter((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id))


def edge(edges: DataFrame, doc_id, edge_id: int) -> DataFrame:
    return edges.filter((F.col("doc_id") == doc_id) & (F.col("edge_id") == edge_id))


def nodes_of_type(nodes: DataFrame, node_type: str | None = None) -> DataFrame:
    return nodes if node_type is None else nodes.filter(F.col("node_type") == node_type)


def edges_of_type(edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    return edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)


def having_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, node_id) that exist."""
    return wanted.join(nodes, ["doc_id", "node_id"], "left_semi")


def having_edges(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, src, dst, edge_type) that exist."""
    return wanted.join(edges, ["doc_id", "src", "dst", "edge_type"], "left_semi")


def edges_between(sources: DataFrame, targets: DataFrame, edges: DataFrame, edge_type: str, matching: Column) -> DataFrame:
    """(doc_id, src, dst, edge_type) of the pairs of ``sources`` (doc_id, src, ...) and ``targets`` (doc_id, dst, ...) that match and that an edge joins.

    The edges look up their ends, so what is made grows with them, not with the pairs. A source or target given twice makes its pairs twice.
    """
    linked = edges_of_type(edges, edge_type).select("doc_id", "src", "dst", "edge_type").distinct()
    return linked.join(sources, ["doc_id", "src"]).join(targets, ["doc_id", "dst"]).filter(matching).select("doc_id", "src", "dst", "edge_type")


def with_properties(rows: DataFrame, equal: dict[str, object] | None = None, none_of: dict[str, list] | None = None) -> DataFrame:
    """The nodes or edges whose columns equal the given values and hold none of those excluded."""
    for name, value in (equal or {}).items():
        rows = rows.filter(F.col(name) == value)
    for name, values in (none_of or {}).items():
        rows = rows.filter(~F.col(name).isin(values))
    return rows


# ---- traversal


def neighbors(edges: DataFrame, edge_types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(doc_id, node_id, other_id, edge_type) for every node; both directions give a bag."""
    use = edges if edge_types is None else edges.filter(F.col("edge_type").isin(edge_types))
    out = use.select("doc_id", F.col("src").alias("node_id"), F.col("dst").alias("other_id"), "edge_type")
    back = use.select("doc_id", F.col("dst").alias("node_id"), F.col("src").alias("other_id"), "edge_type")
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def walk(edges: DataFrame, starts: DataFrame, edge_types: list[str], direction: str = "out", max_depth: int = 10) -> DataFrame:
    """(doc_id, start, path, depth): simple paths of 1 to ``max_depth`` edges from each start (doc_id, node_id).

    One look-up in the adjacency per level: edges are shuffled when it is built and not again. It ends early when a level is empty.
    Parallel edges repeat paths.
    """
    links = adjacency.build(neighbors(edges, edge_types, direction).select("doc_id", "node_id", "other_id"))
    level = links.enter(starts.select("doc_id", "node_id", F.col("node_id").alias("start"), F.array("node_id").alias("path")))
    found = None
    for depth in range(1, max_depth + 1):
        level = links.step(level).filter(~F.array_contains("path", F.col("other")))
        level = level.select("doc_id", "start", F.array_append("path", F.col("other")).alias("path"), F.col("other").alias("node_id"), F.col("other_pieces").alias("pieces"))
        now = level.select("doc_id", "start", "path", F.lit(depth).alias("depth"))
        found = now if found is None else found.unionAll(now)
        if depth % 3 == 0 and depth < max_depth:
            level = stored(level, "paths")
            if level.isEmpty():
                break
    return found


def subgraph(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph induced by ``wanted`` (doc_id, node_id, ord); ids follow ord.

    Unknown ids are skipped; an id given twice makes two nodes, and edges go to the last.
    """
    kept = wanted.join(nodes, ["doc_id", "node_id"]).withColumnRenamed("node_id", "old_id")
    kept = stored(dense(stored(kept, "induced"), ["ord"], "node_id"), "renumbered")
    new = kept.groupBy("doc_id", "old_id").agg(F.max("node_id").alias("new_id"))
    ends = edges.join(new.select("doc_id", F.col("old_id").alias("src"), F.col("new_id").alias("new_src")), ["doc_id", "src"])
    ends = ends.join(new.select("doc_id", F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst")), ["doc_id", "dst"])
    ends = ends.drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"}).withColumnRenamed("edge_id", "old_id")
    ends = dense(stored(first_edges(ends, "old_id"), "induced-edges"), ["old_id"], "edge_id").drop("old_id")
    sub = F.concat(F.col("doc_id").cast("string"), F.lit("_sub"))
    return kept.drop("old_id", "ord").withColumn("doc_id", sub), ends.withColumn("doc_id", sub)


def edge_report(edges: DataFrame, nodes: DataFrame, edge_type: str) -> DataFrame:
    """Edges of a type with the text of both ends."""
    end = lambda n, name: nodes.select("doc_id", F.col("node_id").alias(n), F.col("text").alias(name))
    return edges_of_type(edges, edge_type).join(end("src", "src_text"), ["doc_id", "src"]).join(end("dst", "dst_text"), ["doc_id", "dst"])


def first_nodes(nodes: DataFrame, k: int, node_type: str | None = None) -> DataFrame:
    """The first k nodes of each document, in id order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    return nodes_of_type(nodes, node_type).withColumn("__n", n).filter(F.col("__n") <= k).drop("__n")


# ---- checks and counts


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, kind, type, n): totals (type null) and counts by type, in one pass each."""

    def counted(df: DataFrame, kind: str, column: str) -> DataFrame:
        df = df.select("doc_id", F.col(column).alias("type"))
        return df.groupingSets([["doc_id"], ["doc_id", "type"]], "doc_id", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))

    return counted(nodes, "node", "node_type").unionByName(counted(edges, "edge", "edge_type")).select("doc_id", "kind", "type", "n")


def validate(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, rule, element_id, message) of every problem; ``docs`` names the documents."""
    is_ = lambda t: F.count_if(F.col("node_type") == t)
    per_node = nodes.groupBy("doc_id").agg(is_("DOCUMENT").alias("n_doc"), is_("SENTENCE").alias("n_sent"))
    per_edge = edges.groupBy("doc_id").agg(F.count_if(F.col("edge_type") == "NEXT_TOKEN").alias("n_next"), F.count_if(F.col("edge_type") == "DEP").alias("n_dep"))
    count = docs.select("doc_id").distinct().join(per_node, "doc_id", "left").join(per_edge, "doc_id", "left").fillna(0)
    issue = lambda rule, when, message: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message")))
    whole = count.select("doc_id", F.explode(F.array_compact(F.array(
        issue("V1", F.col("n_doc") == 0, "no DOCUMENT node"),
        issue("V2", F.col("n_doc") > 1, "several DOCUMENT nodes"),
        issue("V5", (F.col("n_sent") > 0) & (F.col("n_next") == 0), "sentences but no NEXT_TOKEN edges"),
        issue("V6", (F.col("n_sent") > 0) & (F.col("n_dep") == 0), "sentences but no DEP edges"),
    ))).alias("i")).select("doc_id", "i.rule", F.lit(None).cast("long").alias("element_id"), "i.message")
    gone = dangling(edges, nodes).select("doc_id", F.lit("V3").alias("rule"), F.col("edge_id").alias("element_id"), F.concat(F.lit("unknown "), "end").alias("message"))
    tokens = nodes_of_type(nodes, "TOKEN").select("doc_id", F.col("node_id").alias("dst"))
    held = edges_of_type(edges, "CONTAINS").join(tokens, ["doc_id", "dst"], "left_semi").select("doc_id", F.col("src").alias("node_id"))
    bare = nodes_of_type(nodes, "SENTENCE").join(held, ["doc_id", "node_id"], "left_anti")
    bare = bare.select("doc_id", F.lit("V4").alias("rule"), F.col("node_id").alias("element_id"), F.lit("sentence without tokens").alias("message"))
    return whole.unionByName(gone).unionByName(bare)


def summary(graph: PropertyGraph, doc_id) -> str:
    """Counts and problems of one document as text."""
    mine = F.col("doc_id") == doc_id
    nodes, edges = graph.node_table().filter(mine), graph.edge_table().filter(mine)
    lines = [f"graph of {doc_id}"]
    for r in stats(nodes, edges).orderBy(F.desc("kind"), F.col("type").asc_nulls_first()).collect():
        lines.append(f"  {r['kind']}s: {r['n']}" if r["type"] is None else f"    {r['type']}: {r['n']}")
    lines.append("  passes: " + ", ".join(graph.passes))
    found = validate(nodes, edges, graph.meta.filter(mine)).collect()
    lines += [f"  {r['rule']}: {r['message']}" for r in found] or ["  valid"]
    return "\n".join(lines)
