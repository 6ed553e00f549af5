"""Presets: annotator, front end, passes and exports in one object."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.storage import stored
from loomgraph.operators import crossmodal, export, frontend, security
from loomgraph.operators.annotate import Annotator, RuleAnnotator
from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.passes import Pass, default_passes
from loomgraph.schema import DEFAULT_SCHEMA, FULL_SCHEMA, SECURITY_SCHEMA, Schema
from loomgraph.sources.code_graph import CodeGraph
from loomgraph.sources.text import from_strings


class GraphPipeline:
    """Documents (doc_id, text) to graphs. An empty list of passes means the default ones."""

    def __init__(self, annotator: Annotator | None = None, passes: list[Pass] | None = None, schema: Schema = DEFAULT_SCHEMA) -> None:
        self.annotator = annotator or RuleAnnotator()
        self.passes = list(passes or default_passes())
        self.schema = schema

    def initial(self, docs: DataFrame) -> PropertyGraph:
        return frontend.build(self.annotator.annotate(docs).kept(), self.schema)

    def run(self, docs: DataFrame) -> PropertyGraph:
        graph = self.initial(docs)
        for p in self.passes:
            graph = p.run(graph)
        # part by part: one plan for the edges of all passes runs all of their joins at once, and fills the driver's memory
        parts = [stored(part, "edges") for part in graph.edge_parts()]
        return replace(graph.over(stored(graph.nodes, "nodes")), edges=reduce(DataFrame.unionByName, parts))

    export_graphson = staticmethod(export.write_graphson)
    export_graphson_string = staticmethod(export.graphson)
    export_tensors = staticmethod(export.tensors)


class SecurityPipeline(GraphPipeline):
    """With security entities and relations, which come before the passes' edges."""

    def __init__(self, annotator: Annotator | None = None, passes: list[Pass] | None = None, schema: Schema = SECURITY_SCHEMA) -> None:
        super().__init__(annotator, passes, schema)

    def initial(self, docs: DataFrame) -> PropertyGraph:
        notes = self.annotator.annotate(docs).kept()
        return security.overlay(frontend.build(notes, self.schema), notes.docs, notes.sentences)


class CrossModalPipeline(SecurityPipeline):
    """With alignment to a code graph after the other passes, and the merge."""

    def __init__(self, cpg: CodeGraph | None = None, annotator: Annotator | None = None, passes: list[Pass] | None = None, schema: Schema = FULL_SCHEMA) -> None:
        super().__init__(annotator, passes, schema)
        self.cpg = cpg
        self.passes = [*self.passes, crossmodal.CrossModalPass(cpg)]

    def merge_with_code(self, graph: PropertyGraph) -> PropertyGraph:
        return crossmodal.merge(graph, self.cpg)


def parse_text(spark: SparkSession, text: str, doc_id: str = "", annotator: Annotator | None = None) -> PropertyGraph:
    return GraphPipeline(annotator).run(from_strings(spark, {doc_id: text}))


def parse_security_text(spark: SparkSession, text: str, doc_id: str = "", annotator: Annotator | None = None) -> PropertyGraph:
    return SecurityPipeline(annotator).run(from_strings(spark, {doc_id: text}))
