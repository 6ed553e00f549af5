"""What the third review found of exports and merges: nodes and edges that were sorted, numbered and moved several times over."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import crossmodal, export, frontend, graph, security
from loomgraph.operators.annotate import LexiconAnnotator, RuleAnnotator
from loomgraph.sources import code_graph

TEXT = "The Old Fox saw that Mary Smith quickly made a very large attack. She was hurt badly.\n\nThe strcpy() allows a remote attacker to cause a buffer overflow."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, TEXT) for k in range(3)], "doc_id bigint, text string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_gathered_edges_are_those_of_the_table(spark, docs):
    g = frontend.build(LexiconAnnotator().annotate(docs))
    again = g.edges.filter("edge_type = 'DEP'").drop("allow_duplicate")
    before = again.limit(2).withColumn("seq", graph.seq(0, "src"))
    for built in (g, g.with_edges(again.withColumn("seq", graph.seq(9, "src", "dst"))), g.add_edges(again.withColumn("seq", graph.seq(9, "src", "dst")), True), g.add_edges(before, True)):
        want, found = built.edge_table(), built.edge_table(gathered=True)
        assert found.columns == want.columns and found.count() == want.count()
        assert rows(found.drop("edge_id")) == rows(want.drop("edge_id"))
        ids = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("edge_id")).alias("ids")).collect()
        assert all(r.ids == list(range(len(r.ids))) for r in ids)


def test_tensors_of_ids_with_gaps(spark):
    nodes = graph.filled(spark.createDataFrame([(1, 5, "TOKEN"), (1, 9, "SENTENCE"), (1, 70, "TOKEN"), (2, 0, "TOKEN"), (2, 1, "TOKEN")], "doc_id int, node_id bigint, node_type string"), graph.NODE_FIELDS).select(*graph.NODE_COLUMNS)
    edges = spark.createDataFrame([(1, 5, 70, "DEP"), (1, 9, 5, "CONTAINS"), (1, 5, 6, "DEP"), (1, 4, 9, "DEP"), (1, 99, 9, "DEP"), (2, 0, 1, "DEP"), (2, 1, 2, "DEP"), (2, -1, 1, "DEP")], "doc_id int, src bigint, dst bigint, edge_type string")
    g = graph.PropertyGraph(nodes, graph.edge_rows(edges.withColumn("seq", graph.seq(0, "src", "dst"))), nodes.select("doc_id").distinct())
    made = {r.doc_id: r for r in export.tensors(g).collect()}
    assert made[1].edge_index == [[0, 1], [2, 0]] and made[1].num_nodes == 3 and made[1].num_edges == 2
    assert made[2].edge_index == [[0], [1]]
    # documents are gathered once: nodes, edges, and no ranges
    told = plan(export.tensors(g))
    assert "__part" not in told and told.split("Initial Plan")[-1].count("Exchange hashpartitioning(doc_id") <= 3


def test_next_ids_are_known_without_the_nodes(spark, docs):
    """They were the greatest of all nodes' ids, for which all nodes were made."""
    for annotator in (RuleAnnotator(), LexiconAnnotator()):
        notes = annotator.annotate(docs).kept()
        g = security.overlay(frontend.build(notes), notes.docs, notes.sentences)
        plain = replace(g, ends=None)
        assert rows(g.bases()) == rows(plain.bases())
        assert "posexplode" not in plan(g.bases())
        ids = g.nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list("node_id")).alias("ids")).collect()
        assert all(r.ids == list(range(len(r.ids))) for r in ids)
        # of nodes that someone else put there nothing is known
        fewer = replace(g, nodes=g.nodes.filter("node_id < 4"))
        assert {r.base for r in fewer.bases().collect()} == {4}


def test_only_code_elements_are_joined_with_the_code_graph(spark, docs):
    cpg = code_graph.from_rows(spark, [(7, "CALL", "strcpy(a, b)", "strcpy", 1)], [(7, 7, "REACHING_DEF", "")])
    notes = RuleAnnotator().annotate(docs).kept()
    g = security.overlay(frontend.build(notes), notes.docs, notes.sentences)
    out = crossmodal.CrossModalPass(cpg).run(g)
    assert rows(out.nodes.drop("extra")) == rows(g.nodes.drop("extra"))
    noted = out.node_table().filter("extra.cpg_node_id is not null")
    assert noted.count() == 3
    # the frames, and so all tokens, are not looked at
    read = lambda df: any("annotated-" in f for f in df.inputFiles())
    assert not read(noted) and read(out.node_table())


def test_edges_are_written_as_they_were_added(spark, docs):
    """All passes' edges were one plan."""
    notes = RuleAnnotator().annotate(docs).kept()
    g = security.overlay(frontend.build(notes), notes.docs, notes.sentences)
    parts = g.edge_parts()
    assert len(parts) == 3 and sum(p.count() for p in parts) == g.edges.count()
    assert len(replace(g, edges=g.edges.filter("src = 0")).edge_parts()) == 1
