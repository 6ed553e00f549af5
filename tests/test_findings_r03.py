"""What the third review found: work and memory that grew faster than a query's input."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import crossmodal, frontend, graph
from loomgraph.operators.annotate import LexiconAnnotator
from loomgraph.sources import code_graph

TEXT = "The Old Fox saw that Mary Smith quickly made a very large attack. She was hurt badly.\n\nThe buffer allows a remote Attacker to cause it."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lexicon_graph(spark):
    docs = spark.createDataFrame([(k, TEXT) for k in range(3)], "doc_id bigint, text string")
    return frontend.build(LexiconAnnotator().annotate(docs).kept())


def test_edges_of_types_are_those_of_the_table_without_ids(lexicon_graph):
    whole = lexicon_graph.edge_table().drop("edge_id")
    for types in (("DEP",), ("SRL_ARG", "BELONGS_TO"), ()):
        found = lexicon_graph.edges_of(*types)
        want = whole.filter(F.col("edge_type").isin(*types)) if types else whole
        assert found.columns == want.columns and want.count() > 0
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_edges_of_a_type_make_no_others_and_broadcast_nothing(lexicon_graph):
    made = plan(lexicon_graph.edges_of("DEP"))
    assert "SRL_ARG" not in made and "NEXT_TOKEN" not in made and "__part" not in made
    # the table is small here, as a compressed file seems to be at any size
    assert "Broadcast" not in made
    assert "Broadcast" not in plan(lexicon_graph.edges_of("BELONGS_TO", "SRL_ARG", "CONTAINS"))


def test_edges_between_look_up_their_ends(spark):
    edges = spark.createDataFrame([(0, 1, 11, "A", 1), (0, 1, 11, "A", 2), (0, 2, 12, "A", 3), (0, 1, 12, "A", 4), (0, 3, 11, "B", 5), (1, 1, 11, "A", 6), (0, 9, 11, "A", 7), (0, None, 11, "A", 8)], "doc_id int, src bigint, dst bigint, edge_type string, edge_id bigint")
    sources = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (0, 2, 0), (0, 3, 1), (0, None, 1)], "doc_id int, src bigint, s int")
    targets = spark.createDataFrame([(0, 11, 1), (0, 12, 0)], "doc_id int, dst bigint, p int")
    found = graph.edges_between(sources, targets, edges, "A", F.col("s") == F.col("p"))
    pairs = sources.join(targets, sources["s"] == targets["p"]).select(sources["doc_id"], "src", "dst", F.lit("A").alias("edge_type"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.having_edges(pairs, edges).collect())) == [(0, 1, 11, "A"), (0, 2, 12, "A"), (0, 2, 12, "A")]


def test_has_edge_makes_no_pairs(spark, sf):
    """The pairs, a tenth of all, were joined by the remainder of their keys."""
    from loomgraph.plans.queries import queries

    made = plan(queries()["has_edge"](spark, sf))
    joins = [line for line in made.split("\n") if "Join" in line]
    assert joins and all("src" in line or "dst" in line for line in joins)


def test_parts_of_a_merge_are_those_of_the_whole(spark, lexicon_graph):
    """Code edges were deduplicated and code nodes numbered once a document, with all edges of the text."""
    vertices = [(7, "CALL", "strcpy(a, b)", "strcpy", 1), (8, "LOCAL", "int a", "a", 2), (7, "CALL", "strcpy(c)", "strcpy", 3)]
    cpg = code_graph.from_rows(spark, vertices, [(7, 8, "AST", ""), (7, 8, "CFG", ""), (7, 8, "CONTAINS", ""), (8, 8, "AST", ""), (7, 99, "AST", "")])
    whole = crossmodal.merge(lexicon_graph, cpg)
    code = whole.edges_of().filter("extra.cpg_original_label is not null")
    part = crossmodal.as_merged(crossmodal.code_edges(lexicon_graph, cpg)).select(*code.columns)
    assert sorted(map(repr, part.collect())) == sorted(map(repr, code.collect())) and code.count() > 0
    base = lexicon_graph.nodes.filter("doc_id = 0").count()
    made = whole.node_table().filter("doc_id = '0_merged' and source like 'cpg:%'").orderBy("node_id").collect()
    assert [(r.node_id - base, r.text) for r in made] == [(0, "strcpy(a, b)"), (1, "int a"), (2, "strcpy(c)")]
    ids = [r.edge_id for r in whole.edge_table().filter("doc_id = '0_merged'").orderBy("edge_id").select("edge_id", "extra.cpg_original_label").collect()]
    assert ids == list(range(len(ids)))
    # no edge of the text is looked at for the code's
    assert "BELONGS_TO" not in plan(part)
