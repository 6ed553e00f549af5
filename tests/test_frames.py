"""Nodes of framed annotations: cut and numbered within a document's row."""

import re
import unicodedata
from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.operators import frontend, passes
from loomgraph.operators.annotate import LexiconAnnotator, RuleAnnotator, documents
from loomgraph.operators.frames import word_counts

TEXTS = [
    "Ünïted Ärzte said “that” İstanbul ΟΔΟΣ Ⅷ went; a’b-c quickly walking    red. And?! \n \n Two\x1c three.\n \n", None, " \n ", "...", "",
    "The Old Fox saw that Mary Smith quickly made a very large attack. She was hurt badly.\n\nThe buffer allows it. 12 ½ 一二 𐐀bc", "word " * 3000 + ". He said that she opened it",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_those_of_the_tables_without_a_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for annotator in (RuleAnnotator(), LexiconAnnotator()):
        a = annotator.annotate(docs).kept()
        made = frontend.initial_nodes(a)
        # the rows were sorted by a window over each document
        assert "Window" not in plan(made) and "Exchange" not in plan(made)
        by_table = frontend.initial_nodes(replace(a, frames=None, nested=None))
        assert sorted(map(repr, made.collect())) == sorted(map(repr, by_table.select(*made.columns).collect()))


def test_pythons_classes_are_those_of_the_patterns():
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)[0]
        assert bool(re.match(r"\w", c)) == (kind in "LN" or c == "_")
        assert bool(re.match(r"\s", c)) == c.isspace() == (kind == "Z" or c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85")


def test_edges_are_those_of_the_tables_without_a_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for annotator in (RuleAnnotator(), LexiconAnnotator()):
        a = annotator.annotate(docs).kept()
        made = frontend.initial_edges(a)
        # ends were found by windows over all nodes and joins with the tokens
        assert not any(x in plan(made) for x in ("Window", "Exchange", "Join"))
        tables = replace(a, frames=None, nested=None)
        by_table = frontend.initial_edges(tables, frontend.initial_nodes(tables))
        assert sorted(map(repr, made.collect())) == sorted(map(repr, by_table.select(*made.columns).collect()))


def test_words_counted_in_the_row_give_the_topics_of_the_tokens(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, "red red ΟΔΟΣ said"), (5, "bc")], "doc_id int, text string")
    tokens = passes.top_topics(RuleAnnotator().annotate(docs).tokens.withColumn("place", F.col("i")))
    counted = word_counts(documents(docs)).withColumn("lemma", F.lower("text"))
    assert counted.filter("doc_id = 6 and text = 'word'").first().times == 3000  # was a row a token
    found = passes.top_topics(counted)
    order = lambda df: sorted((r.doc_id, r.rank, r.freq, r.importance) for r in df.collect())
    assert found.columns == tokens.columns and order(found) == order(tokens) and found.count() > 5
    told = lambda df: {(r.doc_id, r.word, r.freq) for r in df.filter("doc_id <> 5").collect()}  # noqa: E731  5 has ties at the last rank
    assert told(found) == told(tokens)
    assert plan(found).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
