"""Enrichment passes: coreference, discourse, entity relations, topics.

A pass is any object with ``name`` and ``run(graph) -> graph``. All joins and windows are
within a document; pairs arise within a sentence only.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import lexicons as lex
from loomgraph.functions.arrays import cells, nearest
from loomgraph.functions.phrases import occurrences
from loomgraph.functions.storage import shuffled, stored
from loomgraph.functions.text import let, or_else, strip
from loomgraph.operators.graph import PropertyGraph, seq
from loomgraph.operators.security import longest_first
from loomgraph.schema import EDGE_EXTRA, extra

CHAIN_STAGE, MENTION_STAGE, DISCOURSE_STAGE, RELATION_STAGE, TOPIC_STAGE = 5, 6, 7, 8, 9
TOP = 5


class Pass(Protocol):
    name: str

    def run(self, graph: PropertyGraph) -> PropertyGraph: ...


# ---- coreference


def entity_clusters(nodes: DataFrame) -> DataFrame:
    """Entities with ``key`` and ``cluster``, the rank of the key's first occurrence."""
    ents = nodes.filter("node_type = 'ENTITY'").withColumn("key", strip(F.lower("text")))
    first = F.min(F.struct("sent_idx", "char_start", "node_id")).over(Window.partitionBy("doc_id", "key"))
    return ents.withColumn("first", first).withColumn("cluster", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")) - 1).cast("int")).drop("first")


def entity_chain(clusters: DataFrame) -> DataFrame:
    """(doc_id, src, dst, cluster): each occurrence linked from the one before."""
    w = Window.partitionBy("doc_id", "key").orderBy("sent_idx", "char_start", "node_id")
    return clusters.select("doc_id", F.lag("node_id").over(w).alias("src"), F.col("node_id").alias("dst"), "cluster").filter("src is not null")


def first_sightings(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, entity_type, sent_idx, token_idx): where each entity is first met.

    A token that begins an entity meets the lowest-id entity of its sentence that covers it.
    """
    begin = nodes.filter("node_type = 'TOKEN' and entity_type <> '' and entity_iob = 'B'").select("doc_id", "sent_idx", "token_idx", F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    ents = nodes.filter("node_type = 'ENTITY'").select("doc_id", "sent_idx", "node_id", "char_start", "char_end", F.col("entity_type").alias("type"))
    covered = begin.join(shuffled(ents), ["doc_id", "sent_idx"]).filter("char_start <= a and b <= char_end")
    met = covered.groupBy("doc_id", "sent_idx", "token_idx").agg(F.min_by(F.struct("node_id", "type"), "node_id").alias("e"))
    return met.groupBy("doc_id", F.col("e.node_id").alias("node_id"), F.col("e.type").alias("entity_type")).agg(F.min(F.struct("sent_idx", "token_idx")).alias("at")).select("doc_id", "node_id", "entity_type", "at.*")


def antecedents(nodes: DataFrame) -> DataFrame:
    """(doc_id, token_node, text, sent_idx, token_idx, antecedent) of pronouns with one: an as-of join by window."""
    low = F.lower("text")
    words = lex.PRONOUNS
    group = (
        F.when(low.isin(words["male"] + words["female"]), "person").when(low.isin(words["neutral"]), "thing")
        .when(low.isin(words["plural"]), "group").when(low.isin(words["demonstrative"] + words["relative"]), "any")
    )
    pronouns = nodes.filter("node_type = 'TOKEN'").withColumn("want", group).filter("want is not null").select(
        "doc_id", "sent_idx", "token_idx", F.col("node_id").alias("token_node"), "text", "want", "para_idx", F.lit(None).cast("long").alias("ent"), F.lit(None).cast("string").alias("type"), F.lit(1).alias("late")
    )
    none = F.lit(None)
    events = first_sightings(nodes).select(
        "doc_id", "sent_idx", "token_idx", none.cast("long").alias("token_node"), none.cast("string").alias("text"), none.cast("string").alias("want"), none.cast("int").alias("para_idx"), F.col("node_id").alias("ent"), F.col("entity_type").alias("type"), F.lit(0).alias("late")
    )
    w = Window.partitionBy("doc_id").orderBy("sent_idx", "token_idx", "late").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when: F.last(F.when(when & F.col("ent").isNotNull(), F.col("ent")), True).over(w)
    both = pronouns.unionByName(events).withColumns({
        "person": last(F.col("type").isin(lex.PERSON_TYPES)), "thing": last(~F.col("type").isin(lex.PERSON_TYPES)),
        "group": last(F.col("type").isin(lex.GROUP_TYPES)), "any": last(F.lit(True)),
    })
    wanted = F.when(F.col("want") == "person", F.col("person")).when(F.col("want") == "thing", F.col("thing")).when(F.col("want") == "group", F.col("group"))
    return both.filter("late = 1").withColumn("antecedent", F.coalesce(wanted, F.col("any"))).filter("antecedent is not null").select("doc_id", "token_node", "text", "sent_idx", "token_idx", "antecedent")


class CoreferencePass:
    name = "coreference_pass"

    def run(self, graph: PropertyGraph) -> PropertyGraph:
        clusters = entity_clusters(graph.nodes)
        chain = entity_chain(clusters).select("doc_id", "src", "dst", F.lit("COREF").alias("edge_type"), F.col("cluster").alias("coref_cluster"), seq(CHAIN_STAGE, "cluster", "dst").alias("seq"))
        found = antecedents(graph.nodes).join(shuffled(clusters.select("doc_id", F.col("node_id").alias("antecedent"), "cluster")), ["doc_id", "antecedent"])
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "token_idx")))
        found = stored(found, "mentions")
        placed = found.join(shuffled(graph.bases()), "doc_id").withColumn("mention", F.col("base") + F.col("place") - 1)
        mentions = found.select("doc_id", "place", F.lit("MENTION").alias("node_type"), "text", "sent_idx", "token_idx", F.lit(self.name).alias("source"))
        belongs = placed.select("doc_id", F.col("mention").alias("src"), F.col("token_node").alias("dst"), F.lit("BELONGS_TO").alias("edge_type"), seq(MENTION_STAGE, "place", 0).alias("seq"))
        refers = placed.select("doc_id", F.col("mention").alias("src"), F.col("antecedent").alias("dst"), F.lit("COREF").alias("edge_type"), F.col("cluster").alias("coref_cluster"), seq(MENTION_STAGE, "place", 1).alias("seq"))
        return graph.with_edges(chain).with_nodes(mentions, place=F.col("place") - 1).with_edges(belongs).with_edges(refers).marked(self.name)


# ---- discourse


def first_marker(text: Column) -> Column:
    """(k, label) of the first marker, longest first, that the lower-cased text starts with or holds after a comma; else null."""
    listed = longest_first(lex.DISCOURSE_MARKERS)
    order = F.create_map(*[F.lit(x) for i, m in enumerate(listed) for x in (m, i)])
    labels = F.create_map(*[F.lit(x) for m in listed for x in (m, lex.DISCOURSE_MARKERS[m])])

    def hits(low: Column) -> Column:
        after_comma = lambda x: (F.substring(low, x["start"] - 1, 2) == ", ") & F.substring(low, x["start"] + F.length(x["phrase"]) + 1, 1).isin(" ", ",")
        found = F.filter(occurrences(low, listed), lambda x: (x["start"] == 0) | ((x["start"] > 1) & after_comma(x)))
        return F.array_min(F.transform(found, lambda x: F.struct(F.try_element_at(order, x["phrase"]).alias("n"), x["phrase"].alias("k"))))

    return let(F.lower(text), lambda low: let(hits(low), lambda m: F.when(m.isNotNull(), F.struct(m["k"].alias("k"), F.try_element_at(labels, m["k"]).alias("label")))))


def discourse_links(sentences: DataFrame) -> DataFrame:
    """(doc_id, src, dst, sent_idx, marker, label) of neighbouring sentences (node_id, sent_idx, text); label null: continuation."""
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    linked = sentences.select("doc_id", "sent_idx", F.lag("node_id").over(w).alias("src"), F.col("node_id").alias("dst"), "text").filter("src is not null")
    return linked.withColumn("m", first_marker(F.col("text"))).select("doc_id", "src", "dst", "sent_idx", F.col("m.k").alias("marker"), F.col("m.label").alias("label"))


class DiscoursePass:
    name = "discourse_pass"

    def run(self, graph: PropertyGraph) -> PropertyGraph:
        links = discourse_links(graph.nodes.filter("node_type = 'SENTENCE'"))
        known = F.col("label").isNotNull()
        return graph.with_edges(links.select(
            "doc_id", "src", "dst", F.when(known, "RST_RELATION").otherwise("DISCOURSE").alias("edge_type"), F.coalesce("label", F.lit("")).alias("rst_label"),
            extra(EDGE_EXTRA, marker=F.col("marker"), relation=F.when(~known, "continuation")).alias("extra"), seq(DISCOURSE_STAGE, "sent_idx").alias("seq"),
        )).marked(self.name)


# ---- relations between entities


def entity_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, src, dst, mid): pairs of entities of one sentence, in id order; mid is the mean of their starts."""
    e = nodes.filter("node_type = 'ENTITY'").select("doc_id", "sent_idx", F.col("node_id").alias("src"), F.col("char_start").alias("a"))
    f = e.withColumnsRenamed({"src": "dst", "a": "b"})
    return e.join(shuffled(f), ["doc_id", "sent_idx"]).filter("src < dst").select("doc_id", "sent_idx", "src", "dst", ((F.col("a") + F.col("b")) / 2).alias("mid"))


def nearest_predicates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with ``label``: the predicate of the sentence whose token_idx is nearest to mid, ties to the lower id."""
    preds = nodes.filter("node_type = 'PREDICATE'").select("doc_id", "sent_idx", F.col("node_id").alias("p"), "token_idx", or_else(F.col("lemma"), F.col("text")).alias("word"))
    # of several at one place the lowest id is nearest; the places of a sentence are cut into cells once
    places = preds.groupBy("doc_id", "sent_idx", "token_idx").agg(F.min(F.struct("p", "word")).alias("item"))
    points = F.sort_array(F.collect_list(F.struct(F.col("token_idx").alias("at"), "item")))
    listed = places.groupBy("doc_id", "sent_idx").agg(points.alias("points")).select("doc_id", "sent_idx", cells(F.col("points")).alias("cells"))
    joined = pairs.join(shuffled(listed), ["doc_id", "sent_idx"], "left")
    return joined.withColumn("label", F.coalesce(nearest(F.col("cells"), F.col("mid"))["word"], F.lit("co-occurs"))).drop("cells")


class EntityRelationPass:
    name = "entity_relation_pass"

    def run(self, graph: PropertyGraph) -> PropertyGraph:
        found = nearest_predicates(entity_pairs(graph.nodes), graph.nodes)
        return graph.with_edges(found.select("doc_id", "src", "dst", F.lit("ENTITY_REL").alias("edge_type"), F.col("label").alias("entity_rel_type"), seq(RELATION_STAGE, "sent_idx", "src", "dst").alias("seq"))).marked(self.name)


# ---- topics


def with_word(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("word", F.lower(or_else(F.col("lemma"), F.col("text"))))


def is_keyword() -> Column:
    return ~F.col("word").isin(lex.STOPWORDS) & (F.length("word") > 2)


def top_topics(tokens: DataFrame, k: int = TOP) -> DataFrame:
    """(doc_id, word, freq, rank, importance): the k most frequent words; ties by first appearance.

    ``tokens`` has doc_id, place (order in the document), text and lemma; or it has words counted before, each with
    the ``times`` that it stands for. Importance divides by all tokens of the document: stop words are counted with the others, in one pass.
    """
    worded, times = with_word(tokens), F.count(F.lit(1))
    if "times" in tokens.columns:
        worded, times = worded.repartition("doc_id"), F.sum("times")
    counted = worded.groupBy("doc_id", "word").agg(times.alias("freq"), F.min("place").alias("first"))
    counted = counted.withColumn("n_tokens", F.sum("freq").over(Window.partitionBy("doc_id"))).filter(is_keyword())
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("freq"), "first"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.select("doc_id", "word", "freq", "rank", (F.col("freq").cast("double") / F.col("n_tokens")).alias("importance"))


def topic_sentences(tokens: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc_id, word, rank, sent_idx): each sentence that has a topic's word."""
    where = with_word(tokens).filter(is_keyword()).select("doc_id", "word", "sent_idx").distinct()
    return where.join(shuffled(topics.select("doc_id", "word", "rank")), ["doc_id", "word"])


class TopicPass:
    name = "topic_pass"

    def run(self, graph: PropertyGraph) -> PropertyGraph:
        tokens = graph.nodes.filter("node_type = 'TOKEN'").withColumn("place", F.col("node_id"))
        topics = stored(top_topics(tokens), "topics")
        placed = topics.join(shuffled(graph.bases()), "doc_id").withColumn("topic", F.col("base") + F.col("rank") - 1)
        if graph.known_ends() is None:
            placed = placed.join(shuffled(graph.nodes.groupBy("doc_id").agg(F.min("node_id").alias("root"))), "doc_id")
        else:  # of a graph that is numbered from its document on
            placed = placed.withColumn("root", F.lit(0).cast("long"))
        new = topics.select("doc_id", "rank", F.lit("TOPIC").alias("node_type"), F.col("word").alias("text"), "importance", F.lit(self.name).alias("source"))
        sents = graph.nodes.filter("node_type = 'SENTENCE'").select("doc_id", "sent_idx", F.col("node_id").alias("dst"))
        holds = placed.select("doc_id", F.col("root").alias("src"), F.col("topic").alias("dst"), F.lit("CONTAINS").alias("edge_type"), seq(TOPIC_STAGE, "rank", -1).alias("seq"))
        about = topic_sentences(tokens, topics).join(shuffled(placed.select("doc_id", "word", F.col("topic").alias("src"))), ["doc_id", "word"]).join(shuffled(sents), ["doc_id", "sent_idx"])
        about = about.select("doc_id", "src", "dst", F.lit("DISCOURSE").alias("edge_type"), extra(EDGE_EXTRA, topic_relevance=F.lit(True)).alias("extra"), seq(TOPIC_STAGE, "rank", "sent_idx").alias("seq"))
        return graph.with_nodes(new, place=F.col("rank") - 1).with_edges(holds).with_edges(about).marked(self.name)


def default_passes() -> list[Pass]:
    return [CoreferencePass(), DiscoursePass(), EntityRelationPass(), TopicPass()]
