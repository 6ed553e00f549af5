"""The property graph: worked examples, invariants, and every query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph import lexicons as lex
from loomgraph.operators import crossmodal, export, graph, security
from loomgraph.operators.annotate import FixtureAnnotator, LexiconAnnotator, ModelAnnotator, RuleAnnotator, best_annotator
from loomgraph.plans import engine_queries, queries
from loomgraph.plans.pipeline import CrossModalPipeline, GraphPipeline, SecurityPipeline, parse_security_text
from loomgraph.schema import DEFAULT_SCHEMA, FULL_SCHEMA, SECURITY_SCHEMA
from loomgraph.sources import code_graph
from loomgraph.sources.text import from_files, from_strings

MEDICAL = """The patient John Smith was admitted to City Hospital on Monday.
He was prescribed aspirin for his chest pain.

However, his condition worsened after taking the medication.
The doctor immediately ordered additional tests.
Subsequently, the treatment plan was revised by Dr. Williams.

In conclusion, the patient responded well to the new treatment.
He was discharged on Friday."""
ADVISORY = """CVE-2024-1234: A buffer overflow vulnerability (CWE-120) has been discovered
in Apache HTTP Server version 2.4.51. The flaw exists in the mod_ssl module where
user-supplied input is copied to a fixed-size buffer using strcpy without bounds checking.
Remote attackers can exploit this to execute arbitrary code.
The vulnerability should be patched by upgrading to version 2.4.52.
Organizations running Apache httpd on production servers should apply the fix immediately."""


@pytest.fixture(scope="module")
def medical(spark):
    return GraphPipeline(LexiconAnnotator()).run(from_strings(spark, {"m": MEDICAL, "empty": "", "blank": " \n\n ", "one": "Only one."}))


def counts(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_invariants(medical):
    nodes, edges = medical.node_table().filter("doc_id = 'm'"), medical.edge_table().filter("doc_id = 'm'")
    n, e = counts(nodes, "node_type"), counts(edges, "edge_type")
    assert n["PARAGRAPH"] == 3 and n["DOCUMENT"] == 1
    assert e["NEXT_TOKEN"] == n["TOKEN"] - 1 and e["NEXT_SENT"] == n["SENTENCE"] - 1 and e["NEXT_PARA"] == 2
    assert e["SRL_ARG"] == 2 * n["ARGUMENT"] and e["DEP"] == n["TOKEN"] - n["SENTENCE"]
    assert e["CONTAINS"] == sum(n.values()) - 1 - n["ARGUMENT"] - n["MENTION"]
    cont = edges.filter("extra.relation = 'continuation'").count()
    assert e["RST_RELATION"] + cont == n["SENTENCE"] - 1
    assert {r.marker for r in edges.filter("edge_type = 'RST_RELATION'").select("extra.marker").collect()} == {"however", "subsequently", "in conclusion"}
    assert n["MENTION"] <= e["COREF"] and n["TOPIC"] <= 5
    ids = [r.node_id for r in nodes.orderBy("node_id").collect()]
    assert ids == list(range(len(ids)))
    assert edges.groupBy("src", "dst", "edge_type").count().filter("count > 1").count() == 0
    for r in nodes.filter("node_type = 'TOPIC'").collect():
        assert abs(r.importance * n["TOKEN"] - round(r.importance * n["TOKEN"])) < 1e-9


def test_empty_documents(medical):
    nodes = medical.node_table()
    assert counts(nodes.filter("doc_id = 'empty'"), "node_type") == {"DOCUMENT": 1, "PARAGRAPH": 1}
    assert "SENTENCE" not in counts(nodes.filter("doc_id = 'blank'"), "node_type")
    assert "valid" in graph.summary(medical, "one") or "V6" in graph.summary(medical, "one")


def test_security_example(spark):
    g = parse_security_text(spark, ADVISORY, "a")
    found = [(r.entity_type, r.domain_type, r.text, r.char_start, r.char_end, r.confidence) for r in g.node_table().filter("source = 'security_frontend'").orderBy("node_id").collect()]
    assert found == [
        ("CVE_ID", "vulnerability_id", "CVE-2024-1234", 0, 13, 1.0), ("CWE_ID", "weakness_class", "CWE-120", 48, 55, 1.0),
        ("VERSION", "software_version", "2.4.51", 107, 113, 0.8), ("VERSION", "software_version", "2.4.52", 371, 377, 0.8),
        ("SOFTWARE", "software_product", "Apache HTTP Server", 80, 98, 0.9), ("SOFTWARE", "software_product", "Apache", 80, 86, 0.9),
        ("SOFTWARE", "software_product", "Apache", 401, 407, 0.9), ("CODE_ELEMENT", "code_construct", "strcpy", 218, 224, 1.0),
        ("ATTACK_VECTOR", "user_input", "user-supplied input", 159, 178, 0.85), ("ATTACK_VECTOR", "remote", "Remote attacker", 250, 265, 0.85),
        ("ATTACK_VECTOR", "remote", "Remote", 250, 256, 0.85), ("VULN_TYPE", "buffer_overflow", "buffer overflow", 17, 32, 0.95),
        ("REMEDIATION", "upgrade", "upgrading to version 2.4.52.", 350, 378, 0.85), ("REMEDIATION", "update", "should be patched", 329, 346, 0.85),
    ]
    rel = counts(g.edge_table().filter("edge_type = 'ENTITY_REL'"), "entity_rel_type")
    assert {k: v for k, v in rel.items() if k.isupper()} == {"AFFECTS": 3, "CLASSIFIED_AS": 1, "HAS_VERSION": 6, "USES_FUNCTION": 1, "MITIGATED_BY": 2, "THREATENS": 6}


def test_extractor_rules(spark):
    docs = from_strings(spark, {"a": "high value, low below digital. foo() bar foo()x use-after-free", "b": "😀 LOW", "c": ""})
    assert sorted((r.text, r.char_start) for r in security.extracted(docs, "severity").collect()) == [("LOW", 2), ("high ", 0), ("low ", 12)]
    assert sorted(r.text for r in security.extracted(docs, "code_element").collect()) == ["foo()", "free"]
    assert [(r.text, r.char_start) for r in security.extracted(docs, "software").collect()] == [("git", 24)]
    assert [r.domain_type for r in security.extracted(docs, "impact").collect()] == ["uaf"]
    assert [r.domain_type for r in security.extracted(docs, "vulnerability").collect()] == ["use_after_free"]


@pytest.mark.parametrize("offset_mode", ["reference", "document"])
def test_sentence_links(spark, offset_mode):
    text = "First sentence here.\n\nSecond holds CVE-2024-0001 now."
    a = RuleAnnotator().annotate(from_strings(spark, {"d": text}))
    paras = a.paragraphs.withColumn("doc_offset", F.when(F.col("para_idx") == 0, 0).otherwise(22))
    got = security.sentence_links(security.extracted(a.docs, "cve").withColumn("ent_ord", F.lit(0)), a.sentences, paras, offset_mode).first()
    # place 35 of the document; the second paragraph has 31 characters of its own
    assert (got.sent_idx, got.linked) == ((1, True) if offset_mode == "document" else (0, False))


def test_patterns_know_unicode(spark):
    import re

    texts = ["high\u00a0risk", "upgrade\u2003to 2.0", "CVE-\u0662\u0660\u0662\u0664-\uff11234", "v\u0661.\u0662.3 x1.2 \u00e91.2", "LOW\u0085severity", "highé lowe low.", "mitigaté", "disabled\x1cfoo", "\u212aubernetes KUBERNETES"]
    docs = from_strings(spark, {str(i): t for i, t in enumerate(texts)})
    plain = {"severity": lex.SEVERITY, "cve": lex.CVE, "version": lex.VERSION}
    for name, pattern in plain.items():
        got = sorted((r.doc_id, r.text, r.char_start, r.char_end) for r in security.extracted(docs, name).collect())
        assert got == sorted((str(i), m[0], m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(pattern, t)), name
    got = sorted((r.doc_id, r.domain_type, r.text, r.char_start) for r in security.extracted(docs, "remediation").collect())
    assert got == sorted((str(i), d, m[0], m.start()) for i, t in enumerate(texts) for d, p in lex.REMEDIATIONS if (m := re.search(p, t)))
    assert sorted((r.text, r.char_start) for r in security.extracted(docs, "software").collect()) == [("KUBERNETES", 11), ("\u212aubernetes", 0)]


def test_edges_are_checked_and_may_be_duplicates(spark):
    nodes = spark.createDataFrame([(0, 0, "DOCUMENT"), (0, 1, "TOKEN")], "doc_id int, node_id bigint, node_type string")
    edges = spark.createDataFrame([], "doc_id int, src bigint, dst bigint, edge_type string").withColumn("seq", graph.seq(0))
    g = graph.PropertyGraph(nodes, graph.edge_rows(edges), nodes.select("doc_id").distinct())
    link = lambda dst, place: spark.createDataFrame([(0, 0, dst, "DEP", f"l{place}")], "doc_id int, src bigint, dst bigint, edge_type string, dep_label string").withColumn("seq", graph.seq(place))
    g = g.add_edges(link(1, 1)).add_edges(link(1, 2)).add_edges(link(1, 3), allow_duplicate=True).add_edges(link(0, 4))
    assert [(r.edge_id, r.dst, r.dep_label) for r in g.edge_table().orderBy("edge_id").collect()] == [(0, 1, "l1"), (1, 1, "l3"), (2, 0, "l4")]
    with pytest.raises(ValueError, match="unknown target"):
        g.add_edges(link(7, 5))


def test_a_model_by_its_adapter(spark, tmp_path, monkeypatch):
    """A stand-in for the model library, found by driver and workers alike."""
    (tmp_path / "spacy.py").write_text(
        "class T:\n"
        "    def __init__(s, i, text, idx):\n        s.i, s.text, s.idx, s.lemma_, s.pos_, s.dep_, s.ent_type_, s.ent_iob_, s.head = i, text, idx, text.lower(), 'NOUN', 'dep', '', 'O', s\n"
        "class S:\n"
        "    def __init__(s, text):\n        s.text, s.start_char, s.ents, s.noun_chunks, s.label_, s.start, s.end, s.end_char = text, 0, [], [], 'X', 0, 1, len(text.split()[0])\n        s.toks = [T(i, w, text.index(w)) for i, w in enumerate(text.split())]\n        s.ents = [type('E', (), dict(label_='ORG', text=text.split()[0], start=0, end=1, start_char=0, end_char=len(text.split()[0])))]\n"
        "    def __iter__(s):\n        return iter(s.toks)\n"
        "def load(name):\n    if name != 'tiny':\n        raise OSError(name)\n    return lambda text: type('D', (), dict(sents=[S(text)]))\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "spacy.py"))
    assert isinstance(best_annotator("none"), RuleAnnotator)
    a = best_annotator("tiny").annotate(from_strings(spark, {"d": "Acme sells\n\nfish"}))
    assert a.has_parser and a.model == "tiny"
    assert sorted((r.para_idx, r.sent_idx, r.i, r.text, r.char_start) for r in a.tokens.collect()) == [(0, 0, 0, "Acme", 0), (0, 0, 1, "sells", 5), (1, 1, 0, "fish", 0)]
    assert sorted((r.sent_idx, r.label, r.text) for r in a.spans.collect()) == [(0, "ORG", "Acme"), (1, "ORG", "fish")]


def cpg(spark):
    return code_graph.from_rows(spark, queries.CPG_VERTICES, queries.CPG_EDGES)


def test_cross_modal(spark):
    p = CrossModalPipeline(cpg(spark))
    g = p.run(from_strings(spark, {"a": ADVISORY}))
    rel = counts(g.edge_table(), "entity_rel_type")
    assert rel["MAPS_TO"] == 3 and "DESCRIBES" not in rel  # the pair is linked by USES_FUNCTION already
    code = g.node_table().filter("domain_type = 'code_construct'").first()
    assert (code.extra.cpg_node_id, code.extra.cpg_label, code.extra.cross_modal) == (4, "CALL", "REFERS_TO")
    m = p.merge_with_code(g)
    meta = m.meta.first()
    assert (meta.doc_id, meta.code_nodes, meta.source) == ("a_merged", 11, lex.MERGED_SOURCE)
    n = m.node_table()
    assert n.count() == g.node_table().count() + 11
    imported = [r.node_type for r in n.filter("source like 'cpg:%'").orderBy("node_id").collect()]
    assert imported[:4] == ["DOCUMENT", "ARGUMENT", "ARGUMENT", "PREDICATE"] and imported[-1] == "TOKEN"
    refs = m.edge_table().filter("entity_rel_type = 'CROSS_MODAL_REFERS_TO'").collect()
    assert len(refs) == 1 and graph.dangling(m.edge_table(), n).count() == 0
    without = CrossModalPipeline(None)
    g = without.run(from_strings(spark, {"a": ADVISORY}))
    assert without.merge_with_code(g) is g
    assert [r.extra.inferred_cwe for r in g.node_table().filter("extra.inferred_cwe is not null").collect()] == ["CWE-120"]


def test_vertex_zero_counts_as_none(spark):
    c = code_graph.from_rows(spark, [(0, "CALL", "strcpy(a)", "strcpy", 1)], [])
    g = CrossModalPipeline(c).run(from_strings(spark, {"a": ADVISORY}))
    assert g.edge_table().filter("entity_rel_type in ('DESCRIBES', 'MAPS_TO')").count() == 0


def test_graphson_source(spark, tmp_path):
    text = '{"vertices": [{"id": 0, "label": "CALL", "properties": {"CODE": [{"value": "f(x)"}], "NAME": "f", "LINE_NUMBER": 3}}, {"id": 1, "properties": {"CODE": [], "LINE_NUMBER": "x"}}], "edges": [{"outV": 0, "inV": 1, "label": "AST"}, {"outV": 0, "inV": 9}]}'
    (tmp_path / "g.json").write_text(text)
    for c in (code_graph.from_graphson(spark, str(tmp_path / "g.json")), code_graph.from_string(spark, text)):
        assert [tuple(r) for r in c.vertices.orderBy("ord").collect()] == [(0, 0, "CALL", "f(x)", "f", 3), (1, 1, None, "", "", 0)]
        assert [(r.src, r.dst, r.label) for r in c.edges.orderBy("ord").collect()] == [(0, 1, "AST"), (0, 9, None)]
    assert crossmodal.link_counts(c).count() == 2
    empty = code_graph.from_string(spark, "{}")
    assert empty.vertices.count() == 0 and empty.edges.count() == 0


def test_edges_keep_the_first_writer_and_known_ends(spark):
    nodes = spark.sql("SELECT 'd' doc_id, id node_id FROM range(3)")
    raw = spark.createDataFrame([("d", 0, 1, "DEP", 5, "b"), ("d", 0, 1, "DEP", 2, "a"), ("d", 1, 1, "DEP", 3, "c"), ("d", 0, 1, "COREF", 1, "x")], "doc_id string, src bigint, dst bigint, edge_type string, n int, dep_label string")
    edges = graph.edge_rows(raw.withColumn("seq", graph.seq(1, "n")))
    assert [(r.edge_id, r.dep_label) for r in graph.stored_edges(edges).orderBy("edge_id").collect()] == [(0, "x"), (1, "a"), (2, "c")]
    graph.checked_edges(edges, nodes)
    with pytest.raises(ValueError):
        graph.checked_edges(edges.withColumn("dst", F.lit(9).cast("long")), nodes)


def test_subgraph_with_repeated_and_unknown_ids(spark):
    nodes = spark.sql("SELECT 'd' doc_id, id node_id, 'TOKEN' node_type FROM range(4)")
    edges = spark.createDataFrame([("d", 0, 1, "DEP", 0), ("d", 1, 2, "DEP", 1)], "doc_id string, src bigint, dst bigint, edge_type string, edge_id bigint")
    wanted = spark.createDataFrame([("d", 1, 0), ("d", 0, 1), ("d", 1, 2), ("d", 77, 3)], "doc_id string, node_id bigint, ord int")
    n, e = graph.subgraph(nodes, edges, wanted)
    assert n.count() == 3 and [(r.src, r.dst, r.doc_id) for r in e.collect()] == [(1, 2, "d_sub")]


def test_walk_lists_simple_paths(spark):
    edges = spark.createDataFrame([("d", 0, 1, "A"), ("d", 1, 2, "A"), ("d", 2, 0, "A"), ("d", 0, 1, "B"), ("d", 2, 2, "A")], "doc_id string, src bigint, dst bigint, edge_type string")
    starts = spark.createDataFrame([("d", 0)], "doc_id string, node_id bigint")
    got = sorted(tuple(r.path) for r in graph.walk(edges, starts, ["A", "B"]).collect())
    assert got == [(0, 1), (0, 1), (0, 1, 2), (0, 1, 2)]
    assert sorted(tuple(r.path) for r in graph.walk(edges, starts, ["A"], "in", 1).collect()) == [(0, 2)]


def test_exports(spark, tmp_path):
    import json

    g = SecurityPipeline().run(from_strings(spark, {"a": ADVISORY, "b": "Größe 漢字. So it goes."}))
    docs = {r.doc_id: json.loads(r.graphson) for r in export.graphson(g).collect()}
    a = docs["a"]
    assert a["stats"]["total_nodes"] == len(a["vertices"]) == g.node_table().filter("doc_id = 'a'").count()
    assert len(a["metadata"]["source_text"]) == 200 and a["schema"]["num_node_types"] == 13
    cve = next(v for v in a["vertices"] if v["properties"].get("ENTITY_TYPE") == "CVE_ID")
    assert "CONFIDENCE" not in cve["properties"] and cve["properties"]["SENT_IDX"] == 0 and "LEMMA" not in cve["properties"]
    assert a["edges"][0]["id"] == "e0" and docs["b"]["metadata"]["source_text"].startswith("Größe 漢字")
    export.write_graphson(g, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2
    y = spark.createDataFrame([("a", 1)], "doc_id string, y int")
    t = {r.doc_id: r for r in export.tensors(g, y, 2).collect()}["a"]
    assert t.num_nodes == len(t.x) == len(t.node_pos) and len(t.x[0]) == 15 and t.x[0][0] == 1.0 and t.y == 1
    assert len(t.edge_index[0]) == t.num_edges == len(t.edge_type) and sum(t.edge_attr[0]) == 1.0


def test_schemas(spark):
    assert (DEFAULT_SCHEMA.total_node_labels, SECURITY_SCHEMA.total_node_labels, FULL_SCHEMA.total_node_labels) == (13, 25, 28)
    assert (DEFAULT_SCHEMA.total_edge_labels, SECURITY_SCHEMA.total_edge_labels, FULL_SCHEMA.total_edge_labels) == (13, 23, 28)
    assert DEFAULT_SCHEMA.node_type_index("TOPIC") == 12 and "28 node labels" in FULL_SCHEMA.describe()
    with pytest.raises(KeyError):
        DEFAULT_SCHEMA.edge_type_index("NONE")
    assert len(lex.SOFTWARE) == 40 and len(lex.DISCOURSE_MARKERS) == 62 and len(lex.STOPWORDS) == 70 and len(lex.COMMON_VERBS) == 88


def test_custom_annotators(spark):
    docs = from_strings(spark, {"a": "x y.\n\nz."})
    a = RuleAnnotator().annotate(docs)
    same = FixtureAnnotator(a.sentences, a.tokens, a.spans, False).annotate(docs)
    assert same.tokens.count() == a.tokens.count()

    def load():
        def parse(text):
            return [{"sent": 0, "text": text, "char_start": 0, "char_end": len(text)}], [{"sent": 0, "token_idx": 0, "i": 0, "text": text, "lemma": text, "pos": "X", "dep": "ROOT", "head_i": 0, "ent_type": "", "ent_iob": "O", "char_start": 0, "char_end": len(text)}], []

        return parse

    m = ModelAnnotator(load).annotate(docs)
    assert [(r.sent_idx, r.text) for r in m.sentences.orderBy("sent_idx").collect()] == [(0, "x y."), (1, "z.")]
    assert GraphPipeline(ModelAnnotator(load)).run(docs).node_table().filter("node_type = 'TOKEN'").count() == 2


def test_results_do_not_depend_on_partitions(spark):
    docs = from_strings(spark, {"m": MEDICAL, "a": ADVISORY})
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        g = SecurityPipeline(LexiconAnnotator()).run(docs)
        seen.append((sorted(map(str, g.node_table().collect())), sorted(map(str, g.edge_table().collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_files_and_stream(spark, tmp_path):
    from loomgraph.streaming.incremental import write_graphs

    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.txt").write_text("One. Two.")
    (tmp_path / "in/b.txt").write_text("Three words here.")
    assert from_files(spark, str(tmp_path / "in")).count() == 2
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).load(str(tmp_path / "in"))
    stream = stream.select(F.col("value").alias("doc_id"), F.col("value").alias("text"))
    write_graphs(stream, GraphPipeline(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    nodes = spark.read.parquet(f"{tmp_path}/out/nodes")
    assert nodes.filter("node_type = 'DOCUMENT'").count() == 2 and nodes.filter("node_type = 'SENTENCE'").count() == 3


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def shown(row):
    return tuple(round(x, 9) if isinstance(x, float) else (int(x) if isinstance(x, int) and not isinstance(x, bool) else x) for x in row)


#: of the queries over whole graphs one of each kind; the others take the same paths
WHOLE = ["lexicon_graph_nodes", "srl_arg_edges", "mention_edges", "topic_edges", "pipeline_security_edges", "merge_edges", "graphson_documents"]


@pytest.mark.parametrize("name", [*sorted(set(queries.SQL) - set(engine_queries.NAMES)), *WHOLE])
def test_against_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(queries.SQL[name])
    assert columns == sorted(want.columns)
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    as_text = lambda rs: sorted(str([str(v) if hasattr(v, "as_tuple") else v for v in shown(r)]) for r in rs)
    import decimal

    rows = [tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in rows]
    assert as_text(map(tuple, got.select(*columns).collect())) == as_text(rows)
