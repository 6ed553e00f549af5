"""GraphSON files read by splits, against a whole reading."""

import json

import pytest

from loomgraph.operators.annotate import RuleAnnotator
from loomgraph.operators.export import write_graphson
from loomgraph.plans.pipeline import GraphPipeline
from loomgraph.sources import code_graph, graphson
from loomgraph.sources.text import from_strings

ODD = ["", "plain", 'a "quoted" {[', "ends with \\", "\\\\\\", '\\"', "]}, {\"id\": 1, \"label\": \"x\"}", "äöü 漢字 😀", "a\nb\tc", '": [']


def document(n: int, key: str = "vertices") -> dict:
    vertices = [{"id": i, "label": ODD[i % len(ODD)] or "L", "properties": {"CODE": ODD[(i * 3 + 1) % len(ODD)], "NAME": [{"id": 5, "value": ODD[(i * 7 + 2) % len(ODD)]}], "LINE_NUMBER": i}} for i in range(n)]
    edges = [{"id": f"e{i}", "outV": i, "inV": (i * 7) % max(n, 1), "label": "AST", "properties": {"VARIABLE": [{"value": ODD[i % len(ODD)]}]}} for i in range(n)]
    return {"directed": True, "metadata": {"of": {"x": ["{", {"y": [1]}]}, "passes": ["a", "b"]}, key: vertices, "empty": [], "edges": edges}


def cut(data: bytes, size: int, chunk: int) -> list[tuple]:
    """What all splits of ``size`` bytes find, with the states that they tell each other."""
    read = lambda a, b: data[a:b]
    before, graphson.CHUNK_BYTES = graphson.CHUNK_BYTES, chunk
    try:
        inside, depth, key, out = False, 0, None, []
        for start in range(0, len(data), size):
            end = min(start + size, len(data))
            for _, name, element in graphson.elements(read, start, end, len(data), inside, depth):
                if element is None:
                    key = name
                elif key:
                    out.append((key, json.loads(element)))
            quotes, outside, within = graphson.effect(read, start, end, len(data))
            depth += within if inside else outside
            inside ^= quotes % 2 == 1
        assert not inside and depth == 0
        return out
    finally:
        graphson.CHUNK_BYTES = before


@pytest.mark.parametrize("indent", [None, 2])
def test_splits_anywhere_find_each_element_once(indent):
    docs = [document(4), document(0), document(3)]
    data = "\n".join(json.dumps(d, indent=indent, ensure_ascii=False) for d in docs).encode()
    want = [(k, x) for d in docs for k in ("vertices", "edges") for x in d[k]]
    for size in (1, 2, 7, 31, 100, 333, 1000, len(data)):
        assert cut(data, size, 1 << 20) == want, size
    for chunk in (1, 2, 3, 7, 50):
        assert cut(data, 64, chunk) == want, chunk


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    d = document(100)
    (tmp_path / "graph.json").write_text(json.dumps(d, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "none.json").write_text("")
    found = graphson.read_elements(spark, f"file://{tmp_path}", 1997)
    rows = sorted((r.key, r.ord, r.element) for r in found.collect())
    assert [(k, o, json.loads(e)) for k, o, e in rows] == [(k, i, x) for k in ("edges", "vertices") for i, x in enumerate(d[k])]
    whole = code_graph.from_string(spark, json.dumps(d))
    parts = code_graph.from_graphson(spark, f"file://{tmp_path}", 1997)
    for a, b in ((whole.vertices, parts.vertices), (whole.edges, parts.edges)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    # a file's splits lie in tasks of their own
    assert graphson.dealt(spark.range(40)).rdd.getNumPartitions() == 40


def test_files_without_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"directed": true}')
    g = code_graph.from_graphson(spark, str(tmp_path))
    assert g.vertices.count() == g.edges.count() == 0


def test_exported_documents_are_read_back(spark, tmp_path):
    texts = {"a": 'He said "no". Then {left} [it].\n\nEnd \\ here.', "b": "", "ü": "漢字 and 😀."}
    g = GraphPipeline(RuleAnnotator()).run(from_strings(spark, texts))
    write_graphson(g, f"file://{tmp_path}/pretty", pretty=True)
    files = {f.parent.name.split("=")[1]: json.loads(f.read_text(encoding="utf-8")) for f in (tmp_path / "pretty").glob("*/*.txt")}
    assert {d["doc_id"] for d in files.values()} == set(texts) and len(files) == 3
    assert all("\n" in f.read_text(encoding="utf-8").strip() for f in (tmp_path / "pretty").glob("*/*.txt"))
    a = next(d for d in files.values() if d["doc_id"] == "a")
    assert a["metadata"] == {"source_text": texts["a"], "spacy_model": "rules", "has_parser": False, "passes_applied": ["spacy_frontend", "coreference_pass", "discourse_pass", "entity_relation_pass", "topic_pass"]}
    types = [v["label"] for v in a["vertices"]]
    assert a["stats"]["total_nodes"] == len(types) and a["stats"]["node_types"] == {t: types.count(t) for t in set(types)}
    kinds = [e["label"] for e in a["edges"]]
    assert a["stats"]["total_edges"] == len(kinds) and a["stats"]["edge_types"] == {t: kinds.count(t) for t in set(kinds)}
    assert a["schema"]["num_node_types"] == len(a["schema"]["node_types"]) == 13
    # documents of many lines, and of one line each in files of several, hold the same vertices and edges
    write_graphson(g, f"file://{tmp_path}/lines")
    want = sorted((k, i, json.dumps(x)) for d in files.values() for k in ("vertices", "edges") for i, x in enumerate(d[k]))
    for folder in ("pretty/*", "lines"):
        found = graphson.read_elements(spark, f"file://{tmp_path}/{folder}", 2000).collect()
        assert sorted((r.key, r.ord, json.dumps(json.loads(r.element))) for r in found) == want
