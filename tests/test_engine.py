"""Building blocks against plain Python: folds, ranges, trees, phrases, containment, first edges."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import lexicons as lex
from loomgraph.functions import arrays, phrases, ranges
from loomgraph.operators import annotate, graph, passes, security, trees
from loomgraph.operators.containment import containing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_ranges(spark):
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_one_large_group_is_numbered_over_all_ranges(spark, many_ranges):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, null, if(id % 3 = 0, id % 7, 1)) AS doc_id", "pmod(xxhash64(id), 1000000) AS k", "id")
    ranged = ranges.in_ranges(rows, ["doc_id", "k", "id"])
    sizes = sorted(r["count"] for r in ranged.groupBy(ranges.PART).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    out = ranges.numbered(rows, ["doc_id"], ["k", "id"], "n")
    assert "row_number" not in plan(out)
    groups = {}
    for r in sorted(out.collect(), key=lambda r: (r["k"], r["id"])):
        assert r["n"] == groups.get(r["doc_id"], 0)
        groups[r["doc_id"]] = r["n"] + 1
    assert sum(groups.values()) == 20_000


def test_numbers_of_an_empty_table(spark):
    assert ranges.numbered(spark.range(0).selectExpr("id AS doc_id", "id"), ["doc_id"], ["id"], "n").collect() == []


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1500])
def test_running_sums_over_blocks(spark, size):
    xs = [random.Random(size).randint(0, 9) for _ in range(size)]
    row = spark.createDataFrame([(xs,)], "xs array<int>").select(arrays.before(F.col("xs")).alias("b")).first()
    assert row["b"] == list(itertools.accumulate(xs, initial=0))[:-1]


def test_nearest_cell_with_ties(spark):
    rng, rows = random.Random(2), []
    for _ in range(300):
        places = rng.sample(range(30), rng.randint(0, 9))
        points = [(at, rng.randint(0, 5) * 100 + k) for k, at in enumerate(places)]
        rows.append((sorted(points), rng.randint(-4, 70) / 2))
    df = spark.createDataFrame(rows, "points array<struct<at: int, item: int>>, mid double")
    got = df.select(arrays.nearest(arrays.cells(F.col("points")), F.col("mid")).alias("x")).collect()
    for r, (points, mid) in zip(got, rows):
        assert r["x"] == min(((abs(at - mid), item) for at, item in points), default=(0, None))[1]


def test_tokens_and_sentences_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "One two. Three  four!\n\n  Five (six) 2.4.51. "), (2, None), (3, " \n "), (4, "word " * 3000)], "doc_id int, text string")
    a = annotate.RuleAnnotator().annotate(docs)
    for table in (a.tokens, a.sentences, a.paragraphs, annotate.LexiconAnnotator().annotate(docs).tokens):
        assert "Exchange" not in plan(table) and "Window" not in plan(table)
    tokens = a.tokens.orderBy("doc_id", "para_idx", "i").collect()
    texts = {r["doc_id"]: re.split(r"\n\s*\n", r["text"] or "") for r in docs.collect()}
    for t in tokens:
        paragraph = texts[t["doc_id"]][t["para_idx"]].strip()
        assert paragraph[t["char_start"] : t["char_end"]] == t["text"]
    assert [(t["sent_idx"], t["token_idx"], t["text"]) for t in tokens if t["doc_id"] == 1 and t["token_idx"] == 1] == [(0, 1, "two"), (1, 1, "four"), (2, 1, "(")]
    assert [t["i"] for t in tokens if t["doc_id"] == 4] == list(range(3000))
    assert not [t for t in tokens if t["doc_id"] in (2, 3)]


def test_tokens_keep_control_characters(spark):
    text = "a \x01\x02 b\x03c"
    tokens = annotate.RuleAnnotator().annotate(spark.createDataFrame([(1, text)], "doc_id int, text string")).tokens.orderBy("i").collect()
    assert [(t["text"], t["char_start"]) for t in tokens] == [("a", 0), ("\x01", 2), ("\x02", 3), ("b", 5), ("\x03", 6), ("c", 7)]


def below(parent, head):
    out = [head]
    for x in out:
        out += [i for i, p in enumerate(parent) if p == x and i != x]
    return sorted(out)


def test_subtrees_are_ranges():
    rng, forests = random.Random(4), []
    for _ in range(60):
        n = rng.randint(0, 25)
        order = rng.sample(range(n), n)
        parent = [0] * n
        for k, i in enumerate(order):
            parent[i] = order[rng.randrange(k)] if k and rng.random() < 0.9 else rng.choice([i, -1])
        forests.append(parent)
    row = np.repeat(np.arange(len(forests)), [len(p) for p in forests])
    start = np.cumsum([0, *map(len, forests)])
    flat = np.array([x + start[f] if x >= 0 else -1 for f, p in enumerate(forests) for x in p], np.int64)
    pre, size = trees.preorder(row, flat)
    for f, parent in enumerate(forests):
        mine, sizes = pre[start[f] : start[f + 1]], size[start[f] : start[f + 1]]
        assert sorted(mine) == list(range(len(parent)))
        for i in range(len(parent)):
            assert [j for j in range(len(parent)) if mine[i] <= mine[j] < mine[i] + sizes[i]] == below(parent, i)


def test_what_hangs_on_a_cycle_stands_for_itself():
    pre, size = trees.preorder(np.zeros(5, int), np.array([0, 2, 1, 0, 2]))
    assert sorted(pre) == [0, 1, 2, 3, 4] and size.tolist() == [2, 1, 1, 1, 1] and pre[3] == 1


def test_clauses_from_tables_and_from_rows_are_the_same(spark):
    docs = spark.createDataFrame([(1, "He said that she opened it quickly and closed the old door. They walked."), (2, "Nothing here")], "doc_id int, text string")
    a = annotate.LexiconAnnotator().annotate(docs)
    from dataclasses import replace

    by_row, by_table = (sorted(tuple(r) for r in trees.subtrees(x, lex.CLAUSE_DEPS).collect()) for x in (a, replace(a, nested=None)))
    assert by_row == by_table and by_row


def test_all_phrases_in_one_pass(spark):
    rng = random.Random(6)
    names = ["a", "ab", "aba", "abab", "b c", "c.d", "dd", "d-e", "cab"]
    texts = ["".join(rng.choice("abcd. -e\x01\x02") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "abababab", "ddddd"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = phrases.occurrences(F.col("text"), names)
    got = df.select(found.alias("all"), phrases.apart(found, names).alias("apart"), phrases.firsts(found).alias("firsts")).collect()
    for text, r in zip(texts, got):
        every = {(p, i) for p in names for i in range(len(text)) if text.startswith(p, i)}
        assert {tuple(x) for x in r["all"]} == every and len(r["all"]) == len(every)
        assert {tuple(x) for x in r["firsts"]} == {(p, text.find(p)) for p in names if p in text}
        searched = set()
        for p in names:
            at = text.find(p)
            while at >= 0:
                searched.add((p, at))
                at = text.find(p, at + len(p))
        assert {tuple(x) for x in r["apart"]} == searched


def test_entities_stand_where_the_lower_cased_text_has_them(spark):
    """A letter whose lower case is longer moves the places of phrases behind it, and the text is cut there."""
    text = "İ Apache HTTP Server strutstruts: remote attackers, Remote code execution"
    rows = security.entities(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    low = text.lower()
    want = []
    for name in security.longest_first(sorted(lex.SOFTWARE)):
        at = low.find(name)
        while at >= 0:
            want.append(("SOFTWARE", text[at : at + len(name)], at))
            at = low.find(name, at + len(name))
    for kind, held in (("ATTACK_VECTOR", lex.ATTACK_VECTORS), ("IMPACT", lex.IMPACTS), ("VULN_TYPE", lex.VULNERABILITIES)):
        want += [(kind, text[low.find(p) : low.find(p) + len(p)], low.find(p)) for p in security.longest_first(held) if p in low]
    kinds = {k for k, *_ in want}
    assert [(r["entity_type"], r["text"], r["char_start"]) for r in sorted(rows, key=lambda r: r["ent_ord"]) if r["entity_type"] in kinds] == want
    assert sum(r["text"].lower().strip() == "struts" for r in rows) <= 2


def test_entities_need_no_shuffle(spark):
    found = security.entities(spark.range(3).selectExpr("id AS doc_id", "'CVE-2024-1234 in apache' AS text"))
    assert "Exchange" not in plan(found) and "Window" not in plan(found) and found.count() == 6


def test_markers_against_the_plain_search(spark):
    rng = random.Random(8)
    listed = security.longest_first(lex.DISCOURSE_MARKERS)
    texts = []
    for _ in range(300):
        parts = [rng.choice([*listed, "walk", "home"]) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice(["", ", ", "x"]) + rng.choice([", ", " ", ","]).join(parts).title() + rng.choice(["", ",", " on"]))
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(passes.first_marker(F.col("text")).alias("m")).collect()
    for text, r in zip(texts, got):
        low = text.lower()
        want = next(((m, lex.DISCOURSE_MARKERS[m]) for m in listed if low.startswith(m) or f", {m} " in low or f", {m}," in low), None)
        assert (tuple(r["m"]) if r["m"] else None) == want


def test_containment_by_grams(spark):
    rng = random.Random(9)
    word = lambda most: "".join(rng.choice("abcé😀(") for _ in range(rng.randint(0, most)))
    needles, texts = [word(6) for _ in range(120)] + ["", "a", "ab", None], [word(25) for _ in range(200)] + ["", None]
    out = containing(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string"))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == sorted((n, t) for n in set(needles) - {None} for t in set(texts) - {None} if n in t)


def test_first_writer_and_duplicates(spark):
    rng = random.Random(10)
    rows = [(1, rng.randint(0, 3), rng.randint(0, 3), "DEP", k, f"label{k}", rng.random() < 0.2) for k in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "doc_id int, src bigint, dst bigint, edge_type string, seq int, dep_label string, allow_duplicate boolean")
    seen, want = set(), []
    for r in sorted(rows, key=lambda r: r[4]):
        if r[6] or r[:4] not in seen:
            want.append(r)
        seen.add(r[:4])
    assert sorted(tuple(r) for r in graph.first_edges(df).collect()) == sorted(want)
    plain = sorted(tuple(r) for r in graph.first_edges(df.drop("allow_duplicate")).collect())
    assert plain == sorted(min((r[:6] for r in rows if r[:4] == k), key=lambda r: r[4]) for k in seen)


def test_a_model_in_the_workers(spark):
    """A stub model: sentences at full stops, one token a word, each hanging on the sentence's first."""

    def load():
        def parse(text):
            sents, toks, i, at = [], [], 0, 0
            for n, sent in enumerate(x for x in text.split(".") if x.strip()):
                start = text.index(sent.strip(), at)
                sents.append({"sent": n, "text": sent.strip(), "char_start": start, "char_end": start + len(sent.strip())})
                head = i
                for k, w in enumerate(sent.split()):
                    toks.append({"sent": n, "token_idx": k, "i": i, "text": w, "lemma": w.lower(), "pos": "NOUN", "dep": "ROOT" if k == 0 else "advcl", "head_i": head, "ent_type": "", "ent_iob": "O", "char_start": text.index(w, at), "char_end": text.index(w, at) + len(w)})
                    at = text.index(w, at) + len(w)
                    i += 1
            return sents, toks, [{"sent": 0, "kind": "np", "label": "NP", "text": toks[0]["text"], "start_i": 0, "end_i": 1, "char_start": 0, "char_end": 1}] if toks else []

        return parse

    docs = spark.createDataFrame([(1, "One two. Three.\n\nFour five six."), (2, "Seven.")], "doc_id int, text string")
    a = annotate.ModelAnnotator(load, "stub").annotate(docs)
    assert sorted((r["doc_id"], r["para_idx"], r["sent_idx"], r["text"]) for r in a.sentences.collect()) == [(1, 0, 0, "One two"), (1, 0, 1, "Three"), (1, 1, 2, "Four five six"), (2, 0, 0, "Seven")]
    assert sorted((r["doc_id"], r["para_idx"], r["sent_idx"], r["i"], r["text"]) for r in a.tokens.collect()) == [(1, 0, 0, 0, "One"), (1, 0, 0, 1, "two"), (1, 0, 1, 2, "Three"), (1, 1, 2, 0, "Four"), (1, 1, 2, 1, "five"), (1, 1, 2, 2, "six"), (2, 0, 0, 0, "Seven")]
    assert a.has_parser and a.spans.count() == 3
    from loomgraph.operators import frontend

    g = frontend.build(a.kept())
    # the sentence of one word has neither a next token nor a dependency
    assert sorted((r["doc_id"], r["rule"]) for r in graph.validate(g.node_table(), g.edge_table(), docs).collect()) == [(2, "V5"), (2, "V6")]
    assert g.node_table().filter("node_type = 'CLAUSE'").count() == 3
