"""op13 against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=50):
    held = [(doc, Counter(terms_of(text))) for doc, text in docs]
    held = [(doc, tf, sum(tf.values())) for doc, tf in held if tf]
    all_docs, all_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scored = []
        for doc, tf, n in held:
            m = 50 + 50 * n * all_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms_of(text)) if t in tf)
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, n string").repartition(3), spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, number int")


def found(spark, docs, items, **options):
    return sorted((tuple(r) for r in lexical.rank(*frames(spark, docs, items), **options).collect()), key=repr)


def corpus(seed, n_docs=500, n_words=300):
    """Words of very unlike frequencies, and items that stand in some documents."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(n_words)]
    weights = [1 / (i + 1) for i in range(n_words)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(n_docs)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(25)]
    for i, text in items[:10]:
        for _ in range(4):
            docs[rng.randrange(n_docs)] = (1000 + len(docs), text + " " + text)
            docs.append((2000 + len(docs), text.upper()))
    return docs, items


@pytest.mark.parametrize("tiers", [(1 << 40,), (4, 40), (0, 0), (20, 100, 200)])
def test_against_all_documents(spark, tiers):
    docs, items = corpus(1)
    assert found(spark, docs, items, k=5, tiers=tiers) == by_hand(docs, items, 5)


def test_production_parameters(spark):
    docs, items = corpus(2)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_items_are_proven_or_fall_through(spark):
    """Rare terms prove an item in tier 0 though the frequent ones aren't looked up; frequent terms alone fall through."""
    docs = [(i, "the of and " * (i % 9 + 1) + f"filler{i}") for i in range(400)]
    docs += [(1000 + i, "zebra quagga okapi the") for i in range(6)]
    items = [(1, "zebra quagga okapi the"), (2, "the of and")]
    frame, _ = frames(spark, docs, items)
    terms = sorted({t.encode() + b" " for _, text in items for t in terms_of(text)})
    index = lexical.build(frame, terms, tiers=(10, 50))
    of_items = [np.array([terms.index(t.encode() + b" ") for t in sorted(set(terms_of(text)))]) for _, text in items]
    rows, proof = lexical.search(index, of_items, 5)
    assert proof == [0, 2]
    assert sorted((items[r["item"]][0], r["rank"], r["doc_id"], r["score"]) for r in rows.collect()) == by_hand(docs, items, 5)
    sizes = index.table.selectExpr("sum(size(tids0)) a", "sum(size(tids1)) b", "sum(size(tids2)) c").first()
    assert sizes["a"] < sizes["c"]


def test_a_search_of_the_first_tier_reads_its_columns_only(spark):
    docs, items = corpus(4)
    index = lexical.build(frames(spark, docs, items)[0], [b"w0 ", b"w1 "])
    plan = index.table.select("doc_id", "n", "tids0", "tfs0")._jdf.queryExecution().executedPlan().toString()
    assert "tids1" not in plan and "tids0" in plan


def test_odd_input(spark, odd_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    items = [(1, "Lorem ipsum one TWO"), (1, "漢字 äöü İ"), (None, "three"), (5, None), (6, ""), (7, "!!"), (8, "nowhere"), (9, "three three")]
    asked = frames(spark, [], items)[1]
    out = sorted((tuple(r) for r in lexical.rank(odd_docs, asked).collect()), key=repr)
    assert out == by_hand(rows, items)
    assert found(spark, [], items) == [] and found(spark, rows, []) == []
    assert found(spark, [(1, None), (2, "--")], items) == []


def test_several_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 10)
    docs, items = corpus(3, 120)
    assert found(spark, docs, items, k=7) == by_hand(docs, items, 7)
