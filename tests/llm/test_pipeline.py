"""Stages of the pipeline against brute force and on odd rows."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomgraph.llm import langid, near_dups  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], SCHEMA)


def shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def survivors(rows):
    """The smallest id of each group of 5-word similarity 0.8 or more, by comparing all with all."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if root[j] < root[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i], changed = root[j], True
    return {i for i in root if root[i] == i}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.random()}"
    return words


def test_near_duplicates_are_those_of_five_words_and_four_fifths(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(25):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([60, 150, 300]))]
        # around the threshold: an edit of one word changes five shingles
        rows += [" ".join(edited(rnd, base, n)) for n in (0, 1, 2, 3, 4, len(base) // 45, len(base) // 40)]
    rows += ["one two", "One  two", "one three", "one two three four five", "one two three four six"]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    out = corpus_pipeline.remove_near_duplicates(spark, documents(spark, rows).repartition(5), "").collect()
    assert sorted(r.doc_id for r in out) == sorted(survivors(rows))


def test_near_duplicates_in_a_large_bucket(spark):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate(" ".join(edited(rnd, base, rnd.choice([1, 2, 3, 5, 8]))) for _ in range(4 * near_dups.BLOCK)))
    out = corpus_pipeline.remove_near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in out) == sorted(survivors(rows))


def test_near_duplicates_keep_every_text_of_odd_rows(spark):
    say = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, say("a")), (2, say("a")), (2, say("b")), (2, say("c")), (2, say("c")), (None, say("d")), (None, say("e")), (None, say("e")), (None, say("b")), (3, "")]
    rows += [(4, None), (5, say("f")), (None, say("f") + " more")]
    out = corpus_pipeline.remove_near_duplicates(spark, documents(spark, rows).repartition(3), "").collect()
    want = [(1, say("a")), (2, say("b")), (2, say("c")), (None, say("d")), (None, say("e")), (3, ""), (5, say("f"))]
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(want, key=str)


def test_language_keeps_short_texts_and_drops_unlearned_ones(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice(["the", "cat", "sat", "on", "a", "mat", "with", "her", "hat"]) for _ in range(n))
    rows = [(i, say(40)) for i in range(60)]
    short, junk = [(100, "A."), (101, "Q")], [(200, "".join(rnd.choice("абвгдежзиклмн") for _ in range(40))), (201, "漢字" * 30)]
    docs = documents(spark, rows).unionByName(spark.createDataFrame([(i, t, None, "a", len(t)) for i, t in short + junk], SCHEMA))
    rates = {r.doc_id: r.bits_per_byte for r in langid.fit_and_identify(docs).collect()}
    assert all(rates[i] > corpus_pipeline.MOST_BITS_PER_BYTE for i, _ in short + junk)
    out = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows + short]
