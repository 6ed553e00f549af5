"""op12 against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import minhash


def set_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else set(words)


def by_hand(rows):
    """(doc_id, n_shingles, component_id, kept) for each row."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc is not None and doc == component))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, set string, n int")).collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(5000)]


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows, doc = [], 0
    for _ in range(60):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 400]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((doc, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.05, 0.1])))))
            doc += 1
    rng.shuffle(rows)
    assert found(spark, rows) == by_hand(rows)


def test_links_that_no_star_meets(spark):
    """One bucket's texts around a centre that most are just not linked with."""
    rng = random.Random(5)
    base = [rng.choice(VOCABULARY) for _ in range(300)]
    rows = [(i, " ".join(edited(rng, base, 0.07))) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 90, 3)]
    assert found(spark, rows) == by_hand(rows)


def test_odd_input(spark, odd_docs, odd_rows):
    out = sorted((tuple(r) for r in minhash.near_duplicates(odd_docs).collect()), key=repr)
    assert out == by_hand([(r[0], r[1]) for r in odd_rows])
    assert found(spark, []) == []
    same = [(None, "a b c d"), (None, "A b  c d"), (4, "a b\tc d"), (None, "x y"), (None, None), (9, ""), (9, "")]
    assert found(spark, same) == by_hand(same)


@pytest.mark.parametrize("size", [3, 12, 100])
def test_densified_bins_agree_as_often_as_the_sets(size):
    """Shares of equal bins estimate the similarity, also where most bins are empty."""
    rng, shares = random.Random(size), []
    for _ in range(60):
        union = [f"s{rng.random()}" for _ in range(size)]
        a, b = union[: -max(1, size // 6)], union[max(1, size // 6) :]
        hashes, text = minhash.distinct_shingles(pa.array([" ".join(a), " ".join(b)]), 1)
        spread = minhash.mixed(hashes)
        bins = np.full((2, minhash.BINS), minhash._EMPTY)
        np.minimum.at(bins, (text, ((spread >> np.uint64(32)) * np.uint64(minhash.BINS) >> np.uint64(32)).astype(int)), (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        filled = minhash.densified(bins)
        assert (filled != minhash._EMPTY).all()
        shares.append((filled[0] == filled[1]).mean())
    similarity = (size - 2 * max(1, size // 6)) / size
    assert abs(np.mean(shares) - similarity) < 0.1


def test_a_star_has_one_edge_fewer_than_sets(spark):
    banded = spark.createDataFrame([(b, bytes([i]), 100 + i % 3, 10) for b in (1, 2) for i in range(50)], "band bigint, set binary, n bigint, bytes bigint")
    assert minhash.stars(banded).count() == 49
