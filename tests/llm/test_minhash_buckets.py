"""Buckets of op12 are laid out once, and components are sought only where links were found."""

from loomgraph.llm import graph, minhash


def test_stars_need_no_other_join_than_the_buckets(spark):
    banded = spark.createDataFrame([(b, bytes([s]), 10, 5) for b in (1, 2) for s in range(4)] + [(3, b"x", 10, 5)], "band bigint, set binary, n bigint, bytes bigint")
    buckets = minhash.shared(banded)
    assert sorted((r.band, r.set, r.held, r.all, r.c.set) for r in buckets.collect()) == [(b, bytes([s]), 4, 20, b"\0") for b in (1, 2) for s in range(4)]
    edges = minhash.star_edges(buckets)
    assert sorted(edges.collect()) == sorted(minhash.stars(banded).collect()) and edges.count() == 3


def test_settled_tells_stars_from_chains(spark):
    of = lambda *rows: spark.createDataFrame(rows, "u int, v int")
    assert graph.settled(of((2, 1), (3, 1), (5, 4)))
    assert not graph.settled(of((2, 1), (3, 2))) and not graph.settled(of((3, 1), (3, 2)))
