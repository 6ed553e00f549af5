"""What must not be broadcast, however small Spark takes it to be."""

import numpy as np

from loomgraph.llm import near_dups, simhash


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_probes_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """By the size of their file they could be, as it stands for a row a fingerprint; there are some 17 for each of its two segments."""
    prints = np.random.default_rng(7).integers(-(2**62), 2**62, 300).tolist()
    rows = [(x, x) for y in prints for x in (y, y ^ 1, y ^ (1 << 40) ^ 6)]
    spark.createDataFrame(rows, "fp bigint, rep bigint").write.parquet(f"{tmp_path}/prints")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    assert broadcasts(found) == 0
    links = {tuple(sorted((r.u, r.v))) for r in found.collect()}
    assert links == {tuple(sorted(x)) for y in prints for x in ((y, y ^ 1), (y, y ^ (1 << 40) ^ 6))}


def test_classes_of_the_pipeline_are_sought_without_a_broadcast(spark, monkeypatch):
    """The near-duplicate stage writes its fingerprints and joins them with their probes as read again."""
    seen = []
    monkeypatch.setattr(near_dups, "components", lambda links: seen.append(links) or spark.createDataFrame([], "node bigint, root bigint"))
    prints = np.random.default_rng(8).integers(-(2**62), 2**62, 100).tolist()
    rows = [(bytes([k]), 10, [k], int(x)) for k, x in enumerate(prints)]
    near_dups.keyed(spark.createDataFrame(rows, "bag binary, size bigint, bands array<bigint>, fp bigint"))
    assert len(seen) == 1 and broadcasts(seen[0]) == 0
