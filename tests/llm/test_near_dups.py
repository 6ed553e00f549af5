"""Candidates of the near-duplicate stage."""

import random

import pyarrow as pa

from loomgraph.llm import near_dups, simhash


def test_simhash_classes_are_keys_beside_the_bands(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 9000)}" for _ in range(2000)]
    texts = [" ".join(base), " ".join([*base[:-1], "new"]), " ".join(f"v{rnd.random()}" for _ in range(2000))]
    _, _, prints = near_dups.signatures(pa.array(texts))
    assert prints.tolist() == simhash.fingerprints(pa.array(texts), near_dups.WIDTH).tolist()
    # no band in common: before, such bags met nowhere
    rows = [(bytes([k]), 10, [k], int(fp)) for k, fp in enumerate(prints.view("int64"))] + [(b"x", 10, [7], int(prints.view("int64")[2]) ^ 5)]
    found = near_dups.keyed(spark.createDataFrame(rows, "bag binary, size bigint, bands array<bigint>, fp bigint"))
    shared = sorted(sorted(map(bytes, r.bags)) for r in found.groupBy("band").agg({"bag": "collect_list"}).toDF("band", "bags").filter("size(bags) > 1").collect())
    assert shared == [[b"\0", b"\1"], [b"\2", b"x"]]
