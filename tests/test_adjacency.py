"""Walks over the compressed adjacency against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import adjacency, graph


def paths(edges, starts, depth):
    out, level = Counter(), [(d, s, (s,)) for d, s in starts]
    for _ in range(depth):
        level = [(d, s, (*p, b)) for d, s, p in level for e, a, b in edges if (e, a) == (d, p[-1]) and b not in p]
        out.update(level)
    return out


def test_walks_with_hubs_and_parallel_edges(spark):
    rnd = random.Random(4)
    edges = [(d, rnd.randrange(12), rnd.randrange(12)) for d in (1, 2) for _ in range(30)] + [(1, 0, n) for n in range(12)] + [(2, 3, 4)] * 3
    starts = [(1, 0), (2, 3), (2, 99), (3, 0)]
    links = spark.createDataFrame([*edges, (1, None, 5), (1, 5, None)], "doc_id bigint, src bigint, dst bigint").withColumn("edge_type", F.lit("E"))
    wanted = spark.createDataFrame(starts, "doc_id bigint, node_id bigint")
    got = graph.walk(links, wanted, ["E"], max_depth=3).collect()
    assert Counter((r.doc_id, r.start, tuple(r.path)) for r in got) == paths(edges, starts, 3)
    back = graph.walk(links, wanted, ["E"], "in", 2).collect()
    assert Counter((r.doc_id, r.start, tuple(r.path)) for r in back) == paths([(d, b, a) for d, a, b in edges], starts, 2)
    assert graph.walk(links.limit(0), wanted, ["E"]).count() == 0


def test_hubs_are_cut_and_steps_leave_the_edges_where_they_are(spark):
    links = spark.range(5000).select(F.lit(1).alias("doc_id"), (F.col("id") * 0).alias("node_id"), F.col("id").alias("other_id"))
    held = adjacency.build(links, 100)
    lists = held.lists.select(F.size("others").alias("n")).collect()
    assert len(lists) == 50 and sum(r.n for r in lists) == 5000 and max(r.n for r in lists) < 200
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(1, 0, 50)], "doc_id int, node_id bigint, pieces bigint")
        met = held.step(asked)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert met.count() == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
