"""Which texts contain which needles: a join by q-grams instead of all with all.

Each text stands in the posting lists of its distinct grams of ``Q`` characters. A needle looks
only into the list of its rarest gram; what it finds there is verified. A needle with a gram
that no text has is in none. Needles shorter than ``Q`` have lists of their own, of
grams of their length; the empty needle is in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import stored

Q = 3


def grams(text: Column, q: int) -> Column:
    """The distinct pieces of ``q`` characters of a text."""
    n = F.length(text) - q + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, q))
    return F.when(n > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of each needle (needle) and each distinct text (text) that contains it; nulls take no part."""
    needles = stored(needles.select("needle").filter("needle is not null").distinct(), "needles")
    texts = stored(texts.select("text").filter("text is not null").distinct().withColumn("key", F.xxhash64("text")), "contained")
    listed = lambda q: texts.select(F.explode_outer(grams(F.col("text"), q)).alias("gram"), "key").filter("gram is not null")
    postings = stored(listed(Q), "grams")
    held = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = needles.filter(F.length("needle") >= Q).select("needle", F.explode_outer(grams(F.col("needle"), Q)).alias("gram"))
    # a gram without a list counts as the rarest, and then finds nothing
    rarest = parts.join(held, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(postings, "gram").select("needle", "key")
    for q in range(1, Q):
        short = needles.filter(F.length("needle") == q).select("needle", F.col("needle").alias("gram"))
        found = found.unionByName(listed(q).join(short, "gram").select("needle", "key"))
    # texts with equal keys are told apart here as well
    out = found.join(texts, "key").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")
    if not needles.filter("needle = ''").isEmpty():
        out = out.unionByName(texts.select(F.lit("").alias("needle"), "text"))
    return out
