"""Line dedup: remove boilerplate lines that spread over many sites.

Method: every non-blank line (white space trimmed) is hashed to 128 bits. For each
hash an HLL sketch of the sites it occurs on is built map-side and merged by
aggregation, next to the smallest occurrence. A line whose estimate lies clearly
below ``min_sites`` stays, one clearly above is boilerplate, and one within ``band``
of the threshold gets an exact distinct count of its sites. Of a boilerplate line the
first occurrence (smallest document id, then line number) is kept and every other is
removed, so no content is lost from the corpus.

Skew: a line that holds a third of all rows is pre-aggregated map-side by both the
sketch and the exact count (a distinct over (line, site) first); removal joins the
document's line hashes with the boilerplate table, whose hot keys are split by a salt.

Defined results: a null text stays null with no lines; an empty text stays empty.
Blank lines are never counted or removed. A null site counts as one site of its own.
Repeated document ids are separate documents (rows are told apart by id and 128 bits
of id, site and text; rows equal in all three are identical and get equal
results). An empty table gives an empty result. Extra columns are kept, whatever their
names; n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

MIN_SITES = 10
BAND = 0.25
LG_K = 8
SALTS = 16
BLANKS = " \t\r\x0b\x0c"


def document_lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row (a, b, site, at) for each non-blank line; at = (doc_id, k1, k2, line number)."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), *row_key(doc_id, text, site),
        F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"),
    ).withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.col("line") != "")
    return rows.select(
        F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), "site",
        F.struct("doc_id", "k1", "k2", "line_no").alias("at"),
    )


def row_key(doc_id: str, text: str, site: str) -> list[Column]:
    """(k1, k2): 128 bits that tell rows apart unless id, site and text are equal."""
    # a hash passes over nulls, so where they stand is hashed as well
    parts = [x for c in (doc_id, site, text) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(k), *parts).alias(k) for k in ("k1", "k2")]


def salted(df: DataFrame) -> DataFrame:
    """The small side of a join whose other side deals a hot key to ``SALTS`` partitions."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(a, b, first) of each line found on ``min_sites`` sites or more."""
    # fewer occurrences than min_sites can't have min_sites sites, so count() prunes exactly
    sketched = lines.groupBy("a", "b").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= min_sites).select("a", "b", "first", F.hll_sketch_estimate("sites").alias("estimate"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    sketched = stored(sketched.filter(F.col("estimate") >= low), "line-sketches")
    near = sketched.filter(F.col("estimate") <= high)
    spread = (
        lines.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
        .join(salted(near.select("a", "b")), ["a", "b", "salt"], "left_semi")
        .select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_sites"))
        .filter(F.col("n_sites") >= min_sites).select("a", "b")
    )
    return sketched.filter(F.col("estimate") > high).unionByName(near.join(spread, ["a", "b"], "left_semi")).select("a", "b", "first")


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines numbered in ``gone``."""
    # the list of one binds the lines to a name, so that they are split once
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(kept(lines), lambda i: lines[i]), "\n"))[0]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines, n_removed (longs)."""
    docs = docs.drop(*({"n_lines", "n_removed"} - {doc_id, text, site}))
    lines = document_lines(docs, doc_id, text, site)
    common = stored(boilerplate_lines(lines, min_sites, band), "boilerplate")
    removed = (
        lines.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
        .join(salted(common), ["a", "b", "salt"]).filter(F.col("at") != F.col("first"))
        .groupBy("at.doc_id", "at.k1", "at.k2").agg(F.collect_set("at.line_no").alias("gone"))
    )
    # the row travels as one struct, so no column of the input can clash
    rows = docs.select(F.struct("*").alias("row"), *row_key(doc_id, text, site)).alias("d")
    same = F.col(f"d.row.{quoted(doc_id)}").eqNullSafe(F.col("r.doc_id")) & (F.col("d.k1") == F.col("r.k1")) & (F.col("d.k2") == F.col("r.k2"))
    out = rows.join(removed.alias("r"), same, "left")
    whole = F.col(f"d.row.{quoted(text)}")
    made = {
        text: F.when(F.col("r.gone").isNotNull(), without_lines(whole, F.col("r.gone"))).otherwise(whole),
        "n_lines": F.when(whole.isNull(), 0).otherwise(F.size(F.split(whole, "\n"))).cast("long"),
        "n_removed": F.coalesce(F.when(F.col("r.gone").isNotNull(), F.size("r.gone")), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *(n for n in made if n not in docs.columns)]
    return out.select(*(made[n].alias(n) if n in made else F.col(f"d.row.{quoted(n)}").alias(n) for n in names))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
