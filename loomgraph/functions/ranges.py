"""Running numbers over groups of any size: by ranges, without a window over a whole group.

Rows are dealt and sorted by ranges of (group, order). What a range needs to know of the
ranges before it is one row a group and range, so a window over these rows has at most as
many rows of a group as there are ranges, however many rows the group itself has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import stored

#: Added by ``in_ranges``: the range of a row, and its place (ascending in a range, not dense over ranges)
PART, AT = "__part", "__at"


def in_ranges(df: DataFrame, keys: list[str | Column], name: str = "ranges") -> DataFrame:
    """``df`` written in ranges of ``keys``, with PART and AT. Rows with equal keys stand in one range in any order."""
    # the input is sampled for the borders of the ranges and then read again, so it should be cheap to make
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ranged.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), name)


def with_pieces(rows: DataFrame, pieces: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with what ``pieces`` (a row for each group and range) has of their group and range; nulls are a group."""
    names = {c: f"__{i}" for i, c in enumerate(group)} | {PART: "__p"}
    pieces = pieces.withColumnsRenamed(names)
    on = F.lit(True)
    for c, name in names.items():
        on = on & rows[c].eqNullSafe(pieces[name])
    return rows.join(pieces, on).drop(*names.values())


def numbered(df: DataFrame, group: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: 0, 1, ... by ``order`` within each ``group`` (nulls are a group). Ties take any order."""
    ranged = in_ranges(df, [*group, *order], "numbered")
    pieces = ranged.groupBy(*group, PART).agg(F.count(F.lit(1)).alias("__n"), F.min(AT).alias("__first"))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    placed = with_pieces(ranged, pieces.drop("__n", "__first"), group)
    return placed.select(*df.columns, (F.col(AT) + F.col("__shift")).alias(out))
