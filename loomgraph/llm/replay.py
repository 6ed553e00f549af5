"""Quarantine and cascading release: replays deliveries of conversation turns that depend on earlier turns.

A conversation's turns, numbered p from 0 by turn, arrive at second ``SPACING`` * p. h(k) is crc32
of the text ``k:conv_id:turn``. A turn's parent stands h(0) % ``REACH`` turns earlier (0, or
before the first turn: none). A turn with h(1) % 101 < 50 is faulty and repaired h(2) % 101
seconds after its arrival. Attempt 1 comes at the arrival or the parent's delivery, if that
is later; attempt a + 1 comes 20 * 2^(a-1) seconds after attempt a. A faulty turn's attempt a
fails before the repair, or if h(a+2) % 3 = 0. ``ATTEMPTS`` failures: dead. A dead or blocked
parent blocks its children. Delivered turns are released by (last_at, turn).

Method: JVM expressions only. Turns are collected as sorted arrays of structs; an
aggregate folds each array into a growing array of outcomes, in which a turn finds its parent
by index; outcomes are exploded, ranked and summed.

Scale: what is collected isn't a conversation but a stretch between two cuts. A cut is a place
that no link from a turn to its parent crosses; as links reach ``REACH`` - 1 turns back, four
turns tell, and one place in 26 is a cut. Stretches don't depend on each other.
Their length is geometric: of 1e12 turns the longest is expected to hold some 700.
Turns are numbered, and releases ranked and summed, by ranges of (conversation,
time) with one row of totals a range (``functions/ranges.py``), so a conversation with a
third of all rows is spread like any other third.

Defined results: a null conv_id is a conversation, a null turn comes first, a null
text counts as empty; in h a null is empty. Rows with equal (conv_id, turn) are turns
of their own, ordered by the crc32 of their texts. A state beyond 64 bits is
null. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ranges import AT, PART, in_ranges, with_pieces
from loomgraph.llm.common import stored

SPACING = 7
REACH = 5
ATTEMPTS = 6
#: Seconds from attempt 1 to attempt a + 1
WAITED = [20 * (2**a - 1) for a in range(ATTEMPTS)]
OUTCOME = "struct<status: string, attempts: int, first_at: bigint, last_at: bigint>"


def drawn(df: DataFrame, conv_id: str, turn: str, text: str) -> DataFrame:
    """(conv, turn, crc, back, repair, fails): what the hashes say of each turn.

    back: the parent's distance; repair: seconds to the repair, null unless faulty; fails: bit
    a - 1 tells that attempt a fails.
    """
    rest = F.concat(F.lit(":"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit("")))
    h = lambda k: F.crc32(F.concat(F.lit(str(k)), rest).cast("binary"))
    fails = F.lit(0)
    for a in range(ATTEMPTS):
        fails = fails + F.when(h(a + 3) % 3 == 0, 1 << a).otherwise(0)
    faulty = h(1) % 101 < 50
    return df.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        (h(0) % REACH).cast("int").alias("back"), F.when(faulty, (h(2) % 101).cast("int")).alias("repair"), F.when(faulty, fails).otherwise(0).alias("fails"),
    )


def stretches(turns: DataFrame) -> DataFrame:
    """The turns with p (their number), and (at_part, at_row), equal within a stretch between two cuts."""
    ranged = in_ranges(turns, ["conv", "turn", "crc"], "replay-turns")
    local = Window.partitionBy("conv", PART).orderBy(AT)
    # where a range ends before the next turns are seen there is no cut: stretches only get longer
    uncrossed = F.col("back") == 0
    for j in range(1, REACH - 1):
        uncrossed = uncrossed & (F.coalesce(F.lead("back", j).over(local), F.lit(REACH)) <= j)
    rows = ranged.withColumns({"row": F.row_number().over(local) - 1, "cut": uncrossed})
    start = F.max(F.when(F.col("cut"), F.col("row"))).over(local.rowsBetween(Window.unboundedPreceding, 0))
    rows = stored(rows.withColumn("start", start).drop("cut", AT), "replay-cuts")

    before = Window.partitionBy("conv").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv", PART).agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("last"))
    pieces = pieces.withColumn("p0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the stretch that is open at the end of a range; before the first cut it is that of the conversation's start
    opened = F.when(F.col("last").isNotNull() | (F.col("p0") == 0), F.struct(F.col(PART).alias("part"), F.coalesce("last", F.lit(-1)).alias("row")))
    pieces = pieces.withColumn("opened", opened).withColumn("open", F.last("opened", True).over(before)).drop("n", "last", "opened")
    joined = with_pieces(rows, pieces, ["conv"])
    inherited = F.col("start").isNull() & F.col("open").isNotNull()
    return joined.select(
        "conv", "turn", "crc", "back", "repair", "fails", (F.col("p0") + F.col("row")).alias("p"),
        F.when(inherited, F.col("open.part")).otherwise(F.col(PART)).alias("at_part"), F.when(inherited, F.col("open.row")).otherwise(F.coalesce("start", F.lit(-1))).alias("at_row"),
    )


def outcome(turn: Column, before: Column) -> Column:
    """What becomes of a turn, given the outcomes of the turns of its stretch before it."""
    has_parent = (turn["back"] > 0) & (turn["p"] >= turn["back"])
    parent = F.when(has_parent, F.get(before, F.size(before) - turn["back"]))
    arrival = SPACING * turn["p"]

    def tried(first: Column) -> Column:
        """The outcome if attempt 1 comes at ``first``."""
        good = F.lit(None).cast("int")
        for a in reversed(range(ATTEMPTS)):
            fine = (turn["fails"].bitwiseAND(1 << a) == 0) & (first + WAITED[a] >= arrival + turn["repair"])
            good = F.when(fine, a + 1).otherwise(good)
        attempts = F.when(turn["repair"].isNull(), 1).otherwise(good)
        waited = F.element_at(F.array(*(F.lit(w) for w in WAITED)), F.coalesce(attempts, F.lit(ATTEMPTS)))
        status = F.when(attempts.isNull(), "dead").otherwise("delivered")
        return F.struct(status.alias("status"), F.coalesce(attempts, F.lit(ATTEMPTS)).alias("attempts"), first.alias("first_at"), (first + waited).alias("last_at"))

    blocked = F.struct(F.lit("blocked").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("bigint").alias("first_at"), F.lit(None).cast("bigint").alias("last_at"))
    first = F.greatest(arrival, F.coalesce(parent["last_at"], arrival))
    return F.when(has_parent & (parent["status"] != "delivered"), blocked).otherwise(F.get(F.transform(F.array(first), tried), F.lit(0))).cast(OUTCOME)


def delivered(rows: DataFrame) -> DataFrame:
    """Delivered turns with release_no and state."""
    ranged = in_ranges(rows, ["conv", "last_at", "turn", "p"], "replay-releases")
    local = Window.partitionBy("conv", PART).orderBy(AT)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("k", F.row_number().over(local).cast("bigint"))
    ranged = ranged.withColumns({"crcs": F.try_sum("crc").over(upto), "weighed": F.try_sum(F.try_multiply("k", "crc")).over(upto)})
    ranged = stored(ranged.drop(AT), "replay-sums")
    # of a range: how many turns, the sum of their crcs, and that weighed by their place in the range
    pieces = ranged.groupBy("conv", PART).agg(F.max("k").alias("n"), F.max_by("crcs", "k").alias("crcs"), F.max_by("weighed", "k").alias("weighed"))
    before = Window.partitionBy("conv").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = pieces.withColumn("whole", F.try_add("weighed", F.try_multiply("n0", "crcs")))
    broken = F.max(F.col("whole").isNull()).over(before)
    pieces = pieces.withColumn("state0", F.when(~F.coalesce(broken, F.lit(False)), F.coalesce(F.try_sum("whole").over(before), F.when(F.col("n0") == 0, F.lit(0)))))
    pieces = pieces.drop("n", "crcs", "weighed", "whole")
    joined = with_pieces(ranged, pieces, ["conv"])
    state = F.try_add("state0", F.try_add("weighed", F.try_multiply("n0", "crcs")))
    return joined.select("conv", "turn", "status", "attempts", "first_at", "last_at", (F.col("n0") + F.col("k")).alias("release_no"), state.alias("state"))


def replay(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no, state for each row."""
    turns = F.sort_array(F.collect_list(F.struct("p", "turn", "crc", "back", "repair", "fails")))
    rows = stretches(drawn(df, conv_id, turn, text)).groupBy("conv", "at_part", "at_row").agg(turns.alias("turns"))
    folded = F.aggregate("turns", F.array().cast(f"array<{OUTCOME}>"), lambda done, x: F.concat(done, F.array(outcome(x, done))))
    each = rows.select("conv", F.explode(F.arrays_zip("turns", folded.alias("done"))).alias("x"))
    out = stored(each.select("conv", "x.turns.turn", "x.turns.p", "x.turns.crc", "x.done.*"), "replay-outcomes")
    held = out.filter("status <> 'delivered'").select("conv", "turn", "status", "attempts", "first_at", "last_at", F.lit(None).cast("bigint").alias("release_no"), F.lit(None).cast("bigint").alias("state"))
    released = delivered(out.filter("status = 'delivered'").select("conv", "turn", "p", "crc", "status", "attempts", "first_at", "last_at"))
    return released.unionByName(held).select(F.col("conv").alias("conv_id"), "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")
