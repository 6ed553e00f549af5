"""Running folds over arrays in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import let

#: Elements that are folded into one growing array; the arrays of a long input are joined once
BLOCK = 256


def blocks(items: Column) -> Column:
    """``items`` in consecutive slices of ``BLOCK``; an empty one if there are none."""
    return F.transform(F.sequence(F.lit(0), (F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], state: str, out: str) -> Column:
    """An array of what ``step`` (state, element) -> (next state, out) gives for each element, from left to right.

    ``state`` and ``out`` are the types, which ``step`` must give (a cast in a step would copy what has grown). A growing array is copied with each element, so
    elements are folded in blocks: the cost is ``BLOCK`` an element at most, not the array's length.
    """

    def one(acc: Column, x: Column) -> Column:
        after, given = step(acc["state"], x)
        return F.struct(after.alias("state"), F.array_append(acc["out"], given).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out"))
        return let(F.aggregate(xs, begin, one), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    begin = F.struct(zero.cast(state).alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return let(items, lambda xs: F.aggregate(blocks(xs), begin, block, lambda acc: F.flatten(acc["out"])))


def before(sizes: Column) -> Column:
    """For each element the sum of those before it."""
    return scanned(sizes, F.lit(0), lambda s, x: (s + x, s), "int", "int")


PLACED = "struct<text: string, char_start: int, char_end: int>"


def matches(text: Column, pattern: str, base: Column | None = None) -> Column:
    """An array of (text, char_start, char_end): each match of ``pattern``; places count code points from ``base`` (0)."""

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        return end, F.struct(x["match"].alias("text"), start.alias("char_start"), end.alias("char_end"))

    p = F.lit(pattern)
    pairs = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"))
    # what follows the last match has none
    return scanned(let(pairs, lambda xs: F.slice(xs, 1, F.size(xs) - 1)), F.lit(0) if base is None else base, place, "int", PLACED)


def cells(points: Column) -> Column:
    """Sorted (at, item) points as cells (upto, closed, item): ``item`` is nearest to what lies below ``upto`` (``closed``: or at it).

    Neighbours are parted at the middle between them; at the middle itself the smaller item is nearest.
    """
    def cell(x: Column, k: Column) -> Column:
        after = F.get(points, k + 1)
        middle = (x["at"] + after["at"]) / 2
        return F.struct(F.coalesce(middle, F.lit(float("inf"))).alias("upto"), F.coalesce(x["item"] < after["item"], F.lit(True)).alias("closed"), x["item"].alias("item"))

    return F.transform(points, cell)


def nearest(cells: Column, value: Column) -> Column:
    """The item of the cell that holds ``value``, by binary search; null without cells."""
    # (lo, hi): the cell is one of them or lies between
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(cells), F.lit(1)))).cast("int"))

    def halved(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        x = F.get(cells, middle)
        here = (value < x["upto"]) | ((value == x["upto"]) & x["closed"])
        return F.struct(F.when(here | (s["lo"] >= s["hi"]), s["lo"]).otherwise(middle + 1).alias("lo"), F.when(here, middle).otherwise(s["hi"]).alias("hi")).cast("struct<lo: int, hi: int>")

    begin = F.struct(F.lit(0).alias("lo"), (F.size(cells) - 1).alias("hi")).cast("struct<lo: int, hi: int>")
    return F.get(cells, F.aggregate(steps, begin, halved, lambda s: s["lo"]))["item"]
