"""All occurrences of many phrases in one pass over a text, in Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.arrays import scanned
from loomgraph.functions.text import let

#: Written around what is found; where a text has them it is read as if it had OTHER
BEGIN, END, OTHER = "\x01", "\x02", "\x03"
OCCURRENCE = "struct<phrase: string, start: int>"


def trie(phrases: Iterable[str]) -> str:
    """A pattern for the longest of the phrases at a place: a branch for each letter that can follow, so each letter of a text is looked at once a place."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(letter) + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return joined + ("?" if "" in node else "")

    return pattern(root)


def longest_at(text: Column, phrases: list[str]) -> Column:
    """An array of (phrase, start): at each place of ``text`` where phrases begin the longest of them."""
    clean = F.translate(text, BEGIN + END, OTHER * 2)
    pieces = F.split(F.regexp_replace(clean, f"(?=({trie(phrases)}))", f"{BEGIN}$1{END}"), BEGIN, -1)

    def piece(at: Column, x: Column) -> tuple[Column, Column]:
        phrase = F.substring_index(x, END, 1)
        return at + F.length(x) - F.length(phrase) - 1, F.struct(phrase.alias("phrase"), at.alias("start"))

    # the first piece is what stands before the first place
    return let(pieces, lambda xs: scanned(F.slice(xs, 2, F.size(xs) - 1), F.length(F.get(xs, F.lit(0))), piece, "int", OCCURRENCE))


def occurrences(text: Column, phrases: list[str]) -> Column:
    """An array of (phrase, start) of every occurrence of every phrase, overlapping ones too, by start."""
    # what begins where a longer phrase begins is a beginning of it
    begins = {p: [q for q in phrases if p.startswith(q)] for p in phrases}
    if all(len(x) == 1 for x in begins.values()):
        return longest_at(text, phrases)
    shorter = F.create_map(*[x for p, qs in begins.items() for x in (F.lit(p), F.array(*map(F.lit, qs)))])
    each = lambda o: F.transform(F.try_element_at(shorter, o["phrase"]), lambda p: F.struct(p.alias("phrase"), o["start"].alias("start")))
    return F.flatten(F.transform(longest_at(text, phrases), each))


def overlaps_itself(phrase: str) -> bool:
    """Whether an occurrence can begin within another one."""
    return any(phrase.endswith(phrase[:k]) for k in range(1, len(phrase)))


def apart(found: Column, phrases: list[str]) -> Column:
    """Of ``occurrences`` those that a search gives which goes on behind each: none overlaps one of the same phrase before it."""
    tangled = [p for p in phrases if overlaps_itself(p)]
    if not tangled:
        return found

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["start"] + F.length(x["phrase"])).otherwise(end), F.when(free, x)

    def clear(xs: Column) -> Column:
        of = lambda p: F.filter(xs, lambda x: x["phrase"] == p)
        mine = [of(p) for p in tangled]
        kept = [F.filter(scanned(m, F.lit(0), step, "int", OCCURRENCE), lambda x: x.isNotNull()) for m in mine]
        return F.concat(F.filter(xs, lambda x: ~x["phrase"].isin(tangled)), *kept)

    return let(found, clear)


def firsts(found: Column) -> Column:
    """Of ``occurrences`` the first of each phrase."""

    def step(seen: Column, x: Column) -> tuple[Column, Column]:
        new = ~F.array_contains(seen, x["phrase"])
        return F.when(new, F.array_append(seen, x["phrase"])).otherwise(seen), F.when(new, x)

    return F.filter(scanned(found, F.array().cast("array<string>"), step, "array<string>", OCCURRENCE), lambda x: x.isNotNull())
