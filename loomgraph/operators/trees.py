"""Dependency trees as intervals: pre-order numbers, under which a subtree is a range."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

if TYPE_CHECKING:
    from loomgraph.operators.annotate import Annotations


def preorder(row: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pre, size) of the nodes of many forests laid out one after the other.

    ``row``: the forest of each node, ascending; ``parent``: each node's parent, itself or negative if it
    has none. ``pre`` numbers a forest's nodes from 0 so that the subtree of a node is the ``size``
    numbers from its own; children come in the order of nodes. What hangs on a cycle
    is in no tree: it comes last, each node for itself.
    """
    n = len(row)
    node = np.arange(n)
    root = (parent < 0) | (parent == node)
    # children by parent; each level is the children of the level above, so all trees are walked at once
    order = np.argsort(np.where(root, n, parent), kind="stable")[: n - int(root.sum())]
    first, last = (np.searchsorted(parent[order], node, side) for side in ("left", "right"))
    levels, now = [], np.flatnonzero(root)
    while len(now):
        levels.append(now)
        held = last[now] - first[now]
        at = np.repeat(first[now] - np.cumsum(held) + held, held) + np.arange(int(held.sum()))
        now = order[at]
    size, pre = np.ones(n, np.int64), np.full(n, -1, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    start = np.searchsorted(row, row)  # each node's forest
    for depth, level in enumerate(levels):
        group = start[level] if depth == 0 else parent[level]
        passed = np.cumsum(size[level]) - size[level]
        passed -= passed[np.searchsorted(group, group)] if depth == 0 else passed[_group_starts(group)]
        pre[level] = passed if depth == 0 else pre[parent[level]] + 1 + passed
    left = np.flatnonzero(pre < 0)
    if len(left):
        placed = np.bincount(row[pre >= 0], minlength=int(row[-1]) + 1)
        pre[left] = placed[row[left]] + np.arange(len(left)) - np.searchsorted(row[left], row[left])
    return pre, size


def _group_starts(group: np.ndarray) -> np.ndarray:
    """For each element the place of the first of its run of equal values."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def forests(a: Annotations) -> DataFrame:
    """(doc_id, para_idx, t): the tokens (i, head_i, sent_idx, dep, text) of a sentence or paragraph that no link leaves."""
    if a.nested is not None:
        token = lambda x, k: F.struct((F.col("first_i") + k).alias("i"), x["head_i"].alias("head_i"), F.col("sent_idx").alias("sent_idx"), x["dep"].alias("dep"), x["text"].alias("text"))
        return a.nested.select("doc_id", "para_idx", F.transform("toks", token).alias("t"))
    return a.tokens.groupBy("doc_id", "para_idx").agg(F.sort_array(F.collect_list(F.struct("i", "head_i", "sent_idx", "dep", "text"))).alias("t"))


def numbered(rows: DataFrame) -> DataFrame:
    """``forests`` with by_pre (the places of the tokens in pre-order), pre and size (by place)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("t")
            counts = np.asarray(pc.list_value_length(tokens))
            flat = tokens.flatten()
            i, head = (np.asarray(flat.field(c)).astype(np.int64) for c in ("i", "head_i"))
            row = np.repeat(np.arange(len(counts)), counts)
            key, wanted = row << 32 | i, row << 32 | np.maximum(head, 0)
            at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
            pre, size = preorder(row, np.where(key[at] == wanted, at, -1) if len(key) else at)
            start = np.cumsum(counts) - counts
            by_pre = np.empty(len(row), np.int64)
            by_pre[start[row] + pre] = np.arange(len(row)) - start[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (by_pre, pre, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "by_pre", "pre", "size"])

    numbers = [StructField(c, ArrayType(IntegerType())) for c in ("by_pre", "pre", "size")]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *numbers]))


def subtrees(a: Annotations, deps: list[str]) -> DataFrame:
    """(doc_id, para_idx, sent_idx, head, dep, members, text) of the tokens with one of ``deps``: all tokens below them, in order."""
    rows = numbered(forests(a).filter(F.exists("t", lambda x: x["dep"].isin(deps))))
    heads = rows.select("doc_id", "para_idx", "t", "by_pre", F.explode_outer(F.filter(F.arrays_zip("t", "pre", "size"), lambda x: x["t"]["dep"].isin(deps))).alias("h")).filter("h is not null")
    places = F.sort_array(F.slice("by_pre", F.col("h.pre") + 1, F.col("h.size")))
    held = heads.select("doc_id", "para_idx", "h", F.transform(places, lambda k: F.get("t", k)).alias("m"))
    return held.select("doc_id", "para_idx", "h.t.sent_idx", F.col("h.t.i").alias("head"), "h.t.dep", F.col("m.i").alias("members"), F.array_join("m.text", " ").alias("text"))
