"""Near-duplicate groups of texts by SimHash classes, MinHash bands and exact similarity.

The similarity of two texts is that of their sets of shingles of ``WIDTH`` words (common
over all; words as in simhash.py, a shorter text is one shingle). Texts of ``SIMILARITY``
or more are linked, linked texts are one group.

Method: texts with equal bags of shingles (128 bits of sums over the shingles' hashes) are made one first. Each distinct
bag has a SimHash fingerprint of its shingles, and fingerprints within 3 bits are joined into classes as in simhash.py; its class is one key. At
0.8 some 10 bits differ, so each bag has ``BANDS`` keys of ``ROWS`` MinHash values as well. Bags that share a key are compared
exactly, all with all, as blocks of about ``BLOCK`` bags: common shingles are counted as
bits of a block's shared shingles, and only the links that join its parts are returned.
So the keys only choose what is compared; a pair at exactly 0.8 shares none with a probability of (1 - 0.8^5)^30, about 7 in a million, and less above it.

Skew: blocks of a large bucket are compared each in itself first. Pairs of wide blocks (of
``WIDE`` bags or ``WIDE_BYTES`` bytes) follow only where a bucket still holds several groups;
their rows grow with the square of that bucket's size over ``WIDE``: many texts that share a
key but stay just below the similarity. Copies are pre-aggregated map-side.

Defined results: null texts and texts without words are one group. Repeated ids and rows
are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import simhash
from loomgraph.llm.common import bounded_batches, byte_view, release_memory, slices, stored, tidy
from loomgraph.llm.graph import components
from loomgraph.llm.hashing import Words, mixed, xxh64

WIDTH = 5
SIMILARITY = (4, 5)  # as a fraction, so that the comparison is one of whole numbers
BANDS = 30
ROWS = 5
BLOCK = 32
WIDE, WIDE_BYTES = 512, 4 << 20
COLUMNS = 1 << 14
SLICE_BYTES = 1 << 20
KEY = ["__k1", "__k2"]
_U = np.uint64
_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).astype(np.uint32).reshape(BANDS, ROWS, 2)


def row_key(docs: DataFrame) -> list[Column]:
    """(__k1, __k2): 128 bits that tell rows apart unless all their columns are equal."""
    # a hash passes over nulls, so where they stand is hashed as well
    parts = [x for c in docs.columns for x in (docs[c].isNull(), docs[c])]
    return [F.xxhash64(F.lit(k), *parts).alias(k) for k in KEY]


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, and how many each has."""
    words = Words(*byte_view(texts))
    first, last, n = words.shingles(width)
    starts = words.starts[first]
    return xxh64(words.data, starts, words.ends[last] - starts), n


def sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits (two columns) that tell the bags of hashes apart; each bag begins at one of ``first``."""
    return np.stack([np.add.reduceat(mixed(hashes ^ flip), first) for flip in (_U(0), _U(0x9E3779B97F4A7C15))], 1)


def binaries(keys: np.ndarray) -> pa.Array:
    """Rows of two 64-bit values as binaries of 16 bytes."""
    ends = np.arange(len(keys) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the hash of its bag of shingles, its band keys, and its SimHash fingerprint."""
    bags, bands, prints = np.zeros((len(texts), 2), np.uint64), np.zeros((len(texts), BANDS), np.uint64), np.zeros(len(texts), np.uint64)
    with np.errstate(over="ignore"):
        for a, b in slices(texts, SLICE_BYTES):
            hashes, n = shingle_hashes(texts[a:b])
            some = np.flatnonzero(n)
            if not len(some):
                continue
            prints[a:b] = simhash.bit_majority(hashes, n)
            first = (np.cumsum(n) - n)[some]
            bags[a + some] = sums(hashes, first)
            high = (hashes >> _U(32)).astype(np.uint32)
            for k in range(BANDS):
                key = np.full(len(some), k + 1, np.uint64)
                for flip, times in _SEEDS[k]:
                    key = mixed(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat((high ^ flip) * (times | np.uint32(1)), first))
                bands[a + some, k] = key
    return bags, bands, prints


def marked_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__k1, __k2, doc_id, bag, bands, fp, bytes) of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, bands, prints = signatures(batch.column(3))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], binaries(bags), lists, pa.array(prints.view(np.int64)), pc.fill_null(pc.binary_length(batch.column(3)), 0).cast(pa.int64())], names=[*KEY, "doc_id", "bag", "bands", "fp", "bytes"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*row_key(docs), F.col(doc_id), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(run), f"__k1 bigint, __k2 bigint, doc_id {kind}, bag binary, bands array<bigint>, fp bigint, bytes bigint")


def distinct_shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct shingles, by hash."""
    hashes, n = shingle_hashes(texts, width)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((text, hashes))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def similar(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Which pairs of texts (a square of booleans) have the similarity."""
    hashes, text = distinct_shingles(texts, width)
    n = np.zeros(len(texts))
    size = np.bincount(text, minlength=len(n))
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, text = np.unique(column[shared], return_inverse=True)[1], text[shared]
    common = np.zeros((len(n), len(n)), np.int64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(n), COLUMNS), bool)
        part[text[i:j], column[i:j] - a] = True
        part = np.packbits(part, axis=1).view(np.uint64)
        for k in range(len(n)):
            common[k] += np.bitwise_count(part & part[k]).sum(1, dtype=np.int64)
    np.fill_diagonal(common, size)
    over, under = SIMILARITY
    return common * (over + under) >= over * (size[:, None] + size[None, :])


def joined(bags: list[bytes], near: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links (u, v) that join what ``near`` joins, one fewer than the bags of each part."""
    out, left = [], set(range(len(bags)))
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in [j for j in np.flatnonzero(near[i]).tolist() if j in left]:
                left.remove(j)
                todo.append(j)
                out.append((bags[i], bags[j]))
    return out


def links(lists: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(u, v) of similar bags that stand in one of the lists (bags); texts: (bag, text)."""

    def compare(rows: pa.Table) -> pa.Table:
        found = joined(rows["bag"].to_pylist(), similar(rows["text"].combine_chunks(), width))
        release_memory()
        return pa.table([pa.array(x, pa.binary()) for x in (zip(*found) if found else ([], []))], names=["u", "v"])

    members = lists.select(F.xxhash64("bags").alias("list"), F.explode("bags").alias("bag")).distinct()
    return members.join(texts, "bag").groupBy("list").applyInArrow(compare, "u binary, v binary")


def blocked(buckets: DataFrame, pairs: bool) -> DataFrame:
    """(bags): the blocks of the buckets' (band, bag, n, bytes) rows, or all pairs of a bucket's wide blocks."""
    wide = F.greatest(F.col("n") / WIDE, F.col("bytes") / WIDE_BYTES)
    parts = F.greatest(F.lit(1), F.ceil(wide if pairs else F.col("n") / BLOCK)).cast("int")
    rows = buckets.withColumn("parts", parts).withColumn("i", F.pmod(F.xxhash64("bag"), F.col("parts")).cast("int"))
    if pairs:
        rows = rows.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)"))).filter("i <> j or parts = 1")
    else:
        rows = rows.withColumn("j", F.col("i"))
    lists = rows.groupBy("band", F.least("i", "j"), F.greatest("i", "j")).agg(F.sort_array(F.collect_set("bag")).alias("bags"))
    return lists.filter(F.size("bags") > 1).select("bags").distinct()


def keyed(distinct: DataFrame) -> DataFrame:
    """(bag, size, band): the keys of distinct bags (bag, size, bands, fp), their SimHash class and their MinHash bands."""
    prints = stored(distinct.select("fp", F.col("fp").alias("rep")).distinct(), "fingerprints")
    roots = components(simhash.links(prints))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return known.select("bag", "size", F.explode(F.array_append("bands", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")))).alias("band"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__k1, __k2, doc_id, bag, component) of each row, by ``row_key``; rows of a group have the same component."""
    marked = stored(marked_rows(docs, doc_id, text), "signatures")
    distinct = stored(marked.groupBy("bag").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.max("bytes").alias("size")), "distinct-bags")
    banded = stored(keyed(distinct), "keys")
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    buckets = stored(banded.drop("size").join(sizes, "band"), "buckets")
    reps = distinct.join(buckets.select("bag").distinct(), "bag", "left_semi").select("bag", "rep.*")
    rows = docs.select(*row_key(docs), F.col(text).cast("string").alias("text"))
    texts = stored(rows.join(reps, KEY).select("bag", "text").dropDuplicates(["bag"]), "candidates")
    found = stored(links(stored(blocked(buckets, False), "blocks"), texts), "near-links")
    roots = stored(components(found), "near-roots")
    large = buckets.filter(F.col("n") > BLOCK)
    if large.limit(1).count():
        known = large.join(roots, large["bag"] == roots["node"], "left").withColumn("root", F.coalesce("root", "bag"))
        mixed_bands = known.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
        more = links(stored(blocked(large.join(mixed_bands, "band", "left_semi"), True), "block-pairs"), texts)
        roots = stored(components(found.unionByName(stored(more, "more-links"))), "near-roots")
    of_bag = distinct.select("bag").join(roots, F.col("bag") == roots["node"], "left").select("bag", F.coalesce("root", "bag").alias("component"))
    return marked.drop("bands", "fp", "bytes").join(of_bag, "bag").select(*KEY, "doc_id", "bag", "component")
