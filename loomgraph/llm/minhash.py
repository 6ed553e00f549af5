"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

A text's set holds its distinct shingles of ``WIDTH`` words (A-Z lower-cased; words as in
simhash.py; with fewer words the whole sequence is the one shingle). Texts whose sets have a
similarity (common over all) of 0.8 or more are linked, linked texts are one component.

Method: one permutation. Each shingle is hashed once (XXH64); the hash chooses one of
``BANDS`` x ``ROWS`` bins and a value, and a bin keeps its least value. Optimal densification:
an empty bin takes the value of the first filled bin in an order of its own, the same for all
sets. Equal sets are made one first. Sets that share a band of ``ROWS`` values stand in one
bucket. A bucket's candidates are a star: each set against the bucket's least set, n - 1
edges for n sets. Edges whose sizes exclude 0.8 go; the others are confirmed on full sets.

Completeness: a bucket's other pairs could be linked although neither is linked with the star's
centre. So where a bucket still holds several components besides its centre, its sets are
compared with each other, in blocks and then in pairs of wide blocks (near_dups.py).
Nothing is capped. The bands only choose what is compared: a pair at exactly 0.8 shares none
with a probability of (1 - 0.8^5)^30, about 7 in a million, and less above it.

Scale: a star is cut into chunks of ``CHUNK`` sets (or ``CHUNK_BYTES``), each with a copy of the
centre. Sets are confirmed against one centre first; the other edges follow only where they
would join two components. Texts move only for sets that share a bucket. Rows of buckets that stay just
below the similarity grow with the square of the bucket's size over near_dups.WIDE.

Defined results: null texts and texts without words have an empty set, n_shingles 0, and
their own id as component. Repeated ids and rows are rows like any other. Rows with a
null id link others; the component_id is the smallest id that isn't null, and null if there
is none; ``kept`` is false for a null id. An empty table gives an empty result. Extra columns
aren't returned. Shingles with equal 64-bit hashes in a pair count as equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, release_memory, slices, stored, tidy
from loomgraph.llm.graph import components
from loomgraph.llm.hashing import mixed
from loomgraph.llm.near_dups import BLOCK, KEY, SIMILARITY, SLICE_BYTES, binaries, blocked, distinct_shingles, links, row_key, sums

WIDTH = 2
BANDS = 30
ROWS = 5
CHUNK, CHUNK_BYTES = 64, 4 << 20
BINS = BANDS * ROWS
_U = np.uint64
_EMPTY = np.uint32(0xFFFFFFFF)
#: For each bin, all bins in the order in which it looks for a value
_ORDER = np.argsort(mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).reshape(BINS, BINS), axis=1, kind="stable")


def densified(bins: np.ndarray) -> np.ndarray:
    """``bins`` (a row for each set, ``_EMPTY`` where a bin has no value), filled up; rows without any value stay empty."""
    row, column = np.nonzero((bins == _EMPTY) & (bins != _EMPTY).any(1)[:, None])
    out = bins.copy()
    for step in range(BINS):
        if not len(row):
            break
        value = bins[row, _ORDER[column, step]]
        found = value != _EMPTY
        out[row[found], column[found]] = value[found]
        row, column = row[~found], column[~found]
    return out


def band_keys(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """The band keys of each set; (hash, text) are the sets' distinct shingles."""
    spread = mixed(hashes)
    place = ((spread >> _U(32)) * _U(BINS)) >> _U(32)
    value = np.minimum((spread & _U(0xFFFFFFFF)).astype(np.uint32), _EMPTY - np.uint32(1))
    bins = np.full(n_texts * BINS, _EMPTY)
    np.minimum.at(bins, text * BINS + place.astype(np.int64), value)
    bins = densified(bins.reshape(n_texts, BINS)).astype(np.uint64).reshape(n_texts, BANDS, ROWS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n_texts, 1))
    for r in range(ROWS):
        keys = mixed(keys * _U(0x9E3779B97F4A7C15) + bins[:, :, r])
    return keys


def signatures(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the size of its set, 128 bits that tell sets apart, and its band keys."""
    n, sets, bands = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.uint64), np.zeros((len(texts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for a, b in slices(texts, SLICE_BYTES):
            hashes, text = distinct_shingles(texts[a:b], width)
            n[a:b] = np.bincount(text, minlength=b - a)
            bands[a:b] = band_keys(hashes, text, b - a)
            order = np.argsort(text, kind="stable")
            some = np.flatnonzero(n[a:b])
            if len(some):
                sets[a + some] = sums(hashes[order], (np.cumsum(n[a:b]) - n[a:b])[some])
    return n, sets, bands


def marked_rows(docs: DataFrame, doc_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """(__k1, __k2, doc_id, n, set, bands, bytes) of each row; set is null where it is empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, bands = signatures(batch.column(3), width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            named = pc.if_else(pa.array(n > 0), binaries(sets), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), named, lists, pc.fill_null(pc.binary_length(batch.column(3)), 0).cast(pa.int64())], names=[*KEY, "doc_id", "n", "set", "bands", "bytes"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*row_key(docs), F.col(doc_id), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(run), f"__k1 bigint, __k2 bigint, doc_id {kind}, n bigint, set binary, bands array<bigint>, bytes bigint")


def shared(banded: DataFrame) -> DataFrame:
    """(band, set, n, bytes, held, all, c): the rows of buckets of several sets, with the number and bytes of its sets and its least, the centre."""
    held = banded.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.sum("bytes").alias("all"), F.min(F.struct("set", "n")).alias("c")).filter("held > 1")
    return banded.join(held, "band")


def stars(banded: DataFrame) -> DataFrame:
    """The stars of (band, set, n, bytes) rows."""
    return star_edges(shared(banded))


def star_edges(buckets: DataFrame) -> DataFrame:
    """(center, set, bytes): each bucket's sets against its least; pairs whose sizes exclude the similarity are left out."""
    over, under = SIMILARITY
    near = F.least("n", "c.n") * under >= F.greatest("n", "c.n") * over
    return buckets.filter((F.col("set") != F.col("c.set")) & near).select(F.col("c.set").alias("center"), "set", "bytes").distinct()


def confirmed(edges: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The (u, v) of the (center, set, bytes) edges whose full sets have the similarity."""
    over, under = SIMILARITY

    def compare(rows: pa.Table) -> pa.Table:
        order = np.argsort(~np.asarray(rows["is_center"]), kind="stable")  # the centre first
        rows = rows.take(order)
        hashes, text = distinct_shingles(rows["text"].combine_chunks(), width)
        size = np.bincount(text, minlength=len(order))
        common = np.bincount(text[np.isin(hashes, hashes[text == 0])], minlength=len(order))
        near = np.flatnonzero(common * under >= over * (size + size[0] - common))
        near = near[near > 0]
        members = rows["set"].combine_chunks()
        release_memory()
        return pa.table([pa.array([members[0].as_py()] * len(near), pa.binary()), members.take(pa.array(near))], names=["u", "v"])

    sizes = edges.groupBy("center").agg(F.greatest(F.lit(1), F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("bytes") / CHUNK_BYTES))).cast("int").alias("chunks"))
    dealt = edges.join(sizes, "center").select("center", F.pmod(F.xxhash64("set"), "chunks").cast("int").alias("chunk"), "set", F.lit(False).alias("is_center"))
    centers = sizes.select("center", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("center").alias("set"), F.lit(True).alias("is_center"))
    rows = stored(dealt.unionByName(centers), "star-chunks").join(texts, "set")
    return rows.groupBy("center", "chunk").applyInArrow(compare, "u binary, v binary")


def rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(set, root) of each set."""
    return sets.select("set").join(roots, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"))


def parts(distinct: DataFrame, docs: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """(node, root) of the distinct sets (set, n, bands, bytes, rep) that are linked, except the roots."""
    banded = stored(distinct.select("set", "n", "bytes", F.explode("bands").alias("band")), "bands")
    buckets = stored(shared(banded), "buckets")
    edges = stored(star_edges(buckets), "stars")
    buckets = buckets.select("band", "set", "held", "all", F.col("c.set").alias("center"))
    reps = distinct.join(buckets.select("set").distinct(), "set", "left_semi").select("set", "rep.*")
    rows = docs.select(*row_key(docs), F.col(text).cast("string").alias("text"))
    texts = stored(rows.join(reps, KEY).select("set", "text").dropDuplicates(["set"]), "set-texts")

    # one edge a set, then those of the others that would still join something
    first = edges.groupBy("set").agg(F.min(F.struct("center", "bytes")).alias("e")).select("e.center", "set", "e.bytes")
    found = stored(confirmed(first, texts, width), "star-links")
    roots = stored(components(found), "star-roots")
    node = rooted(distinct, roots)
    apart = edges.join(node, "set").join(node.select(F.col("set").alias("center"), F.col("root").alias("root2")), "center").filter("root <> root2")
    others = stored(apart.select("center", "set", "bytes"), "other-edges")
    if others.limit(1).count():
        more = stored(confirmed(others, texts, width), "star-links")
        if more.limit(1).count():
            found = found.unionByName(more)
            roots = stored(components(found), "star-roots")
    # what is left: buckets with several components besides the centre, which all have met
    for wide in (False, True):
        known = buckets.filter("set <> center" if not wide else f"held > {BLOCK}").join(rooted(distinct, roots), "set")
        several = known.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
        left = known.join(several, "band", "left_semi").select("band", F.col("set").alias("bag"), F.col("held").alias("n"), F.col("all").alias("bytes"))
        lists = stored(blocked(left, wide), "bucket-blocks")
        if lists.limit(1).count():
            more = stored(links(lists, texts.withColumnRenamed("set", "bag"), width), "bucket-links")
            if more.limit(1).count():
                found = found.unionByName(more)
                roots = stored(components(found), "bucket-roots")
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept for each row."""
    docs = docs.select(doc_id, text)
    marked = stored(marked_rows(docs, doc_id, text, width), "set-signatures")
    some = marked.filter("set is not null")
    least = F.min("doc_id").alias("least")
    distinct = stored(some.groupBy("set").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes"), F.first("n").alias("n"), least), "distinct-sets")
    roots = parts(distinct, docs, text, width)
    of_set = stored(rooted(distinct, roots).join(distinct.select("set", "least"), "set"), "set-roots")
    ids = of_set.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(of_set.join(ids, "root").select("set", "component_id"), "set-components")
    none = marked.filter("set is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = some.join(named, "set").select("doc_id", "n", "component_id").unionByName(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
