"""SimHash near-dedup by multi-index hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's shingles. Words are runs of bytes other than blank and 0x09-0x0D, with A-Z
lower-cased; shingles are ``width`` words joined by a blank, repeats included; a
shorter text is one shingle, a text without words has fingerprint zero.

Method: fingerprints are made distinct first, so copies meet once. Each distinct
fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at
most 3 bits differ in at most 1 bit in one of the segments. The table side holds each
segment; the probe side enumerates the segment's Hamming ball of radius 1. A pair that
differs in one bit of a segment has a 0 there on one side, so enumerating the 0 -> 1
flips (and the segment itself) meets every pair. Matches are verified on the complete
distance. Linked fingerprints are joined into components by star steps.

Skew: only distinct fingerprints enter the join; a segment that many share is split by
Spark's skew join (both sides are plain exchanges, never broadcast).

Defined results: null, empty and white-space texts have fingerprint zero and are linked
like any other. Repeated ids are separate rows with the component of their fingerprint.
Rows with a null id link others like any row; the component_id of a component is the
smallest id in it that isn't null, and null if it has none.
An empty table gives an empty result. Extra columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, byte_view, slices, stored, tidy
from loomgraph.llm.graph import components
from loomgraph.llm.hashing import Words, xxh64

RADIUS = 3
WIDTH = 3
SLICE_BYTES = 1 << 20
BITS_AT_ONCE = 1 << 16


def bit_majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the 64-bit value whose bits are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = (np.cumsum(counts) - counts)[some]
    sums = np.zeros((len(some), 64), np.int64)
    # bit planes of a bounded stretch of hashes at a time
    for a in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[a : a + BITS_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(part), "left")
        sums[i:j] += np.add.reduceat(bits, np.maximum(first[i:j] - a, 0), axis=0, dtype=np.int32)
    bits = (2 * sums > counts[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices(texts, SLICE_BYTES):
        words = Words(*byte_view(texts[a:b]))
        first, last, n = words.shingles(width)
        starts = words.starts[first]
        out[a:b] = bit_majority(xxh64(words.data, starts, words.ends[last] - starts), n)
    return out


def with_fingerprint(df: DataFrame, doc_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(batch.column(1), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    bounded_batches(df.sparkSession)
    return df.select(doc_id, F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) representatives of distinct fingerprints (fp, rep) that differ in at most ``radius`` (0 to 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 cover a radius of 3 at most")
    segment = F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")),
        F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")),
    ))
    cut = distinct.select("fp", "rep", segment.alias("s")).select("fp", "rep", "s.part", "s.value")
    ball = F.expr("concat(array(value), transform(filter(sequence(0, 31), i -> (shiftright(value, i) & 1) = 0), i -> value | shiftleft(1L, i)))")
    probes = cut.select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"), "part", F.explode(ball).alias("value"))
    apart = F.col("fp").bitwiseXOR(F.col("fp2"))
    near = (F.col("fp") != F.col("fp2")) & (F.bit_count(apart) <= radius)
    # Spark sizes an exploded row as the row it came from, so it would broadcast some 35 probes a fingerprint
    return cut.join(probes.hint("merge"), ["part", "value"]).filter(near).select(F.col("rep").alias("u"), F.col("rep2").alias("v"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, fingerprint (hex), component_id (smallest id reachable) for each row."""
    marked = stored(with_fingerprint(df, doc_id, text, width), "fingerprints")
    # fingerprints are the nodes, so that one that only rows without an id have still links others
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    of_fp = stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")
    ids = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    out = marked.join(stored(of_fp.join(ids, "root").select("fp", "component_id"), "component-ids"), "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
