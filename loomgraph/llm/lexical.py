"""Ranked lexical search over a tiered index: exact top k documents of each item.

Terms are the maximal runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased. With N documents
that have a term, L terms in all, n terms in a document and df documents that hold a term, a
term's weight w is floor(1000 ln((2N+2)/(2df+1))), a document's m is 100-50+((50nN) div L),
and a posting's impact is w ((1000000000 tf) div (1000 tf + 20 m)). A score sums the impacts of the
item's distinct terms. Ties go to the smaller doc_id.

Method: one pass cuts the whole texts and keeps, for each document, n and the (term, tf) of the terms that
items ask for. Counts of postings by quantised impact give each term its tiers: tier 0 holds its
highest impacts (``TIERS[0]`` postings at most), tier 1 the next, the last tier all others. The
index has a row a document and columns a tier, so a search of the upper tiers reads only
their columns, and a document's postings of a tier stand together: no shuffle adds them up.
An item's search begins in tier 0. The k-th best partial score is a lower bound of its k-th score; a
document not seen yet reaches at most the sum of its terms' residual bounds, the highest impacts below the
tier. If that is below the lower bound, the tier proves which documents can be in the result;
if not, the item falls through to the next tier. In a last pass each item's candidates
(partial score plus the residuals of terms not seen reaches the bound) get their exact scores from all tiers;
items without a proof are scored whole.

Scale: documents are never shuffled. A task returns k rows an item at most, which meet by (item, a
64th of the tasks) and then by item. Items are taken in groups of ``GROUP_ITEMS``, each with a pass over the texts;
what tasks get is the terms of one group.

Defined results: a text that is null or has no term counts nowhere. Rows without an id count in N, L
and df but aren't returned. Repeated ids and rows are documents of their own; so are items.
An item without terms gives no rows, nor does an empty table. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ranges import numbered
from loomgraph.llm.common import bounded_batches, byte_view, slices, stored, tidy
from loomgraph.llm.hashing import Words, distinct, gathered

TOP = 50
#: Postings of a term in tier 0, and in tiers 0 and 1; the last tier has the rest
TIERS = (4096, 65536)
GROUP_ITEMS = 1024
BUCKET_BITS = 14
SLICE_BYTES = 1 << 20
#: What a term can't hold: ASCII but letters and digits
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[SEPARATORS] = 0x20


def cut(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct terms (each with a blank after it), the place among them of each term of the texts, and how many each text has."""
    words = Words(*byte_view(texts), SEPARATORS, FOLDED)
    terms, which = distinct(words.data, words.starts)
    return terms, which, words.counts


def asked_terms(items: DataFrame, item_text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and terms (distinct) of each item."""
    schema = items.select(*keep).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, which, n = cut(batch.column(len(keep)))
            ends = np.cumsum(n)
            of = [np.unique(which[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
            flat = terms.take(pa.array(np.concatenate([np.zeros(0, np.int64), *of]))).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, of)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "terms"])

    bounded_batches(items.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return items.select(*keep, F.col(item_text).cast("string")).mapInArrow(tidy(run), f"{kinds}, terms array<binary>")


def lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    sizes = np.asarray(pc.list_value_length(column))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(sizes)), sizes)


def forward(docs: DataFrame, doc_id: str, text: str, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, tids, tfs) of each document with a term; tids are places in ``terms``, in ascending order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms, pa.large_binary())
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                found, which, n = cut(batch.column(1)[a:b])
                tid = np.asarray(pc.fill_null(pc.index_in(found, value_set=asked), -1))[which]
                doc = np.repeat(np.arange(len(n)), n)[tid >= 0]
                key, tf = np.unique(doc * max(1, len(terms)) + tid[tid >= 0], return_counts=True)
                counts = np.bincount(key // max(1, len(terms)), minlength=len(n))
                rows = [batch.column(0)[a:b], pa.array(n), lists(key % max(1, len(terms)), counts), lists(tf, counts)]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n", "tids", "tfs"]).filter(pa.array(n > 0))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(tidy(run), "doc_id bigint, n bigint, tids array<int>, tfs array<int>")


@dataclass
class Index:
    """A row a document: doc_id, n and, for each tier t, tids<t> and tfs<t>; and what is known of each term."""

    table: DataFrame
    n_docs: int
    n_terms: int
    #: Of each term: df, weight, and for each tier but the last the least bucket in it or above and the largest value below it
    df: np.ndarray
    weight: np.ndarray
    lowest: np.ndarray
    below: np.ndarray


def value(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's impact without its term's weight."""
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def bucket(values: np.ndarray) -> np.ndarray:
    return values >> BUCKET_BITS


def build(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS) -> Index | None:
    """The tiered index of the ``terms`` (as ``cut`` gives them); None if no document has a term."""
    rows = stored(forward(docs, doc_id, text, terms), "lexical-forward")
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None

    def valued(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        tid, doc = flattened(batch.column("tids"))
        tf = flattened(batch.column("tfs"))[0].astype(np.int64)
        return tid, doc, tf, value(tf, np.asarray(batch.column("n"))[doc], n_docs, n_terms)

    def histogram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, _, _, values = valued(batch)
            key, at = np.unique(tid.astype(np.int64) << 32 | bucket(values), return_inverse=True)
            top = np.zeros(len(key), np.int64)
            np.maximum.at(top, at, values)
            columns = [key >> 32, key & 0xFFFFFFFF, np.bincount(at, minlength=len(key)), top]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["tid", "bucket", "n", "top"])

    counted = rows.drop("doc_id").mapInArrow(histogram, "tid bigint, bucket bigint, n bigint, top bigint").groupBy("tid", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    upto = F.sum("n").over(Window.partitionBy("tid").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("upto", upto)
    known = [F.sum("n").alias("df")]
    for t, most in enumerate(tiers):
        known += [F.min(F.when(F.col("upto") <= most, F.col("bucket"))).alias(f"low{t}"), F.max(F.when(F.col("upto") > most, F.col("top"))).alias(f"below{t}")]
    # a row for each term asked
    of_terms = counted.groupBy("tid").agg(*known).toPandas()
    df, lowest, below = np.zeros(len(terms), np.int64), np.full((len(tiers), len(terms)), 1 << 40), np.zeros((len(tiers), len(terms)), np.int64)
    tid = of_terms["tid"].to_numpy(np.int64)
    df[tid] = of_terms["df"].to_numpy(np.int64)
    for t in range(len(tiers)):
        lowest[t, tid] = of_terms[f"low{t}"].fillna(1 << 40).to_numpy(np.int64)
        below[t, tid] = of_terms[f"below{t}"].fillna(0).to_numpy(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def tiered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, doc, tf, values = valued(batch)
            tier = (bucket(values)[None, :] < lowest[:, tid]).sum(0)
            columns, names = [batch.column("doc_id"), batch.column("n")], ["doc_id", "n"]
            for t in range(len(tiers) + 1):
                counts = np.bincount(doc[tier == t], minlength=batch.num_rows)
                columns += [lists(tid[tier == t], counts), lists(tf[tier == t], counts)]
                names += [f"tids{t}", f"tfs{t}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "".join(f", tids{t} array<int>, tfs{t} array<int>" for t in range(len(tiers) + 1))
    return Index(stored(rows.mapInArrow(tidy(tiered), f"doc_id bigint, n bigint{kinds}"), "lexical-index"), n_docs, n_terms, df, weight, lowest, below)


class Asked:
    """Items as postings by term: ``items[offsets[t] : offsets[t + 1]]`` ask for term t."""

    def __init__(self, of_items: list[np.ndarray], which: list[int], n_terms: int):
        item = np.repeat(np.array(which, np.int64), [len(of_items[i]) for i in which])
        tid = np.concatenate([np.zeros(0, np.int64), *(of_items[i] for i in which)])
        self.items = item[np.argsort(tid, kind="stable")]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(tid, minlength=n_terms))])

    def add(self, sums: np.ndarray, doc: np.ndarray, tid: np.ndarray, amount: np.ndarray) -> None:
        """sums[doc, item] += amount for each posting and each item that asks for its term."""
        items, n = gathered(self.items, self.offsets, tid)
        np.add.at(sums.reshape(-1), np.repeat(doc, n) * sums.shape[1] + items, np.repeat(amount, n))


class Best:
    """The k best (score, id) of each item among the rows that it is given."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.rows, self.held = floors.copy(), k, [], 0

    def add(self, ids: np.ndarray, doc: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        self.rows.append((item, score, ids[doc]))
        self.held += len(item)
        if self.held > 8 * self.k * len(self.floors):
            self.rows = [self.kept()]
            self.held = len(self.rows[0][0])

    def kept(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        item, score, doc_id = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((doc_id, -score, item))
        item, score, doc_id = item[order], score[order], doc_id[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        last = rank == self.k - 1
        self.floors[item[last]] = np.maximum(self.floors[item[last]], score[last])
        return tuple(x[rank < self.k] for x in (item, score, doc_id))


def best(rows: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score): the k best of each item."""
    for keys in (["item", "share"], ["item"]):
        window = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        rows = rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return rows.select("item", "rank", "doc_id", "score")


def search(index: Index, of_items: list[np.ndarray], k: int = TOP) -> tuple[DataFrame, list[int]]:
    """(item, rank, doc_id, score) of items given as arrays of term places, and the tier that proves each item (the last proves all)."""
    n_items, last = len(of_items), len(index.below)
    weight, below, n_docs, n_terms = index.weight, index.below, index.n_docs, index.n_terms
    residual = np.array([[int((weight[x] * b[x]).sum()) for x in of_items] for b in below] + [[0] * n_items], np.int64)
    floors, proof = np.zeros(n_items, np.int64), np.full(n_items, last)

    def scan(tiers: int, of_batch: Callable) -> DataFrame:
        """The best rows of each task, of documents with their postings in the first ``tiers`` tiers."""
        start, share = floors.copy(), F.pmod(F.spark_partition_id(), F.lit(64))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Best(start, k)
            for batch in batches:
                batch = batch.filter(batch.column("doc_id").is_valid())
                n, ids, held = np.asarray(batch.column("n")), np.asarray(batch.column("doc_id")), []
                for t in range(tiers):
                    tid, doc = flattened(batch.column(f"tids{t}"))
                    held.append((doc, tid, weight[tid] * value(flattened(batch.column(f"tfs{t}"))[0].astype(np.int64), n[doc], n_docs, n_terms)))
                sums, allowed = of_batch(held, len(n))
                doc, item = np.nonzero((sums > 0) & allowed & (sums >= top.floors))
                top.add(ids, doc, item, sums[doc, item])
            item, score, doc_id = top.kept()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, score, doc_id)], names=["item", "score", "doc_id"])

        columns = [c for t in range(tiers) for c in (f"tids{t}", f"tfs{t}")]
        found = index.table.select("doc_id", "n", *columns).mapInArrow(tidy(run), "item bigint, score bigint, doc_id bigint")
        return found.withColumn("share", share)

    for tier in range(last):
        left = np.flatnonzero(proof == last).tolist()
        if not left:
            break
        asked = Asked(of_items, left, len(weight))

        def partial(held: list, n: int, asked=asked) -> tuple:
            sums = np.zeros((n, n_items), np.int64)
            for x in held:
                asked.add(sums, *x)
            return sums, True

        # a row an item
        for r in best(scan(tier + 1, partial), k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).collect():
            floors[r["item"]] = max(floors[r["item"]], r["kth"])
        for i in left:
            if residual[tier, i] < floors[i]:
                proof[i] = tier

    groups = [(t, Asked(of_items, np.flatnonzero(proof == t).tolist(), len(weight))) for t in sorted(set(proof.tolist()))]
    bound, of_proof = floors.copy(), residual[proof, np.arange(n_items)]

    def exact(held: list, n: int) -> tuple:
        """Scores of the documents that an item's tier doesn't exclude."""
        sums, unseen = np.zeros((n, n_items), np.int64), np.tile(of_proof, (n, 1))
        for t, asked in groups:
            for doc, tid, amount in held[: t + 1]:
                asked.add(sums, doc, tid, amount)
                if t < last:
                    asked.add(unseen, doc, tid, -weight[tid] * below[t][tid])
        allowed = (sums > 0) & (sums + unseen >= bound)
        for t, asked in groups:
            if t < last:
                # the lower tiers' postings of documents with a candidate
                some = allowed[:, np.unique(asked.items)].any(1)
                for doc, tid, amount in held[t + 1 :]:
                    asked.add(sums, doc[some[doc]], tid[some[doc]], amount[some[doc]])
        return sums, allowed

    return best(scan(last + 1, exact), k), proof.tolist()


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = stored(asked_terms(numbered(asked, [], ["item_id", "text"], "number"), "text", ["number", "item_id"]), "lexical-items")
    parts = []
    for group in range(-(-asked.count() // GROUP_ITEMS)):
        mine = asked.filter(F.expr(f"number div {GROUP_ITEMS} = {group}"))
        of_items = [(r["number"], r["terms"]) for r in mine.select("number", "terms").orderBy("number").collect()]
        terms = sorted({bytes(t) for _, x in of_items for t in x})
        place = {t: i for i, t in enumerate(terms)}
        index = build(docs, terms, doc_id, text, tiers)
        if index is None:
            break
        found, _ = search(index, [np.array(sorted(place[bytes(t)] for t in x), np.int64) for _, x in of_items], k)
        parts.append(found.withColumn("number", F.col("item") + of_items[0][0]))
    if not parts:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
