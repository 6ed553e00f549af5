"""Benchmark decontamination: find item-sized windows of documents that repeat benchmark items.

Method: words are runs of letters and digits of the lower-cased text (all bytes beyond
ASCII count as letters). An item of m words is compared with every window of m words of a
document (a shorter document is one window). Item and windows have a SimHash of their
shingles (``WIDTH`` words; the whole text if shorter), each weighted by how often it
occurs. Item fingerprints are indexed by blocks of 16 bits: two fingerprints that differ in at
most ``RADIUS`` bits differ in at most ``BALLS[b]`` bits in one block ``b``, for if all
differed in more, these would be more than ``RADIUS`` bits. So each block's table lists every item within its ball
(4 or 3 bits: 9.8 % of all values in the four blocks together). Each window's fingerprint
looks its blocks up; what the tables return is checked on the complete distance, then by the
exact weighted-shingle similarity (sum of smaller over sum of larger multiplicities),
which must reach ``SIMILARITY``.

A window whose similarity to an item of s shingles reaches t holds at least
t / (1 + t) x (shingles of the window + s) shingles of that item. Windows with fewer
shingles of all items together have no fingerprint made; this leaves none out, and
tells nothing of which item it could be. An item of m < ``WIDTH``
words is one shingle, found in longer documents by windows of m words
if ``short`` is set, as the query and the pipeline do; else it matches whole documents only.
RADIUS is two and a half standard deviations above the distance expected at SIMILARITY.

Bounds: the items are read in groups of at most ``GROUP_WORDS`` words and ``GROUP_ITEMS`` items, whose
indexes are written to the shared folder. The documents are passed over once; a task holds one group's index at a time.

Defined results: null, empty and white-space texts match nothing, items without words
likewise; repeated items and documents are each judged; ties between windows go to the
first. Item ids are of any type, null included. Columns of the documents are kept; a column
named ``leaks`` is replaced. Empty tables give no leaks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import bounded_batches, byte_view, local_path, new_dir, release_memory, slices
from loomgraph.llm.hashing import Words, mixed, xxh64

WIDTH = 5
SIMILARITY = 0.8
BALLS = (4, 4, 3, 3)
RADIUS = sum(b + 1 for b in BALLS) - 1
GROUP_WORDS = 1 << 20
GROUP_ITEMS = 2000
SLICE_BYTES = 1 << 20
_U = np.uint64
WINDOWS_AT_ONCE = 1 << 14

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[_BETWEEN] = 0x20


def words_of(texts: pa.Array) -> Words:
    """Words of lower-cased texts."""
    data, offsets = byte_view(pc.utf8_lower(texts.cast(pa.large_string())))
    return Words(data, offsets, _BETWEEN, _FOLD)


def shingle_hashes(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, its first word, shingles of each text)."""
    each = xxh64(words.data, words.starts, words.ends - words.starts)
    first, last, n = words.shingles(width)
    out = mixed((last - first + 1).astype(np.uint64))
    with np.errstate(over="ignore"):
        for j in range(width):
            inside = first + j <= last
            out = np.where(inside, mixed(out * _U(0x9E3779B97F4A7C15) + each[np.minimum(first + j, last)]), out)
    return out, first, n


def simhash(hashes: np.ndarray) -> np.uint64:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0]


def sliding_simhashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger multiplicities of two bags of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


@dataclass
class Sized:
    """The items of one number of words: their places in the group, shingles and fingerprints, and a table for each block."""

    items: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # by block: values in order, and for each an item in whose ball it is

    @classmethod
    def build(cls, items: list[int], shingles: list[np.ndarray], balls: tuple[int, ...]) -> Sized:
        prints = np.array([simhash(x) for x in shingles], np.uint64)
        width = 64 // len(balls)
        masks = np.arange(1 << width, dtype=np.uint64)
        tables = []
        for block, ball in enumerate(balls):
            part = (prints >> _U(block * width)) & _U((1 << width) - 1)
            values = (part[:, None] ^ masks[np.bitwise_count(masks) <= ball]).astype(np.uint16)
            held = np.repeat(np.arange(len(prints), dtype=np.int32), values.shape[1])
            order = np.argsort(values.ravel(), kind="stable")
            tables.append((values.ravel()[order], held[order]))
        return cls(np.array(items), shingles, prints, tables)

    def returned(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) pairs of each block's table."""
        width = 64 // len(self.tables)
        for block, (values, held) in enumerate(self.tables):
            value = ((prints >> _U(block * width)) & _U((1 << width) - 1)).astype(np.uint16)
            first, upto = (np.searchsorted(values[: len(held)], value, side) for side in ("left", "right"))
            n = upto - first
            at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            yield np.repeat(np.arange(len(prints)), n), held[at]

    def look_up(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints differ in at most ``radius`` bits, from the blocks' tables."""
        found = [np.zeros(0, np.int64)]
        for window, items in self.returned(prints):
            near = np.bitwise_count(self.prints[items] ^ prints[window]) <= radius
            found.append(window[near] * len(self.items) + items[near])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.items)))


@dataclass
class Index:
    """Shingles and fingerprints of a group of items."""

    sizes: dict[int, Sized]  # by number of words
    known: np.ndarray  # distinct shingles of items of WIDTH words or more, sorted
    filter: np.ndarray
    radius: int

    @classmethod
    def build(cls, texts: list[str], balls: tuple[int, ...] = BALLS) -> Index:
        words = words_of(pa.array(texts, pa.string()))
        hashes, _, n = shingle_hashes(words)
        ends = np.cumsum(n)
        own = [hashes[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        sizes = {}
        for m in sorted(set(words.counts.tolist()) - {0}):
            mine = np.flatnonzero(words.counts == m).tolist()
            sizes[m] = Sized.build(mine, [own[i] for i in mine], balls)
        known = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        maybe = np.zeros(1 << 20, bool)
        maybe[(known & _U((1 << 20) - 1)).astype(np.int64)] = True
        return cls(sizes, known, maybe, sum(b + 1 for b in balls) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of an item."""
        out = np.zeros(len(hashes), bool)
        maybe = np.flatnonzero(self.filter[(hashes & _U((1 << 20) - 1)).astype(np.int64)])
        if len(self.known):
            out[maybe] = self.known[np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)] == hashes[maybe]
        return out


def leaks_of(texts: pa.Array, index: Index, threshold: float = SIMILARITY, width: int = WIDTH, short: bool = False) -> list[list[tuple]]:
    """For each text the items found in it: (place of the item, start_word, n_words, similarity) of the best window.

    ``short``: items of fewer than ``width`` words are sought in longer texts as well.
    """
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    for a, b in slices(texts, SLICE_BYTES) if index.sizes else []:
        words = words_of(texts[a:b])
        hashes, _, n = shingle_hashes(words, width)
        held = np.concatenate([[0], np.cumsum(index.holds(hashes))])
        ends = np.cumsum(n)
        best: dict[tuple, tuple] = {}
        waiting: dict[int, list[tuple]] = {m: [] for m in index.sizes}  # by number of words: (text, its first shingle, size, starts, prints)
        for t in np.flatnonzero(held[ends] > held[ends - n]).tolist():
            lo, hi = int(ends[t] - n[t]), int(ends[t])
            for m, size, starts, prints in windows_of(hashes[lo:hi], int(words.counts[t]), held[lo : hi + 1], index, threshold, width):
                waiting[m].append((a + t, lo, size, starts, prints))
                if sum(len(w[3]) for w in waiting[m]) >= WINDOWS_AT_ONCE:
                    judge(waiting[m], hashes, index.sizes[m], index.radius, threshold, width, best)
                    waiting[m] = []
        for m, rest in waiting.items():
            judge(rest, hashes, index.sizes[m], index.radius, threshold, width, best)
        for t, place in sorted(best):
            out[t].append(best[t, place])
        for m in [m for m in index.sizes if m < width] if short else []:
            for t, item, start in short_items(words, index, m):
                out[a + t].append((item, start, m, 1.0))
    return out


def windows_of(hashes: np.ndarray, n_words: int, held: np.ndarray, index: Index, threshold: float, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words of the items, words of a window, first shingles, fingerprints) of a text's windows; ``held``: the number of items' shingles before each place."""
    places = np.flatnonzero(np.diff(held))
    for m in index.sizes:
        if min(m, n_words) < width and m != n_words:  # a text or item of one shingle equals its like only
            continue
        size = min(m, n_words)
        span, own = max(size - width + 1, 1), max(m - width + 1, 1)  # shingles of a window and of an item
        needed = max(1, int(np.ceil(threshold / (1 + threshold) * (span + own) - 1e-9)))
        last = len(hashes) - span
        if last < 0 or len(places) < needed:
            continue
        # windows that hold ``needed`` of the places: all that start between the last and the first of such a run
        first, upto = np.maximum(places[needed - 1 :] - span + 1, 0), np.minimum(places[: len(places) - needed + 1], last)
        mark = np.zeros(last + 2, np.int64)
        some = first <= upto
        np.add.at(mark, first[some], 1)
        np.add.at(mark, upto[some] + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1) if len(starts) else []:
            for k in range(0, len(run), WINDOWS_AT_ONCE):
                part = run[k : k + WINDOWS_AT_ONCE]
                yield m, size, part, sliding_simhashes(hashes[part[0] : part[-1] + span], span)


def judge(waiting: list[tuple], hashes: np.ndarray, sized: Sized, radius: int, threshold: float, width: int, best: dict[tuple, tuple]) -> None:
    """Look the windows up together, compare what is returned, and keep the first best window of each text and item."""
    if not waiting:
        return
    origin = np.repeat(np.arange(len(waiting)), [len(w[3]) for w in waiting])
    starts, prints = (np.concatenate([w[i] for w in waiting]) for i in (3, 4))
    for window, item in zip(*(x.tolist() for x in sized.look_up(prints, radius))):
        t, lo, size, *_ = waiting[origin[window]]
        s, place = int(starts[window]), int(sized.items[item])
        found = similarity(hashes[lo + s : lo + s + max(size - width + 1, 1)], sized.shingles[item])
        if found >= threshold and found > best.get((t, place), (0, 0, 0, 0.0))[3]:
            best[t, place] = (place, s, size, found)


def short_items(words: Words, index: Index, m: int) -> Iterator[tuple[int, int, int]]:
    """(text, place of the item, first word) of the first window equal to each item of ``m`` words, in texts of more words.

    Such an item is one shingle, and its fingerprint that shingle's hash.
    """
    hashes, _, n = shingle_hashes(words, m)
    seeds = np.flatnonzero(np.repeat(words.counts > m, n) & index.holds(hashes))
    sized, ends, seen = index.sizes[m], np.cumsum(n), set()
    for window, item in zip(*(x.tolist() for x in sized.look_up(hashes[seeds], index.radius))):
        s = int(seeds[window])
        t = int(np.searchsorted(ends, s, "right"))
        if sized.shingles[item][0] == hashes[s] and (t, item) not in seen:
            seen.add((t, item))
            yield t, int(sized.items[item]), s - int(ends[t] - n[t])


def item_groups(benchmark: DataFrame, item_id: str, text: str, most: int = GROUP_WORDS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts): the benchmark in groups of bounded size."""
    ids: list = []
    texts: list[str] = []
    size = 0
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item_id), F.col(text).cast("string"))
    for i, t in rows.toLocalIterator():
        n = t.count(" ") + 1
        if ids and (size + n > most or len(ids) == GROUP_ITEMS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if ids:
        yield ids, texts


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, short: bool = False, group_words: int = GROUP_WORDS) -> DataFrame:
    """``docs`` with ``leaks``, an array of (item_id, start_word, n_words, similarity), empty if clean.

    ``short``: items of fewer than ``WIDTH`` words are found inside longer documents as well.
    """
    id_type = benchmark.schema[item_id].dataType
    kind = f"array<struct<item_id: {id_type.simpleString()}, start_word: bigint, n_words: bigint, similarity: double>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
    names = [f.name for f in arrow.value_type]
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, groups = new_dir(spark, "items"), 0
    for group in item_groups(benchmark, item_id, item_text, group_words):
        files, path = local_path(folder)
        files.create_dir(path)
        with files.open_output_stream(f"{path}/{groups}") as out:
            pickle.dump((group[0], Index.build(group[1])), out)
        groups += 1

    def load(group: int) -> tuple[list, Index]:
        files, path = local_path(folder)
        with files.open_input_stream(f"{path}/{group}") as source:
            return pickle.load(source)

    @F.arrow_udf(kind)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = load(0) if groups == 1 else None
        for batch in batches:
            texts = pc.fill_null(batch, "")
            rows: list[list[dict]] = [[] for _ in range(len(texts))]
            for group in range(groups):
                ids, index = held or load(group)
                for row, leaks in zip(rows, leaks_of(texts, index, threshold, short=short)):
                    row += [dict(zip(names, (ids[x[0]], *x[1:]))) for x in leaks]
            yield pa.array(rows, arrow)
        release_memory()

    return docs.withColumn("leaks", judged(F.col(text).cast("string")))
