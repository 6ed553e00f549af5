"""Suffix-array dedup: remove every byte of a string of ``LENGTH`` bytes that also starts earlier.

Texts are UTF-8 bytes; strings never cross documents; "earlier" is a smaller document id,
or an earlier start in the same document. Overlaps count, and strings are judged on the
input.

Method: repeats come out of suffix arrays, built by linear grouping (see ``suffix_sort``),
over those parts of the corpus that can hold any:

1. Anchors. Every window of ``LENGTH`` bytes is assigned to the position of its smallest
   ``GRAM``-byte hash (rightmost of equals). That depends on the window's bytes only, so
   equal windows have equal anchors at equal offsets. Consecutive windows with one anchor
   form a stretch, its context (at most 2 x LENGTH - GRAM bytes).
2. Contexts meet by anchor in one shuffle, equal ones (80 bits of two hashes beside the 48 of
   the anchor) next to each other. The second of equal contexts is paired with the first;
   where an anchor has several distinct contexts, the first of each is a candidate. Further
   copies are collapsed, first within a task: they repeat what the second repeats.
3. Pairs that go on in step through two documents are joined to runs, cut into pieces of
   ``PIECE`` windows. Candidates are keyed by the 66 or 67 bytes that each of their windows
   holds around the anchor (this splits frequent short strings), and trimmed to what
   another candidate of the key shares.
4. The two sides of a piece, and the candidates of a key, go into one suffix array;
   neighbours in it with 100 equal bytes (compared) are equal windows, of which all but the
   first are repeats.
5. Spans meet their documents again, are merged, and cut out.

So the second of equal windows is removed only if the array finds it equal to an earlier one. Third
and later copies of a context are removed because their hashes equal those of the first two, and the
windows of hot keys (see Skew) because of theirs, without the array. README has the shares.

Skew: a copied document is one row per anchor and task after step 2's local collapse; the
rows that are already known as repeats are dealt out by a hash of their place. Each context is
paired once in its task and once over all, so no document has more pairs than contexts, however
often it is copied. A key with more than ``MOST`` candidates is not gathered: its candidates are
sorted by what stands to their right and to their left, in ranges, and trimmed to what neighbours
share; the windows that are left meet by two 64-bit hashes, one row each, like contexts in step 2,
whose stream holds one row of state.

Defined results: null and empty texts have no bytes and no spans. Ids are integers, of any
size; documents that share an id come in the order of a hash of their text, each on its own.
Null ids sort first. An empty table gives an empty result. Extra columns aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, byte_view, release, slices, stored, tidy
from loomgraph.llm.hashing import mixed, xxh64
from loomgraph.llm.suffix_sort import suffix_arrays

LENGTH = 100
GRAM = 32
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
COLLAPSE_ROWS = 1 << 20
PIECE = 1000
MOST = 64
CUTS_AT_ONCE = 1 << 14
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of data[i : i + width] for each i, by doubling."""
    now = (data.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
    out, have, length, power = None, 0, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if width & length:
                if out is None:
                    out, have = now, length
                else:
                    n = len(data) - have - length + 1
                    out, have = out[:n] * power + now[have : have + n], have + length
            if 2 * length > width:
                return mixed(out)
            n = len(now) - length
            now = now[:n] * power + now[length:]
            length, power = 2 * length, power * power


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of values[i : i + width] (rightmost of equals) for each i."""
    at = np.arange(len(values), dtype=np.int32)
    length = 1

    def merged(values, at, step):
        a, b = values[:-step], values[step:]
        right = b <= a
        return np.minimum(a, b), np.where(right, at[step:], at[:-step])

    while 2 * length <= width:
        values, at = merged(values, at, length)
        length *= 2
    if width > length:
        values, at = merged(values, at, width - length)
    return at


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, c, text number, anchor, first window, last window) of each stretch; places within the text.

    h holds 48 bits of the anchor's hash and 16 of the context's, from its grams; c is another hash of the context.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    hashes = gram_hashes(data, GRAM)
    anchor = window_minima(hashes, LENGTH - GRAM + 1)
    sizes = np.diff(offsets)
    n = len(anchor)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    valid = np.flatnonzero(np.arange(n) + LENGTH <= offsets[1:][text])
    if not len(valid):
        return none
    of = anchor[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (of[1:] != of[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = valid[new]
    last = valid[np.append(np.flatnonzero(new)[1:], len(valid)) - 1]
    p = of[new].astype(np.int64)
    ctx = xxh64(data, first, last + LENGTH - first)
    mine = text[first]
    base = offsets[mine]
    grams, end = hashes[first], last + LENGTH - GRAM
    for k in range(1, -(-(2 * LENGTH - GRAM) // GRAM)):
        grams = mixed(grams * _BASE + hashes[np.minimum(first + k * GRAM, end)])
    h = (hashes[p] & ~_U(0xFFFF)) | (grams >> _U(48))
    return h.view(np.int64), (ctx ^ mixed((p - first).astype(np.uint64))).view(np.int64), mine, p - base, first - base, last - base


def packed_at(p, first, last):
    """Anchor, first and last window in one number, ordered by anchor."""
    return (p << 16) | ((p - first) << 8) | (p - last)


def unpacked_at(at):
    p = at >> 16
    return p, p - ((at >> 8) & 255), p - (at & 255)


SINGLE, REPEAT, PAIR = 0, 1, 2
ROWS = "kind byte, h bigint, c bigint, doc bigint, at bigint"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(kind, h, c, doc, at) over (doc, text): the first of equal contexts in a task, or a known repeat; of a PAIR, (h, c) is the place (doc, at) of the first."""

    def collapsed(parts: list[tuple]) -> pa.RecordBatch:
        h, c, doc, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at = h[order], c[order], doc[order], at[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        second = again.copy()
        second[1:] &= ~again[:-1]
        kind = np.where(again, np.where(second, PAIR, REPEAT), SINGLE)
        at_second = np.flatnonzero(second)
        h[again], c[again] = 0, 0
        h[at_second], c[at_second] = doc[at_second - 1], at[at_second - 1]
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), *(pa.array(x) for x in (h, c, doc, at))], names=["kind", "h", "c", "doc", "at"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        total = 0
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for a, b in slices(batch.column(1), SLICE_BYTES):
                h, c, text, *place = contexts(*byte_view(batch.column(1)[a:b], ""))
                parts.append((h, c, ids[a + text], packed_at(*place)))
                total += len(h)
                if total >= COLLAPSE_ROWS:
                    yield collapsed(parts)
                    parts, total = [], 0
        if parts:
            yield collapsed(parts)

    return docs.select("doc", "text").mapInArrow(tidy(run), ROWS)


def judged(rows: DataFrame) -> DataFrame:
    """(kind, doc, at, first_doc, first_at) of ``anchor_rows``: repeats, pairs with their firsts, and as SINGLE the first of each context whose anchor has several."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc, at) of a first row whose anchor has one context so far
        last = None  # (h, c, doc, at, whether it is its context's first) of the last row
        several = False
        none = np.zeros(0, np.int64)
        for batch in batches:
            kind, h, c, doc, at = (np.asarray(x) for x in batch.columns)
            out: list[tuple] = []

            def put(k, d, a, first_d=None, first_a=None):
                out.append((np.full(len(d), k, np.int8), d, a, np.zeros_like(d) if first_d is None else first_d, np.zeros_like(a) if first_a is None else first_a))

            put(REPEAT, doc[kind == REPEAT], at[kind == REPEAT])
            known = kind == PAIR
            put(PAIR, doc[known], at[known], h[known], c[known])
            h, c, doc, at = (x[kind == SINGLE] for x in (h, c, doc, at))
            if len(h):
                # the last row of the batch before stands in front
                front = last if last is not None else (~h[0], c[0], 0, 0, True)
                ph, pc_, pdoc, pat = (np.concatenate([[x], y[:-1]]) for x, y in zip(front, (h, c, doc, at)))
                new_h = h >> 16 != ph >> 16
                new_c = (h != ph) | (c != pc_)
                second = ~new_c & np.concatenate([[front[4]], new_c[:-1]])
                put(PAIR, doc[second], at[second], pdoc[second], pat[second])
                more = ~new_c & ~second
                put(REPEAT, doc[more], at[more])
                run_of = np.cumsum(new_h)  # 0: goes on from the batch before
                distinct = np.bincount(run_of, new_c, minlength=run_of[-1] + 1).astype(np.int64)
                if last is not None:
                    distinct[0] += 2 if several else 1
                many = distinct >= 2
                if held is not None:
                    if many[0]:
                        put(SINGLE, np.array([held[0]]), np.array([held[1]]))
                    if many[0] or run_of[-1] > 0:
                        held = None
                firsts = np.flatnonzero(new_c)
                ready = firsts[many[run_of[firsts]]]
                put(SINGLE, doc[ready], at[ready])
                tail = firsts[run_of[firsts] == run_of[-1]]
                if not many[-1] and len(tail):
                    held = (doc[tail[0]], at[tail[0]])
                last, several = (h[-1], c[-1], doc[-1], at[-1], bool(new_c[-1])), bool(many[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none.astype(x[0].dtype), *x])) for x in zip(*out)], names=["kind", "doc", "at", "first_doc", "first_at"])

    dealt = F.when(F.col("kind") == SINGLE, F.shiftright("h", 16)).otherwise(F.xxhash64("doc", "at"))
    ordered = rows.repartition(dealt).sortWithinPartitions("h", "c", "doc", "at")
    return ordered.mapInArrow(tidy(run), "kind byte, doc bigint, at bigint, first_doc bigint, first_at bigint")


def places(marks: DataFrame) -> DataFrame:
    """(doc, places): what is to be cut out of each document: candidates (role -1), and of pairs the first (0) and the second (1)."""
    pair = marks.filter(F.col("kind") == PAIR)
    step = F.shiftright("at", 16) - F.shiftright("first_at", 16)
    found = marks.filter(F.col("kind") == SINGLE).select("doc", F.struct(F.lit(-1).alias("role"), F.lit(0).cast("bigint").alias("other"), F.lit(0).cast("bigint").alias("step"), "at").alias("x"))
    found = found.unionAll(pair.select("doc", F.struct(F.lit(1).alias("role"), F.col("first_doc").alias("other"), step.alias("step"), "at").alias("x")))
    found = found.unionAll(pair.select(F.col("first_doc").alias("doc"), F.struct(F.lit(0).alias("role"), F.col("doc").alias("other"), step.alias("step"), F.col("first_at").alias("at")).alias("x")))
    return found.groupBy("doc").agg(F.collect_list("x").alias("places"))


CUTS = "key bigint, doc bigint, start bigint, anchor int, bytes binary"


def cut_out(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, doc, start, anchor, bytes): the strings to sort; anchor is -1 in pieces of pairs."""
    side = 2 * LENGTH - GRAM - LENGTH  # 68: the most that lies on one side of a gram
    half = side // 2

    def candidates(data, doc, base, at):
        p, first, last = unpacked_at(at)
        found = []
        # windows that hold the half before the gram, and those that hold the half after it
        for lo, hi, left, width, salt in ((np.maximum(first, p - half), last, 0, GRAM + half, 0), (first, np.minimum(last, p - half - 1), half + 1, GRAM + half + 1, 1)):
            ok = lo <= hi
            key = mixed(xxh64(data, (base + p - left)[ok], np.full(int(ok.sum()), width)) + _U(salt))
            found.append((key.view(np.int64), doc[ok], lo[ok], (p - lo)[ok], base[ok], (hi + LENGTH - lo)[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def pieces(doc, base, role, other, step, at):
        p, first, last = unpacked_at(at)
        order = np.lexsort((first, step, other, role, doc))
        doc, base, role, other, step, first, last = (x[order] for x in (doc, base, role, other, step, first, last))
        new = np.ones(len(doc), bool)
        new[1:] = first[1:] != last[:-1] + 1
        for x in (doc, role, other, step):
            new[1:] |= x[1:] != x[:-1]
        lead = np.flatnonzero(new)
        first, last = first[lead], last[np.append(lead[1:], len(doc)) - 1] if len(lead) else last
        n = -(-(last - first + 1) // PIECE)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc, base, role, other, step, first, last = (np.repeat(x, n) for x in (doc[lead], base[lead], role[lead], other[lead], step[lead], first, last))
        first = first + k * PIECE
        last = np.minimum(last, first + PIECE - 1)
        # both sides of a pair name it by the first document, the second, and the place in the second
        key = np.zeros(len(doc), np.uint64)
        for x in (np.where(role == 0, doc, other), np.where(role == 0, other, doc), step, np.where(role == 0, first + step, first)):
            key = mixed(key * _BASE + x.view(np.uint64) + _U(1))
        return key.view(np.int64), doc, first, np.full(len(doc), -1), base, last - first + LENGTH

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES):
                data, offsets = byte_view(batch.column(1)[a:b], "")
                lists = batch.column(2)[a:b]
                n = np.asarray(lists.value_lengths(), np.int64)
                role, other, step, at = (np.asarray(lists.flatten().field(k), np.int64) for k in range(4))
                doc = np.repeat(np.asarray(batch.column(0)[a:b], np.int64), n)
                base = np.repeat(offsets[:-1], n)
                lone = role < 0
                found = candidates(data, doc[lone], base[lone], at[lone]), pieces(*(x[~lone] for x in (doc, base, role, other, step, at)))
                key, doc, start, rel, base, size = (np.concatenate(x) for x in zip(*found))
                raw = data.tobytes()
                for k in range(0, len(key), CUTS_AT_ONCE):
                    mine = slice(k, k + CUTS_AT_ONCE)
                    cut = [raw[i : i + m] for i, m in zip((base + start)[mine].tolist(), size[mine].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(key[mine]), pa.array(doc[mine]), pa.array(start[mine]), pa.array(rel[mine].astype(np.int32)), pa.array(cut, pa.binary())], names=["key", "doc", "start", "anchor", "bytes"])

    return docs.join(places(marks), "doc").select("doc", "text", "places").mapInArrow(tidy(run), CUTS)


def shared_reach(group: np.ndarray, strings: list[bytes], width: int) -> np.ndarray:
    """How many leading bytes each string shares with another one of its group, at most ``width``."""
    if not strings:
        return np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), np.uint8).reshape(-1, width)
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), table], 1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), kind="stable")
    same = table[order][1:] == table[order][:-1]
    common = np.where(same.all(1), width, same.argmin(1))
    common = np.minimum(common, np.minimum(sizes[order][1:], sizes[order][:-1]))
    common[group[order][1:] != group[order][:-1]] = 0
    out = np.zeros(len(strings), np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def repeats_of(key: np.ndarray, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, cut: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first window, last window) of repeated windows among strings, sorted by key, doc, start."""
    new = np.diff(key, prepend=~key[:1]) != 0
    group = np.cumsum(new) - 1
    keep = np.bincount(group, minlength=1)[group] > 1
    anchor = anchor.astype(np.int64)
    lone = np.flatnonzero(keep & (anchor >= 0))
    # what no other candidate shares can't repeat
    right = shared_reach(group[lone], [cut[i][anchor[i] :] for i in lone.tolist()], LENGTH)
    left = shared_reach(group[lone], [cut[i][: anchor[i]][::-1] for i in lone.tolist()], LENGTH)
    ok = left + right >= LENGTH
    trimmed = zip(lone[ok].tolist(), left[ok].tolist(), right[ok].tolist())
    pairs = np.flatnonzero(keep & (anchor < 0))
    group, doc, start = (np.concatenate([x[pairs], x[lone[ok]]]) for x in (group, doc, start + np.maximum(anchor, 0)))
    strings = [cut[i] for i in pairs.tolist()] + [cut[i][anchor[i] - m : anchor[i] + r] for i, m, r in trimmed]
    start[len(pairs) :] -= left[ok]
    return sorted_repeats(group, doc, start, strings)


def sorted_repeats(group: np.ndarray, doc: np.ndarray, start: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first window, last window) of windows that an earlier one in the group equals, by a suffix array of each group's strings."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    new = np.diff(group, prepend=-1) != 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(group)))
    some = np.repeat(n > 1, n)
    if not some.any():
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    if not some.all():
        return sorted_repeats(group[some], doc[some], start[some], [x for x, k in zip(strings, some.tolist()) if k])
    # each string ends in a symbol of its own, below all bytes; the last of a group is the smallest
    data = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = data.astype(np.int64) + np.repeat(np.repeat(n, n), sizes + 1)
    text[begin + sizes] = np.repeat(n + first, n) - 1 - np.arange(len(group))
    array = suffix_arrays(text, np.append(begin[first], len(data)))
    of = np.repeat(np.arange(len(group)), sizes + 1)[array]
    window = array - begin[of] + LENGTH <= sizes[of]
    array, of = array[window], of[window]
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))
    same = np.flatnonzero(group[of[1:]] == group[of[:-1]])
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same = same[words[array[same] + k] == words[array[same + 1] + k]]
    fresh_ = np.ones(len(array), bool)
    fresh_[same + 1] = False
    run = np.cumsum(fresh_) - 1
    many = np.bincount(run, minlength=1)[run] > 1
    array, of, run = array[many], of[many], run[many]
    d, s = doc[of], start[of] + array - begin[of]
    order = np.lexsort((s, d, run))
    d, s, run = d[order], s[order], run[order]
    lead = np.flatnonzero(np.diff(run, prepend=-1))
    lead = np.repeat(lead, np.diff(np.append(lead, len(run))))
    # a document's window may stand in two strings; it is no repeat of itself
    again = (d != d[lead]) | (s != s[lead])
    d, s = d[again], s[again]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    first = np.flatnonzero(new)
    return d[first], s[first], s[np.append(first[1:], len(d)) - 1] if len(first) else s[:0]


def common_with_next(key: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """How many leading bytes each string shares with the next one, if that has the same key."""
    sizes = np.fromiter(map(len, sides), np.int64, len(sides))
    width = max(1, int(sizes.max(initial=0)))
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(-1, width)
    same = table[1:] == table[:-1]
    common = np.where(same.all(1), width, same.argmin(1))
    return np.where(key[1:] == key[:-1], np.minimum(common, np.minimum(sizes[1:], sizes[:-1])), 0)


def with_reach(cuts: DataFrame, name: str, side: str) -> DataFrame:
    """``cuts`` with ``name``: how many bytes of ``side`` any other candidate of the key shares at most.

    Neighbours in the order of (key, side) tell. Ranges of that order are dealt out, so a key of
    any size is split; the first and last row of a range take their whole length, which is never too little.
    """
    columns = [c for c in cuts.columns if c not in (side, name)]
    kinds = {f.name: f.dataType.simpleString() for f in cuts.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last row, whose next one isn't known yet
        before = None  # what it shares with the one before
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not len(table):
                continue
            sides = table[side].to_pylist()
            common = common_with_next(np.asarray(table["key"]), sides)
            first = np.array([len(sides[0]) if before is None else before])
            reach = np.maximum(np.concatenate([first, common])[:-1], common)
            yield from table.slice(0, len(table) - 1).select(columns).append_column(name, pa.array(reach.astype(np.int32))).to_batches()
            held, before = table.slice(len(table) - 1), (int(common[-1]) if len(common) else first[0])
        if held is not None:
            yield from held.select(columns).append_column(name, pa.array([len(held[side][0].as_py())], pa.int32())).to_batches()

    ranged = cuts.repartitionByRange("key", side).sortWithinPartitions("key", side)
    return ranged.mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c]}" for c in columns) + f", {name} int")


def windows_of(cuts: DataFrame) -> DataFrame:
    """Rows like ``anchor_rows`` for the windows that some candidates may share, which meet by hash alone; collapsed within a task."""
    mirrored = F.arrow_udf(lambda x: pa.array([y[::-1] for y in x.to_pylist()], pa.binary()), "binary")
    sided = cuts.withColumn("right_side", F.expr("substring(bytes, anchor + 1)")).withColumn("left_side", mirrored(F.expr("substring(bytes, 1, anchor)")))
    reached = with_reach(stored(with_reach(stored(sided, "hot-strings"), "right_reach", "right_side"), "hot-right"), "left_reach", "left_side")
    trimmed = reached.filter(F.col("left_reach") + F.col("right_reach") >= LENGTH).select(
        "doc", (F.col("start") + F.col("anchor") - F.col("left_reach")).alias("start"), F.expr("substring(bytes, anchor - left_reach + 1, left_reach + right_reach)").alias("bytes")
    )

    def collapsed(parts: list[tuple]) -> pa.RecordBatch:
        """The first of equal windows in a task; the others as stretches of repeats."""
        h, c, doc, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at = h[order], c[order], doc[order], at[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        d, s = doc[again], at[again]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
        run = np.cumsum(new) - 1
        inside = np.arange(len(d)) - np.flatnonzero(new)[run]
        new |= inside % 128 == 0  # what a packed place can tell
        first = np.flatnonzero(new)
        last = s[np.append(first[1:], len(d)) - 1] if len(first) else s
        kept = ~again
        kind = np.concatenate([np.full(len(first), REPEAT), np.full(int(kept.sum()), SINGLE)]).astype(np.int8)
        none = np.zeros(len(first), np.int64)
        places_ = np.concatenate([packed_at(last, s[first], last), packed_at(at[kept], at[kept], at[kept])])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([none, h[kept]])), pa.array(np.concatenate([none, c[kept]])), pa.array(np.concatenate([d[first], doc[kept]])), pa.array(places_)], names=["kind", "h", "c", "doc", "at"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        total = 0
        for batch in batches:
            for a, b in slices(batch.column(2), SLICE_BYTES):
                cut = batch.column(2)[a:b].cast(pa.large_binary())
                offsets = np.frombuffer(cut.buffers()[1], np.int64)[cut.offset : cut.offset + len(cut) + 1]
                data = np.frombuffer(cut.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(offsets[:-1], n) + inside
                full = np.full(len(at), LENGTH)
                place = np.repeat(np.asarray(batch.column(1)[a:b], np.int64), n) + inside
                parts.append((*(xxh64(data, at, full, seed).view(np.int64) for seed in (42, 43)), np.repeat(np.asarray(batch.column(0)[a:b], np.int64), n), place))
                total += len(at)
                if total >= COLLAPSE_ROWS:
                    yield collapsed(parts)
                    parts, total = [], 0
        if parts:
            yield collapsed(parts)

    return trimmed.mapInArrow(tidy(run), ROWS)


def sorted_contexts(cuts: DataFrame) -> DataFrame:
    """(doc, first, last): repeated windows of the contexts in question."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            found = repeats_of(*(np.asarray(table.column(i), np.int64) for i in range(4)), table.column(4).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc", "first", "last"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < BATCH_BYTES:
                continue
            table = pa.Table.from_batches(held)
            key = np.asarray(table.column(0))
            upto = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if upto:
                yield solve(table.slice(0, upto))
                table = table.slice(upto)
            held, size = table.to_batches(), table.nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    ordered = cuts.repartition(F.col("key")).sortWithinPartitions("key", "doc", "start")
    return ordered.mapInArrow(tidy(run), "doc bigint, first bigint, last bigint")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, id, n_bytes, n_removed, n_spans, spans, kept) of (doc, id, text) and windows (doc, first, last)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES):
                data, offsets = byte_view(batch.column(1)[a:b], "")
                lists = batch.column(2)[a:b]
                n = np.asarray(pc.fill_null(lists.value_lengths(), 0), np.int64)
                pairs = lists.flatten()
                base = np.repeat(offsets[:-1], n)
                level = np.zeros(len(data) + 1, np.int64)
                np.add.at(level, base + np.asarray(pairs.field(0), np.int64), 1)
                np.add.at(level, base + np.asarray(pairs.field(1), np.int64) + LENGTH, -1)
                gone = np.cumsum(level)[:-1] > 0
                edge = np.zeros(len(data), bool)
                edge[offsets[:-1][offsets[:-1] < len(data)]] = True
                opens = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
                shut = np.concatenate([~gone[1:] | edge[1:], [True]]) if len(data) else np.zeros(0, bool)
                closes = np.flatnonzero(gone & shut) + 1
                upto = np.concatenate([[0], np.cumsum(gone)])
                removed = upto[offsets[1:]] - upto[offsets[:-1]]
                of = np.searchsorted(opens, offsets)
                text = np.searchsorted(offsets, opens, "right") - 1
                spans_out = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(opens - offsets[text]), pa.array(closes - offsets[text])], names=["start", "end"]))
                kept = data[~gone].tobytes()
                cuts = (offsets - upto[offsets]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(3)[a:b], pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(of)), spans_out, pa.array([kept[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary())],
                    names=["doc", "id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    grouped = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    joined = docs.join(grouped, "doc", "left").select("doc", "text", "windows", "id")
    return joined.mapInArrow(tidy(run), "doc bigint, id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed) and kept (bytes) of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = unambiguous(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")))
    marks = stored(judged(anchor_rows(rows)), "marks")
    release(spark)
    cuts = stored(cut_out(rows, marks), "strings")
    release(spark)
    hot = stored(cuts.filter("anchor >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select("key"), "hot-keys")
    # a pair's second is left to the array; copies after it repeat what it repeats
    later = [marks.filter(F.col("kind") == REPEAT).select("doc", "at")]
    if hot.limit(1).count():
        later.append(stored(judged(windows_of(cuts.join(hot, "key", "left_semi"))).filter(F.col("kind") != SINGLE).select("doc", "at"), "hot-windows"))
        cuts = cuts.join(hot, "key", "left_anti")
    found = stored(sorted_contexts(cuts), "sorted-windows")
    release(spark)
    for x in later:
        found = found.unionByName(x.select("doc", F.expr("shiftright(at, 16) - (shiftright(at, 8) & 255)").alias("first"), F.expr("shiftright(at, 16) - (at & 255)").alias("last")))
    return without_spans(rows, found).withColumnRenamed("id", "doc_id").drop("doc")


def unambiguous(rows: DataFrame) -> DataFrame:
    """Rows (id, text) with ``doc``, numbers that differ and are in order of id."""
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    most, nulls = counts.agg(F.max("n"), F.count_if(F.col("id").isNull())).first()
    if (most or 1) == 1 and not nulls:
        return rows.withColumn("doc", F.col("id"))
    # numbers that grow with the partition and the row in it; written, because equal rows are numbered in any order
    order = ["id", F.xxhash64("text"), "text"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "numbered")
