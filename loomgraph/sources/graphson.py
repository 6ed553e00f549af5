"""GraphSON files of any size: one file is read by many tasks.

A split may begin inside a string, an escape or a nested object. So files are read twice:

1. Every split tells what it does to a reader's state: how many quotes it holds that open or
   close a string, and by how much its brackets change the depth, both if it begins
   outside a string and if it begins inside one. Running sums over one row a split then give the
   state in which each split begins.
2. From that state, each split cuts out the elements (the objects in an array that is the value
   of a document's key) that begin in it, and reads on to the end of the last one. They are parsed by the JVM.

A file holds one document, or several one after another. Tasks read files through pyarrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import file_system, stored

SPLIT_BYTES = 1 << 26
CHUNK_BYTES = 1 << 20
#: An array's key is sought in so many bytes before its bracket.
KEY_BYTES = 1 << 12
BATCH_ROWS = 2000
MOST_TASKS = 20_000

_SIGN = np.zeros(256, np.int64)
_SIGN[list(b"{[")] = 1
_SIGN[list(b"}]")] = -1
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')

Reader = Callable[[int, int], bytes]


def strings(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that open or close a string, and whether the next byte is escaped."""
    plain = np.flatnonzero(data != 0x5C)
    quotes = np.flatnonzero(data == 0x22)
    before = np.searchsorted(plain, quotes) - 1  # the last byte before it that is no backslash
    last = np.where(before >= 0, plain[np.maximum(before, 0)] if len(plain) else -1, -1 - int(escaped))
    trailing = len(data) - 1 - (int(plain[-1]) if len(plain) else -1 - int(escaped))
    return quotes[(quotes - last) % 2 == 1], trailing % 2 == 1


def chunks(read: Reader, start: int, end: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, bytes, quotes) from ``start`` on, by chunks that end at ``end`` and at the end of the file."""
    run, at = 0, start  # backslashes before the first byte
    while at:
        held = read(max(0, at - 64), at)
        kept = len(held.rstrip(b"\\"))
        run, at = run + len(held) - kept, at - len(held)
        if kept:
            break
    escaped, at = run % 2 == 1, start
    while at < size:
        upto = min(at + CHUNK_BYTES, end if at < end else size)
        data = np.frombuffer(read(at, upto), np.uint8)
        quotes, escaped = strings(data, escaped)
        yield at, data, quotes
        at = upto


def effect(read: Reader, start: int, end: int, size: int) -> tuple[int, int, int]:
    """(quotes, change of depth if the split begins outside a string, and if inside one)."""
    quotes, changes = 0, [0, 0]
    for at, data, found in chunks(read, start, end, size):
        if at >= end:
            break
        signs = _SIGN[data]
        places = np.flatnonzero(signs)
        inside = (np.searchsorted(found, places) + quotes) % 2
        for i in (0, 1):
            changes[i] += int(signs[places[inside == i]].sum())
        quotes += len(found)
    return quotes, changes[0], changes[1]


def elements(read: Reader, start: int, end: int, size: int, inside: bool, depth: int) -> Iterator[tuple[int, str | None, bytes | None]]:
    """(array, key, element) of all elements that begin in the split, and (array, key, null) of each array that does.

    Arrays are numbered from 1; an element of an array that began before has number 0 and no key.
    """
    array, key, parts, began = 0, None, [], -1
    parity = int(inside)
    for at, data, found in chunks(read, start, end, size):
        if at >= end and began < 0:
            return
        signs = _SIGN[data]
        places = np.flatnonzero(signs)
        places = places[(np.searchsorted(found, places) + parity) % 2 == 0]
        after = depth + np.cumsum(signs[places])
        parity = (parity + len(found)) % 2
        # only openings and closings of a document's values and of their elements matter
        opens = signs[places] > 0
        wanted = (opens & ((after == 2) | (after == 3))) | (~opens & (after == 2))
        cut = 0
        for place, level, opening in zip(places[wanted].tolist(), after[wanted].tolist(), opens[wanted].tolist()):
            if not opening:
                if began >= 0:
                    yield array, key, b"".join(parts) + data[cut : place + 1].tobytes()
                    parts, began = [], -1
                if at + place >= end - 1:
                    return
            elif at + place >= end:
                return
            elif level == 2:
                array += 1
                name = _KEY.search(read(max(0, at + place - KEY_BYTES), at + place)) if data[place] == 0x5B else None
                key = name[1].decode("utf-8", "replace") if name else ""
                yield array, key, None
            else:
                cut, began = place, at + place
        if began >= 0:
            parts.append(data[cut:].tobytes())
        if len(after):
            depth = int(after[-1])


def reader(path: str) -> Reader:
    files, name = file_system(path)
    source = files.open_input_file(name)

    def read(start: int, end: int) -> bytes:
        source.seek(start)
        return source.read(end - start)

    return read


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        told = [effect(reader(r["path"]), r["start"], r["end"], r["length"]) for r in rows]
        for i, name in enumerate(("quotes", "outside", "within")):
            batch = batch.append_column(name, pa.array([t[i] for t in told], pa.int64()))
        yield batch


FOUND = pa.schema([("path", pa.string()), ("start", pa.int64()), ("array", pa.int64()), ("key", pa.string()), ("at", pa.int64()), ("element", pa.string())])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rows, held, place, of = [], 0, 0, 0
            for array, key, element in elements(reader(r["path"]), r["start"], r["end"], r["length"], r["inside"], r["depth"]):
                if array != of:
                    of, place = array, 0
                rows.append((r["path"], r["start"], array, key, None if element is None else place, None if element is None else element.decode("utf-8", "replace")))
                if element is not None:
                    place, held = place + 1, held + len(element)
                if len(rows) == BATCH_ROWS or held > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FOUND.types)], schema=FOUND)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FOUND.types)], schema=FOUND)


def dealt(df: DataFrame) -> DataFrame:
    """One row a task: each row stands for a split of a file."""
    return df.repartition(max(1, min(df.count(), MOST_TASKS)))


def read_elements(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, key, ord, element): the elements of every array that is the value of a document's key, as JSON text.

    ``ord``: 0, 1, ... within the array, however many splits it spans. An empty file or
    folder has none, nor has a key without an array of objects. Broken JSON after a place shifts what is found from there on.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = starts.withColumn("end", F.least(F.col("start") + split_bytes, F.col("length")))
    told = stored(dealt(splits).mapInArrow(effects, "path string, length bigint, start bigint, end bigint, quotes bigint, outside bigint, within bigint"), "graphson-effects")
    # one row a split in each of these windows, never an element
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = told.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    states = states.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    found = stored(dealt(states.drop("quotes", "outside", "within")).mapInArrow(cut, "path string, start bigint, array bigint, key string, at bigint, element string"), "graphson-elements")

    # what an array that goes on from earlier splits is called, and how many of its elements they hold
    counts = found.groupBy("path", "start", "array").agg(F.count("element").alias("n"), F.first("key", ignorenulls=True).alias("key"))
    last = counts.groupBy("path", "start").agg(F.max("array").alias("arrays"), F.max_by("n", "array").alias("n"), F.max_by("key", "array").alias("key"))
    last = last.withColumns({"sum": F.sum("n").over(before) + F.col("n"), "opens": F.col("arrays") > 0}).withColumn("sum", F.coalesce("sum", "n"))
    carried = last.select(
        "path", "start", F.last("key", True).over(before).alias("old_key"),
        (F.last("sum").over(before) - F.coalesce(F.last(F.when(F.col("opens"), F.col("sum") - F.col("n")), True).over(before), F.lit(0))).alias("shift"),
    )
    rest = found.filter("element is not null and array = 0").join(carried, ["path", "start"], "left")
    rest = rest.select("path", F.col("old_key").alias("key"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("ord"), "element")
    out = found.filter("element is not null and array > 0").select("path", "key", F.col("at").alias("ord"), "element").unionAll(rest)
    return out.filter("key <> ''")  # objects in a value that is no array
