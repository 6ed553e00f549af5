"""Token ids in Parquet list columns that can be read selectively.

Format: rows ``part, doc_id, part_start, n_tokens, token_ids`` in ascending doc_id order over
range-partitioned files (``part`` numbers the ranges, ``part_start``
counts the ids before the document in its range). ``token_ids`` is a list column
with dictionary encoding, the numbers beside it are delta-encoded (writer version 2).
Row groups are held to ``ROW_GROUP_BYTES`` and pages to ``PAGE_BYTES``; Parquet writes a
column and an offset index for each, so a read of a few documents touches their pages
only, and a read of lengths touches no tokens.

Encoding cuts a text before ASCII white space that follows a character that is surely
not white space, and between an ASCII letter and an ASCII mark: boundaries that byte-level
pre-tokenisation never crosses; each
distinct piece of a slice (told apart by its bytes) is encoded once by the tokenizers library and kept in a
cache of ``CACHE_PIECES`` entries per process (emptied when full). ``end_id`` is appended
to every document.

Defined results: null and empty texts hold ``end_id`` alone. Repeated ids keep their rows
in the order of (id, text hash). A null id sorts first. An empty table gives an empty
store. Extra columns aren't stored.

Recovery: a store is written by Spark's commit protocol and is read from its files.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, byte_view, slices, tidy
from loomgraph.llm.hashing import distinct, gathered
from loomgraph.llm.word_bpe import encoded, tokenizer

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
STEP_BYTES = 8 << 20
CACHE_PIECES = 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = _PRINTED & ~_LETTER
_MARK[48:58] = False

#: Letters of ASCII and Latin-1 (in UTF-8), after a blank or not
LETTERS = r"^ ?([A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+$"
#: The alphabet that stands for bytes: printed Latin-1 characters for themselves, the others in order from U+0100 on
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = np.arange(256, dtype="<u2")
_SHOWN[np.setdiff1d(np.arange(256), _KEPT)] = 0x100 + np.arange(256 - len(_KEPT))
_SHOWN[0x0A] = 0x0A  # between pieces


class PieceCache:
    """Ids of pieces seen before, in growing arrays."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.large_binary())
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def look_up(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """The place of each of some distinct pieces in the cache."""
        if len(self.pieces) + len(pieces) > CACHE_PIECES:
            self.clear()
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(at.is_null())
        place = np.asarray(at.fill_null(0), np.int64)
        if len(new):
            place[np.asarray(at.is_null())] = len(self.pieces) + np.arange(len(new))
            ids, offsets = piece_ids(self.path, new)
            self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])
            self.pieces = pa.concat_arrays([self.pieces, new])
        return place


_caches: dict[str, PieceCache] = {}


def piece_ids(path: str, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces one after the other, and n+1 offsets.

    A piece of letters alone, with a blank before it or not, is one word to the byte-level
    pre-tokenizer; it goes to the library's BPE model directly. The others take the whole way.
    """
    simple = is_byte_level(path)
    alone = np.asarray(pc.match_substring_regex(pieces, LETTERS)) if simple else np.zeros(len(pieces), bool)
    lengths = np.zeros(len(pieces), np.int64)
    joined = np.frombuffer(b"\n".join(pieces.filter(pa.array(alone)).to_pylist()), np.uint8)
    words = _SHOWN[joined].tobytes().decode("utf-16-le").split("\n") if alone.any() else []
    tokenize = tokenizer(path).model.tokenize
    found = [[t.id for t in tokenize(x)] for x in words]
    lengths[alone] = np.fromiter(map(len, found), np.int64, len(found))
    rest, at = encoded(path, [x.decode() for x in pieces.filter(pa.array(~alone)).to_pylist()])
    lengths[~alone] = np.diff(at)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    out = np.empty(int(offsets[-1]), np.uint32)
    mine = np.repeat(alone, lengths)
    out[mine] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(mine.sum()))
    out[~mine] = rest
    return out, offsets


@functools.cache
def is_byte_level(path: str) -> bool:
    """Whether the file is a BPE whose only step before the model is the byte-level pre-tokenizer as it comes."""
    import json

    told = json.loads(tokenizer(path).to_str())
    before = told["pre_tokenizer"] or {}
    model = told["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    return bool(plain and told["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout") and not any(t["content"].strip().isalpha() for t in told["added_tokens"]))


def special_tokens(path: str) -> re.Pattern:
    """Matches the text of every added token (nothing if there are none)."""
    found = [re.escape(t.content.encode()) for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile(b"|".join(found) or b"(?!)")


def encode_texts(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts and n+1 offsets."""
    cache = _caches.setdefault(path, PieceCache(path))
    data, offsets = byte_view(texts, "")
    if len(data):
        cut = _GAP[data]
        before = np.zeros(len(data), bool)
        before[1:] = _PRINTED[data[:-1]]
        before[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)  # a letter of Latin-1
        cut &= before
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        for found in special_tokens(path).finditer(data.tobytes()):  # these are met as one, letters and marks alike
            cut[found.start() + 1 : found.end()] = False
        edges = offsets[(offsets < len(data))]
        cut[edges] = True
        starts = np.flatnonzero(cut)
        pieces, place = distinct(data, starts)
        which = cache.look_up(pieces)[place]
        ids, lengths = gathered(cache.flat, cache.offsets, which)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        bounds = upto[np.searchsorted(starts, offsets, "left")]
    else:
        ids, bounds = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    if end_id is None:
        return ids, bounds
    ids = np.insert(ids, bounds[1:], np.uint32(end_id))
    return ids, bounds + np.arange(len(bounds))


def write_store(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the store below ``folder``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    ranged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange("doc_id")
    ordered = ranged.withColumn("h", F.xxhash64("text")).sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column(1), STEP_BYTES):
                ids, at = encode_texts(batch.column(1)[a:b], path, end_id)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                names = ["part", "doc_id", "part_start", "n_tokens", "token_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), batch.column(0)[a:b], pa.array(at[:-1] + before), pa.array(np.diff(at)), lists], names=names)
                before += len(ids)

    (
        ordered.mapInArrow(tidy(run), f"part int, doc_id {kind}, part_start bigint, n_tokens bigint, token_ids array<int>").write
        .option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#token_ids.list.element", "true").option("parquet.dictionary.page.size", str(1 << 20))
        .parquet(folder)
    )


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """All rows; select or filter them, and Parquet reads only the pages that are needed."""
    return spark.read.parquet(folder)


def with_start(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``rows`` of a store with start: the ids before each document in the whole sequence. Reads no tokens.

    The window runs over one row for each part.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = read_store(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return with_start(checksums(read_store(spark, folder)), spark, folder)


def checksums(rows: DataFrame) -> DataFrame:
    """``rows`` of a store with ids_crc32 in place of token_ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("token_ids"))
            at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values).astype("<u4", copy=False)).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    columns = ["part", "doc_id", "part_start", "n_tokens", "token_ids"]
    return rows.select(*columns).mapInArrow(tidy(run), f"part int, doc_id {kind}, part_start bigint, n_tokens bigint, ids_crc32 bigint")
