"""BPE encoding and decoding through a distinct-word table.

Method: texts are split at ASCII white space into words (a boundary no merge crosses
for a vocabulary that drops white space). A slice of a partition keeps, for each word
occurrence, its position and the place of the word in the slice's own word list; the
lists are dealt by word hash, so that each distinct word meets in one group and is
encoded once by the tokenizers library; its ids go back to the slices, which put them
in place by position. Words are told apart by their bytes. Decoding joins ids with the vocabulary's pieces
(a vocabulary with a decoder of its own is decoded by the library). Positions don't travel:
each slice's are a file in the shared folder, named in the word lists, so a repeated
task's file is never read by mistake.

Bounds: a slice holds about ``SLICE_BYTES`` of text (a longer document is a slice of
its own); the word table has ``spark.sql.shuffle.partitions`` hash parts, each read as a stream
in which about ``WORDS_HELD`` encoded words are kept; the id-to-piece table has one row for each entry of
the vocabulary. A word that fills a third of the corpus is one entry per slice.

Defined results: null and empty texts have no tokens and decode to the empty string;
repeated ids are separate rows; an empty table gives an empty result; other columns are
not returned. Special tokens in a text are matched as the library does by default.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, byte_view, local_path, new_dir, release_memory, slices, stored, tidy
from loomgraph.llm.hashing import Words, distinct, gathered, xxh64

SLICE_BYTES = 32 << 20
STEP_BYTES = 8 << 20
WORDS_AT_ONCE = 1 << 18
WORDS_HELD = 1 << 20
COMMON = 255
WORDS_A_TEXT = 1000
AS_IS = np.where(np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]), 0x20, np.arange(256)).astype(np.uint8)

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process, with truncation and padding off."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def separator(path: str) -> tuple[str, int] | None:
    """A special token that the library always cuts out of a text, whatever stands beside it."""
    for i, token in tokenizer(path).get_added_tokens_decoder().items():
        if token.special and not (token.normalized or token.lstrip or token.rstrip or token.single_word):
            return token.content, i
    return None


def encoded(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and n+1 offsets.

    Many words go into one text, with a special token between them: the library encodes
    what lies between special tokens by itself, and their ids tell where words end. A
    word that holds the token's own text is encoded alone.
    """
    cut = separator(path)
    alone = [i for i, x in enumerate(words) if cut is None or cut[0] in x]
    apart = set(alone)
    joined = [x for i, x in enumerate(words) if i not in apart] if apart else words
    groups = [joined[i : i + WORDS_A_TEXT] for i in range(0, len(joined), WORDS_A_TEXT)]
    lengths = np.zeros(len(words), np.int64)
    rest = np.setdiff1d(np.arange(len(words)), alone)
    parts, sizes = [], []
    if groups:
        for group, found in zip(groups, tokenizer(path).encode_batch_fast([cut[0].join(g) + cut[0] for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ids == cut[1])
            if len(ends) != len(group):
                raise ValueError("the separating token was lost or met in a word")
            parts.append(np.delete(ids, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        lengths[rest] = np.concatenate(sizes)
    if not alone:
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), offsets
    own = [x.ids for x in tokenizer(path).encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
    lengths[alone] = [len(x) for x in own]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    out = np.empty(int(offsets[-1]), np.uint32)
    kept = np.ones(len(out), bool)
    for i, x in zip(alone, own):
        out[offsets[i] : offsets[i + 1]] = x
        kept[offsets[i] : offsets[i + 1]] = False
    out[kept] = np.concatenate([*parts, np.zeros(0, np.uint32)])
    return out, offsets


def packed_places(ranks: np.ndarray) -> bytes:
    """Frequency ranks, compressed: a byte for the most frequent words, three for the others."""
    rare = ranks >= COMMON
    rest = (ranks[rare] - COMMON).astype("<u4").view(np.uint8).reshape(-1, 4)
    first = np.where(rare, 255, ranks).astype(np.uint8)
    planes = [first, *(np.ascontiguousarray(rest[:, j]) for j in (3, 2, 1, 0))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in planes))


def unpacked_places(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = raw[:n].astype(np.int64)
    rare = out == 255
    planes = raw[n:].reshape(4, -1)[::-1]
    out[rare] = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64) + COMMON
    return out


class _Slice:
    """Word lists and positions of the documents of one slice."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        data, offsets = byte_view(texts)
        words = Words(data, offsets, folded=AS_IS)
        pieces, place = distinct(words.data, words.starts)
        names = [x[:-1] for x in pieces.to_pylist()]  # each word is followed by a blank
        at = np.fromiter((self.index.setdefault(x, len(self.index)) for x in names), np.int64, len(names))
        self.ids += doc_ids.to_pylist()
        self.counts.append(words.counts)
        self.places.append(at[place] if len(names) else place)
        self.bytes += len(data)

    def written(self, parts: int, folder: str, kind: pa.DataType) -> pa.RecordBatch:
        """Write the positions to a file of their own; a row for each part of the word list."""
        name = uuid.uuid4().int >> 65
        places = np.concatenate([*self.places, np.zeros(0, np.int64)])
        words = list(self.index)
        by_count = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by_count] = np.arange(len(words))
        words = [words[i] for i in by_count.tolist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(words), np.uint8)
        part = (xxh64(flat, ends - sizes, sizes) % np.uint64(parts)).astype("<u4")
        files, root = local_path(folder)
        files.create_dir(root, recursive=True)
        docs = pa.table({"id": pa.array(self.ids, kind), "n": pa.array(np.concatenate(self.counts))})
        meta = {b"places": packed_places(rank[places]), b"parts": zstandard.compress(part.tobytes(), 3)}
        with files.open_output_stream(f"{root}/{name}.arrow", compression=None) as out:
            out.write(len(meta[b"places"]).to_bytes(8, "little") + meta[b"places"] + len(meta[b"parts"]).to_bytes(8, "little") + meta[b"parts"])
            with pa.ipc.new_stream(out, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(docs)
        rows = []
        order = np.argsort(part, kind="stable")
        present, first = np.unique(part[order], return_index=True)
        for h, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            rows.append((name, h, b - a, zstandard.compress(b"\n".join(words[i] for i in order[a:b].tolist()), 3)))
        if not rows:  # documents without words still come back
            rows.append((name, 0, 0, b""))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["slice", "part", "n", "words"])


def read_slice(folder: str, name: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(documents with their numbers of words, ranks by position, part of each rank)."""
    files, root = local_path(folder)
    with files.open_input_stream(f"{root}/{name}.arrow", compression=None) as source:
        raw = source.read()
    n = int.from_bytes(raw[:8], "little")
    m = int.from_bytes(raw[8 + n : 16 + n], "little")
    docs = pa.ipc.open_stream(pa.BufferReader(raw[16 + n + m :])).read_all()
    total = int(np.asarray(docs.column("n"), np.int64).sum())
    return docs, unpacked_places(raw[8 : 8 + n], total), np.frombuffer(zstandard.decompress(raw[16 + n : 16 + n + m]), "<u4")


def word_slices(docs: DataFrame, doc_id: str, text: str, parts: int, folder: str) -> DataFrame:
    """(slice, part, n, words): the word lists; positions go to files below ``folder``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Slice()
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in slices(batch.column(1), STEP_BYTES):
                now.add(batch.column(0)[a:b], batch.column(1)[a:b])
                if now.bytes >= SLICE_BYTES:
                    yield now.written(parts, folder, kind)
                    now = _Slice()
        if now.ids:
            yield now.written(parts, folder, kind)

    return docs.select(doc_id, docs[text].cast("string")).mapInArrow(tidy(run), "slice bigint, part int, n int, words binary")


def encode_words(lists: DataFrame, path: str) -> DataFrame:
    """(slice, part, lengths, tokens, wide): each distinct word of a part is encoded once, as long as ``WORDS_HELD`` words hold it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        flat, offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        now = None
        for batch in batches:
            parts = np.asarray(batch.column(1))
            first = np.flatnonzero(np.diff(parts, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(parts)]):
                if parts[a] != now or len(known) > WORDS_HELD:
                    known, flat, offsets, now = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64), parts[a]
                places = []
                for n, blob in zip(batch.column(2)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist()):
                    words = zstandard.decompress(blob).split(b"\n") if n else []
                    places.append(np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, n))
                new = list(itertools.islice(known, len(offsets) - 1, None))
                if new:
                    ids, at = encoded(path, [x.decode() for x in new])
                    offsets = np.concatenate([offsets, at[1:] + len(flat)])
                    flat = np.concatenate([flat, ids])
                wide = bool(len(flat) and flat.max() >= 1 << 16)
                lengths, tokens = [], []
                for which in places:
                    ids, n = gathered(flat, offsets, which)
                    lengths.append(zstandard.compress(n.astype("<u4").tobytes(), 1))
                    tokens.append(zstandard.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(lengths, pa.binary()), pa.array(tokens, pa.binary()), pa.array([wide] * (b - a))], names=["slice", "part", "lengths", "tokens", "wide"]
                )

    dealt = lists.repartition(F.col("part")).sortWithinPartitions("part", "slice")
    return dealt.mapInArrow(tidy(run), "slice bigint, part int, lengths binary, tokens binary, wide boolean")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (null unless ``decode``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_dir(spark, "word-places")
    lists = stored(word_slices(docs, doc_id, text, parts, folder), "word-lists")

    def run(words: pa.Table) -> Iterator[pa.Table]:
        mine, place, part = read_slice(folder, words.column("slice")[0].as_py())
        words = words.sort_by("part")
        n = [np.frombuffer(zstandard.decompress(x), "<u4") for x in words.column("lengths").to_pylist()]
        ids = [np.frombuffer(zstandard.decompress(x), "<u4" if w else "<u2") for x, w in zip(words.column("tokens").to_pylist(), words.column("wide").to_pylist())]
        flat = np.concatenate([*ids, np.zeros(0, np.uint16)]).astype("<u4")
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([*n, np.zeros(0, np.uint32)]).astype(np.int64))])
        # the lists come by part, ranks run over all parts
        at = np.empty(len(part), np.int64)
        at[np.argsort(part, kind="stable")] = np.arange(len(part))
        place = at[place]
        shown: list[bytes] = []
        decoder = decode and tokenizer(path).decoder
        if decode and not decoder:
            piece = pieces(path)
            cut = offsets.tolist()
            joined = [piece[i] for i in flat.tolist()]
            shown = [b" ".join(joined[a:b]) for a, b in zip(cut, cut[1:])]
        counts = np.asarray(mine.column("n"), np.int64)
        ends = np.cumsum(counts)
        for a, b in runs(counts, WORDS_AT_ONCE):
            first = int(ends[a] - counts[a])
            which = place[first : int(ends[b - 1])]
            got, lengths = gathered(flat, offsets, which)
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
            raw, names = got.tobytes(), which.tolist()
            cuts = [0, *(ends[a:b] - first).tolist()]
            tokens = upto[cuts].tolist()
            out = {"doc_id": mine.column("id").slice(a, b - a), "n_tokens": pa.array(np.diff(tokens)), "ids": pa.array([raw[4 * i : 4 * j] for i, j in zip(tokens, tokens[1:])], pa.binary())}
            # a word without ids (dropped by the vocabulary) leaves no blank behind
            if decoder:
                texts = [tokenizer(path).decode(got[i:j].tolist(), skip_special_tokens=False).encode() for i, j in zip(tokens, tokens[1:])]
            else:
                texts = [b" ".join([x for k in names[i:j] if (x := shown[k])]) for i, j in zip(cuts, cuts[1:])] if decode else None
            yield pa.table(out | {"decoded": pa.array(texts, pa.binary()) if decode else pa.nulls(b - a, pa.binary())})

    def assembled(words: pa.Table) -> pa.Table:
        out = pa.concat_tables(run(words))
        release_memory()
        return out

    out = encode_words(lists, path).groupBy("slice").applyInArrow(assembled, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumn("decoded", F.col("decoded").cast("string"))


def runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` words."""
    first = total = 0
    for i, n in enumerate(counts.tolist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(counts) > first:
        yield first, len(counts)


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: what decoding joins with a blank for each id."""
    found = tokenizer(path)
    by_id = found.get_vocab(with_added_tokens=True)
    out = [b""] * (max(by_id.values()) + 1)
    for piece, i in by_id.items():
        out[i] = piece.encode()
    return out
