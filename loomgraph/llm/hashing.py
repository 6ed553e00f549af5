"""Vectorised hashing of words and shingles over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
# The primes of XXH64
P1, P2, P3, P4, P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
FEW = 8


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _lane(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return rotl(acc + value * P2, 31) * P1


def _fixed_length(words: np.ndarray, data: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of data[a : a + n] for each a; words[i] is the little-endian 8 bytes at i."""
    s, end = _U(seed), 0
    if n >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        while end + 32 <= n:
            for j in range(4):
                v[j] = _lane(v[j], words[at + (end + 8 * j)])
            end += 32
        h = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
        for x in v:
            h = (h ^ _lane(_U(0), x)) * P1 + P4
    else:
        h = np.full(len(at), s + P5, np.uint64)
    h += _U(n)
    while end + 8 <= n:
        h ^= _lane(_U(0), words[at + end])
        h = rotl(h, 27) * P1 + P4
        end += 8
    if end + 4 <= n:
        h ^= (words[at + end] & _U(0xFFFFFFFF)) * P1
        h = rotl(h, 23) * P2 + P3
        end += 4
    while end < n:
        h ^= data[at + end].astype(np.uint64) * P5
        h = rotl(h, 11) * P1
        end += 1
    h ^= h >> _U(33)
    h *= P2
    h ^= h >> _U(29)
    h *= P3
    h ^= h >> _U(32)
    return h


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of a byte array."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    order = np.argsort(lengths.astype(np.uint16) if lengths.max() < 65536 else lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            at = order[a:b]
            if b - a < FEW:
                for i in at.tolist():
                    out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + n].tobytes(), seed)
            else:
                out[at] = _fixed_length(words, data, starts[at], n, seed)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z and every separator to a blank
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[SEPARATORS] = 0x20


class Words:
    """The words of texts laid out one after the other, with one blank after each.

    ``data`` and ``offsets`` come from ``byte_view(texts, " ")``: each text ends in a
    separator. ``starts``/``ends`` are slices of ``self.data``; ``counts`` is the
    number of words of each text and ``first`` the index of its first.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS, folded: np.ndarray = FOLDED):
        gap = separators[data]
        end = gap.copy()
        end[1:] &= ~gap[:-1]
        if len(end):
            end[0] = False
        self.data = folded[data[~gap | end]]
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1] + 1]) if len(self.ends) else np.zeros(0, np.int64)
        self.counts = np.add.reduceat(end, offsets[:-1], dtype=np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, number for each text); a shorter text is one shingle."""
        n = np.where(self.counts >= width, self.counts - width + 1, (self.counts > 0).astype(np.int64))
        before = np.cumsum(n) - n
        word = np.repeat(self.first - before, n) + np.arange(int(n.sum()))
        return word, word + np.repeat(np.minimum(self.counts, width), n) - 1, n


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct pieces of a byte array cut at ``starts`` (the last goes to its end), compared byte by byte, and for each piece its place among them."""
    ends = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    found = pieces.dictionary_encode()
    return found.dictionary, np.asarray(found.indices)


def gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[offsets[w] : offsets[w + 1]] for each w, one after the other, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[which] - ends + lengths, lengths) + np.arange(total)], lengths
