"""Language identification by prediction by partial matching (PPM).

Method: for each language a context tree over bytes holds, for every context of 0 to
``ORDER`` bytes seen in its training texts, how often each byte followed. The code length
of a byte is -log2 of its share at the longest known context; a byte unseen there pays the
context's escape (method C: distinct / (total + distinct)) and is looked up one byte
shorter, down to the uniform distribution over 256 bytes. Statistics are frozen after
training, without exclusions, so the code length of each n-gram is one number per
language. These are tabulated once; a text is scored by one table lookup a byte
(escapes: one more for each shorter context), for all languages together. The language
with the smallest total wins; ties go to the smaller name. The score is the winner's
posterior probability under equal priors.

Training sample (bounded): rows with a language and a text whose crc32(id as text) mod
``FOLDS`` is not 0; of each language the whole texts of the ``TRAIN_DOCS`` rows that come
first by a hash of id and text (fewer where all languages' would be over ``TRAIN_ROWS``;
rows equal in id and text count once). That bounds the rows that reach the driver and the
model that is broadcast. Predictions read whole texts and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text when no row can train. Repeated ids and rows are predicted alike. A null id is
held out of training. Extra columns are kept (those that clash with output names are
replaced). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, byte_view, fresh, release_memory, slices

ORDER = 4
FOLDS = 5
TRAIN_DOCS = 400
TRAIN_ROWS = 20_000
SLICE_BYTES = 1 << 18
UNDETERMINED = "und"
_U = np.uint64


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32(id as text) mod folds = 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


class Table:
    """Distinct 64-bit keys to their row numbers, by linear probing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.rows[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.rows[at[won]], self.keys[at[won]] = todo[won], keys[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + (self.rows[at[left]] >= 0)) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, or -1."""
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.rows[at], -2).astype(np.int32)
        out[self.rows[at] < 0] = -1
        todo = np.flatnonzero(out == -2)
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.rows) - 1)
            rows = self.rows[at]
            hit = (rows >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = rows[hit]
            out[todo[rows < 0]] = -1
            more = (rows >= 0) & ~hit
            todo, at = todo[more], at[more]
        return out


@dataclass
class Model:
    """Code lengths in bits: by order, of n-grams (context and byte) and of escapes from contexts."""

    languages: list[str]
    grams: list[tuple[Table, np.ndarray]]
    escapes: list[tuple[Table, np.ndarray]]


def rolling(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from the ``order``-th on: it and the ``order`` bytes before, as one number (itself lowest)."""
    out = np.zeros(max(len(data) - order, 0), np.uint64)
    for j in range(order + 1):
        out |= data[order - j : len(data) - j].astype(np.uint64) << _U(8 * j)
    return out


def laid_out(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``order`` blanks before each (context only), and the bounds of each in rolling()'s result."""
    data, offsets = byte_view(texts, " " * order)
    return np.concatenate([np.full(order, 0x20, np.uint8), data]), offsets


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """The model of some texts in each language."""
    languages = sorted(texts)
    seen = []
    for language in languages:
        data, offsets = laid_out(pa.array(texts[language], pa.string()), order)
        coded = np.ones(max(len(data) - order, 0), bool)
        for j in range(order):  # the blanks after each text
            coded[offsets[1:] - 1 - j] = False
        seen.append(rolling(data, order)[coded])
    grams: list[tuple[Table, np.ndarray]] = []
    escapes: list[tuple[Table, np.ndarray]] = []
    for k in range(order + 1):
        counted = [np.unique(x & _U((1 << 8 * (k + 1)) - 1), return_counts=True) for x in seen]
        keys = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, np.uint64)
        bits = np.empty((len(keys), len(languages)), np.float32)
        if k == 0:
            bits[:] = 8.0
        else:
            table, shorter = grams[k - 1]
            bits[:] = shorter[table.find(keys & _U((1 << 8 * k) - 1))]
        contexts = np.unique(keys >> _U(8))
        away = np.zeros((len(contexts), len(languages)), np.float32)
        for j, (mine, n) in enumerate(counted):
            own, start = np.unique(mine >> _U(8), return_index=True)
            if not len(own):
                continue
            total, kinds = np.add.reduceat(n, start), np.diff(np.append(start, len(mine)))
            away[np.searchsorted(contexts, own), j] = np.log2((total + kinds) / kinds)
            of = np.searchsorted(contexts, keys >> _U(8))
            bits[:, j] += away[of, j]
            at = np.searchsorted(keys, mine)
            which = np.searchsorted(own, mine >> _U(8))
            bits[at, j] = np.log2((total + kinds)[which] / n)
        grams.append((Table(keys), bits))
        escapes.append((Table(contexts), away))
    return Model(languages, grams, escapes)


def code_lengths(texts: pa.Array, model: Model) -> np.ndarray:
    """Bits of each text under each language."""
    order, n_languages = len(model.grams) - 1, len(model.languages)
    out = np.zeros((len(texts), n_languages))
    for a, b in slices(texts, SLICE_BYTES):
        data, offsets = laid_out(texts[a:b], order)
        window = rolling(data, order)
        bits = np.zeros((len(window), n_languages), np.float32)
        left = np.arange(len(window))
        for k in range(order, -1, -1):
            table, lengths = model.grams[k]
            mine = window if k == order else window[left]
            row = table.find(mine & _U((1 << 8 * (k + 1)) - 1))
            hit = row >= 0
            bits[left[hit]] += lengths[row[hit]]
            left, mine = left[~hit], mine[~hit]
            if not len(left):
                break
            table, lengths = model.escapes[k]
            row = table.find((mine >> _U(8)) & _U((1 << 8 * k) - 1))
            known = row >= 0
            bits[left[known]] += lengths[row[known]]
        bits[left] += np.float32(8.0)
        for j in range(order):
            bits[offsets[1:] - 1 - j] = 0
        sums = np.add.reduceat(bits, offsets[:-1], axis=0, dtype=np.float64) if b > a else 0
        out[a:b] = sums
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = byte_view(texts, " ")
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    found = np.add.reduceat(ascii_letter, offsets[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(c.isalpha() for c in (texts[i].as_py() or ""))
    return found


def predicted(texts: pa.Array, model: Model) -> pa.StructArray:
    """lang_pred, score and bits_per_byte of each text."""
    names = np.array([*model.languages, UNDETERMINED], object)
    best, score, rate = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.full(len(texts), np.nan)
    ok = has_letter(texts)
    if model.languages and ok.any():
        mine = texts.filter(pa.array(ok))
        bits = code_lengths(mine, model)
        best[ok] = bits.argmin(1)
        least = bits.min(1)
        score[ok] = 1 / np.exp2(least[:, None] - bits).sum(1)
        rate[ok] = least / np.diff(byte_view(mine, "")[1])
    return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], names=["lang_pred", "score", "bits_per_byte"])


def training_texts(docs: DataFrame, doc_id: str, text: str, lang: str, n: int = TRAIN_DOCS, rows_at_most: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """The bounded training sample, on the driver: whole texts of each language's first rows by hash."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("train"), doc_id, text).alias("h"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = max(1, min(n, rows_at_most // max(1, len(counts))))
    # a threshold on the hash thins each language to about 4n rows before they are ranked
    share = F.lit(None).cast("bigint")
    for name, count in sorted(counts.items()):
        limit = (1 << 63) - 1 if count <= 4 * n else int((4 * n / count * 2 - 1) * (1 << 63))
        share = F.when(F.col("lang") == name, F.lit(limit)).otherwise(share)
    order = Window.partitionBy("lang").orderBy("h")
    ranked = rows.filter(F.col("h") <= share).select("lang", "h").distinct().withColumn("rank", F.row_number().over(order))
    last = {r["lang"]: r["h"] for r in ranked.filter(F.col("rank") <= n).groupBy("lang").agg(F.max("h").alias("h")).collect()}
    upto = F.lit(None).cast("bigint")
    for name, h in sorted(last.items()):
        upto = F.when(F.col("lang") == name, F.lit(h)).otherwise(upto)
    chosen = rows.filter(F.col("h") <= upto).groupBy("lang", "h").agg(F.first("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield predicted(batch, sent.value)
        release_memory()

    bounded_batches(docs.sparkSession)
    own = fresh(docs, "judged")
    out = docs.withColumn(own, judged(F.col(text).cast("string")))
    return out.withColumns({k: F.col(f"{own}.{k}") for k in ("lang_pred", "score", "bits_per_byte")}).drop(own)


def fit_and_identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled rows outside the held-out fold and identify every row."""
    return identify(docs, train(training_texts(docs, doc_id, text, lang)), text).withColumn("held_out", held_out(F.col(doc_id)))


