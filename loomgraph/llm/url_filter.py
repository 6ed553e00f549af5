"""URL filter: host and path rules first, then a weighted vocabulary.

Method: an Aho-Corasick automaton counts strict and soft terms in the lower-cased
(A-Z) URL. A hit counts only if the characters beside it are not in [a-z0-9]. One
strict hit rejects; so do ``SOFT_AT_LEAST`` or more distinct soft terms whose weights sum to
``soft_limit``. The terms come from a table (term, kind, weight). A rule ``(host, path)`` fits its host and every subdomain when the
URL's path starts with the rule's path; the longest fitting rule overrides the
vocabulary.

Defined results: a null URL, or one without ``://``, has an empty host and path, no
rule, and is judged by the vocabulary alone (null: no hits, allow). Repeated rows are
judged alike; columns of the input are kept, and those that clash with the operator's
output names are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, fresh

#: The table (term, kind, weight) that ``Vocabulary.default`` reads.
TERMS = os.path.join(os.path.dirname(__file__), "url_terms.csv")
#: Weights: 1 for words that clean URLs have as well, 2 for words of spam topics, 3 for words seldom seen elsewhere.
#: A word of a topic and one more are rejected, two usual words are not.
SOFT_LIMIT = 3
SOFT_AT_LEAST = 2
MOST_TERMS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, soft terms with weights, and the weight of several distinct soft hits that rejects."""

    strict: frozenset[str]
    soft: dict[str, int]
    soft_limit: int = SOFT_LIMIT

    @classmethod
    def of(cls, rows: list[tuple[str, str, int]], soft_limit: int = SOFT_LIMIT) -> Vocabulary:
        """From (term, kind, weight) rows; a term that is strict and soft is strict, of repeated soft ones the largest weight holds."""
        strict = frozenset(t for t, kind, _ in rows if kind == "strict" and t)
        soft: dict[str, int] = {}
        for t, kind, weight in rows:
            if kind == "soft" and t and t not in strict:
                soft[t] = max(int(weight), soft.get(t, 0))
        return cls(strict, soft, soft_limit)

    @classmethod
    def default(cls) -> Vocabulary:
        with open(TERMS, newline="") as rows:
            return cls.of([(r["term"], r["kind"], int(r["weight"])) for r in csv.DictReader(rows)])

    @classmethod
    def from_table(cls, table: DataFrame, soft_limit: int = SOFT_LIMIT) -> Vocabulary:
        """From a DataFrame (term, kind, weight); refuses more than ``MOST_TERMS`` rows, since the terms are sent to every task."""
        rows = table.select("term", "kind", F.col("weight").cast("int")).limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
        return cls.of([tuple(r) for r in rows], soft_limit)


def split_url(url: Column, name: str) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end; then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format(name))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]], at: int) -> Column:
    """Field ``at`` (0 rule, 1 verdict) of the longest fitting rule, else null."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit((rule_host + rule_path, verdict)[at])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def automaton(vocabulary: Vocabulary):
    import ahocorasick

    words = ahocorasick.Automaton()
    for term in vocabulary.strict:
        words.add_word(term, (term, 0))
    for term, weight in vocabulary.soft.items():
        words.add_word(term, (term, weight))
    words.make_automaton()
    return words


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def counted(urls: pa.Array, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strict hits, distinct soft terms, their weight) of each URL: the automaton runs once over a batch."""
    strict, terms, weights = (np.zeros(len(urls), np.int64) for _ in range(3))
    if not len(words):
        return strict, terms, weights
    urls = pc.fill_null(urls.cast(pa.large_string()), "")
    ends = np.cumsum(np.asarray(pc.utf8_length(urls), np.int64) + 1)  # a line break, which stands in no term, ends each
    text = "\n".join([*urls.to_pylist(), ""]).translate(_LOWER)
    at, soft = [], []
    for end, (term, weight) in words.iter(text):
        start = end + 1 - len(term)
        if (start and text[start - 1] in _INSIDE) or text[end + 1] in _INSIDE:
            continue
        if weight:
            soft.append((end, term, weight))
        else:
            at.append(end)
    np.add.at(strict, np.searchsorted(ends, at, "right"), 1)
    rows = np.searchsorted(ends, [x[0] for x in soft], "right").tolist()
    for row, _, weight in {(row, term, weight) for row, (_, term, weight) in zip(rows, soft)}:
        terms[row] += 1
        weights[row] += weight
    return strict, terms, weights


def judge_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = (), vocabulary: Vocabulary | None = None) -> DataFrame:
    """``df`` with host, path, rule, verdict, strict_hits, soft_terms, soft_weight."""
    vocabulary = vocabulary or Vocabulary.default()
    if any(t != t.strip() or "\n" in t or t != t.translate(_LOWER) for t in [*vocabulary.strict, *vocabulary.soft]):
        raise ValueError("terms are lower case and hold no line break")

    @F.arrow_udf("struct<strict_hits: bigint, soft_terms: bigint, soft_weight: bigint>")
    def hits(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = automaton(vocabulary)
        for batch in urls:
            yield pa.StructArray.from_arrays([pa.array(x) for x in counted(batch, words)], names=["strict_hits", "soft_terms", "soft_weight"])

    own, found = fresh(df, "url_judged"), fresh(df, "url_hits")
    out = df.withColumn(own, F.col(url).cast("string"))
    host, path = split_url(F.col(own), own)
    out = out.withColumns({"host": host, "path": path}).withColumn(found, hits(own))
    out = out.withColumns({k: F.col(f"{found}.{k}") for k in ("strict_hits", "soft_terms", "soft_weight")})
    rejected = (F.col("strict_hits") > 0) | ((F.col("soft_terms") >= SOFT_AT_LEAST) & (F.col("soft_weight") >= vocabulary.soft_limit))
    rules = list(rules)
    ruled = rule_column(F.col("host"), F.col("path"), rules, 1)
    return out.withColumns({
        "rule": rule_column(F.col("host"), F.col("path"), rules, 0),
        "verdict": F.coalesce(ruled, F.when(rejected, "block").otherwise("allow")),
    }).drop(own, found)
