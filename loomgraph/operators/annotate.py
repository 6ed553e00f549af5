"""Annotators: from documents to paragraphs, sentences, tokens and spans.

All later operators read these tables and never see an NLP library. Offsets of
sentences, tokens and spans are relative to their paragraph; ``i`` numbers the tokens of a
paragraph, ``token_idx`` those of a sentence; ``sent_idx`` runs over the document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import lexicons as lex
from loomgraph.functions.arrays import before
from loomgraph.functions.storage import stored
from loomgraph.functions.text import let, paragraphs_of, strip
from loomgraph.operators.frames import framed
from loomgraph.operators.tags import _ADPOSITIONS, _CONJUNCTIONS, _DETERMINERS  # noqa: F401  the SQL reads them here

TOKEN_SCHEMA = (
    "doc_id {id}, para_idx int, sent_idx int, token_idx int, i int, text string, lemma string, pos string, dep string, "
    "head_i int, ent_type string, ent_iob string, char_start int, char_end int"
)
SPAN_SCHEMA = (
    "doc_id {id}, para_idx int, sent_idx int, kind string, label string, text string, start_i int, end_i int, "
    "char_start int, char_end int"
)
SENTENCE_SCHEMA = "doc_id {id}, para_idx int, sent_idx int, text string, char_start int, char_end int"


@dataclass(frozen=True)
class Annotations:
    """docs(doc_id, text), paragraphs(doc_id, para_idx, text), sentences, tokens and spans.

    ``nested``: a row a sentence with its tokens and spans as arrays, where the tables come from such rows; ``frames``: these and
    the rows of documents and paragraphs, ``written`` once they are files.
    """

    docs: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    tokens: DataFrame
    spans: DataFrame
    has_parser: bool = False
    model: str = "rules"
    nested: DataFrame | None = None
    frames: DataFrame | None = None
    written: bool = False

    def kept(self) -> Annotations:
        """The same written once, since several operators read each."""
        if self.frames is not None:
            return self if self.written else replace(from_frames(self.docs, stored(self.frames, "annotated"), self.has_parser, self.model), written=True)
        return replace(self, sentences=stored(self.sentences, "sentences"), tokens=stored(self.tokens, "tokens"), spans=stored(self.spans, "spans"))


class Annotator(Protocol):
    def annotate(self, docs: DataFrame) -> Annotations: ...


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text); a null text is empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def split_paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(paragraphs_of(F.col("text"), lex.PARAGRAPH_BREAK)).alias("para_idx", "text"))


def sentences_of(paragraph: Column) -> Column:
    """An array of (text, char_start): stripped sentences; one that is white space only is dropped."""
    raws = F.regexp_extract_all(paragraph, F.lit(lex.SENTENCE), F.lit(0))
    pairs = let(raws, lambda found: F.arrays_zip(found.alias("raw"), before(F.transform(found, F.length)).alias("at")))
    # what is stripped in front is white space, so the stripped text is first found behind it
    shown = F.transform(pairs, lambda x: let(strip(x["raw"]), lambda text: F.struct(text.alias("text"), (x["at"] + F.position(text, x["raw"]) - 1).alias("char_start"))))
    return F.filter(shown, lambda x: x["text"] != "")


def _sentence_rows(docs: DataFrame, of_paragraph) -> DataFrame:
    """A row for each element that ``of_paragraph`` gives for a paragraph's text, with para_idx and sent_idx, which runs over the document."""
    # the outer forms, here and below: for the others Spark infers a filter on the array's size, for which it makes the array once more
    cut = docs.select("doc_id", F.transform(paragraphs_of(F.col("text"), lex.PARAGRAPH_BREAK), of_paragraph).alias("cut"))
    paras = cut.select("doc_id", F.posexplode_outer(F.arrays_zip("cut", before(F.transform("cut", F.size)).alias("base"))).alias("para_idx", "p"))
    rows = paras.select("doc_id", "para_idx", F.col("p.base").alias("base"), F.posexplode_outer("p.cut").alias("k", "s")).filter("k is not null")
    return rows.select("doc_id", "para_idx", (F.col("base") + F.col("k")).alias("sent_idx"), "s.*")


def split_sentences(docs: DataFrame) -> DataFrame:
    """Stripped sentences of documents (doc_id, text), cut within the row: no shuffle."""
    rows = _sentence_rows(docs, sentences_of)
    return rows.withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int")).select(*_names(SENTENCE_SCHEMA))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def from_frames(docs: DataFrame, frames: DataFrame, has_parser: bool, model: str) -> Annotations:
    """The tables of ``frames.framed``'s rows."""
    rows = frames.filter("sent_idx is not null")
    sentences = rows.select(*_names(SENTENCE_SCHEMA))
    tokens = rows.select("doc_id", "para_idx", "sent_idx", "first_i", F.posexplode("toks").alias("token_idx", "t"))
    tokens = tokens.select("*", "t.*").withColumns({"i": F.col("first_i") + F.col("token_idx"), "lemma": F.lower("text")})
    if has_parser:
        spans = rows.select("doc_id", "para_idx", "sent_idx", F.inline("spans")).select(*_names(SPAN_SCHEMA))
    else:
        none = F.lit("")
        tokens = tokens.withColumns({"pos": none, "dep": none, "head_i": F.col("i"), "ent_type": none, "ent_iob": none})
        fields = [f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in SPAN_SCHEMA.split(", ")[1:]]
        spans = docs.filter("false").selectExpr("doc_id", *fields)
    return Annotations(docs, split_paragraphs(docs), sentences, tokens.select(*_names(TOKEN_SCHEMA)), spans, has_parser, model, rows, frames)


class RuleAnnotator:
    """Tokens and sentences by pattern; no tags, no dependencies, no entities."""

    def annotate(self, docs: DataFrame) -> Annotations:
        docs = documents(docs)
        return replace(from_frames(docs, framed(docs, False), False, "rules"), sentences=split_sentences(docs))


class LexiconAnnotator:
    """Deterministic tags, dependencies and entities by word lists, endings and order.

    A heuristic: it gives every operator over labels something to work on, but its labels
    are not those of a statistical parser. Verbs hang on the verb before them, nouns on the
    nearest verb (left: object, right: subject), determiners, adjectives and numbers on the
    noun that follows, all else on the verb to the left or the root. Names are runs of
    proper nouns; noun chunks are runs of determiners, adjectives, numbers and nouns up to their last noun.
    """

    def annotate(self, docs: DataFrame) -> Annotations:
        docs = documents(docs)
        return from_frames(docs, framed(docs, True), True, "lexicon")


@dataclass(frozen=True)
class FixtureAnnotator:
    """Tables written by hand or made elsewhere, for the documents they name."""

    sentences: DataFrame
    tokens: DataFrame
    spans: DataFrame
    has_parser: bool = True
    model: str = "fixture"

    def annotate(self, docs: DataFrame) -> Annotations:
        docs = documents(docs)
        return Annotations(docs, split_paragraphs(docs), self.sentences, self.tokens, self.spans, self.has_parser, self.model)


@dataclass(frozen=True)
class ModelAnnotator:
    """A model run per paragraph in Python workers, loaded once per worker.

    ``load()`` returns a function text -> (sentences, tokens, spans), lists of dicts with
    the columns of the contract except doc_id, para_idx and sent_idx (sentences are
    numbered within the paragraph in ``sent``).
    """

    load: Callable[[], Callable[[str], tuple[list[dict], list[dict], list[dict]]]]
    model: str = "model"

    def annotate(self, docs: DataFrame) -> Annotations:
        docs = documents(docs)
        paragraphs = split_paragraphs(docs)
        kind = docs.schema["doc_id"].dataType.simpleString()
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            parse = load()
            for batch in batches:
                parsed = [parse(t) for t in batch["text"]]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "para_idx": batch["para_idx"], **{k: [json.dumps(p[j]) for p in parsed] for j, k in enumerate(("s", "t", "n"))}})

        raw = paragraphs.mapInPandas(run, f"doc_id {kind}, para_idx int, s string, t string, n string")
        raw = stored(raw, "annotations")
        ends = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
        raw = raw.withColumn("base", F.coalesce(F.sum(F.size(F.from_json("s", "array<struct<sent: int>>"))).over(ends), F.lit(0)).cast("int"))

        def table(column: str, schema: str) -> DataFrame:
            fields = [x for x in schema.split(", ") if x.split()[0] not in ("doc_id", "para_idx", "sent_idx")]
            rows = raw.select("doc_id", "para_idx", "base", F.explode(F.from_json(column, f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ['sent int', *fields])}>>")).alias("r"))
            return rows.select("doc_id", "para_idx", (F.col("base") + F.col("r.sent")).alias("sent_idx"), "r.*").drop("sent").select(*[x.split()[0] for x in schema.split(", ")])

        return Annotations(docs, paragraphs, table("s", SENTENCE_SCHEMA), table("t", TOKEN_SCHEMA), table("n", SPAN_SCHEMA), True, self.model)


def load_spacy(model: str) -> Callable[[str], tuple[list[dict], list[dict], list[dict]]]:
    """A parser for ``ModelAnnotator`` by a spaCy model: sentences, tokens, and entities and noun chunks as spans."""
    import spacy

    nlp = spacy.load(model)

    def parse(text: str) -> tuple[list[dict], list[dict], list[dict]]:
        doc = nlp(text)
        sents, toks, spans = [], [], []
        for number, sent in enumerate(doc.sents):
            shown = sent.text.strip()
            start = sent.start_char + len(sent.text) - len(sent.text.lstrip())
            sents.append({"sent": number, "text": shown, "char_start": start, "char_end": start + len(shown)})
            for k, t in enumerate(sent):
                toks.append({
                    "sent": number, "token_idx": k, "i": t.i, "text": t.text, "lemma": t.lemma_, "pos": t.pos_, "dep": t.dep_, "head_i": t.head.i,
                    "ent_type": t.ent_type_, "ent_iob": t.ent_iob_, "char_start": t.idx, "char_end": t.idx + len(t.text),
                })
            for kind, found in (("ent", sent.ents), ("np", sent.noun_chunks)):
                spans += [{"sent": number, "kind": kind, "label": x.label_, "text": x.text, "start_i": x.start, "end_i": x.end, "char_start": x.start_char, "char_end": x.end_char} for x in found]
        return sents, toks, spans

    return parse


def best_annotator(model: str = "en_core_web_sm") -> Annotator:
    """``ModelAnnotator`` with a spaCy model where the library and the model are installed, else ``RuleAnnotator``.

    The driver looks; the workers must have what it has.
    """
    try:
        import spacy

        spacy.load(model)
    except (ImportError, OSError):
        return RuleAnnotator()
    return ModelAnnotator(functools.partial(load_spacy, model), model)
