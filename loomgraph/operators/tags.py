"""Tags of words by list, ending and shape."""

from __future__ import annotations

import unicodedata

from loomgraph import lexicons as lex

TAGS = ["DET", "PRON", "AUX", "ADP", "CCONJ", "PART", "PUNCT", "NUM", "VERB", "ADV", "ADJ", "PROPN", "NOUN"]
_PRONOUNS = [w for k in ("male", "female", "neutral", "plural", "demonstrative", "relative") for w in lex.PRONOUNS[k]]
_DETERMINERS = ["the", "a", "an"]
_ADPOSITIONS = ["of", "in", "to", "for", "on", "with", "at", "by", "from", "as", "via"]
_CONJUNCTIONS = ["and", "or", "but"]
#: of a word in several lists the first counts
_LISTED = [("DET", _DETERMINERS), ("PRON", _PRONOUNS), ("AUX", lex.AUXILIARY_VERBS), ("ADP", _ADPOSITIONS), ("CCONJ", _CONJUNCTIONS), ("PART", ["not"])]
_TAG = {w: t for t, words in reversed(_LISTED) for w in words}
_VERBS = frozenset(lex.COMMON_VERBS)


def _ends(low: str, least: int, endings: tuple[str, ...]) -> bool:
    """Whether the word is letters only, at least ``least`` before one of the endings."""
    return low.isalpha() and any(low.endswith(x) and len(low) >= least + len(x) for x in endings)


def tag(word: str, later: bool) -> str:
    """The tag of a word that begins a sentence or stands in it ``later``."""
    low = word.lower()
    if low in _TAG:
        return _TAG[low]
    if not any(c.isalnum() for c in word):
        return "PUNCT"
    if "0" <= word[0] <= "9":
        return "NUM"
    if low in _VERBS or _ends(low, 3, ("ed", "ing")):
        return "VERB"
    if low.endswith("ly"):
        return "ADV"
    if _ends(low, 2, ("ble", "ful", "ous", "ive")):
        return "ADJ"
    return "PROPN" if later and unicodedata.category(word[0]) == "Lu" else "NOUN"
