"""SQL building blocks that say in DuckDB what the operators compute.

``cte(names...)`` gives a WITH clause with the named blocks and all they rest on.
"""

from __future__ import annotations

from loomgraph import lexicons as lex
from loomgraph.operators.annotate import _ADPOSITIONS, _CONJUNCTIONS, _DETERMINERS


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def in_(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + " END"


def values(rows, columns: str) -> str:
    show = lambda x: q(x) if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(show(x) for x in r) + ")" for r in rows) + f") AS v({columns}))"


def pick(k: str, choices: list[str]) -> str:
    """One of the choices by k; the same text in Spark and DuckDB."""
    return f"CASE {k} % {len(choices)} " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(choices)) + " END"


#: invented advisories over ``part``: one SQL expression that both engines evaluate
ADVISORY = (
    "CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'Some people value a digital low bar below.' ELSE "
    "'CVE-2024-' || lpad(cast(p_partkey as string), 5, '0') || ': A ' || " + pick("p_partkey", list(lex.VULNERABILITIES)) + " || ' flaw (CWE-' || cast(100 + p_partkey % 50 as string) || ') in '"
    " || " + pick("p_partkey", ["Apache HTTP Server", "nginx", "OpenSSL", "the Linux Kernel", "PostgreSQL and MySQL", "Node.js", "GitLab"]) + " || ' version ' || cast(p_partkey % 5 as string) || '.' || cast(p_partkey % 11 as string) || '.2. However, it allows '"
    " || " + pick("p_partkey", [*lex.ATTACK_VECTORS]) + " || ' attackers to cause ' || " + pick("p_partkey", list(lex.IMPACTS)) + " || ' via strcpy(buf), malloc() x and memcpy.'"
    " || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) ELSE ' ' END || 'It was reported with ' || " + pick("p_partkey", ["Critical severity", "high risk", "low", "MODERATE impact", "no score"]) + " || '. Users should be patched or '"
    " || " + pick("p_partkey", ["upgrade to version 2.4.52.", "try a workaround.", "mitigate this by disabling uploads.", "patch by applying fix 9."]) + " || ' Therefore CVE-2024-' || lpad(cast(p_partkey as string), 5, '0') || ' is closed, however, slowly.' END"
)

#: white space in RE2, and what it is stripped by
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"
WS = rf"'^{SPACE}+|{SPACE}+$'"
BREAK = rf"\n{SPACE}*\n"

#: the advisories with other white space and digits than ASCII's
WIDE = f"CASE p_partkey % 3 WHEN 0 THEN translate({ADVISORY}, ' 2', '\u00a0\u0662') WHEN 1 THEN translate({ADVISORY}, ' 0', '\u2003\uff10') ELSE translate({ADVISORY}, 'x5', '\u00e9\u096b') END"


def shape(text: str) -> str:
    """The text as ASCII of the same length, digits as 0, other letters as _, white space as blanks: patterns that know ASCII only find in it what they find in Unicode text."""
    digits = rf"regexp_replace({text}, '\p{{Nd}}', '0', 'g')"
    letters = rf"regexp_replace({digits}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', '_', 'g')"
    return f"regexp_replace({letters}, '{SPACE}', ' ', 'g')"


BLOCKS: dict[str, tuple[list[str], str]] = {
    "corpus": ([], "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "turns": ([], "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"),
    "htmls": ([], "SELECT page_id AS doc_id, coalesce(html, '') AS text FROM pages"),
    "advisories": ([], f"SELECT p_partkey AS doc_id, {ADVISORY} AS text FROM part"),
    "wide": ([], f"SELECT p_partkey AS doc_id, {WIDE} AS text FROM part"),
}


def _add(name: str, needs: list[str], sql: str) -> None:
    BLOCKS[name] = (needs, sql)


def _text_blocks(src: str) -> None:
    """paras, sents and toks of a source, each suffixed with its name."""
    _add(f"paras0_{src}", [src], rf"SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, {q(BREAK)}), lambda p: regexp_replace(p, {WS}, '', 'g')), lambda p: p <> '') AS ps FROM {src}")
    _add(f"paras_{src}", [f"paras0_{src}"], f"SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS para_idx, unnest(ps) AS text FROM (SELECT doc_id, CASE WHEN len(ps) > 0 THEN ps ELSE [text] END AS ps FROM paras0_{src})")
    _add(f"sents0_{src}", [f"paras_{src}"], f"SELECT doc_id, para_idx, unnest(range(len(m))) AS k, unnest(m) AS raw FROM (SELECT doc_id, para_idx, regexp_extract_all(text, {q(lex.SENTENCE)}) AS m FROM paras_{src})")
    _add(f"sents1_{src}", [f"sents0_{src}"], rf"SELECT doc_id, para_idx, k, CAST(coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, para_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(regexp_replace(raw, '^{SPACE}+', '')) AS BIGINT) AS char_start, regexp_replace(raw, {WS}, '', 'g') AS text FROM sents0_{src}")
    _add(f"sents_{src}", [f"sents1_{src}"], f"SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS sent_idx, text, char_start, char_start + length(text) AS char_end FROM sents1_{src} WHERE text <> ''")
    _add(f"toks0_{src}", [f"sents_{src}"], f"SELECT doc_id, para_idx, sent_idx, char_start AS base, unnest(range(len(m))) AS token_idx, unnest(m) AS text, unnest(list_slice(g, 1, len(m))) AS gap FROM (SELECT *, regexp_extract_all(text, {q(lex.TOKEN)}) AS m, string_split_regex(text, {q(lex.TOKEN)}) AS g FROM sents_{src})")
    _add(f"toks1_{src}", [f"toks0_{src}"], f"SELECT *, CAST(base + sum(length(gap) + length(text)) OVER (PARTITION BY doc_id, sent_idx ORDER BY token_idx) AS BIGINT) AS char_end, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx, token_idx) - 1 AS i FROM toks0_{src}")
    _add(f"toks_{src}", [f"toks1_{src}"], f"SELECT doc_id, para_idx, sent_idx, token_idx, i, text, lower(text) AS lemma, char_end - length(text) AS char_start, char_end FROM toks1_{src}")
    # the initial graph of the rule annotator
    _add(
        f"nodes_{src}", [src, f"paras_{src}", f"sents_{src}", f"toks_{src}"],
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st, para, sent, kind, k1, k2) - 1 AS node_id, * EXCLUDE (doc_id) FROM (
        SELECT doc_id, 0 AS st, -1 AS para, -1 AS sent, 0 AS kind, 0 AS k1, 0 AS k2, 'DOCUMENT' AS node_type, substring(text, 1, 200) AS text, '' AS lemma, '' AS pos_tag, 0 AS para_idx, 0 AS sent_idx, 0 AS token_idx, 0 AS char_start, 0 AS char_end FROM {src}
        UNION ALL SELECT doc_id, 1, para_idx, -1, 0, 0, 0, 'PARAGRAPH', substring(text, 1, 100), '', '', para_idx, 0, 0, 0, 0 FROM paras_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 0, 0, 0, 'SENTENCE', text, '', '', para_idx, sent_idx, 0, char_start, char_end FROM sents_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 1, i, 0, 'TOKEN', text, lemma, '', para_idx, sent_idx, token_idx, char_start, char_end FROM toks_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 3, i, -1, 'PREDICATE', text, lower(text), 'VERB', para_idx, sent_idx, token_idx, 0, 0 FROM toks_{src} WHERE lower(text) IN {in_(lex.COMMON_VERBS)})""",
    )
    # tags, dependencies and entities of the lexicon annotator
    pronouns = [w for k in ("male", "female", "neutral", "plural", "demonstrative", "relative") for w in lex.PRONOUNS[k]]
    pos = (
        f"CASE WHEN lemma IN {in_(_DETERMINERS)} THEN 'DET' WHEN lemma IN {in_(pronouns)} THEN 'PRON' WHEN lemma IN {in_(lex.AUXILIARY_VERBS)} THEN 'AUX' "
        f"WHEN lemma IN {in_(_ADPOSITIONS)} THEN 'ADP' WHEN lemma IN {in_(_CONJUNCTIONS)} THEN 'CCONJ' WHEN lemma = 'not' THEN 'PART' "
        rf"WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN 'PUNCT' WHEN regexp_matches(text, '^[0-9]') THEN 'NUM' "
        rf"WHEN lemma IN {in_(lex.COMMON_VERBS)} OR regexp_matches(lemma, '^\p{{L}}{{3,}}(ed|ing)$') THEN 'VERB' WHEN regexp_matches(lemma, 'ly$') THEN 'ADV' "
        rf"WHEN regexp_matches(lemma, '^\p{{L}}{{2,}}(ble|ful|ous|ive)$') THEN 'ADJ' WHEN token_idx > 0 AND regexp_matches(text, '^\p{{Lu}}') THEN 'PROPN' ELSE 'NOUN' END"
    )
    w = "PARTITION BY doc_id, sent_idx ORDER BY token_idx"
    before, after, whole = (f"{w} ROWS BETWEEN {x}" for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
    _add(f"pos_{src}", [f"toks_{src}"], f"SELECT *, {pos} AS pos FROM toks_{src}")
    _add(
        f"near_{src}", [f"pos_{src}"],
        f"""SELECT *, max(verb) OVER ({before}) AS vl, min(verb) OVER ({after}) AS vr, min(noun) OVER ({after}) AS nr,
        coalesce(min(verb) OVER ({whole}), min(i) OVER ({whole})) AS root, lower(lag(text) OVER ({w})) AS prev, coalesce(lag(pos) OVER ({w}) = 'PROPN', false) AS prev_name
        FROM (SELECT *, CASE WHEN pos = 'VERB' THEN i END AS verb, CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END AS noun FROM pos_{src})""",
    )
    _add(
        f"dep_{src}", [f"near_{src}"],
        f"""SELECT *, CASE WHEN i = root THEN 'ROOT' WHEN pos = 'PUNCT' THEN 'punct'
        WHEN pos IN ('DET', 'ADJ', 'NUM') AND nr IS NOT NULL THEN CASE pos WHEN 'DET' THEN 'det' WHEN 'ADJ' THEN 'amod' ELSE 'nummod' END
        WHEN pos = 'VERB' AND vl IS NOT NULL THEN CASE WHEN prev = 'that' THEN 'ccomp' ELSE 'advcl' END
        WHEN pos IN ('NOUN', 'PROPN', 'PRON') AND vl IS NOT NULL THEN 'dobj' WHEN pos IN ('NOUN', 'PROPN', 'PRON') AND vr IS NOT NULL THEN 'nsubj'
        WHEN pos = 'AUX' AND vr IS NOT NULL THEN 'aux' WHEN pos = 'ADV' THEN 'advmod' WHEN pos = 'ADP' THEN 'prep' WHEN pos = 'PART' THEN 'neg' ELSE 'dep' END AS dep FROM near_{src}""",
    )
    _add(
        f"ltoks_{src}", [f"dep_{src}"],
        f"""SELECT * EXCLUDE (ent_no), ent_no, CASE WHEN pos <> 'PROPN' THEN '' WHEN count(*) OVER (PARTITION BY doc_id, ent_no, pos = 'PROPN') > 1 THEN 'PERSON'
        WHEN max(length(text)) OVER (PARTITION BY doc_id, ent_no, pos = 'PROPN') % 2 = 0 THEN 'ORG' ELSE 'GPE' END AS ent_type FROM (
        SELECT *, sum(CAST(ent_iob = 'B' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY para_idx, i) AS ent_no FROM (
        SELECT *, CASE WHEN dep = 'ROOT' THEN i WHEN dep IN ('det', 'amod', 'nummod') THEN nr WHEN dep IN ('nsubj', 'aux') THEN vr WHEN dep = 'punct' THEN root ELSE coalesce(vl, root) END AS head_i,
        CASE WHEN pos = 'PROPN' THEN CASE WHEN prev_name THEN 'I' ELSE 'B' END ELSE 'O' END AS ent_iob FROM dep_{src}))""",
    )
    _add(f"ents_{src}", [f"ltoks_{src}"], f"SELECT doc_id, para_idx, sent_idx, any_value(ent_type) AS label, min(i) AS start_i, max(i) + 1 AS end_i, min(char_start) AS char_start, max(char_end) AS char_end FROM ltoks_{src} WHERE ent_type <> '' GROUP BY doc_id, para_idx, sent_idx, ent_no")
    _add(
        f"chunks_{src}", [f"ltoks_{src}"],
        f"""SELECT doc_id, para_idx, sent_idx, min(i) AS start_i, max(i) + 1 AS end_i, min(char_start) AS char_start, max(char_end) AS char_end FROM (
        SELECT *, max(CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END) OVER (PARTITION BY doc_id, sent_idx, chunk) AS last FROM (
        SELECT *, sum(CAST(pos NOT IN ('DET', 'ADJ', 'NUM', 'NOUN', 'PROPN') AS INTEGER)) OVER ({w}) AS chunk FROM ltoks_{src}) WHERE pos IN ('DET', 'ADJ', 'NUM', 'NOUN', 'PROPN')) WHERE i <= last GROUP BY doc_id, para_idx, sent_idx, chunk""",
    )
    verb = f"pos = 'VERB' AND dep NOT IN ('aux', 'auxpass') AND lemma NOT IN {in_(lex.AUXILIARY_VERBS)}"
    _add(f"lpreds_{src}", [f"ltoks_{src}"], f"SELECT * FROM ltoks_{src} WHERE {verb}")
    _add(f"lents_{src}", [f"ents_{src}", f"paras_{src}"], f"SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.para_idx, e.sent_idx, e.start_i) - 1 AS ent, substring(p.text, CAST(e.char_start + 1 AS BIGINT), CAST(e.char_end - e.char_start AS BIGINT)) AS text FROM ents_{src} e JOIN paras_{src} p USING (doc_id, para_idx)")


def _graph_blocks(src: str) -> None:
    """The initial graph of the lexicon annotator: lnodes (clauses without their text) and its edges."""
    t, zero = f"ltoks_{src}", "'' AS lemma, '' AS dep, '' AS ent_type, '' AS ent_iob, '' AS role"
    roles = f"CASE c.dep {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in lex.ROLE_OF_DEP.items())} END"
    _add(f"largs_{src}", [t, f"lpreds_{src}"], f"SELECT c.*, p.i AS verb_i, p.sent_idx AS verb_sent, {roles} AS role FROM {t} c JOIN lpreds_{src} p ON p.doc_id = c.doc_id AND p.para_idx = c.para_idx AND p.i = c.head_i WHERE c.head_i <> c.i AND c.dep IN {in_(lex.ROLE_OF_DEP)}")
    companions = f"c.dep IN {in_(lex.VERB_GROUP_DEPS)} AND c.head_i <> c.i"
    _add(f"lgroups_{src}", [t], f"SELECT v.*, c.i AS companion FROM {t} v JOIN {t} c ON c.doc_id = v.doc_id AND c.para_idx = v.para_idx AND c.head_i = v.i WHERE {companions} AND v.pos = 'VERB' AND v.dep NOT IN ('aux', 'auxpass')")
    columns = "doc_id, st, para, sent, kind, k1, k2, node_type, text, lemma, dep, ent_type, ent_iob, role, sent_idx, token_idx, char_start, char_end"
    _add(
        f"lnodes_{src}", [src, f"paras_{src}", f"sents_{src}", f"lents_{src}", f"chunks_{src}", f"largs_{src}", f"lgroups_{src}", f"lpreds_{src}", t],
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st, para, sent, kind, k1, k2) - 1 AS node_id, * EXCLUDE (doc_id) FROM (
        SELECT doc_id, 0 AS st, -1 AS para, -1 AS sent, 0 AS kind, 0 AS k1, 0 AS k2, 'DOCUMENT' AS node_type, substring(text, 1, 200) AS text, {zero}, 0 AS sent_idx, 0 AS token_idx, 0 AS char_start, 0 AS char_end FROM {src}
        UNION ALL SELECT doc_id, 1, para_idx, -1, 0, 0, 0, 'PARAGRAPH', substring(text, 1, 100), {zero}, 0, 0, 0, 0 FROM paras_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 0, 0, 0, 'SENTENCE', text, {zero}, sent_idx, 0, char_start, char_end FROM sents_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 1, i, 0, 'TOKEN', text, lemma, dep, ent_type, ent_iob, '', sent_idx, token_idx, char_start, char_end FROM {t}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 2, start_i, end_i, 'ENTITY', text, '', '', label, '', '', sent_idx, 0, char_start, char_end FROM lents_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 3, i, -1, 'PREDICATE', text, lemma, '', '', '', '', sent_idx, token_idx, 0, 0 FROM lpreds_{src}
        UNION ALL SELECT doc_id, 1, para_idx, verb_sent, 3, verb_i, i, 'ARGUMENT', text, lemma, dep, '', '', role, sent_idx, token_idx, 0, 0 FROM largs_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 4, start_i, end_i, 'NOUN_PHRASE', '', {zero}, sent_idx, 0, 0, 0 FROM chunks_{src}
        UNION ALL SELECT doc_id, 1, para_idx, sent_idx, 5, i, 0, 'CLAUSE', '', '', dep, '', '', '', sent_idx, 0, 0, 0 FROM {t} WHERE dep IN {in_(lex.CLAUSE_DEPS)}
        UNION ALL SELECT DISTINCT doc_id, 1, para_idx, sent_idx, 6, i, 0, 'VERB_PHRASE', '', {zero}, sent_idx, 0, 0, 0 FROM lgroups_{src}) AS n ({columns})""",
    )
    _add(f"ltoken_{src}", [f"lnodes_{src}"], f"SELECT doc_id, para, k1 AS i, node_id FROM lnodes_{src} WHERE node_type = 'TOKEN'")
    _add(f"lcontains_{src}", [f"lnodes_{src}"], contains_sql(f"lnodes_{src}", "para", "sent"))
    on = "t.doc_id = n.doc_id AND t.para = n.para"
    _add(
        f"lbelongs_{src}", [f"lnodes_{src}", f"ltoken_{src}", f"lgroups_{src}"],
        f"""SELECT n.doc_id, n.node_id AS src, t.node_id AS dst, n.node_type FROM lnodes_{src} n JOIN ltoken_{src} t ON {on} AND t.i >= n.k1 AND t.i < n.k2 WHERE n.node_type IN ('ENTITY', 'NOUN_PHRASE')
        UNION ALL SELECT n.doc_id, n.node_id, t.node_id, n.node_type FROM lnodes_{src} n JOIN ltoken_{src} t ON {on} AND t.i = CASE n.node_type WHEN 'ARGUMENT' THEN n.k2 ELSE n.k1 END WHERE n.node_type IN ('PREDICATE', 'ARGUMENT', 'VERB_PHRASE')
        UNION ALL SELECT n.doc_id, n.node_id, t.node_id, n.node_type FROM lnodes_{src} n JOIN lgroups_{src} g ON g.doc_id = n.doc_id AND g.para_idx = n.para AND g.i = n.k1 JOIN ltoken_{src} t ON {on} AND t.i = g.companion WHERE n.node_type = 'VERB_PHRASE'""",
    )
    _add(
        f"lsrl_{src}", [f"lnodes_{src}", f"ltoken_{src}"],
        f"""SELECT a.doc_id, CASE k WHEN 0 THEN t.node_id ELSE a.node_id END AS src, v.node_id AS dst, a.role AS srl_label, a.dep AS dep_label FROM lnodes_{src} a
        JOIN lnodes_{src} v ON v.doc_id = a.doc_id AND v.para = a.para AND v.k1 = a.k1 AND v.node_type = 'PREDICATE' JOIN ltoken_{src} t ON t.doc_id = a.doc_id AND t.para = a.para AND t.i = a.k2, (VALUES (0), (1)) AS w(k) WHERE a.node_type = 'ARGUMENT'""",
    )
    _add(f"ldep_{src}", [t, f"ltoken_{src}"], f"SELECT c.doc_id, h.node_id AS src, m.node_id AS dst, c.dep AS dep_label FROM {t} c JOIN ltoken_{src} h ON h.doc_id = c.doc_id AND h.para = c.para_idx AND h.i = c.head_i JOIN ltoken_{src} m ON m.doc_id = c.doc_id AND m.para = c.para_idx AND m.i = c.i WHERE c.dep <> '' AND c.head_i <> c.i")
    _add(f"lent_{src}", [f"lnodes_{src}"], f"SELECT doc_id, node_id AS ent, ent_type AS label, text, sent_idx, char_start, char_end FROM lnodes_{src} WHERE node_type = 'ENTITY'")
    # where entities are first met, and pronouns with the entity they refer to
    _add(f"lmet_{src}", [t, f"lent_{src}"], f"SELECT t.doc_id, t.sent_idx, t.token_idx, min(e.ent) AS ent FROM {t} t JOIN lent_{src} e ON e.doc_id = t.doc_id AND e.sent_idx = t.sent_idx AND e.char_start <= t.char_start AND t.char_end <= e.char_end WHERE t.ent_iob = 'B' GROUP BY t.doc_id, t.sent_idx, t.token_idx")
    _add(f"lseen_{src}", [f"lmet_{src}", f"lent_{src}"], f"SELECT m.doc_id, m.ent, any_value(e.label) AS label, min((m.sent_idx, m.token_idx)) AS place FROM lmet_{src} m JOIN lent_{src} e ON e.doc_id = m.doc_id AND e.ent = m.ent GROUP BY m.doc_id, m.ent")
    p = lex.PRONOUNS
    want = f"CASE WHEN lemma IN {in_(p['male'] + p['female'])} THEN 'person' WHEN lemma IN {in_(p['neutral'])} THEN 'thing' WHEN lemma IN {in_(p['plural'])} THEN 'group' WHEN lemma IN {in_(p['demonstrative'] + p['relative'])} THEN 'any' END"
    fits = f"CASE t.want WHEN 'person' THEN s.label IN {in_(lex.PERSON_TYPES)} WHEN 'thing' THEN s.label NOT IN {in_(lex.PERSON_TYPES)} WHEN 'group' THEN s.label IN {in_(lex.GROUP_TYPES)} ELSE true END"
    _add(
        f"lmentions_{src}", [t, f"lseen_{src}"],
        f"""SELECT t.doc_id, t.sent_idx, t.token_idx, t.text, t.para_idx, t.i, coalesce(max_by(s.ent, s.place) FILTER ({fits}), max_by(s.ent, s.place)) AS antecedent
        FROM (SELECT doc_id, sent_idx, token_idx, text, para_idx, i, {want} AS want FROM {t}) t JOIN lseen_{src} s ON s.doc_id = t.doc_id AND s.place <= (t.sent_idx, t.token_idx) WHERE t.want IS NOT NULL GROUP BY ALL""",
    )


def contains_sql(nodes: str, para: str, sent: str) -> str:
    """(doc_id, src, dst) of CONTAINS edges: paragraphs in the document, sentences in paragraphs, all else in sentences."""
    held = lambda t: f"max(CASE WHEN node_type = '{t}' THEN node_id END)"
    return f"""SELECT doc_id, src, dst FROM (SELECT doc_id, node_id AS dst, node_type, CASE node_type WHEN 'PARAGRAPH' THEN 0 WHEN 'SENTENCE' THEN {held("PARAGRAPH")} OVER (PARTITION BY doc_id, {para})
        ELSE {held("SENTENCE")} OVER (PARTITION BY doc_id, {para}, {sent}) END AS src FROM {nodes}) WHERE node_type NOT IN ('DOCUMENT', 'ARGUMENT')"""


def topics_sql(tokens: str, place: str) -> str:
    """(doc_id, word, freq, rank) of the five most frequent words of each document."""
    return f"SELECT doc_id, word, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS rank FROM (SELECT doc_id, lemma AS word, count(*) AS freq, min({place}) AS first FROM {tokens} WHERE lemma NOT IN {in_(lex.STOPWORDS)} AND length(lemma) > 2 GROUP BY doc_id, lemma) QUALIFY rank <= 5"


def marker_sql(sents: str) -> str:
    """(doc_id, sent_idx, marker, label) of each sentence but the first."""
    low = "lower(text)"
    tests = [f"WHEN starts_with({low}, {q(m)}) OR contains({low}, {q(f', {m} ')}) OR contains({low}, {q(f', {m},')}) THEN {q(m)}" for m in sorted(lex.DISCOURSE_MARKERS, key=len, reverse=True)]
    return f"SELECT doc_id, sent_idx, marker, {case('marker', lex.DISCOURSE_MARKERS)} AS label FROM (SELECT doc_id, sent_idx, CASE {' '.join(tests)} END AS marker FROM {sents} WHERE sent_idx > 0)"


for _src in ("corpus", "turns", "advisories", "wide"):
    _text_blocks(_src)
    _graph_blocks(_src)
    _add(f"topics_{_src}", [f"nodes_{_src}"], topics_sql(f"(SELECT * FROM nodes_{_src} WHERE node_type = 'TOKEN')", "node_id"))
    _add(f"markers_{_src}", [f"sents_{_src}"], marker_sql(f"sents_{_src}"))


# ---- security entities


def pattern_sql(rank: int, pattern: str, entity_type: str, domain: str, confidence: float, src: str = "advisories", shaped: bool = True) -> str:
    seen = shape("text") if shaped else "text"
    return f"""SELECT doc_id, {rank} AS rank, 0 AS o1, ord AS o2, {q(entity_type)} AS entity_type, {domain} AS domain_type, substring(text, CAST(e - length(match) + 1 AS BIGINT), length(match)) AS text, e - length(match) AS char_start, e AS char_end, CAST({confidence} AS DOUBLE) AS confidence FROM (
        SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS e FROM (
        SELECT doc_id, text, unnest(range(len(m))) AS ord, unnest(m) AS match, unnest(list_slice(g, 1, len(m))) AS gap FROM (SELECT doc_id, text, regexp_extract_all(seen, {q(pattern)}) AS m, string_split_regex(seen, {q(pattern)}) AS g FROM (SELECT doc_id, text, {seen} AS seen FROM {src}))))"""


def _phrases(phrases: list[tuple[str, str]]) -> str:
    return values([(i, p, d) for i, (p, d) in enumerate(phrases)], "o1, phrase, domain")


def all_phrases_sql(rank: int, phrases: list[tuple[str, str]], entity_type: str, confidence: float, src: str = "advisories") -> str:
    return f"""SELECT doc_id, {rank} AS rank, o1, ord AS o2, {q(entity_type)} AS entity_type, domain AS domain_type, substring(text, CAST(e - length(phrase) + 1 AS BIGINT), length(phrase)) AS text, e - length(phrase) AS char_start, e AS char_end, CAST({confidence} AS DOUBLE) AS confidence FROM (
        SELECT *, CAST(sum(length(gap) + length(phrase)) OVER (PARTITION BY doc_id, o1 ORDER BY ord) AS BIGINT) AS e FROM (
        SELECT doc_id, text, o1, phrase, domain, unnest(range(len(g) - 1)) AS ord, unnest(list_slice(g, 1, len(g) - 1)) AS gap FROM (SELECT d.doc_id, d.text, p.*, string_split(lower(d.text), p.phrase) AS g FROM {src} d JOIN {_phrases(phrases)} p ON contains(lower(d.text), p.phrase))))"""


def first_phrases_sql(rank: int, phrases: list[tuple[str, str]], entity_type: str, confidence: float, src: str = "advisories") -> str:
    return f"""SELECT doc_id, {rank} AS rank, o1, 0 AS o2, {q(entity_type)} AS entity_type, domain AS domain_type, substring(text, strpos(lower(text), phrase), length(phrase)) AS text, strpos(lower(text), phrase) - 1 AS char_start, strpos(lower(text), phrase) - 1 + length(phrase) AS char_end, CAST({confidence} AS DOUBLE) AS confidence
        FROM {src} d JOIN {_phrases(phrases)} p ON contains(lower(d.text), p.phrase)"""


def remediation_sql(src: str = "advisories") -> str:
    parts = [f"SELECT doc_id, text, {i} AS o1, {q(d)} AS domain, length(regexp_extract(seen, {q(p)})) AS n, length(string_split_regex(seen, {q(p)})[1]) AS start FROM shapes" for i, (d, p) in enumerate(lex.REMEDIATIONS)]
    return f"WITH shapes AS MATERIALIZED (SELECT doc_id, text, {shape('text')} AS seen FROM {src}) SELECT doc_id, 10 AS rank, o1, 0 AS o2, 'REMEDIATION' AS entity_type, domain AS domain_type, substring(text, CAST(start + 1 AS BIGINT), n) AS text, start AS char_start, start + n AS char_end, CAST(0.85 AS DOUBLE) AS confidence FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def _longest(phrases: dict[str, str]) -> list[tuple[str, str]]:
    return [(p, phrases[p]) for p in sorted(phrases, key=len, reverse=True)]


def extractors(src: str) -> dict[str, str]:
    return {
        "cve": pattern_sql(1, lex.CVE, "CVE_ID", "'vulnerability_id'", 1.0, src),
        "cwe": pattern_sql(2, lex.CWE, "CWE_ID", "'weakness_class'", 1.0, src),
        "version": pattern_sql(3, lex.VERSION, "VERSION", "'software_version'", 0.8, src),
        "software": all_phrases_sql(4, [(p, "software_product") for p in sorted(sorted(lex.SOFTWARE), key=len, reverse=True)], "SOFTWARE", 0.9, src),
        "code_element": pattern_sql(5, lex.CODE_ELEMENT, "CODE_ELEMENT", "'code_construct'", 1.0, src, shaped=False),
        "attack_vector": first_phrases_sql(6, _longest(lex.ATTACK_VECTORS), "ATTACK_VECTOR", 0.85, src),
        "impact": first_phrases_sql(7, _longest(lex.IMPACTS), "IMPACT", 0.9, src),
        "vulnerability": first_phrases_sql(8, _longest(lex.VULNERABILITIES), "VULN_TYPE", 0.95, src),
        "severity": pattern_sql(9, lex.SEVERITY, "SEVERITY", f"lower(regexp_extract(match, {q(lex.SEVERITY)}, 1))", 0.9, src),
        "remediation": remediation_sql(src),
    }


EXTRACTORS = extractors("advisories")
for _src, _mark in (("advisories", ""), ("wide", "_wide")):
    _add(f"sec0{_mark}", [_src], " UNION ALL ".join(f"SELECT * FROM ({x})" for x in extractors(_src).values()))
    _add(f"sec{_mark}", [f"sec0{_mark}"], f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, o1, o2) - 1 AS ent_ord FROM sec0{_mark}")
    _add(
        f"seclinks{_mark}", [f"sec{_mark}", f"sents_{_src}"],
        f"""SELECT e.*, coalesce(s.s, 0) AS sent_idx, s.s IS NOT NULL AS linked FROM sec{_mark} e LEFT JOIN (
        SELECT e.doc_id, e.ent_ord, min(s.sent_idx) AS s FROM sec{_mark} e JOIN sents_{_src} s ON e.doc_id = s.doc_id AND s.char_start <= e.char_start AND e.char_start <= s.char_end GROUP BY e.doc_id, e.ent_ord) s USING (doc_id, ent_ord)""",
    )
_RULES = [(i, name, s, d) for i, (name, ss, ds) in enumerate(lex.RELATIONS) for s in ss for d in ds]
_add("secpairs", ["sec"], f"SELECT a.doc_id, r.rule, r.relation, a.ent_ord AS src, b.ent_ord AS dst FROM sec a JOIN {values(_RULES, 'rule, relation, s, d')} r ON a.domain_type = r.s JOIN sec b ON b.doc_id = a.doc_id AND b.domain_type = r.d")

# ---- the star-schema graph: one document 0

_add(
    "star_nodes", [],
    """SELECT 0 AS doc_id, CAST(r_regionkey AS BIGINT) AS node_id, 'DOCUMENT' AS node_type, r_name AS text FROM region
    UNION ALL SELECT 0, 100 + n_nationkey, 'PARAGRAPH', n_name FROM nation
    UNION ALL SELECT 0, 1000 + s_suppkey, 'ENTITY', s_name FROM supplier
    UNION ALL SELECT 0, 10000000 + c_custkey, 'SENTENCE', c_name FROM customer
    UNION ALL SELECT 0, 100000000 + o_orderkey, 'TOKEN', o_orderpriority FROM orders
    UNION ALL SELECT 0, 1000000000 + p_partkey, 'CONCEPT', p_name FROM part""",
)
_add(
    "star_links", [],
    """SELECT 0 AS doc_id, CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst, 'CONTAINS' AS edge_type, CAST(n_nationkey AS BIGINT) AS place, 0 AS kind FROM nation
    UNION ALL SELECT 0, 100 + s_nationkey, 1000 + s_suppkey, 'CONTAINS', s_suppkey, 1 FROM supplier
    UNION ALL SELECT 0, 100 + c_nationkey, 10000000 + c_custkey, 'CONTAINS', c_custkey, 2 FROM customer
    UNION ALL SELECT 0, 10000000 + o_custkey, 100000000 + o_orderkey, 'CONTAINS', o_orderkey, 3 FROM orders
    UNION ALL SELECT 0, 1000 + l_suppkey, 1000000000 + l_partkey, 'ENTITY_REL', l_orderkey * 10 + l_linenumber, 4 FROM lineitem""",
)
_add("star_edges", ["star_links"], "SELECT doc_id, src, dst, edge_type, kind, place, row_number() OVER (ORDER BY kind, place) - 1 AS edge_id FROM star_links")
_add("star_first", ["star_edges"], "SELECT doc_id, src, dst, edge_type, min(edge_id) AS edge_id FROM star_edges GROUP BY doc_id, src, dst, edge_type")


def cte(*names: str) -> str:
    """A WITH clause of the named blocks, in order of need."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in BLOCKS[name][0]:
            visit(need)
        done.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in done) + "\n"
