"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, langid, lexical, line_dedup, minhash, replay, simhash, suffix_dedup, token_store, topk, url_filter, warc, word_bpe
from loomgraph.llm.common import new_dir, table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, pos, trim(list_extract(parts, pos), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, list_extract(parts, pos) AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)
), spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, s.first IS NOT NULL AND s.first <> (l.doc_id, l.pos) AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= {warc.MIN_REVISIT_BYTES} GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), short=True)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.fit_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return token_store.read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight")


def _term_rows() -> str:
    """The terms are runs of [a-z0-9], so a hit between boundaries is such a run of the URL."""
    words = url_filter.Vocabulary.default()
    return ", ".join([f"('{t}', 'strict', 0)" for t in sorted(words.strict)] + [f"('{t}', 'soft', {n})" for t, n in sorted(words.soft.items())])


OP8_SQL = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_filter(string_split_regex(low, '[^a-z0-9]+'), lambda w: w <> '') AS words
  FROM p
), t(term, kind, weight) AS (VALUES {_term_rows()}),
h AS (
  SELECT page_id, coalesce(sum(n) FILTER (kind = 'strict'), 0) AS strict_hits, count(*) FILTER (kind = 'soft') AS soft_terms, coalesce(sum(weight) FILTER (kind = 'soft'), 0) AS soft_weight
  FROM (SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(words) AS word FROM j) GROUP BY ALL) JOIN t ON word = term GROUP BY page_id
)
SELECT j.page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN strict_hits > 0 OR (soft_terms >= {url_filter.SOFT_AT_LEAST} AND soft_weight >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
  CAST(coalesce(strict_hits, 0) AS BIGINT) AS strict_hits, CAST(coalesce(soft_terms, 0) AS BIGINT) AS soft_terms, CAST(coalesce(soft_weight, 0) AS BIGINT) AS soft_weight
FROM j LEFT JOIN h USING (page_id)
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(table(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text, by a table of 256 entries that the statement makes itself."""
    digit = lambda k: f"instr('123456789ABCDEF', substr(hex({text}), CAST({k} AS BIGINT), 1))"
    read = f"list_transform(range(0, strlen({text})), lambda i: 16 * {digit('2 * i + 1')} + {digit('2 * i + 2')})"
    return f"xor(list_reduce(list_prepend(4294967295, {read}), lambda c, b: xor(c >> 8, list_extract(steps, (xor(c, b) & 255) + 1))), 4294967295)"


def _h_sql(k: int) -> str:
    return _crc32_sql(f"'{k}:' || conv_id || ':' || turn")


OP11_SQL = f"""
WITH RECURSIVE s AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps FROM (SELECT unnest(range(256)) AS n)
), t AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, {_crc32_sql("coalesce(text, '')")} AS crc,
         {_h_sql(0)} % 5 AS back, {_h_sql(1)} % 101 < 50 AS faulty, {_h_sql(2)} % 101 AS repair, [{", ".join(f"{_h_sql(a + 3)} % 3 = 0" for a in range(6))}] AS fails
  FROM conversations, s
), r AS (
  SELECT conv_id, CAST(-1 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS crc, CAST(NULL AS INTEGER) AS attempts, CAST(NULL AS BIGINT) AS first_at, CAST(NULL AS BIGINT) AS last_at, CAST([] AS BIGINT[]) AS lasts FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, turn, crc, CASE WHEN first_at IS NULL THEN 0 ELSE coalesce(good, 6) END, first_at, first_at + 20 * (pow(2, coalesce(good, 6) - 1)::BIGINT - 1),
         list_append(lasts, CASE WHEN good IS NOT NULL THEN first_at + 20 * (pow(2, good - 1)::BIGINT - 1) END)
  FROM (SELECT *, CASE WHEN first_at IS NOT NULL THEN list_filter(range(1, 7), lambda a: NOT faulty OR (first_at + 20 * (pow(2, a - 1)::BIGINT - 1) >= 7 * p + repair AND NOT list_extract(fails, a)))[1] END AS good
        FROM (SELECT t.*, lasts, CASE WHEN back = 0 OR back > t.p THEN 7 * t.p WHEN list_extract(lasts, t.p - back + 1) IS NOT NULL THEN greatest(7 * t.p, list_extract(lasts, t.p - back + 1)) END AS first_at
              FROM r JOIN t ON t.conv_id = r.conv_id AND t.p = r.p + 1))
), o AS (
  SELECT conv_id, turn, attempts, first_at, last_at, crc, CASE WHEN attempts = 0 THEN 'blocked' WHEN list_last(lasts) IS NULL THEN 'dead' ELSE 'delivered' END AS status FROM r WHERE p >= 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, turn) AS release_no FROM o WHERE status = 'delivered'
)
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no, CAST(sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no) AS BIGINT) AS state FROM n
UNION ALL SELECT conv_id, turn, status, attempts, first_at, last_at, NULL, NULL FROM o WHERE status <> 'delivered'
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: list_extract(ws, i) || ' ' || list_extract(ws, i + 1)) ELSE ws END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), linked AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), reach AS (
  SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(w.doc_id, least_id), w.doc_id) AS component_id, coalesce(least(w.doc_id, least_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(key: str, source: str) -> str:
    """(key, term) of every term of every text."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {source}"


OP13_SQL = f"""
WITH t AS ({_terms_sql("doc_id", "documents")}),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, all_docs),
q AS (SELECT DISTINCT item_id, term FROM ({_terms_sql("item_id", "benchmark")})),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {lexical.TOP}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_word_bpe": op4_word_bpe,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_language": op7_language,
    "op8_url_filter": op8_url_filter,
    "op9_token_store": op9_token_store,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_replay": op11_replay,
    "op12_minhash": op12_minhash,
    "op13_lexical": op13_lexical,
}
SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op6_topk": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_replay": OP11_SQL,
    "op12_minhash": OP12_SQL,
    "op13_lexical": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
