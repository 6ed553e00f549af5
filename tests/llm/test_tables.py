"""Operators on pages and vectors, and queries against their SQL."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from loomgraph.llm import queries, topk, url_filter, warc


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200 + "\r\n\r\n</p>"
    pages = [(5, "http://a/?q=ü", big, 1), (2, None, big, 2), (9, "http://a\r\nX: y", "short", 3), (3, "u", "short", 4), (4, "u", None, 5), (7, "u", "", 6), (8, "v", "z" * 100, 7), (8, "v", "z" * 100, 8), (None, "w", big, 9), (6, "WARC/1.1", "WARC/1.1\r\n\r\n" * 50, 10)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, payload int").repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder, file_bytes=200)
    assert index.count() == len(pages) and index.select("file").distinct().count() > 3
    got = {(r.page_id, r.payload_digest): r for r in warc.read_records(index, folder).collect()}
    for i, url, html, _ in pages:
        r = got[(i, hashlib.sha256((html or "").encode()).hexdigest())]
        assert r.payload_bytes == len((html or "").encode())
        assert r.url == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
        if r.record_type == "response":
            assert bytes(r.payload) == (html or "").encode()
    assert {i: (r.record_type, r.refers_to) for (i, _), r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("response", None), 3: ("response", None), 4: ("response", None), 7: ("response", None), 8: ("response", None), None: ("response", None), 6: ("response", None)}
    some = warc.read_records(index.filter("page_id in (5, 9)"), folder).collect()
    assert sorted(r.page_id for r in some) == [5, 9]
    assert warc.write_archives(df.limit(0), f"{folder}-none").count() == 0


def test_warc_ranges_coalesce():
    rows = [("a", 0, 10, 0), ("a", 10, 5, 0), ("a", 100, 5, 0), ("b", 0, 5, 0)]
    assert [[r[1] for r in run] for run in warc.coalesced(rows, gap=50, most=1000)] == [[0, 10], [100], [0]]
    assert len(list(warc.coalesced(rows, gap=500, most=12))) == 4


def brute_top(rows, k):
    use = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, a in use:
        if i % 50 == 0:
            pad = lambda x, n: np.pad(x, (0, n - len(x)))
            found = sorted((-int(pad(a, max(len(a), len(b))) @ pad(b, max(len(a), len(b)))), j) for j, b in use if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4, 256])
def test_top_k(spark, block_rows):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([0.5, -0.25, rnd.gauss(0, 0.2)]) for _ in range(6)]) for i in range(260)]
    rows += [(300, None), (350, []), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (401, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [0.25, 0.5]), (None, [1.0] * 6), (50, [0.1] * 6), (600, [0.5] * 6), (601, [0.5] * 6)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id bigint, embedding array<float>, score string, rank int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, block_rows=block_rows).collect())
    want = brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert [x for x in got if x[0] != 50] == [x for x in want if x[0] != 50]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_takes_the_nearest_score_of_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e18, 2.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0"), 4).orderBy("rank").collect()]
    most = (1 << 63) - 1
    assert got == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 4, most), (0, 4, 2, -most)]


def clustered_blocks(rnd, n):
    """Blocks of 32 rows, each around a direction of its own."""
    out = []
    for k in range(n):
        centre = rnd.normal(size=16) * 200
        rows = np.floor(centre + rnd.normal(size=(32, 16)) * 10).astype(np.int64)
        out.append((np.arange(32 * k, 32 * k + 32), rows, rows.min(0), rows.max(0)))
    return out


def test_top_k_prunes_blocks_and_more_with_a_known_score():
    blocks = clustered_blocks(np.random.default_rng(1), 40)
    rows = np.concatenate([b[1] for b in blocks])
    queries_, ids = rows[::50], np.arange(len(rows))[::50]
    none = np.full(len(ids), -topk.MOST)
    best, scored = topk.best_of_cell(ids, queries_, blocks, 5, none)
    want = brute_top([(i, (v / 256).tolist()) for i, v in enumerate(rows)], 5)
    assert [(r.query_id, r.vec_id, r.score) for r in best.itertuples()] == [(q, j, s) for q, _, j, s in want]
    assert scored < 0.5 * len(ids) * len(blocks)
    floors = best.groupby("query_id")["score"].min().to_numpy()
    first, mine = blocks[:20], blocks[20:]
    apart = [topk.best_of_cell(ids, queries_, part, 5, none)[1] for part in (first, mine)]
    shared = [topk.best_of_cell(ids, queries_, part, 5, floors)[1] for part in (first, mine)]
    assert sum(shared) < sum(apart)


def test_top_k_of_large_values():
    q, m = np.array([[1 << 40, -3]]), np.array([[1 << 20, 5], [-7, 1 << 50]])
    assert topk.product(q, m).tolist() == [[(1 << 60) - 15, -7 * (1 << 40) - 3 * (1 << 50)]]


URLS = {
    "http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://example.net/de": ("example.net", "/de", "net/", "block"),
    "http://example.net": ("example.net", "", None, "allow"),
    "https://x.example.com/de/?porn": ("x.example.com", "/de/", "example.com/de/", "block"),
    "https://y.org/fr/#porn": ("y.org", "/fr/", "org/fr/", "allow"),
    "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "ftp://h?x=1/2": ("h", "", None, "allow"),
    "no scheme porn": ("", "", None, "block"),
    "http://a.com/sexy": ("a.com", "/sexy", None, "allow"),
    "http://a.com/casino-casino": ("a.com", "/casino-casino", None, "allow"),
    "http://a.com/casino-POKER": ("a.com", "/casino-POKER", None, "block"),
    "http://a://b/c": ("a:", "//b/c", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_a_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("bad", "strict", None), ("soso", "soft", 1), ("soso", "soft", 3), ("meh", "soft", 2), ("bad", "soft", 9)], "term string, kind string, weight int")
    words = url_filter.Vocabulary.from_table(table, soft_limit=5)
    assert words == url_filter.Vocabulary(frozenset({"bad"}), {"soso": 3, "meh": 2}, 5)
    urls = {"http://x/bad": "block", "http://x/badly": "allow", "soso-soso": "allow", "SOSO/meh": "block", "meh": "allow", "ébadé": "block", "bad\nsoso": "block", None: "allow"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.verdict for r in url_filter.judge_urls(df, vocabulary=words).collect()} == urls


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", "y", "z", "z") for i, u in enumerate([*URLS, None])], "page_id bigint, url string, host string, verdict string, url_hits string, `URL_judged` string")
    out = url_filter.judge_urls(df, "url", queries.URL_RULES).collect()
    assert {(r.url_hits, r.URL_judged) for r in out} == {("z", "z")}
    assert len(out) == len(URLS) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.url], r.url
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, rows))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from loomgraph.llm import langid
    from tests.llm.test_texts import best_similarity, dedup, grouped, public

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    bench = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    docs += [{"doc_id": 9000 + i, "text": t, "lang": "en", "source": "src1", "n_chars": 0} for i, t in enumerate([None, "", "!!! 123", docs[3]["text"], bench[0]["text"], docs[5]["text"] + " and more"])]
    docs += [{"doc_id": 9100 + i, "text": f"{docs[7]['text']}\nThe same line on every site.", "lang": "en", "source": f"s{i}", "n_chars": 0} for i in range(12)]
    os.makedirs(tmp_path / "in")
    pq.write_table(pa.Table.from_pylist(docs), tmp_path / "in/documents.parquet")
    pq.write_table(pa.Table.from_pylist(bench), tmp_path / "in/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}/in").collect()}

    df = spark.read.parquet(f"file://{tmp_path}/in/documents.parquet")
    model = langid.train(langid.training_texts(df, "doc_id", "text", "lang"))
    said = langid.predicted(pa.array([d["text"] for d in docs], pa.string()), model).to_pylist()
    excess = lambda d, s: (s["bits_per_byte"] - corpus_pipeline.MOST_BITS_PER_BYTE) * len(d["text"].encode())
    left = [d for d, s in zip(docs, said) if s["lang_pred"] != "und" and excess(d, s) <= corpus_pipeline.EXCESS_BITS]
    cleaned = dedup([(d["doc_id"], d["text"], d["source"]) for d in left], 10)
    left = [d | {"text": t} for d, t in zip(left, cleaned) if t == d["text"] or t.strip()]
    root = grouped([(d["doc_id"], d["text"]) for d in left])
    left = [d for d in left if root[d["doc_id"]] == d["doc_id"]]
    left = [d for d in left if not any(best_similarity(d["text"], b["text"]) >= 0.8 for b in bench)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want = {d["doc_id"]: t.encode(d["text"], add_special_tokens=False).ids for d in left}
    assert got == {i: (len(x), np.array(x, "<u4").tobytes()) for i, x in want.items()}
    assert 9004 not in got and 9002 not in got and 9003 not in got


def test_stages_keep_the_columns_and_bear_odd_rows(spark, odd_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "three four five six seven")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, f"file://{tmp_path}")
            assert out.columns == docs.columns, name
            assert out.count() <= rows.count()
        assert corpus_pipeline.encode(spark, rows, f"file://{tmp_path}").count() == rows.count()
