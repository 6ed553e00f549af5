"""Operators on texts against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import decontaminate, hashing, langid, line_dedup, queries, simhash, suffix_dedup, suffix_sort, token_store, word_bpe
from loomgraph.llm.common import byte_view

public = pytest.importorskip("public_tokenizers")


def words3(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def fingerprint(text):
    w = words3(text or "")
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    if not shingles:
        return 0
    counts = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints):
    """{id: smallest id reachable} by brute force over (id, fingerprint) pairs."""
    ids = sorted({i for i, _ in prints if i is not None})
    root = {f: min([i for i, g in prints if g == f and i is not None], default=None) for _, f in prints}
    for _ in ids:
        changed = False
        for f in root:
            for g in root:
                if (f ^ g).bit_count() <= 3 and root[g] is not None and (root[f] is None or root[g] < root[f]):
                    root[f], changed = root[g], True
        if not changed:
            break
    return root


def repeats(docs, length=100):
    """(n_bytes, n_removed, n_spans, kept) of (id, text) rows in order."""
    seen, out = set(), []
    for _, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if (w := b[s : s + length]) in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def dedup(rows, min_sites):
    """Texts of (id, text, site) rows without boilerplate lines."""
    found = collections.defaultdict(list)
    for i, (doc, text, site) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            if bare := line.strip(" \t\r\x0b\x0c"):
                found[bare].append((doc, i, k, site))
    gone = set()
    for places in found.values():
        if len({s for *_, s in places}) >= min_sites:
            gone |= {(i, k) for _, i, k, _ in sorted(places, key=lambda p: (p[0], p[1], p[2]))[1:]}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, (_, t, _) in enumerate(rows)]


def grouped(rows):
    """{id: smallest id of its group}: texts linked by a similarity of 0.8 or more of their sets of 5-word shingles, all with all."""
    sets = {}
    for i, text in rows:
        w = words3(text or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}
    near = [(i, j) for i in sets for j in sets if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return root


def bag(text, width=5):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return w, [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([tuple(w)] if w else [])


def best_similarity(text, item, width=5):
    w, s = bag(text, width)
    iw, own = bag(item, width)
    if not s or not own:
        return 0.0
    span, own, best = max(min(len(iw), len(w)) - width + 1, 1), collections.Counter(own), 0.0
    for a in range(len(s) - span + 1):
        c = collections.Counter(s[a : a + span])
        common = sum((c & own).values())
        best = max(best, common / (span + sum(own.values()) - common))
    return best


# ---- shared pieces


@given(st.lists(st.binary(min_size=0, max_size=70), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_vector_xxh64_is_xxh64(parts):
    parts = parts + [p * 3 for p in parts for _ in range(4)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    assert hashing.xxh64(data, starts, sizes).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


@given(st.lists(st.one_of(st.lists(st.integers(1, 4), max_size=60), st.builds(lambda x, n: x * n, st.lists(st.integers(1, 3), max_size=5), st.integers(1, 20))), max_size=6))
@settings(max_examples=300, deadline=None)
def test_suffix_arrays_by_grouping(texts):
    texts = [[*x, 0] for x in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    got = suffix_sort.suffix_arrays(np.array([x for t in texts for x in t], np.int64), bounds)
    want = [b + i for b, t in zip(bounds.tolist(), texts) for i in sorted(range(len(t)), key=lambda i: t[i:])]
    assert got.tolist() == want


# ---- SimHash


@given(st.lists(st.text(alphabet="aB cé\n\t.", max_size=60), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_fingerprints(texts):
    assert simhash.fingerprints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()), key=str)
    prints = [(r[0], fingerprint(r[1])) for r in odd_rows]
    root = components(prints)
    assert got == sorted(((i, f"{f:016x}", root[f]) for i, f in prints), key=str)


def test_links_cover_every_pair_within_the_radius(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for i in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << i
            prints.add(x)
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(spark.createDataFrame(rows, "fp bigint, rep bigint")).collect()}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_rows_without_an_id_link_others(spark, monkeypatch):
    prints = {1: 0, None: 0b111, 3: 0b111111, 4: 1 << 40, 5: 0b1111 << 50}
    texts = {f"text {k}": v for k, v in prints.items()}
    rows = [(k, f"text {k}") for k in prints] + [(None, "text 4")]
    marked = spark.createDataFrame([(i, texts[t] - (1 << 64) if texts[t] >> 63 else texts[t]) for i, t in rows], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda *a: marked)
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: v for (k, _), v in out.items() if k} == {1: 1, 3: 1, 4: 1, 5: 5} and out[None, f"{7:016x}"] == 1


def test_documents_that_share_an_id_lose_their_own_lines_only(spark):
    line = "Subscribe to our newsletter"
    rows = [(i, f"{line}\nown {i}", f"s{i}") for i in range(12)] + [(20, f"a\n{line}\n", "x"), (20, f"b\nc\n{line}", "x"), (20, f"b\nc\n{line}", None), (None, f"{line}\n\nd", "x"), (None, "d", "x")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).collect()
    want = dedup([(-1 if i is None else i, t, s) for i, t, s in rows], 10)
    assert sorted(((r.doc_id, r.text, r.source) for r in out), key=str) == sorted(((i, t, s) for (i, _, s), t in zip(rows, want)), key=str)
    assert [r.n_lines for r in out if r.text == "a\n"] == [3]


def test_components_of_a_chain_and_a_star(spark):
    from loomgraph.llm.graph import components as joined

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in joined(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 160)}}


# ---- line dedup


def test_line_dedup(spark, odd_docs, odd_rows):
    rnd = random.Random(5)
    common = [f"boilerplate line {i}" for i in range(4)]
    rows = [(i, "\n".join(rnd.choice([*common, f"own {i} {k}", "", "  "]) for k in range(8)), f"site{rnd.randint(0, 5)}") for i in range(60)]
    for min_sites in (2, 5, 6):
        out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_sites=min_sites)
        assert {r.doc_id: r.text for r in out.collect()} == dict(zip((r[0] for r in rows), dedup(rows, min_sites)))
    out = line_dedup.dedup_lines(odd_docs, min_sites=2).collect()
    assert len(out) == len(odd_rows) and sum(r.text is None for r in out) == 1
    # the sites b and c share the long text: it stays in the smaller id
    assert {r.doc_id: r.n_removed for r in out if r.doc_id in (4, 5)} == {4: 0, 5: 1}


# ---- decontamination


def test_leaks_against_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([3, 5, 8, 15, 30, 59, 30])] + [(90, None), (91, ""), (92, "  !! ")]
    docs = []
    for i in range(120):
        w = say(rnd.randint(0, 150))
        if i % 2:
            leak = (rnd.choice(items[:7])[1]).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                at = rnd.randrange(len(leak))
                leak[at : at + 1] = rnd.choice([[], ["zz"], [leak[at], "yy"]])
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() if rnd.random() < 0.3 else x + rnd.choice(["", ",", "\n"]) for x in leak]
        docs.append((i, " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, x.item_id): x.similarity for r in decontaminate.with_leaks(df, bench).collect() for x in r.leaks}
    want = {(i, j): s for i, t in docs for j, x in items if (s := best_similarity(t, x)) >= 0.8}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert any(0.8 <= s < 1 for s in want.values())


def test_leaks_of_odd_rows(spark, odd_docs, odd_rows):
    bench = spark.createDataFrame([(1, "three four five"), (2, None), (3, "three four five")], "item_id bigint, text string")
    out = decontaminate.with_leaks(odd_docs, bench).collect()
    assert len(out) == len(odd_rows)
    assert [sorted(x.item_id for x in r.leaks) for r in out if r.text == "three four five"] == [[1, 3]]
    assert sum(bool(r.leaks) for r in out) == 1
    assert decontaminate.with_leaks(odd_docs, bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_every_print_within_the_radius_is_a_candidate():
    rnd = random.Random(2)
    index = decontaminate.Index.build([" ".join(f"a{rnd.randint(0, 99)}" for _ in range(20)) for _ in range(30)])
    sized = index.sizes[20]
    for item, p in enumerate(sized.prints.tolist()):
        for n in (0, 1, 10, decontaminate.RADIUS, decontaminate.RADIUS + 1):
            x = p
            for b in rnd.sample(range(64), n):
                x ^= 1 << b
            found = sized.look_up(np.array([x], np.uint64), decontaminate.RADIUS)[1].tolist()
            assert (item in found) == (n <= decontaminate.RADIUS)


def leaky_texts(rnd, n, size):
    """Texts that each hold an edited item of ``size`` words, with the similarity of the best window."""
    items = [[f"i{k}w{rnd.randint(0, 5000)}" for _ in range(size)] for k in range(40)]
    out = []
    while len(out) < n:
        k = rnd.randrange(len(items))
        leak = list(items[k])
        for _ in range(rnd.choice([0, 1, 1, 2])):
            leak[rnd.randrange(size)] = "zz"
        text = " ".join([f"x{rnd.randint(0, 9999)}" for _ in range(rnd.randint(0, 40))] + leak + ["end"])
        if best_similarity(text, " ".join(items[k])) >= 0.8:
            out.append((k, text))
    return [" ".join(x) for x in items], out


def test_recall_of_the_blocks_and_that_matches_come_from_them():
    rnd = random.Random(9)
    found = total = 0
    for size in (30, 60, 120):
        items, texts = leaky_texts(rnd, 300, size)
        index = decontaminate.Index.build(items)
        leaks = decontaminate.leaks_of(pa.array([t for _, t in texts]), index)
        found += sum(k in [x[0] for x in got] for (k, _), got in zip(texts, leaks))
        total += len(texts)
        for sized in index.sizes.values():
            sized.tables = [(np.zeros_like(offsets), held[:0]) for offsets, held in sized.tables]
        assert not any(decontaminate.leaks_of(pa.array([t for _, t in texts]), index))
    assert found >= 0.99 * total


def test_leaks_with_items_in_several_groups_and_ids_of_any_type(spark):
    rnd = random.Random(5)
    items, texts = leaky_texts(rnd, 30, 40)
    docs = spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(f"item-{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    whole = {(r.doc_id, x) for r in decontaminate.with_leaks(docs, bench).collect() for x in r.leaks}
    parts = {(r.doc_id, x) for r in decontaminate.with_leaks(docs, bench, group_words=200).collect() for x in r.leaks}
    assert whole == parts and {(i, f"item-{k}") for i, (k, _) in enumerate(texts)} <= {(i, x.item_id) for i, x in whole}


# ---- tokens


def test_pieces_are_encoded_as_the_library_does():
    rnd = random.Random(3)
    bits = ["a", "Zz", "é", "ß", "×", "÷", "ÿ", "Ÿ", "漢", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "'s", "'ll", "'", "don't", "1", "23", "_", "-", "...", "<|endoftext|>", "<|end", "|>", "ª", "µ", "word", " the", "😀"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    ids, at = token_store.encode_texts(pa.array(texts), public.path("byte_bpe_50k.json"), None)
    for i, want in enumerate(reference_ids("byte_bpe_50k.json", texts)[1]):
        assert ids[at[i] : at[i + 1]].tolist() == want, texts[i]


def test_pieces_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"ab ab abc ab", np.uint8)
    pieces, place = hashing.distinct(data, np.array([0, 3, 6, 10]))
    assert pieces.to_pylist() == [b"ab ", b"abc ", b"ab"] and place.tolist() == [0, 0, 1, 2]


def reference_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["It's   a\u00a0test\u2003don't!\r\n\x1cX", "'ve 'vest !!'s", "é e\u0301 İ ΑΣ Σ", "<|startoftext|>a<|endoftext|> b", "a\u0300 b\u200b c", "x" * 3000, "1,234.5 a_b-c/d", "“quoted” — dash…", " lead", "trail  ", "\n\n\n", "😀😀 👩‍👩‍👧", "×÷ ×a a×", "naïve café façade "]


def test_word_bpe(spark, odd_docs, odd_rows):
    path = public.path("word_bpe_49k.json")
    texts = [(i, t) for i, t in enumerate([r[1] for r in odd_rows] + ODD)]
    t, ids = reference_ids("word_bpe_49k.json", [x for _, x in texts])
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in word_bpe.encode_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), path).collect()}
    assert got == {i: (len(x), np.array(x, "<u4").tobytes(), t.decode(x, skip_special_tokens=False)) for (i, _), x in zip(texts, ids)}
    assert word_bpe.encode_documents(odd_docs, path).count() == len(odd_rows)
    assert word_bpe.encode_documents(odd_docs.limit(0), path).count() == 0


@given(st.lists(st.text(alphabet="ab 'é.,!1\n\t\u00a0\u2003É漢-", max_size=40) | st.sampled_from(["a<|endoftext|>b", "x <|endoftext|><|endoftext|>.", "<|endoftext"]), max_size=12))
@settings(max_examples=80, deadline=None)
def test_byte_bpe_pieces(texts):
    _, want = reference_ids("byte_bpe_50k.json", texts)
    ids, at = token_store.encode_texts(pa.array(texts, pa.string()), public.path("byte_bpe_50k.json"), 2)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*x, 2] for x in want]


def test_token_store(spark, odd_docs, odd_rows, tmp_path):
    path = public.path("byte_bpe_50k.json")
    texts = [(i, t) for i, t in enumerate([r[1] for r in odd_rows] + ODD)]
    _, ids = reference_ids("byte_bpe_50k.json", [x for _, x in texts])
    folder = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), folder, path)
    want, start = {}, 0
    for (i, _), x in zip(texts, ids):
        want[i] = (start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        start += len(x) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(spark, folder).collect()} == want
    one = token_store.read_store(spark, folder).filter("doc_id = 7").select("token_ids").first().token_ids
    assert one == [*ids[7], 2]
    for name, df in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        token_store.write_store(df, f"{folder}-{name}", path)
        rows = token_store.read_documents(spark, f"{folder}-{name}").collect()
        assert len(rows) == df.count()
        assert sorted(r.start for r in rows) == [0, *np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1]][: len(rows)]


# ---- language


def code_length(text, train, order=langid.ORDER):
    """PPM code length in bits, counted naively."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        b = b" " * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[k][b[i - k : i]][b[i]] += 1
    total, b = 0.0, b" " * order + text.encode()
    for i in range(order, len(b)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            c = seen[k].get(b[i - k : i])
            if c is None:
                continue
            n = sum(c.values()) + len(c)
            if b[i] in c:
                total += -np.log2(c[b[i]] / n)
                break
            total += -np.log2(len(c) / n)
    return total


def test_code_lengths_are_exact():
    train = {"a": ["the cat sat on the mat", "then the hen", ""], "b": ["le chat est là", "é"], "c": []}
    model = langid.train(train)
    texts = ["the chat", "", "zzz 漢", " a", "là là", "the then hen mat" * 3]
    got = langid.code_lengths(pa.array(texts), model)
    want = np.array([[code_length(t, train[k]) for k in sorted(train)] for t in texts])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_language_on_held_out_rows(spark, sf):
    rows = langid.fit_and_identify(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_docs, odd_rows):
    out = langid.fit_and_identify(odd_docs).collect()
    assert len(out) == len(odd_rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1, 2, 3, 8))
    assert langid.fit_and_identify(odd_docs.limit(0)).count() == 0
    none = langid.identify(odd_docs, langid.train({})).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_held_out_is_crc32_of_the_id(odd_docs):
    for r in odd_docs.select("doc_id", langid.held_out(odd_docs["doc_id"]).alias("h")).collect():
        assert r.h == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


# ---- repeated strings


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}


def test_repeats_against_brute_force(spark):
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    passages = [say(rnd.randint(90, 400)) for _ in range(8)]
    docs = []
    for i in range(90):
        t = "".join(rnd.choice([say(rnd.randint(0, 120)), rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 40) : rnd.randint(80, 400)]]) for _ in range(rnd.randint(0, 5)))
        docs.append((i * 3, t))
    docs += [(1000, "ab" * 400), (1001, "x" * 99), (1002, "x" * 100), (1003, "x" * 101), (1004, "ab" * 60), (1005, docs[7][1]), (1006, docs[7][1]), (1007, passages[0][:120] * 3)]
    assert removed(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)) == dict(zip((i for i, _ in docs), repeats(docs)))


def test_repeats_of_odd_rows(odd_docs, odd_rows):
    order = sorted(((-1 if i is None else i), t) for i, t, *_ in [(r[0], r[1] or "") for r in odd_rows])
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd_docs).collect())
    want = sorted((i, n, m) for (i, _), (n, m, _, _) in zip(order, repeats(order)))
    assert [x[:2] for x in got] == [x[:2] for x in want] and sum(x[2] for x in got) == sum(x[2] for x in want)
    assert suffix_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def by_id(docs):
    return [(i, *x) for (i, _), x in zip(docs, repeats(docs))]


def test_repeats_of_one_line_in_many_documents(spark):
    """A line of 98 bytes with other text on both sides: more candidates on one key than are gathered."""
    rnd = random.Random(12)
    line = "".join(rnd.choice("abcdefghij ") for _ in range(96))
    say = lambda n: "".join(rnd.choice("klmnop") for _ in range(n))
    docs = [(i, f"{say(rnd.randint(0, 150))}\n{line}\n{say(rnd.randint(0, 150))}") for i in range(5 * suffix_dedup.MOST)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    marks = suffix_dedup.judged(suffix_dedup.anchor_rows(rows.selectExpr("doc_id AS id", "text", "doc_id AS doc")))
    keys = suffix_dedup.cut_out(rows.selectExpr("doc_id AS doc", "text"), marks).filter("anchor >= 0").groupBy("key").count()
    assert keys.filter(f"count > {suffix_dedup.MOST}").count() > 0
    want = by_id(docs)
    assert sorted((i, *v) for i, v in removed(rows).items()) == want and sum(x[2] > 0 for x in want) > 100


def test_reach_of_candidates_over_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode()) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, doc bigint, side binary")
    share = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    want = {i: max(share(x, y) for k, j, y in rows if k == key and j != i) for key, i, x in rows}
    got = {r.doc: r.reach for r in suffix_dedup.with_reach(df, "reach", "side").collect()}
    assert all(got[i] == want[i] or (got[i] > want[i] and got[i] == len(x)) for _, i, x in rows)
    assert sum(got[i] > want[i] for i in want) <= 2 * 8


def test_repeats_of_large_and_repeated_ids(spark):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(300))
    docs = [(-(1 << 63), text[:150]), (-5, "x" + text[:120]), (1 << 62, text), ((1 << 62) + 1, "q" + text[100:]), ((1 << 63) - 1, text + "z")]
    assert sorted((i, *v) for i, v in removed(spark.createDataFrame(docs, "doc_id bigint, text string")).items()) == by_id(docs)
    again = docs + [(1 << 62, text), ((1 << 63) - 1, text + "z")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(again, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == sorted((i, n) for i, _, n, *_ in by_id(sorted(again)))


def test_repeats_come_out_of_the_array_byte_by_byte():
    rnd = random.Random(8)
    a = bytes(rnd.choice(b"abc") for _ in range(260))
    b = bytearray(a)
    b[130] ^= 1
    one, two = np.zeros(2, np.int64), np.array([5, 9])
    got = suffix_dedup.sorted_repeats(one, two, np.array([7, 1000]), [a, bytes(b)])
    assert [x.tolist() for x in got] == [[9, 9], [1000, 1131], [1030, 1160]]
    assert not len(suffix_dedup.sorted_repeats(np.arange(2), two, np.array([7, 1000]), [a, a])[0])


def test_contexts_depend_on_the_window_only():
    rnd = random.Random(1)
    core = bytes(rnd.choice(b"abc ") for _ in range(300)).decode()
    data, offsets = byte_view(pa.array(["q" + core + "zz", core, "xyz" * 9 + core]), "")
    h, _, text, p, first, last = suffix_dedup.contexts(data, offsets)
    seen = collections.defaultdict(set)
    for k in range(len(h)):
        for s in range(first[k], last[k] + 1):
            w = data[offsets[text[k]] + s : offsets[text[k]] + s + 100].tobytes()
            seen[w].add((int(h[k]) >> 16, int(p[k] - s)))
    assert len(seen) > 201 and all(len(x) == 1 for x in seen.values())


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.queries()}
    assert os.path.exists(public.path("word_bpe_49k.json")) and hashlib.sha256


def test_pairs_of_equal_windows_go_only_if_the_array_finds_them(spark, monkeypatch):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    docs = spark.createDataFrame([(i, "".join(rng.choice("stuvwxyz ") for _ in range(300)) + (passage if i < 2 else "")) for i in range(6)], "doc_id bigint, text string")
    removed = lambda: sum(r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect())
    assert removed() >= 180
    array = suffix_dedup.sorted_contexts
    monkeypatch.setattr(suffix_dedup, "sorted_contexts", lambda cuts: array(cuts).filter("false"))
    assert removed() == 0
