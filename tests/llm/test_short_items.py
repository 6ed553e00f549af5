"""Benchmark items of fewer words than a shingle, inside longer documents."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomgraph.llm import queries  # noqa: E402


def test_short_items_are_found_in_longer_documents(spark, tmp_path):
    rnd = random.Random(6)
    say = lambda n: [rnd.choice("abcdefg") for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 2, 3, 3, 4, 4, 4])] + [(8, "what is photosynthesis"), (9, "what is photosynthesis"), (10, None), (11, "")]
    docs = [(i, " ".join(say(rnd.randint(0, 12)))) for i in range(150)] + [(150, "He asked: What is  photosynthesis? Nobody in the room knew."), (151, "what is it, photosynthesis"), (152, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in queries.op3_decontaminate(spark, str(tmp_path)).collect())
    want = []
    for i, text in docs:
        words = (text or "").lower().translate(str.maketrans("", "", ",:?.")).split()
        for j, item in items:
            own = (item or "").split()
            places = [k for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own] if own else []
            want += [(i, j, places[0], len(own), 1.0)] if places else []
    assert got == sorted(want) and {(150, 8), (150, 9)} <= {x[:2] for x in got} and 151 not in {x[0] for x in got if x[1] in (8, 9)}
    clean = corpus_pipeline.remove_contaminated(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in docs} - {x[0] for x in want})
