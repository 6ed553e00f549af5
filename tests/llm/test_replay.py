"""op11 against a replay turn by turn."""

import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import replay
from loomgraph.llm.replay import replay as run

SCHEMA = "conv_id bigint, turn bigint, text string, p string, conv int"


def by_hand(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[0]].append(r)
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, zlib.crc32((r[2] or "").encode())))
        done = []
        for p, (_, turn, text, *_) in enumerate(turns):
            h = lambda k: zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())
            d = h(0) % 5
            parent = done[p - d] if 0 < d <= p else None
            row = {"conv": conv, "turn": turn, "p": p, "crc": zlib.crc32((text or "").encode())}
            done.append(row)
            if parent and parent["status"] != "delivered":
                row |= {"status": "blocked", "attempts": 0, "first": None, "last": None}
                continue
            at = first = max(7 * p, parent["last"] if parent else 0)
            faulty, repaired = h(1) % 101 < 50, 7 * p + h(2) % 101
            for a in range(1, 7):
                good = not faulty or at >= repaired and h(a + 2) % 3 != 0
                row |= {"status": "delivered" if good else "dead", "attempts": a, "first": first, "last": at}
                if good:
                    break
                at += 20 * 2 ** (a - 1)
        state = 0
        for n, row in enumerate(sorted((r for r in done if r["status"] == "delivered"), key=lambda r: (r["last"], r["turn"] is not None, r["turn"] or 0, r["p"])), 1):
            state += n * row["crc"]
            row |= {"no": n, "state": state}
        out += [(r["conv"], r["turn"], r["status"], r["attempts"], r["first"], r["last"], r.get("no"), r.get("state")) for r in done]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in run(df).collect()), key=repr)


def rows_of(conv, n, step=1):
    return [(conv, step * i, f"text {conv} {i} é" if i % 7 else None, "x", 1) for i in range(n)]


def test_against_the_plain_replay(spark):
    rng = random.Random(1)
    rows = [r for c in range(60) for r in rows_of(c, rng.randint(1, 12))] + rows_of(1000, 3000, 3) + rows_of(-5, 400)
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6)) == by_hand(rows)


@pytest.fixture
def many_ranges(spark):
    """Ranges of few turns, of which many hold no cut."""
    settings = {"spark.sql.shuffle.partitions": "67", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_a_conversation_over_many_ranges_is_split(spark, many_ranges):
    rows = rows_of(7, 1400)
    turns = replay.drawn(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "text")
    parts = replay.stretches(turns).groupBy("at_part", "at_row").count().toPandas()
    assert parts["count"].sum() == 1400
    assert parts["count"].max() < 300 and parts["at_part"].nunique() > 5
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1, "a", "x", 1), (None, None, None, "x", 1), (None, 0, "", "x", 1), (3, 5, "b", None, None), (3, 5, "b", None, None), (3, 5, "a", None, None), (3, -2, "ü" * 10_000, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_a_state_beyond_64_bits_is_null(spark, monkeypatch):
    rows = [(1, i, "x", "", 0) for i in range(40)]
    out = replay.drawn(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "text").selectExpr("conv", "turn", "turn as p", "crc << 29 as crc", "'delivered' as status", "1 as attempts", "7L as first_at", "turn as last_at")
    crc, state = zlib.crc32(b"x") << 29, 0
    for r in replay.delivered(out).orderBy("release_no").collect():
        state += r["release_no"] * crc
        assert r["state"] == (state if state < 2**63 else None)
