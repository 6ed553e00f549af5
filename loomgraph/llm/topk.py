"""Exact top-k inner products, block at a time.

Method: vectors are cut into document-range blocks of consecutive ids. Each block has
a forward index (its rows as one integer matrix) and, for each component, the smallest
and largest value (the signed form of a term maximum). A query's bound on a block is
the sum over components of the larger of weight x maximum and weight x minimum. Blocks
are visited in descending order of bound, scored through the forward index, until the
next bound is below the query's k-th best score. The result is exact.

Scale: blocks are grouped into cells of ``CELL_BLOCKS`` blocks, queries into groups of
``QUERY_GROUP`` rows; a task holds one cell and about ``GROUPS_A_PART`` query groups. Each yields at most k
candidates a query; a window takes the k best of those. Two rounds: in the first each cell
scores the block of best bound for each query; the largest k-th score that any cell finds
is where every cell's pruning starts in the second (a lost executor repeats only its own
cells). Bounds tell blocks apart only as far as rows of neighbouring ids are alike.

Defined results: vectors that are null, empty, or hold null or non-finite components
take no part. Shorter vectors count as padded with zeros. Repeated ids are separate
candidates and separate queries, and a query never meets rows of its own id. Ties go to the smaller id. A
component (after scaling) or score beyond 64 bits counts as the nearest 64-bit value. A
query without candidates gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

BLOCK_ROWS = 256
CELL_BLOCKS = 64
QUERY_GROUP = 1024
GROUPS_A_PART = 8
SCALE = 256

BLOCK = "block bigint, n int, dims int, ids binary, rows binary, low binary, high binary"
EXACT = float(1 << 53)
MOST = (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long; null if the vector takes no part."""
    usable = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nearest = lambda x: F.when(x >= 2.0**63, F.lit(MOST)).when(x <= -(2.0**63), F.lit(-MOST)).otherwise(F.floor(x))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda x: nearest(x.cast("double") * scale)))


def packed(batches: Iterable[pa.RecordBatch], rows: int, tag: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``rows`` consecutive rows of (id, vector)."""
    ids: list[np.ndarray] = []
    vectors: list = []
    count = 0

    def block() -> pa.RecordBatch:
        nonlocal count
        dims = max(len(v) for v in vectors)
        matrix = np.zeros((len(vectors), dims), np.int64)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        row = {
            "block": [(tag << 32) + count], "n": [len(vectors)], "dims": [dims], "ids": [np.array(ids, np.int64).tobytes()],
            "rows": [small(matrix)], "low": [matrix.min(0).tobytes()], "high": [matrix.max(0).tobytes()],
        }
        count += 1
        ids.clear()
        vectors.clear()
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]))

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            vectors.append(v)
            if len(vectors) == rows:
                yield block()
    if vectors:
        yield block()


def small(matrix: np.ndarray) -> bytes:
    """The matrix in 16 bits where that holds all values, with a leading byte that tells."""
    if matrix.min() >= -32768 and matrix.max() <= 32767:
        return b"\2" + matrix.astype("<i2").tobytes()
    return b"\10" + matrix.astype("<i8").tobytes()


def unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, {2: "<i2", 8: "<i8"}[data[0]], offset=1).reshape(n, dims).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers, at most MOST either way: by float64 where that is exact, else in Python integers."""
    most = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block the sum of the larger of weight x low and weight x high."""
    return product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1), np.concatenate([high, low], 1))


def best_of_cell(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple], k: int, floors: np.ndarray, most: int | None = None) -> tuple[pd.DataFrame, int]:
    """The k best rows of the cell for each query, and how many (query, block) pairs were scored.

    ``blocks`` holds (ids, matrix, low, high). ``floors``: for each query a score that k rows
    somewhere reach. ``most``: look at so many blocks of a query only, the best first.
    """
    nq, nb = len(query_ids), len(blocks)
    bound = bounds(queries, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    worst = -MOST  # with the largest id: behind any row of that score
    scored = 0
    scores, ids = np.full((nq, k), worst), np.full((nq, k), np.iinfo(np.int64).max)
    filled = np.zeros(nq, np.int64)
    active = np.arange(nq)
    for step in range(min(nb, most or nb)):
        at = order[active, step]
        # a bound equal to the k-th score may still hide a tie with a smaller id
        least = np.where(filled[active] < k, floors[active], np.maximum(scores[active, -1], floors[active]))
        active, at = (x[bound[active, at] >= least] for x in (active, at))
        if not len(active):
            break
        scored += len(active)
        for j in np.unique(at):
            mine = active[at == j]
            their_ids, matrix = blocks[j][:2]
            got = product(queries[mine], matrix)
            ok = their_ids[None, :] != query_ids[mine][:, None]
            all_scores = np.concatenate([scores[mine], np.where(ok, got, worst)], 1)
            all_ids = np.concatenate([ids[mine], np.where(ok, their_ids[None, :], np.iinfo(np.int64).max)], 1)
            take = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[mine], ids[mine] = np.take_along_axis(all_scores, take, 1), np.take_along_axis(all_ids, take, 1)
            filled[mine] = np.minimum(k, filled[mine] + ok.sum(1))
    rank = np.arange(k)[None, :] < filled[:, None]
    found = pd.DataFrame({"query_id": np.repeat(query_ids, k)[rank.ravel()], "query_row": np.repeat(np.arange(nq), k)[rank.ravel()], "vec_id": ids.ravel()[rank.ravel()], "score": scores.ravel()[rank.ravel()]})
    return found, scored


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    def blocks_of(df: DataFrame, rows: int, name: str) -> DataFrame:
        use = df.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")).filter("v is not null and id is not null")
        ranged = use.repartitionByRange(F.col("id")).sortWithinPartitions("id")

        def run(batches):
            from pyspark import TaskContext

            return packed(batches, rows, TaskContext.get().partitionId())

        return stored(ranged.mapInArrow(run, BLOCK), name)

    blocks = blocks_of(candidates, block_rows, "topk-blocks")
    groups = blocks_of(queries, QUERY_GROUP, "topk-queries")
    n_cells = max(1, -(-blocks.count() // CELL_BLOCKS))
    dims = max(blocks.agg(F.max("dims")).first()[0] or 0, groups.agg(F.max("dims")).first()[0] or 0)
    # the query set against all rows, in blocks: each part of it meets each cell once
    n_parts = max(1, -(-groups.count() // GROUPS_A_PART))
    cells = blocks.withColumns({"cell": F.pmod(F.hash("block"), F.lit(n_cells)), "part": F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))})

    def scored(asked: DataFrame, seeding: bool) -> DataFrame:
        """The best rows of each cell for each query; ``seeding``: of one block only, and of those the k-th best score."""

        def run(cell: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            parts = []
            if len(cell) and len(asked):
                wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
                held = [(np.frombuffer(r.ids, np.int64), wide(unpacked(r.rows, r.n, r.dims)), wide(np.frombuffer(r.low, np.int64)[None, :])[0], wide(np.frombuffer(r.high, np.int64)[None, :])[0]) for r in cell.sort_values("block").itertuples()]
                for q in asked.itertuples():
                    floors = np.full(q.n, -MOST)
                    if q.floors is not None:
                        floors[[x["query_row"] for x in q.floors]] = [x["floor"] for x in q.floors]
                    best, _ = best_of_cell(np.frombuffer(q.ids, np.int64), wide(unpacked(q.rows, q.n, q.dims)), held, k, floors, 1 if seeding else None)
                    if seeding:
                        n = best.groupby("query_row")["score"].agg(["size", "min"])
                        n = n[n["size"] == k]
                        best = pd.DataFrame({"query_id": 0, "query_row": n.index, "vec_id": 0, "score": n["min"]})
                    parts.append(best.assign(block=q.block))
            return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_row", "vec_id", "score", "block")})

        dealt = asked.withColumns({"part": F.pmod(F.hash("block"), F.lit(n_parts)), "cell": F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1)))})
        return cells.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(run, "query_id bigint, query_row bigint, vec_id bigint, score bigint, block bigint")

    floors = "array<struct<query_row: bigint, floor: bigint>>"
    seeds = scored(groups.withColumn("floors", F.lit(None).cast(floors)), True).groupBy("block", "query_row").agg(F.max("score").alias("floor"))
    known = seeds.groupBy("block").agg(F.collect_list(F.struct("query_row", "floor")).alias("floors"))
    found = scored(stored(groups.join(known, "block", "left"), "topk-floors"), False)
    best = Window.partitionBy("query_id", "block", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
