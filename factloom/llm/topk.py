"""Exact top-k search by inner product: columnar branch and bound over blocks of queries and vectors.

Vectors of a block stand in vertical layout, one contiguous row per dimension. Scores are accumulated a
block of dimensions at a time; after each, a vector stays only if for some query of the tile the score
so far plus the product of the two remaining norms can still reach that query's k-th best score. The
survivors are compacted before the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Dimensions accumulated between two prunings, queries that share a list of survivors, and vectors
#: (those with the largest norms) that are scored in full to get first thresholds.
DIMENSIONS, TILE, SEEDS = 8, 64, 128
#: Rows of a block: a share of all rows within these bounds and of at most so many components, so a task's memory is bounded.
VECTOR_BLOCK, QUERY_BLOCK, COMPONENTS = (16_384, 131_072), (1_024, 16_384), 8_000_000


def _vertical(column: pa.ChunkedArray) -> np.ndarray:
    """(dimensions, rows); shorter vectors end in zeros."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((int(lengths.max(initial=0)), len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


def _remaining(vertical: np.ndarray, width: int) -> np.ndarray:
    """Row b: the norm of each vector without its first b blocks of dimensions."""
    squares = vertical.astype(np.float64) ** 2
    blocks = [squares[at : at + width].sum(axis=0) for at in range(0, len(squares), width)]
    tails = np.zeros((len(blocks) + 1, vertical.shape[1]))
    for b in range(len(blocks) - 1, -1, -1):
        tails[b] = tails[b + 1] + blocks[b]
    return np.sqrt(tails)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, best first."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_block(
    vector_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of each query's k best vectors of this block but those of its own id."""
    dims = max(len(vectors), len(queries))
    vectors, queries = (np.vstack([x, np.zeros((dims - len(x), x.shape[1]), np.int64)]) for x in (vectors, queries))
    reach = dims * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64  # sums are exact in each
    tails, q_tails = _remaining(vectors, DIMENSIONS), _remaining(queries, DIMENSIONS)
    order = np.argsort(-tails[0], kind="stable")
    vectors, tails, ids = np.ascontiguousarray(vectors[:, order].astype(kind)), tails[:, order], vector_ids[order]
    queries = queries.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(query_ids), TILE):
        tile = slice(at, at + TILE)
        q, q_ids, q_tail = queries[:, tile].T, query_ids[tile], q_tails[:, tile]
        seeds = min(len(ids), max(SEEDS, k + 1))
        first = (q @ vectors[:, :seeds]).astype(np.float64 if kind != np.int64 else np.int64)
        own = ids[None, :seeds] == q_ids[:, None]
        others = np.where(own, -np.inf, first.astype(np.float64))
        least = np.partition(others, -k, axis=1)[:, -k] if seeds > k else np.full(len(q_ids), -np.inf)
        alive = np.arange(seeds, len(ids))
        so_far = np.zeros((len(q_ids), len(alive)), kind)
        for b in range(len(tails)):
            bound = so_far + np.outer(q_tail[b], tails[b, alive])
            stays = (bound + 1e-6 * np.abs(bound) > least[:, None] - 0.5).any(axis=0)
            if not stays.all():
                alive, so_far = alive[stays], so_far[:, stays]
            if b * DIMENSIONS < dims:
                block = slice(b * DIMENSIONS, (b + 1) * DIMENSIONS)
                so_far = so_far + q[:, block] @ vectors[block, alive]
        held = np.concatenate([np.arange(seeds), alive])
        scores = np.concatenate([first, so_far], axis=1).astype(np.int64)
        for row, query in enumerate(q_ids):
            free = np.flatnonzero(ids[held] != query)
            top = free[_best(scores[row, free], ids[held[free]], k)]
            out.append((np.full(len(top), query), ids[held[top]], scores[row, top]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 3))


def _spread(n: int, share: int, bounds: tuple[int, int], dims: int) -> int:
    """How many blocks n rows of at most `dims` components make."""
    rows = min(bounds[1], max(bounds[0], n // share))
    return max(1, -(-n // max(1, min(rows, COMPONENTS // max(1, dims)))))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other vectors of each row for which `queries` holds.

    vectors has vec_id and embedding; a component x counts as floor(scale * x). Scores are inner products,
    ties go to the smaller vec_id. Rows without an id or vector, or with a null or non-finite component,
    take no part. Vectors of different lengths meet as if ended by zeros; an empty vector scores 0. A
    repeated vec_id is a candidate in each of its rows, but none for itself, and asks once, with its least vector. Sums are exact while they fit a long. Fewer than
    k others give fewer rows. An empty table gives an empty one. Other columns are not read.

    Each block of queries meets each block of vectors in one task; of each meeting only k rows a query go on.
    """
    finite = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('inf'))"
    whole = (
        vectors.where("vec_id IS NOT NULL").where(finite)
        .select("vec_id", F.expr(f"transform(embedding, x -> floor({int(scale)} * double(x)))").alias("v"))
    )
    asked = whole.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = vectors.agg(F.count("vec_id").alias("n"), F.count_if(queries).alias("asked"), F.max(F.size("embedding")).alias("dims")).first()
    across = _spread(size["n"], 64, VECTOR_BLOCK, size["dims"] or 0)
    down = _spread(size["asked"], 8, QUERY_BLOCK, size["dims"] or 0)
    at = F.xxhash64("vec_id")
    cell = lambda i, j: (i * F.lit(down) + j).cast("long").alias("cell")
    left = whole.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(
        cell(F.pmod(at, F.lit(across)), F.col("j")), "vec_id", "v"
    )
    right = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(
        cell(F.col("i"), F.pmod(at, F.lit(down))), "vec_id", "v"
    )

    def meet(vecs: pa.Table, asks: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if vecs.num_rows and asks.num_rows:
            found = search_block(
                vecs["vec_id"].to_numpy(), _vertical(vecs["v"]), asks["vec_id"].to_numpy(), _vertical(asks["v"]), k
            )
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    met = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
