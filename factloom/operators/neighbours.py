"""Exact cosine neighbours: blocks of vectors meet blocks of queries as matrices, and only what can be an answer leaves a block.

Similarities are rounded to DIGITS digits, so that equal vectors tie wherever they stand, and ties go to the smaller id.
Vectors of different lengths meet as if ended by zeros; a null or zero vector is at 0 to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from factloom.operators.graph import written

DIGITS = 12
#: Components of queries that are broadcast at most, of a block of vectors, and pairs that are computed at once.
BROADCAST, BLOCK, AT_ONCE = 2_000_000, 8_000_000, 4_000_000
#: Parts that groups are dealt to, so that blocks hold few rows of different groups.
PARTS = 64
#: Pairs that a task holds as rows at most.
GIVEN = 50_000


class Matrix:
    """Ids, groups (or nothing) and unit vectors of a table's columns."""

    def __init__(self, ids: list, groups: list | None, lists: pa.Array, least: np.ndarray | None = None) -> None:
        self.ids, self.groups, self.least = ids, groups, least
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat = np.nan_to_num(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
        lengths = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        self.units = np.zeros((len(lengths), int(lengths.max(initial=0))))
        row = np.repeat(np.arange(len(lengths)), lengths)
        self.units[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        norms = np.sqrt((self.units**2).sum(axis=1, keepdims=True))
        np.divide(self.units, norms, out=self.units, where=norms > 0)

    def similarities(self, other: Matrix, part: slice) -> np.ndarray:
        """A row for each vector of mine, a column for each of other's part; minus infinity where groups differ."""
        dims = min(self.units.shape[1], other.units.shape[1])
        out = np.round(self.units[:, :dims] @ other.units[part, :dims].T, DIGITS)
        if self.groups is not None:
            codes = {g: i for i, g in enumerate(dict.fromkeys(self.groups + other.groups[part]))}
            mine, theirs = (np.array([codes[g] for g in gs], np.int64) for gs in (self.groups, other.groups[part]))
            out[mine[:, None] != theirs] = -np.inf
        return out


class Best:
    """The k best ids of each query so far, or all that reach the query's own least similarity."""

    def __init__(self, queries: Matrix, k: int | None, floor: float) -> None:
        self.queries, self.k, self.floor = queries, k, floor
        self.held: list[list[tuple[float, object]]] = [[] for _ in queries.ids]

    def meet(self, vectors: Matrix) -> Iterator[list[tuple[object, object, float]]]:
        """Take the vectors in; without k, what reaches the least similarity is given at once, in lists of GIVEN pairs at most."""
        n = len(self.queries.ids)
        width = max(1, AT_ONCE // max(1, n))
        for at in range(0, len(vectors.ids), width):
            part = slice(at, at + width)
            ids, scores = vectors.ids[part], self.queries.similarities(vectors, part)
            if self.k is None:
                near = np.nonzero(scores >= self.queries.least[:, None])
                for cut in range(0, len(near[0]), GIVEN):
                    qs, vs = (x[cut : cut + GIVEN] for x in near)
                    yield [(self.queries.ids[q], ids[v], s) for q, v, s in zip(qs.tolist(), vs.tolist(), scores[qs, vs].tolist(), strict=True)]
                continue
            self.take(scores, ids)

    def take(self, scores: np.ndarray, ids: list) -> None:
        """Take in scores, a row for each query and a column for each id; minus infinity is none."""
        least = np.array([max(self.floor, h[-1][0]) if len(h) == self.k else self.floor for h in self.held])
        near = (scores >= least[:, None]) & (scores > -np.inf)
        many = np.flatnonzero(near.sum(axis=1) > 4 * self.k)
        if len(many) and scores.shape[1] > self.k:
            least[many] = np.maximum(least[many], np.partition(scores[many], -self.k, axis=1)[:, -self.k])
            near[many] &= scores[many] >= least[many, None]
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            row = scores[q]
            fresh = [(float(row[v]), ids[v]) for v in np.flatnonzero(near[q])]
            self.held[q] = sorted(self.held[q] + fresh, key=lambda x: (-x[0], x[1]))[: self.k]

    def rest(self) -> Iterator[tuple[object, object, float]]:
        for q, held in zip(self.queries.ids, self.held, strict=True):
            for score, v in held:
                yield q, v, score


def _met(queries: DataFrame, vectors: DataFrame, k: int | None, floor: float, by: str | None) -> DataFrame:
    """query_id, fact_id, similarity of each block's answers. queries: query_id, q, and least if k is None; vectors: fact_id, embedding."""
    group = [by] if by else []
    least = ["least"] if k is None else []
    # Columns of their own on one side: both may come from one table, whose columns Spark could not tell apart when blocks meet.
    asked = queries.select(*(F.col(c).alias(c) for c in ("query_id", "q", *group, *least)))
    held = vectors.select("fact_id", "embedding", *group)
    schema = StructType([asked.schema["query_id"], held.schema["fact_id"], StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(schema)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dims")).first()
    cells = size["n"] * max(1, size["dims"] or 0)

    def matrix(t: pa.Table, vector: str) -> Matrix:
        lows = np.array(t["least"].to_pylist(), np.float64) if vector == "q" and least else None
        return Matrix(t.column(0).to_pylist(), t[by].to_pylist() if by else None, t[vector], lows)

    def table(rows: list) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    if cells <= BROADCAST:
        sent = queries.sparkSession.sparkContext.broadcast(asked.toArrow())

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(matrix(sent.value, "q"), k, floor)
            for batch in batches:
                for rows in best.meet(matrix(pa.Table.from_batches([batch]), "embedding")):
                    yield from table(rows).to_batches()
            yield from table(list(best.rest())).to_batches()

        return held.mapInArrow(stream, schema)

    across = max(1, -(-vectors.count() * (size["dims"] or 1) // BLOCK))
    down = -(-cells // BROADCAST)
    deal = lambda df, key, n: F.pmod(F.xxhash64(*[F.col(c) for c in (key, *group)]), F.lit(n)).cast("int")
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int") if by else F.lit(0)
    left = asked.withColumn("g", part).withColumn("j", deal(asked, "query_id", down)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(int(across) - 1))))
    right = held.withColumn("g", part).withColumn("i", deal(held, "fact_id", across)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(int(down) - 1))))

    def block(asks: pa.Table, has: pa.Table) -> pa.Table:
        best = Best(matrix(asks, "q"), k, floor)
        return pa.concat_tables([*map(table, best.meet(matrix(has, "embedding"))), table(list(best.rest()))])

    return left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(block, schema)


def meet_in_blocks(queries: DataFrame, vectors: DataFrame, by: list[str], k: int) -> DataFrame:
    """query_id, fact_id, similarity: the k best of each query in each block (columns `by`) that it and vectors are dealt to.

    queries: query_id, q; vectors: fact_id, embedding. A block is held by one task, so blocks of vectors must be bounded;
    queries of a block stand in parts of about BROADCAST components, each sorted behind the others.
    """
    schema = StructType([queries.schema["query_id"], vectors.schema["fact_id"], StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(schema)

    def block(asks: pa.Table, has: pa.Table) -> pa.Table:
        if not (asks.num_rows and has.num_rows):
            return arrow.empty_table()
        held, found = Matrix(has["fact_id"].to_pylist(), None, has["embedding"]), []
        step = max(1, BROADCAST // max(1, held.units.shape[1]))
        for at in range(0, asks.num_rows, step):
            part = asks.slice(at, step)
            best = Best(Matrix(part["query_id"].to_pylist(), None, part["q"]), k, -np.inf)
            for _ in best.meet(held):
                pass
            found += best.rest()
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return queries.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInArrow(block, schema)


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, min_sim: float | None = None, by: str | None = None) -> DataFrame:
    """query_id, fact_id, similarity, rank by cosine. queries: query_id, q; vectors: fact_id, embedding.

    With `by` only rows that agree in that column of both meet. Queries of up to BROADCAST components go to all tasks, which
    stream their vectors past them; more are dealt in blocks that meet blocks of vectors. k rows a query leave a task.
    """
    met = _met(queries, vectors, k, -np.inf if min_sim is None else min_sim, by)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "fact_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def within(queries: DataFrame, vectors: DataFrame, floor: float, share: float = 0.0, nth: int = 1) -> DataFrame:
    """query_id, fact_id, similarity of all vectors at `floor` or nearer that reach `share` of the similarity of the query's nearest, or nth nearest.

    The nearest are found first, so no task orders or holds what is too far. A query with fewer than nth at `floor` gets all of these.
    """
    nearest = exact_knn(queries, vectors, nth, floor).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
    # Less by the last digit, which may differ where the same vectors stand in other blocks.
    reached = F.when(F.col("n") == nth, share * F.col("s") - (10.0**-DIGITS if nth > 1 else 0.0))
    least = nearest.select("query_id", F.greatest(F.lit(floor), reached).alias("least"))
    # Written, as they are read twice: counted, and sent to the tasks.
    return _met(written(queries.join(least, "query_id")), vectors, None, floor, None)
