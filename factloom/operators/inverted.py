"""Approximate neighbours by an inverted file: vectors are kept by cell, a query looks into the cells nearest to it.

Cells are the centres of a spherical k-means over a bounded sample. How many cells a query probes is measured on the sample:
the fewest that keep `recall` of its exact neighbours there, so clustered vectors need few and evenly spread ones many.
Every vector is in its cell; in the cells that are probed all are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factloom.operators.neighbours import BLOCK, Matrix, exact_knn, meet_in_blocks

#: Rows that cells are fitted on, those of them that measure recall, cells at most, and rounds of k-means.
SAMPLE, ASKED, CELLS, ROUNDS = 20_000, 400, 1024, 12


@dataclass(frozen=True)
class Cells:
    centres: np.ndarray
    probes: int

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """Per row its n nearest cells, the nearest first."""
        dims = min(units.shape[1], self.centres.shape[1])
        near = units[:, :dims] @ self.centres[:, :dims].T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def fit_cells(vectors: DataFrame, k: int, recall: float = 0.95, sample: int = SAMPLE, cells: int = CELLS, seed: int = 3) -> Cells:
    """Cells for vectors (fact_id, embedding), about sqrt(rows) of them, and the probes that find `recall` of the k nearest.

    About `sample` rows, taken by a hash of their id, come to the driver. Without vectors there is one cell.
    """
    rows = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("fact_id"), F.lit(max(1, rows // sample))) == 0).select("embedding").toArrow()
    units = Matrix([None] * some.num_rows, None, some["embedding"]).units
    units = units[(units**2).sum(axis=1) > 0]
    n = min(cells, max(1, math.isqrt(rows)), max(1, len(units) // 8))
    if not len(units):
        return Cells(np.zeros((1, 1)), 1)
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), n, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    fitted, own = Cells(centres, n), np.argmax(units @ centres.T, axis=1)
    asked = rng.choice(len(units), min(ASKED, len(units)), replace=False)
    exact = np.argsort(-(units[asked] @ units.T), axis=1)[:, 1 : k + 1]  # beside itself
    order = np.argsort(fitted.nearest(units[asked], n), axis=1)  # order[i, c]: at which probe query i reaches cell c
    reached = np.sort(np.take_along_axis(order, own[exact], axis=1).ravel())
    probes = 1 + int(reached[min(len(reached) - 1, math.ceil(recall * len(reached)))]) if len(reached) else n
    return Cells(centres, probes)


def placed(rows: DataFrame, vector: str, cells: Cells, n: int) -> DataFrame:
    """rows with cell, once for each of the n nearest cells; null and zero vectors have none and are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)  # at most CELLS centres
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = Matrix([None] * batch.num_rows, None, batch.column(at)).units
            there = np.flatnonzero((units**2).sum(axis=1) > 0)
            near = sent.value.nearest(units[there], n)
            took = batch.take(pa.array(np.repeat(there, near.shape[1])))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(near.ravel(), pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def approx_knn(queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, cells: Cells | None = None) -> DataFrame:
    """query_id, fact_id, similarity, rank as exact_knn gives them, with about `recall` of its rows.

    A cell's vectors are dealt in blocks of about neighbours.BLOCK components, each of which meets the queries that probe the
    cell; k rows a query leave a block. Queries that find fewer than k in their cells are looked up exactly.
    """
    cells = cells or fit_cells(vectors, k, recall)
    held = placed(vectors.select("fact_id", "embedding"), "embedding", cells, 1)
    asked = placed(queries.select("query_id", "q"), "q", cells, cells.probes)
    dims = max(1, cells.centres.shape[1])
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = {r.cell: -(-r.n * dims // BLOCK) for r in sizes.collect()}  # a row a cell
    if not blocks:
        return exact_knn(queries, vectors, k)
    many = F.create_map(*(F.lit(x) for c, n in blocks.items() for x in (c, n)))
    of_cell = F.coalesce(F.element_at(many, F.col("cell")), F.lit(0))
    right = held.withColumn("i", F.pmod(F.xxhash64("fact_id"), of_cell).cast("int"))
    left = asked.where(of_cell > 0).withColumn("i", F.explode(F.sequence(F.lit(0), of_cell.cast("int") - 1)))
    met = meet_in_blocks(left, right, ["cell", "i"], k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "fact_id"))
    first = met.withColumn("rank", rank).where(F.col("rank") <= k)
    full = first.where(F.col("rank") == k).select("query_id")
    missed = queries.join(full, "query_id", "left_anti")
    return first.join(full, "query_id", "left_semi").unionByName(exact_knn(missed, vectors, k))
