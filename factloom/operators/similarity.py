"""Vector and lexical similarity for tables of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.graph import written
from factloom.operators.lexical import spread
from factloom.operators.neighbours import exact_knn

#: Do two columns of texts say the same? A comparison, or a call of the caller's UDF.
Judge = Callable[[Column, Column], Column]


def shared_knn(queries: DataFrame, rows: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """exact_knn of rows (fact_id, vec_id) that share vectors (vec_id, embedding): each vector is scored once. Rows without one have no part."""
    held = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("copies"))
    held = written(held.join(vectors.where("embedding IS NOT NULL").select("vec_id"), "vec_id", "left_semi"))
    best = exact_knn(queries, held.join(vectors.select("vec_id", "embedding"), "vec_id"), k).join(held, "fact_id")
    return spread(best.withColumnRenamed("vec_id", "of"), rows.withColumnRenamed("vec_id", "of"), "similarity", k)


def same_group_pairs(facts: DataFrame, keys: list[str], min_sim: float) -> DataFrame:
    """Pairs (fact_id < fact_id_b) with equal keys, overlapping intervals and a cosine of min_sim or more."""
    from factloom.functions.vectors import cosine
    from factloom.operators.intervals import overlap_join

    pairs = overlap_join(facts, facts, keys).where("fact_id < fact_id_b")
    return pairs.withColumn("similarity", cosine(F.col("embedding"), F.col("embedding_b"))).where(F.col("similarity") >= min_sim)


def corroboration_pairs(facts: DataFrame, min_sim: float = 0.9, groups: tuple[int, int] = (2, 8), judge: Judge | None = None) -> DataFrame:
    """younger, elder, similarity: of overlapping active facts of one (entity, predicate) from different origins, each
    younger one's best elder. Groups outside of the sizes are left out, as the job that judges them expects.

    A judge gets both objects as columns and says whether they are the same claim; without one the similarity decides.
    """
    n = F.count("*").over(W.partitionBy("entity_id", "predicate"))
    some = facts.where("status = 'active'").withColumn("__n", n).where(F.col("__n").between(*groups)).drop("__n")
    order = F.struct("recorded_at", "fact_id") < F.struct("recorded_at_b", "fact_id_b")
    pairs = same_group_pairs(some, ["entity_id", "predicate"], min_sim).where("NOT origin_key <=> origin_key_b").withColumn("first", order)
    if judge is not None:
        pairs = pairs.where(judge(F.col("object"), F.col("object_b")))
    sided = pairs.select(
        F.when(F.col("first"), F.col("fact_id_b")).otherwise(F.col("fact_id")).alias("younger"),
        F.when(F.col("first"), F.col("fact_id")).otherwise(F.col("fact_id_b")).alias("elder"), "similarity",
    )
    rank = F.row_number().over(W.partitionBy("younger").orderBy(F.desc("similarity"), "elder"))
    return sided.withColumn("__r", rank).where("__r = 1").drop("__r")


def near_duplicate_entities(names: DataFrame, linked: DataFrame, min_sim: float = 0.92, neighbours: int = 5, judge: Judge | None = None) -> DataFrame:
    """a, b, similarity: entities (entity_id, embedding) whose names are close, each pair once, without linked pairs (a, b).

    A judge gets both canonical_name columns and says whether they name one thing; without one the similarity decides.
    """
    near = exact_knn(names.select(F.col("entity_id").alias("query_id"), F.col("embedding").alias("q")), names.select(F.col("entity_id").alias("fact_id"), "embedding"), neighbours + 1, min_sim)
    pairs = near.where("query_id <> fact_id").select(F.least("query_id", "fact_id").alias("a"), F.greatest("query_id", "fact_id").alias("b"), "similarity")
    found = pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).join(linked, ["a", "b"], "left_anti")
    if judge is None:
        return found
    named = lambda c: names.select(F.col("entity_id").alias(c), F.col("canonical_name").alias(f"name_{c}"))
    return found.join(named("a"), "a").join(named("b"), "b").where(judge(F.col("name_a"), F.col("name_b"))).select("a", "b", "similarity")
