"""Retrieval and answer metrics over result tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def retrieval_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Per group: recall at each k and mean reciprocal rank over queries with an answer, NDCG@10 over all.

    results: group, rank (of the expected answer, 0: missing), absent (the right answer is none).
    """
    r, here = F.col("rank"), ~F.col("absent")
    hit = lambda k: F.avg(F.when(here, F.when((r >= 1) & (r <= k), 1.0).otherwise(0.0)))
    gain = F.when(F.col("absent"), F.when(r == 0, 1.0).otherwise(0.0)).when((r >= 1) & (r <= 10), 1 / F.log2(r + 1.0)).otherwise(0.0)
    return results.groupBy("group").agg(
        *(hit(k).alias(f"recall_{k}") for k in ks), F.avg(F.when(here, F.when(r >= 1, 1.0 / r).otherwise(0.0))).alias("mrr"), F.avg(gain).alias("ndcg_10")
    )


#: Row-by-round weights that are drawn at once.
DRAWN = 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all of the input's (the finaliser of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def poisson_weights(keys: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """A row for each key, a column for each round: how often the row is drawn in it, Poisson of mean 1.

    A weight is a function of key, round and seed alone, so a task that runs again draws the same.
    """
    salts = _mixed(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed << 32))
    u = (_mixed(keys.view(np.uint64)[:, None] ^ salts[None, :]) >> np.uint64(11)) * 2.0**-53
    bounds = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])
    return np.searchsorted(bounds, u, "right").astype(np.float64)


def bootstrap_sums(values: DataFrame, rounds: int, seed: int) -> DataFrame:
    """round, weight, total: sums of the weights and weighted values of each round; a task gives one row a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total, any_ = np.zeros(rounds), np.zeros(rounds), False
        step = max(1, DRAWN // rounds)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                w = poisson_weights(part.column(0).to_numpy(zero_copy_only=False), rounds, seed)
                weight += w.sum(axis=0)
                total += part.column(1).to_numpy(zero_copy_only=False) @ w
                any_ = True
        if any_:
            yield pa.RecordBatch.from_pydict({"round": pa.array(np.arange(1, rounds + 1), pa.int32()), "weight": weight, "total": total})

    keyed = values.where("value IS NOT NULL").select(F.xxhash64("id").alias("key"), F.col("value").cast("double").alias("value"))
    each = keyed.mapInArrow(run, "round int, weight double, total double")
    return each.groupBy("round").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def bootstrap_ci(values: DataFrame, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """mean, low, high: a percentile bootstrap of the mean of values (id, value), its rounds weighed side by side in one pass.

    Each row is drawn Poisson-often in each round, by a hash of its id. Null values take no part; without values all is null.
    """
    means = bootstrap_sums(values, rounds, seed).where("weight > 0").select((F.col("total") / F.col("weight")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return values.agg(F.avg("value").alias("mean")).join(ends)


def identity_f1(merges: DataFrame) -> DataFrame:
    """precision, recall, f1 of merges: expected and merged are booleans per pair."""
    tp, fp, fn = (F.count_if(c).cast("double") for c in (F.expr("expected AND merged"), F.expr("merged AND NOT expected"), F.expr("expected AND NOT merged")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return merges.agg(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auc(scored: DataFrame, buckets: int = 200) -> DataFrame:
    """Rank-sum AUC of score for label 1 against 0, ties one half.

    Counts per score stand in `buckets` ranges of scores (approximate quantiles; any bounds give the same
    result), and only the ranges' totals are summed in one place.
    """
    per = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    bounds = per.agg(F.percentile_approx("score", [k / buckets for k in range(1, buckets)]).alias("bounds"))
    placed = per.join(F.broadcast(bounds)).withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("score"))))
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("before", running(W.orderBy("bucket"))).drop("n")
    inside = placed.withColumn("inside", running(W.partitionBy("bucket").orderBy("score")))
    below = F.col("before") + F.col("inside") + F.col("n") / 2
    return inside.join(F.broadcast(totals), "bucket").agg((F.sum(F.col("p") * below) / (F.sum("p") * F.sum("n"))).alias("auc"))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?<!\w)(?:a|an|the)(?!\w)|[^\w\s]", " "), r"\s+"), lambda t: t != "")


@pandas_udf(DoubleType())
def rouge_l(answers: pd.Series, expected: pd.Series) -> pd.Series:
    """Twice the longest common subsequence of two word arrays over their lengths: 1 if both are empty, 0 if one is.

    Bit i of `open_` is cleared once the common subsequence grows at word i, for all places of a word at once.
    """
    out = []
    for a, e in zip(answers, expected, strict=True):
        places: dict[str, int] = {}
        for i, word in enumerate(e):
            places[word] = places.get(word, 0) | 1 << i
        whole = (1 << len(e)) - 1
        open_ = whole
        for word in a:
            met = open_ & places.get(word, 0)
            open_ = (open_ + met | open_ - met) & whole
        longest = len(e) - open_.bit_count()
        out.append(1.0 if not len(a) and not len(e) else 2.0 * longest / (len(a) + len(e)))
    return pd.Series(out, dtype=float)


def token_overlap(answers: DataFrame) -> DataFrame:
    """id, exact, f1, bleu1, rouge_l of answer against expected: bags of words, and their order for rouge_l."""
    bags = answers.select("id", answer_tokens(F.col("answer")).alias("a"), answer_tokens(F.col("expected")).alias("e"))
    count = lambda side: bags.select("id", F.explode(side).alias("t")).groupBy("id", "t").agg(F.count("*").alias(f"n_{side}"))
    common = count("a").join(count("e"), ["id", "t"]).groupBy("id").agg(F.sum(F.least("n_a", "n_e")).alias("common"))
    na, ne, c = F.size("a"), F.size("e"), F.coalesce("common", F.lit(0))
    brevity = F.when(na >= ne, 1.0).otherwise(F.exp(1 - ne / F.greatest(na, F.lit(1))))
    return bags.join(common, "id", "left").select(
        "id", (F.col("a") == F.col("e")).alias("exact"),
        F.when(c > 0, 2.0 * c / (na + ne)).otherwise(0.0).alias("f1"),
        F.when(na > 0, brevity * c / na).otherwise(0.0).alias("bleu1"),
        rouge_l(F.col("a"), F.col("e")).alias("rouge_l"),
    )


def joint_f1(found: DataFrame) -> DataFrame:
    """id with exact match, precision, recall and f1 of answers, of support and of both together.

    found: id, answers, expected_answers, support, expected_support (arrays, as sets). Nothing found where nothing is expected is
    perfect; with only one side empty, precision and f1 are 0, and recall is 1 where nothing was expected.
    """

    def of(mine: str, want: str) -> list[Column]:
        x, y = F.array_distinct(mine), F.array_distinct(want)
        n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
        share = lambda d: F.when((n == 0) & (m == 0), 1.0).when(d > 0, both / d)
        precision, recall = share(n).otherwise(0.0), share(m).otherwise(1.0)
        return [((n == m) & (both == n)).cast("double"), precision, recall]

    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    out, product = ["id"], [F.lit(1.0)] * 3
    for name, mine, want in (("answer", "answers", "expected_answers"), ("support", "support", "expected_support")):
        parts = of(mine, want)
        product = [x * y for x, y in zip(product, parts, strict=True)]
        out += [c.alias(f"{name}_{k}") for c, k in zip([*parts, f1(*parts[1:])], ("em", "precision", "recall", "f1"), strict=True)]
    out += [c.alias(f"joint_{k}") for c, k in zip([*product, f1(*product[1:])], ("em", "precision", "recall", "f1"), strict=True)]
    return found.select(*out)


def regression_gate(run: DataFrame, baseline: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """metric, value, baseline, blocked (it fell by more than the tolerance)."""
    return run.join(baseline.withColumnRenamed("value", "baseline"), "metric").withColumn("blocked", F.col("baseline") - F.col("value") > tolerance)
