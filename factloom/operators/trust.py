"""Source trust, calibration and conflict scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_SAMPLES = 8


def source_key(vertical: Column, recorder: Column) -> Column:
    return F.concat(vertical, F.lit(":"), F.coalesce(recorder, F.lit("_")))


def declared_trust(vertical: Column) -> Column:
    """By the shape of the source."""
    return F.when(vertical == "billing", 0.95).when(vertical.isin("incidents", "auth"), 0.90).otherwise(0.50)


def recency(age_days: Column) -> Column:
    return F.exp(-age_days / 365)


def conflict_score(confidence: Column, trust: Column, recent: Column, authority: Column) -> Column:
    return 0.30 * confidence + 0.40 * trust + 0.20 * recent + 0.10 * authority


def trust_ladder(learned: Column, declared: Column) -> Column:
    """Learned trust unless it is exactly 0.5, else declared, else 0.5."""
    return F.coalesce(F.when(learned != 0.5, learned), declared, F.lit(0.5))


def trust_events(facts: DataFrame) -> DataFrame:
    """source_key, domain, win, loss, recorded_at. Echoes of one claim by one source and origin count once, the first.

    facts may have corroborates; without it all echoes of a predicate and origin are one.
    """
    same = F.col("corroborates") if "corroborates" in facts.columns else F.lit("")
    key = source_key(F.col("vertical"), F.col("recorder"))
    echo = F.when(F.col("status") == "corroborating", F.concat_ws(" ", F.col("predicate"), F.coalesce("origin_key", key), F.coalesce(same, F.lit(""))))
    nth = F.row_number().over(W.partitionBy("source_key", "echo").orderBy("recorded_at", "fact_id"))
    rows = facts.withColumn("source_key", key).withColumn("echo", F.coalesce(echo, F.concat(F.lit("\u0001"), "fact_id")))
    return rows.withColumn("nth", nth).where("nth = 1").select(
        "source_key",
        F.col("predicate").alias("domain"),
        F.col("status").isin("active", "corroborating").cast("long").alias("win"),
        F.col("status").isin("superseded", "retracted").cast("long").alias("loss"),
        "recorded_at",
    )


def feedback_events(feedback: DataFrame) -> DataFrame:
    """helpful is a win, incorrect a loss; of one actor's equal verdicts on a source's predicate the newest counts."""
    newest = F.row_number().over(W.partitionBy("actor", "source_key", "domain", "verdict").orderBy(F.desc("created_at"), "feedback_id"))
    return feedback.where("verdict IN ('helpful', 'incorrect')").withColumn("nth", newest).where("nth = 1").select(
        "source_key", "domain",
        (F.col("verdict") == "helpful").cast("long").alias("win"),
        (F.col("verdict") == "incorrect").cast("long").alias("loss"),
        F.col("created_at").alias("recorded_at"),
    )


def refit_source_trust(events: DataFrame) -> DataFrame:
    """source_key, domain (null: over all domains), wins, losses, rate, last_seen; scopes without any are left out."""
    grouped = events.groupingSets([["source_key", "domain"], ["source_key"]], "source_key", "domain").agg(
        F.sum("win").alias("wins"), F.sum("loss").alias("losses"), F.max("recorded_at").alias("last_seen")
    )
    n = F.col("wins") + F.col("losses")
    return grouped.where(n > 0).withColumn("rate", F.col("wins") / n).withColumn("samples", n)


def trust_history(new: DataFrame, old: DataFrame, least: float = 0.01) -> DataFrame:
    """Scopes of new that are unknown to old or whose rate moved by more than `least`."""
    prior = old.select(F.col("source_key").alias("__k"), F.col("domain").alias("__d"), F.col("rate").alias("prior_rate"))
    same = (F.col("source_key") == F.col("__k")) & F.col("domain").eqNullSafe(F.col("__d"))
    moved = F.col("prior_rate").isNull() | (F.abs(F.col("rate") - F.col("prior_rate")) > least)
    return new.join(prior, same, "left").where(moved).drop("__k", "__d")


def trust_lookup(keys: DataFrame, trust: DataFrame) -> DataFrame:
    """keys (source_key, domain) with learned: the scoped rate if sampled enough, else the global one, else 0.5."""
    enough = trust.where(F.col("samples") >= MIN_SAMPLES)
    scoped = enough.where("domain IS NOT NULL").select("source_key", "domain", F.col("rate").alias("__scoped"))
    overall = enough.where("domain IS NULL").select("source_key", F.col("rate").alias("__overall"))
    joined = keys.join(scoped, ["source_key", "domain"], "left").join(overall, "source_key", "left")
    return joined.select(*keys.columns, F.coalesce("__scoped", "__overall", F.lit(0.5)).alias("learned"))


def calibration_pairs(facts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """raw (confidence within 0 and 1) and correct (0 or 1) of facts older than `days`."""
    correct = (
        F.when((F.col("status") == "active") & F.col("retracted_at").isNull(), 1)
        .when(F.col("status").isin("retracted", "superseded"), 0)
        .otherwise(1)
    )
    old = facts.where(F.col("confidence").isNotNull() & (F.col("recorded_at") < now - F.make_dt_interval(F.lit(days))))
    return old.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("raw"), correct.alias("correct"))


def calibration_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    return pairs.groupBy(F.least(F.floor(F.col("raw") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("correct").cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("weight")
    )


def fit_isotonic(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: thresholds and values of a rising step function, and the number of pairs.

    Pairs are counted into equal bins; neighbours that fall are pooled, over at most `bins` rows in one array.
    """
    one = calibration_bins(pairs, bins).agg(F.sort_array(F.collect_list(F.struct("bin", "hits", "weight"))).alias("b"), F.sum("weight").alias("n"))
    block = "named_struct('upper', (x.bin + 1) / {bins}, 'hits', x.hits, 'weight', x.weight)".format(bins=float(bins))
    pooled = f"""
      aggregate(b, cast(array() as array<struct<upper: double, hits: double, weight: double>>), (done, x) ->
        aggregate(sequence(0, {bins}), concat(done, array({block})), (s, i) ->
          if(size(s) > 1 AND s[size(s) - 2].hits / s[size(s) - 2].weight > s[size(s) - 1].hits / s[size(s) - 1].weight,
             concat(slice(s, 1, size(s) - 2), array(named_struct('upper', s[size(s) - 1].upper,
                    'hits', s[size(s) - 2].hits + s[size(s) - 1].hits, 'weight', s[size(s) - 2].weight + s[size(s) - 1].weight))), s)))"""
    steps = one.withColumn("s", F.expr(pooled))
    return steps.select(
        F.expr("if(size(s) > 0, concat(transform(slice(s, 1, size(s) - 1), x -> x.upper), array(1.0D)), array(1.0D))").alias("thresholds"),
        F.expr("if(size(s) > 0, transform(s, x -> x.hits / x.weight), array(1.0D))").alias("values"),
        F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("samples"),
    )


def calibrate(confidence: Column, thresholds: Column, values: Column) -> Column:
    """The value of the first step whose threshold the confidence doesn't exceed."""
    at = F.array_position(F.transform(thresholds, lambda t: confidence <= t), F.lit(True))
    return F.when(at > 0, F.element_at(values, F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.element_at(values, -1))
