"""Policy sets compiled to columns. A set is a dict:

{"name", "mode": "enforce" | "report_only", "default": "allow" | "deny",
 "rules": [{"id", "effect": "allow" | "deny", "when": [(attribute, op, value), ...]}]}

An attribute is a column; where it is null no test holds but not_exists.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OPS = {
    "eq": lambda c, v: c == v,
    "in": lambda c, v: c.isin(*v),
    "prefix": lambda c, v: c.startswith(v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def _test(attribute: str, op: str, value: Any) -> Column:
    c = F.col(attribute)
    if op in ("exists", "not_exists"):
        return c.isNotNull() if op == "exists" else c.isNull()
    return F.coalesce(_OPS[op](c, value), F.lit(False))


def _rule(rule: dict) -> Column:
    return reduce(lambda a, b: a & b, (_test(*t) for t in rule["when"]), F.lit(True))


def _verdict(policy: dict) -> Column:
    """Struct of verdict and rule_id: the first deny rule that holds, else the first allow rule, else the default."""
    made = lambda verdict, rule: F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).cast("string").alias("rule_id"))
    out = made(policy["default"], None)
    for effect in ("allow", "deny"):
        for rule in reversed([r for r in policy["rules"] if r["effect"] == effect]):
            out = F.when(_rule(rule), made(effect, rule["id"])).otherwise(out)
    return out


def apply_policy(facts: DataFrame, sets: list[dict]) -> DataFrame:
    """facts with decision (allow, deny or would_deny) and rule_id of the set that decided. A deny wins across sets."""
    enforced, watched = F.lit(None).cast("string"), F.lit(None).cast("string")
    denied, would = F.lit(False), F.lit(False)
    for policy in reversed(sets):
        v = _verdict(policy)
        no = v["verdict"] == "deny"
        if policy["mode"] == "enforce":
            denied, enforced = denied | no, F.when(no, v["rule_id"]).otherwise(enforced)
        else:
            would, watched = would | no, F.when(no, v["rule_id"]).otherwise(watched)
    decision = F.when(denied, "deny").when(would, "would_deny").otherwise("allow")
    return facts.withColumn("decision", decision).withColumn("rule_id", F.when(denied, enforced).when(would, watched))


def policy_meta_union(facts: DataFrame, docs: DataFrame, sets: list[dict]) -> DataFrame:
    """facts without those that any of their origin documents trips a deny rule for. facts has origin_keys, docs origin_key."""
    cited = facts.select("fact_id", F.explode("origin_keys").alias("origin_key"))
    tripped = apply_policy(docs, sets).where("decision = 'deny'").select("origin_key")
    denied = cited.join(tripped, "origin_key", "left_semi").select("fact_id").distinct()
    return facts.join(denied, "fact_id", "left_anti")


def policy_impact(facts: DataFrame, sets: list[dict], samples: int = 3) -> DataFrame:
    """policy_set, total, denied, would_deny, rule_ids and sample_fact_ids of each set.

    rule_ids are up to `samples` rules that denied (posture: the set's default did), sample_fact_ids the smallest fact ids that
    it denies or would deny; both in order. All sets are judged in one pass over the facts.
    """
    names = {p["name"]: p["mode"] for p in sets}
    no = [F.when(v["verdict"] == "deny", F.struct(F.lit(p["name"]).alias("policy_set"), F.coalesce(v["rule_id"], F.lit("posture")).alias("rule"))) for p in sets for v in [_verdict(p)]]
    hits = facts.select("fact_id", F.explode(F.array_compact(F.array(*no))).alias("no")).select("fact_id", "no.*")
    counts = hits.groupBy("policy_set").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("rule")), 1, samples).alias("rule_ids"))
    place = F.row_number().over(W.partitionBy("policy_set").orderBy("fact_id"))
    least = hits.select("policy_set", "fact_id").withColumn("k", place).where(F.col("k") <= samples)
    shown = least.groupBy("policy_set").agg(F.sort_array(F.collect_list("fact_id")).alias("sample_fact_ids"))
    every = facts.sparkSession.createDataFrame(list(names.items()), "policy_set string, mode string")
    joined = every.crossJoin(facts.agg(F.count(F.lit(1)).alias("total"))).join(counts, "policy_set", "left").join(shown, "policy_set", "left")
    n, none = F.coalesce("n", F.lit(0)), F.array().cast("array<string>")
    return joined.select(
        "policy_set", "total", F.when(F.col("mode") == "enforce", n).otherwise(0).alias("denied"), F.when(F.col("mode") != "enforce", n).otherwise(0).alias("would_deny"),
        F.coalesce("rule_ids", none).alias("rule_ids"), F.coalesce("sample_fact_ids", none).alias("sample_fact_ids"),
    )


def preview_rule(facts: DataFrame, rule: dict, limit: int = 1000, samples: int = 3) -> DataFrame:
    """matched, sampled and sample (fact_id, predicate, vertical, recorder) of one rule over the `limit` latest active facts."""
    latest = facts.where("status = 'active' AND retracted_at IS NULL").orderBy(F.desc("recorded_at"), F.desc("fact_id")).limit(limit)
    judged = latest.select(_rule(rule).alias("hit"), F.struct("recorded_at", "fact_id", "predicate", "vertical", "recorder").alias("f"))
    found = F.reverse(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("f")))))
    sample = F.transform(F.slice(found, 1, samples), lambda f: f.dropFields("recorded_at"))
    return judged.agg(F.count_if("hit").alias("matched"), F.count(F.lit(1)).alias("sampled"), sample.alias("sample"))
