"""The scoring rules as SQL functions: register() makes them callable from spark.sql of a session.

They are SQL functions with a body, not UDFs: Spark puts the body in place of the call, so they are optimised and compiled with
the query. Judges of pairs and makers of summaries that a caller brings are registered beside them, as Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from factloom.operators.retrieval import CORROBORATION_CAP, FLOOR, HALF_LIFE_DAYS, SALIENCE

LN2 = 0.6931471805599453
DAY = 86_400_000_000.0

#: Name, arguments, type of the result, body.
FUNCTIONS = [
    ("source_key", "vertical STRING, recorder STRING", "STRING", "concat(vertical, ':', coalesce(recorder, '_'))"),
    ("declared_trust", "vertical STRING", "DOUBLE", "CASE WHEN vertical = 'billing' THEN 0.95D WHEN vertical IN ('incidents', 'auth') THEN 0.90D ELSE 0.50D END"),
    ("days_between", "later TIMESTAMP, earlier TIMESTAMP", "DOUBLE", f"(unix_micros(later) - unix_micros(earlier)) / {DAY}D"),
    ("recency", "age_days DOUBLE", "DOUBLE", "exp(-age_days / 365)"),
    ("conflict_score", "confidence DOUBLE, trust DOUBLE, recent DOUBLE, authority DOUBLE", "DOUBLE", "0.30D * confidence + 0.40D * trust + 0.20D * recent + 0.10D * authority"),
    ("trust_ladder", "learned DOUBLE, declared DOUBLE", "DOUBLE", "coalesce(CASE WHEN learned <> 0.5D THEN learned END, declared, 0.5D)"),
    ("trust_factor", "reputation DOUBLE, corroborations DOUBLE, authority DOUBLE, beta DOUBLE, gamma DOUBLE, delta DOUBLE", "DOUBLE",
     f"(1 + beta * (reputation - 0.5D)) * (1 + gamma * least(corroborations, {float(CORROBORATION_CAP)}D)) * (1 + delta * authority)"),
    ("calibrate", "confidence DOUBLE, thresholds ARRAY<DOUBLE>, levels ARRAY<DOUBLE>", "DOUBLE",
     "coalesce(element_at(filter(transform(thresholds, (t, i) -> CASE WHEN confidence <= t THEN levels[i] END), v -> v IS NOT NULL), 1), element_at(levels, -1))"),
    ("salience_factor", "salience INT", "DOUBLE", f"CASE salience {' '.join(f'WHEN {i} THEN {x}D' for i, x in enumerate(SALIENCE))} ELSE 1.0D END"),
    ("fade", "gap_days DOUBLE", "DOUBLE", f"{FLOOR}D + {1 - FLOOR}D * exp(-{LN2}D * greatest(0.0D, gap_days) / {HALF_LIFE_DAYS}D)"),
    ("read_decay", "at TIMESTAMP, recorded TIMESTAMP, last_read TIMESTAMP, half_life DOUBLE", "DOUBLE",
     f"CASE WHEN half_life IS NULL THEN 1.0D ELSE exp(-{LN2}D * ((unix_micros(at) - unix_micros(greatest(recorded, coalesce(last_read, recorded)))) / {DAY}D) / half_life) END"),
    ("intervals_overlap", "a_from TIMESTAMP, a_until TIMESTAMP, b_from TIMESTAMP, b_until TIMESTAMP", "BOOLEAN", "(b_until IS NULL OR a_from < b_until) AND (a_until IS NULL OR b_from < a_until)"),
    ("covers", "starts TIMESTAMP, ends TIMESTAMP, at TIMESTAMP", "BOOLEAN", "starts <= at AND (ends IS NULL OR ends > at)"),
    ("overlap_factor", "starts TIMESTAMP, ends TIMESTAMP, at TIMESTAMP", "DOUBLE",
     "CASE WHEN starts IS NULL OR {0}covers(starts, ends, at) THEN 1.0D WHEN starts > at THEN {0}fade({0}days_between(starts, at)) ELSE {0}fade({0}days_between(at, ends)) END"),
    ("period_factor", "starts TIMESTAMP, ends TIMESTAMP, mentioned TIMESTAMP, period_from TIMESTAMP, period_to TIMESTAMP", "DOUBLE",
     "CASE WHEN starts IS NULL OR (ends IS NOT NULL AND starts < period_to AND period_from < ends) OR (ends IS NULL AND starts >= period_from AND starts < period_to)"
     " OR (mentioned >= period_from AND mentioned < period_to) THEN 1.0D WHEN starts >= period_to THEN {0}fade({0}days_between(starts, period_to))"
     " ELSE {0}fade({0}days_between(period_from, coalesce(ends, starts))) END"),
    ("diversity_key", "predicate STRING, said STRING", "STRING",
     r"concat_ws('|', predicate, array_join(array_sort(slice(filter(split(regexp_replace(lower(said), r'[^\p{{L}}\p{{N}}]+', ' '), ' '), t -> char_length(t) >= 3), 1, 3)), ' '))"),
    ("clamp01", "x DOUBLE", "DOUBLE", "CASE WHEN x <= 0 THEN 0.0D WHEN x > 1 THEN 1.0D ELSE x END"),
    ("squash", "x DOUBLE", "DOUBLE", "CASE WHEN x <= 0 THEN 0.0D ELSE x / (1 + x) END"),
    ("dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> coalesce(x * y, 0.0D)), 0.0D, (s, x) -> s + x)"),
    ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
     "CASE WHEN {0}dot(a, a) * {0}dot(b, b) > 0 THEN {0}dot(a, b) / (sqrt({0}dot(a, a)) * sqrt({0}dot(b, b))) ELSE 0.0D END"),
]


def register(spark: SparkSession, prefix: str = "fact_") -> list[str]:
    """Make the functions callable in the session under prefix + name; their names."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body.format(prefix)}")
    return [prefix + f[0] for f in FUNCTIONS]


def same_text(a, b):  # noqa: ANN001, ANN201
    """The judge that takes no model: two texts say the same if they are equal."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.equal(a, b), False)


def register_judge(spark: SparkSession, judge: Callable = same_text, name: str = "fact_judge") -> None:
    """Make a judge of pairs (two Arrow arrays of texts -> an Arrow array of booleans) callable in the session."""
    from pyspark.sql.functions import arrow_udf

    spark.udf.register(name, arrow_udf(judge, "boolean"))


def register_summary(spark: SparkSession, summary: Callable, name: str = "fact_summary") -> None:
    """Make a maker of summaries (an Arrow array of lists of texts -> an Arrow array of texts) callable in the session."""
    from pyspark.sql.functions import arrow_udf

    spark.udf.register(name, arrow_udf(summary, "string"))
