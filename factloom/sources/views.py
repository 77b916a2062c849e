"""The fact world that the driver's tables stand for, as one SQL text for Spark and for DuckDB.

ADD_DAYS(t, n) and IDIV(a, b) are spelled for each engine; everything else is common SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "facts": (
        ("orders",),
        """
SELECT fact_id, entity_id, predicate, object, confidence, valid_from, valid_until, prior_valid_until, recorded_at, retracted_at,
  superseded_by, user_id, derived_version, lang, vertical, recorder, origin_key, n,
  CASE WHEN n % 17 = 0 THEN 'retracted' WHEN n % 13 = 0 THEN 'competing' WHEN n % 19 = 0 THEN 'compacted'
       WHEN n % 23 = 0 THEN 'corroborating' WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE 'active' END AS status
FROM (
  SELECT *, CASE WHEN next_id IS NOT NULL AND n % 3 <> 0 THEN next_from END AS valid_until,
    CASE WHEN next_id IS NOT NULL AND n % 3 <> 0 THEN next_id END AS superseded_by,
    CASE WHEN next_id IS NOT NULL AND n % 3 <> 0 AND n % 2 = 0 THEN ADD_DAYS(valid_from, 400) END AS prior_valid_until
  FROM (
    SELECT *, lead(fact_id) OVER (PARTITION BY entity_id, predicate ORDER BY valid_from, fact_id) AS next_id,
      lead(valid_from) OVER (PARTITION BY entity_id, predicate ORDER BY valid_from, fact_id) AS next_from
    FROM (
      SELECT concat('o', o_orderkey) AS fact_id, concat('c', o_custkey) AS entity_id,
        CASE o_orderkey % 7 WHEN 5 THEN 'phone' WHEN 6 THEN 'summary_profile' ELSE 'order_status' END AS predicate,
        o_orderstatus AS object, 0.25 + CAST(o_orderkey % 75 AS DOUBLE) / 100 AS confidence, o_orderdate AS valid_from,
        ADD_DAYS(o_orderdate, o_orderkey % 30) AS recorded_at,
        CASE WHEN o_orderkey % 17 = 0 THEN ADD_DAYS(o_orderdate, 120) END AS retracted_at,
        CASE WHEN o_orderkey % 5 = 0 THEN concat('u', o_custkey % 7) END AS user_id,
        CASE WHEN o_orderkey % 11 = 0 THEN concat('v', o_orderkey % 2) END AS derived_version,
        CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS lang,
        CASE o_orderkey % 3 WHEN 0 THEN 'billing' WHEN 1 THEN 'message' ELSE 'incidents' END AS vertical,
        o_orderpriority AS recorder, concat('doc:', o_orderkey % 997) AS origin_key, o_orderkey AS n
      FROM {orders}) base) timeline) closed
""",
    ),
    "entities": (
        ("customer",),
        """
SELECT concat('c', c_custkey) AS entity_id, c_name AS canonical_name, lower(c_mktsegment) AS type,
  CASE WHEN c_custkey % 20 = 7 THEN concat('c', c_custkey - 7) WHEN c_custkey % 20 = 8 THEN concat('x', c_custkey) END AS merged_into,
  concat('crm__', c_custkey) AS external_ref, c_custkey AS n FROM {customer}
""",
    ),
    "edges": (
        ("lineitem", "orders"),
        """
SELECT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, 'buys' AS kind,
  least(1.0e0, CAST(sum(l_quantity) AS DOUBLE) / 100) AS weight, min(l_shipdate) AS created_at,
  CASE WHEN l_suppkey % 10 = 3 THEN max(l_shipdate) END AS invalidated_at,
  CASE WHEN o_custkey % 9 = 0 THEN concat('u', o_custkey % 7) END AS user_id
FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey
""",
    ),
    "turns": (
        ("events",),
        """
SELECT concat('t', event_id) AS turn_id, concat('conv', user_id) AS conversation_id, event_type AS speaker, ts AS occurred_at,
  CASE WHEN event_id % 6 = 0 THEN concat('u', user_id % 7) END AS user_id, concat(event_type, ' ', CAST(event_id % 50 AS STRING)) AS text,
  event_id AS n FROM {events}
""",
    ),
    "links": (
        ("orders",),
        """
SELECT concat('o', o_orderkey) AS fact_id, concat('o', IDIV(o_orderkey, 2)) AS parent FROM {orders} WHERE o_orderkey % 4 IN (1, 2) AND o_orderkey > 1
""",
    ),
    "registry": (
        (),
        """
SELECT * FROM (VALUES ('order_status', 'single_active', 365.0e0, NULL, NULL), ('phone', 'bitemporal', 180.0e0, 'contact', 'pii:read'),
  ('summary_profile', 'append_only', NULL, NULL, NULL)) AS r(predicate, semantics, half_life_days, pii_class, requires_scope)
""",
    ),
}


def _spell(text: str, add_days: str, idiv: str) -> str:
    text = re.sub(r"ADD_DAYS\(([^,()]+), ([^()]+)\)", add_days, text)
    return re.sub(r"IDIV\(([^,()]+), ([^()]+)\)", idiv, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """facts, entities, edges, turns, links (fact and parent) or registry over the tables in sf_dir."""
    tables, text = VIEWS[name]
    text = _spell(text, r"(\1 + make_dt_interval(CAST(\2 AS INT)))", r"(\1 DIV \2)")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def view_sql(*names: str) -> str:
    """The same views as common table expressions for DuckDB: `WITH facts AS (...), ...`."""
    spelled = (
        f"{n} AS ({_spell(VIEWS[n][1], r'(\1 + to_days(CAST(\2 AS INTEGER)))', r'(\1 // \2)').format(**{t: t for t in VIEWS[n][0]})})"
        for n in names
    )
    return "WITH " + ",\n".join(spelled)
