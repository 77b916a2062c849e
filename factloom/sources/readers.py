"""Sources and sinks of the fact world."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACT_SCHEMA = (
    "tenant string, fact_id string, entity_id string, predicate string, predicate_alias string, object string, confidence double, "
    "valid_from timestamp, valid_until timestamp, prior_valid_until timestamp, recorded_at timestamp, retracted_at timestamp, "
    "retraction_reason string, superseded_by string, corroborates string, derived_from array<string>, status string, user_id string, "
    "derived_version string, lang string, vertical string, recorder string, origin_key string"
)
TURN_SCHEMA = "tenant string, turn_id string, conversation_id string, speaker string, text string, occurred_at timestamp, recorded_at timestamp, user_id string"
EDGE_SCHEMA = "tenant string, src string, dst string, kind string, weight double, created_at timestamp, invalidated_at timestamp, user_id string"
ENTITY_SCHEMA = "tenant string, entity_id string, type string, canonical_name string, merged_into string, external_refs map<string,string>, created_at timestamp"
SCHEMAS = {"facts": FACT_SCHEMA, "turns": TURN_SCHEMA, "edges": EDGE_SCHEMA, "entities": ENTITY_SCHEMA}


def read_world(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a world under its fixed schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")


def ingest_documents(docs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """doc_id, hash, text, deduplicated: one row a document; true where an equal text (after redaction) is stored or came before."""
    from factloom.operators.text import redact_pii

    hashed = redact_pii(docs).withColumn("hash", F.sha2("text", 256))
    nth = F.row_number().over(W.partitionBy("hash").orderBy("doc_id"))
    rows = hashed.withColumn("deduplicated", nth > 1)
    if stored is not None:
        known = stored.select("hash", F.lit(True).alias("__known")).distinct()
        rows = rows.join(known, "hash", "left").withColumn("deduplicated", F.col("deduplicated") | F.coalesce("__known", F.lit(False)))
    return rows.select("doc_id", "hash", "text", "deduplicated")


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, predicate, object, valid_from, valid_until, confidence from nested JSON of entities with facts."""
    schema = "entities array<struct<id: string, facts: array<struct<predicate: string, object: string, validFrom: timestamp, validUntil: timestamp, confidence: double>>>>"
    entities = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("entities").alias("e"))
    return entities.select("e.id", F.explode("e.facts").alias("f")).select(
        F.col("id").alias("entity_id"), "f.predicate", "f.object", F.col("f.validFrom").alias("valid_from"), F.col("f.validUntil").alias("valid_until"), "f.confidence"
    )


def load_conversations(spark: SparkSession, path: str) -> DataFrame:
    """session, turn, dia_id, speaker, text, date of dialogues whose sessions are keys session_N with session_N_date_time."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    entries = raw.select("m", F.explode(F.map_entries("m")).alias("e")).where(F.regexp_like("e.key", F.lit(r"^session_\d+$")))
    sessions = entries.select(
        F.regexp_extract("e.key", r"(\d+)", 1).cast("int").alias("session"),
        F.get(F.transform(F.array(F.concat("e.key", F.lit("_date_time"))), lambda k: F.element_at("m", k)), 0).alias("date"),
        F.posexplode(F.from_json("e.value", "array<struct<dia_id: string, speaker: string, text: string>>")).alias("turn", "t"),
    )
    return sessions.select("session", "turn", "t.dia_id", "t.speaker", "t.text", "date")


def normalize_changes(changes: DataFrame) -> DataFrame:
    """op, record_id, row, version from change items (version, create, update, current, delete as JSON strings)."""
    op = F.when(F.col("delete").isNotNull(), "DELETE").when(F.col("current").isNotNull() | F.col("update").isNotNull(), "UPDATE").otherwise("CREATE")
    row = F.coalesce("current", "update", "create")
    record = F.coalesce(F.get_json_object("delete", "$.id"), F.get_json_object(row, "$.id"))
    return changes.select(op.alias("op"), record.alias("record_id"), row.alias("row"), "version")


def episodes_since(turns: DataFrame, watermark: Column, n: int = 200) -> DataFrame:
    """The next n turns by (recorded_at, turn_id) behind a watermark; their latest recorded_at is the next watermark."""
    return turns.where(F.col("recorded_at") > watermark).orderBy("recorded_at", "turn_id").limit(n)


def write_dead_letter(rejected: DataFrame, path: str, reason: str) -> None:
    rejected.select(F.to_json(F.struct("*")).alias("payload"), F.lit(reason).alias("reason")).write.mode("append").parquet(path)


def write_audit(changes: DataFrame, path: str) -> None:
    """Append changes not yet in the log by (source, record_id, version)."""
    keys = ["source", "record_id", "version"]
    new = changes.dropDuplicates(keys)
    spark = changes.sparkSession
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)


def revive_other_conversations(final: DataFrame, replaced: DataFrame) -> DataFrame:
    """final rows that a replaced row (fact_id) had superseded, outside of the replaced conversations, active again."""
    hit = replaced.select(F.col("fact_id").alias("superseded_by"), F.lit(True).alias("__hit")).distinct()
    rows = final.join(hit, "superseded_by", "left")
    back = F.coalesce("__hit", F.lit(False)) & (F.col("status") == "superseded")
    return rows.withColumns({
        "status": F.when(back, "active").otherwise(F.col("status")), "valid_until": F.when(back, F.col("prior_valid_until")).otherwise(F.col("valid_until")),
        "superseded_by": F.when(~back, F.col("superseded_by")), "prior_valid_until": F.when(~back, F.col("prior_valid_until")),
    }).drop("__hit")
