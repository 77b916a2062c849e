"""Worlds that switch in one step: data files in a folder a version, and one manifest that says which folders are the world.

A promotion writes the new content of the partitions it changes under a name that nobody reads, and then creates the next
manifest. Creating it is the switch; it fails if another promotion created it first. A reader takes the newest manifest once and
reads the folders that it names, so it sees the old world or the new one, whatever happens to a promotion on the way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources.readers import revive_other_conversations

#: Where Spark puts rows whose partition value is null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another promotion came first; promote again, on what it left."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/manifests")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at) if not f.getPath().getName().startswith((".", "_"))) if fs.exists(at) else []


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """number, schema, partitions (columns) and folders (partition -> folder) of a version, by default the newest; 0: none yet."""
    number = max(_numbers(spark, path), default=0) if number is None else number
    if not number:
        return {"number": 0, "schema": None, "partitions": [], "folders": {}}
    text = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number}.json")
    stream = text.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(text)
    content = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return {"number": number} | json.loads(content)


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Create manifest `number`: written under another name first, then renamed to one that must not exist."""
    fs, made = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    stream = fs.create(made, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    _, last = _fs(spark, f"{path}/manifests/{number}.json")
    if fs.exists(last) or not fs.rename(made, last):
        fs.delete(made, False)
        raise Conflict(f"version {number} of {path} exists")


def _value(step: Column) -> Column:
    """The value in `column=value` of a file's URI: signs are escaped in the folder's name, and once more in the URI."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return plain(F.element_at(F.split(plain(step), "=", 2), 2))


def read_world_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The world as its newest manifest (or an older one) has it when this is called. A world never promoted is an error."""
    found = manifest(spark, path, number)
    if not found["number"]:
        raise FileNotFoundError(f"no world was promoted to {path}")
    schema = StructType.fromJson(found["schema"])
    files = StructType([f for f in schema.fields if f.name not in found["partitions"]])
    by_folder: dict[str, list[str]] = {}
    for partition, folder in found["folders"].items():
        by_folder.setdefault(folder, []).append(partition)
    out = spark.createDataFrame([], schema)
    for folder, partitions in sorted(by_folder.items()):
        rows = spark.read.schema(files).option("recursiveFileLookup", "true").parquet(*(f"{path}/{folder}/{p}" for p in partitions))
        where = F.split(F.split(F.input_file_name(), f"/{folder}/")[1], "/")
        named = {c: F.nullif(_value(where[i]), F.lit(NO_VALUE)).cast(schema[c].dataType) for i, c in enumerate(found["partitions"])}
        out = out.unionByName(rows.withColumns(named).select(*schema.names))
    return out


def _partitions(spark: SparkSession, path: str, depth: int) -> list[str]:
    fs, at = _fs(spark, path)
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/*=*" * depth))
    root = fs.makeQualified(at).toString()
    return sorted(f.getPath().toString()[len(root) + 1 :] for f in found)


def promote_world(staging: DataFrame, path: str, partitions: list[str], revive: bool = True, based_on: int | None = None) -> int:
    """Replace the partitions that staging has rows in by these, in one step; returns the new version's number.

    With revive, facts outside of them that a replaced fact had superseded become active again in the same step: the
    partitions they stand in are rewritten too. based_on: the version that staging was made from; if the world has gone on
    since, or goes on meanwhile, nothing changes and Conflict is raised. The manifest holds a line a partition.
    """
    spark = staging.sparkSession
    old = manifest(spark, path)
    if based_on is not None and based_on != old["number"]:
        raise Conflict(f"{path} is at version {old['number']}, not {based_on}")
    folder = f"data/{old['number'] + 1}-{uuid.uuid4().hex}"
    staging.write.partitionBy(*partitions).parquet(f"{path}/{folder}")
    replaced = _partitions(spark, f"{path}/{folder}", len(partitions))
    folders = old["folders"] | dict.fromkeys(replaced, folder)
    if revive and old["number"] and {"fact_id", "superseded_by"} <= set(staging.columns):
        world, new = read_world_version(spark, path, old["number"]), staging.select(*(F.col(c).alias(f"__{c}") for c in partitions)).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in partitions]
        gone = world.join(new, same, "left_semi").select("fact_id")
        rest = world.join(new, same, "left_anti")
        hit = rest.where("status = 'superseded'").join(gone.withColumnRenamed("fact_id", "superseded_by"), "superseded_by", "left_semi")
        touched = hit.select(*(F.col(c).alias(f"__{c}") for c in partitions)).distinct()
        again = revive_other_conversations(rest.join(touched, same, "left_semi"), gone).select(*staging.columns)
        more = f"{folder}-revived"
        again.write.partitionBy(*partitions).parquet(f"{path}/{more}")
        folders |= dict.fromkeys(_partitions(spark, f"{path}/{more}", len(partitions)), more)
    _publish(spark, path, old["number"] + 1, {"schema": staging.schema.jsonValue(), "partitions": partitions, "folders": folders})
    return old["number"] + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest `keep`, and folders that none of these names; their names. No promotion may run meanwhile."""
    numbers = _numbers(spark, path)
    live = {f for n in numbers[-keep:] for f in manifest(spark, path, n)["folders"].values()}
    fs, at = _fs(spark, f"{path}/data")
    dead = [f"data/{f.getPath().getName()}" for f in fs.listStatus(at)] if fs.exists(at) else []
    dead = sorted(d for d in dead if d not in live)
    for name in [*(f"manifests/{n}.json" for n in numbers[:-keep]), *dead]:
        fs.delete(_fs(spark, f"{path}/{name}")[1], True)
    return dead

