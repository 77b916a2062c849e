"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At each level a child's draw is -ln(u) / weight, with u from a hash of the key and the child's name;
the least draw wins. A child's chance is its share of the weight, and a change of weights below one
child changes no draw of its siblings, so only rows of the changed subtree or into it move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A leaf: (region, rack, shard number, weight).
Leaf = tuple[str, str, int, float]


def default_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """A founding tree: racks of `per_rack` shards in regions of `racks` racks, all of weight 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return [(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s, 1.0) for s in range(shards)]


def grow(tree: list[Leaf]) -> list[Leaf]:
    """The tree with one more shard, in a region of its own: no other region's weights change, so every row that moves
    moves into that shard."""
    new = 1 + max(shard for _, _, shard, _ in tree)
    return [*tree, (f"added{new}", "rack0", new, 1.0)]


def _levels(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Children and their weights by parent, level by level."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in tree:
        path = ["", region, f"{region}/{rack}", f"{region}/{rack}/{shard}"]
        for level, (parent, child) in enumerate(zip(path, path[1:], strict=False)):
            children = levels[level].setdefault(parent, {})
            children[child] = children.get(child, 0.0) + weight
    return levels


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard number for a key. The tree is configuration: its size is that of the cluster, not of the data."""
    at = F.lit("")
    for children in _levels(tree):
        options = F.create_map(
            *(
                x
                for parent, kids in children.items()
                for x in (
                    F.lit(parent),
                    F.array(*(F.struct(F.lit(k).alias("name"), F.lit(w).alias("w")) for k, w in kids.items() if w > 0)),
                )
            )
        )
        uniform = lambda name: (F.shiftrightunsigned(F.xxhash64(key, name), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        draws = F.transform(options[at], lambda c: F.struct((-F.ln(uniform(c["name"])) / c["w"]).alias("d"), c["name"].alias("name")))
        at = F.array_min(draws)["name"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Law `key`: doc_id and the number of shards decide alone; with one more shard (grown_shard), rows
    move into that one only. Slots number each shard's rows from 0 without a gap, in order of a hash
    bucket, then doc_id, size and checksum.

    A null text has 0 bytes (size 1, checksum 0). A null doc_id is a key like any other. Repeated rows
    are equal keys: they share a shard and get slots of their own. An empty table gives an empty one.
    Other columns are not read, so their names can't clash.
    """
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    #: About sqrt(rows of a shard) buckets with as many rows each: both levels of numbering stay small.
    buckets = max(1, math.isqrt(docs.count() // shards))
    same = ["doc_id", "size", "text_crc32"]
    counted = (
        rows.groupBy(*same)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", place(key, default_tree(shards)))
        .withColumn("bucket", F.pmod(F.xxhash64(*same), F.lit(buckets)))
    )
    starts = (
        counted.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("n"))
        .withColumn(
            "bucket_start",
            F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("n")
    )
    before = F.sum("copies").over(
        W.partitionBy("shard", "bucket").orderBy(*(F.col(c).asc_nulls_first() for c in same)).rowsBetween(W.unboundedPreceding, -1)
    )
    numbered = counted.withColumn("before", F.coalesce(before, F.lit(0))).join(starts, ["shard", "bucket"])
    start = F.col("bucket_start") + F.col("before")
    return numbered.select(
        *same,
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("slot"),
        place(key, grow(default_tree(shards))).alias("grown_shard"),
    )
