"""Graph operators as rounds of joins; iterative ones are written to the checkpoint folder each round."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_path(df: DataFrame) -> str:
    """A name in spark.checkpoint.dir that is not taken."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/round-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in spark.checkpoint.dir. It is computed once, outlives lost executors and has a size of its own, while a
    checkpoint keeps the product of all sizes joined so far, with which planning gets slower each round."""
    path = new_path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node it is linked with) for every node of links (a, b); labels jump to their labels' labels."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        top = lower.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        jumped = written(lower.join(top, F.col("root") == F.col("__n"), "left").select("node", "old", F.least("root", F.coalesce("__r", "root")).alias("root")))
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            break
    return labels


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 3) -> DataFrame:
    """query_id, node, rank over each query's nodes (seeds: query_id, node, score), undirected and weighted.

    Edges are first cut down to pairs of a query's own nodes. Nodes without edges give their mass back to the seeds.
    """
    total = written(seeds.groupBy("query_id").agg(F.sum("score").alias("total")))
    start = written(seeds.join(total, "query_id").select("query_id", "node", (F.col("score") / F.col("total")).alias("seed")))
    # An edge meets the queries of both its ends at once, so an end that is in many queries does not repeat it for each.
    held = written(start.groupBy("node").agg(F.collect_set("query_id").alias("queries")))
    end = lambda c: held.select(F.col("node").alias(c), F.col("queries").alias(f"of_{c}"))
    both = edges.select("src", "dst", "weight").join(end("src"), "src").join(end("dst"), "dst")
    mine = both.select("src", "dst", "weight", F.explode(F.array_intersect("of_src", "of_dst")).alias("query_id"))
    flat = mine.select("query_id", "src", "dst", "weight").union(mine.select("query_id", "dst", "src", "weight"))
    steps = written(flat.groupBy("query_id", "src", "dst").agg(F.sum("weight").alias("weight")))
    out = written(steps.groupBy("query_id", F.col("src").alias("node")).agg(F.sum("weight").alias("out")))
    start = written(start.join(out, ["query_id", "node"], "left"))
    ranks = start.withColumn("rank", F.col("seed"))
    for _ in range(rounds):
        sent = ranks.where("out IS NOT NULL").select("query_id", F.col("node").alias("src"), "out", "rank")
        got = steps.join(sent, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * (F.col("weight") / F.col("out"))).alias("got"))
        lost = written(ranks.where("out IS NULL").groupBy("query_id").agg(F.sum("rank").alias("lost")))
        ranks = written(
            start.join(got, ["query_id", "node"], "left").join(lost, "query_id", "left").select(
                "query_id", "node", "seed", "out",
                ((1 - alpha) * F.col("seed") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("seed") * F.coalesce("lost", F.lit(0.0)))).alias("rank"),
            )
        )
    return ranks.select("query_id", "node", "rank")


def pagerank_boost(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """hits (query_id, entity_id, rank_score) times 1 + 0.5 x rank / the query's largest rank."""
    top = F.max("rank").over(W.partitionBy("query_id"))
    part = ranks.withColumn("part", F.col("rank") / top).select("query_id", F.col("node").alias("entity_id"), "part")
    return hits.join(part, ["query_id", "entity_id"], "left").withColumn("rank_score", F.col("rank_score") * (1 + 0.5 * F.coalesce("part", F.lit(0.0)))).drop("part")


def _numbered(nodes: DataFrame) -> DataFrame:
    """node and id, a long for each node; ids stand in the order of the nodes."""
    return written(nodes.distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("id")))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by weighted label propagation in synchronous rounds.

    Every node takes its neighbours' heaviest label, the least of equals; on even rounds only if that label is
    smaller than its own, which ends the swinging of two-sided shapes. Loops are dropped, weights of 0 or less are 1.

    Rounds run on ids in the order of the nodes. Edges are a table bucketed by the end that sends, so that a round shuffles
    labels and one vote an edge, and no edges; once few labels change, only votes for nodes with such a neighbour. A bucket and a
    node's votes are each read by one task, row by row.
    """
    spark = edges.sparkSession
    e = written(edges.where("src <> dst").select("src", "dst", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight")))
    ids = _numbered(e.select(F.explode(F.array("src", "dst")).alias("node")))
    end = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    pairs = e.join(end("src"), "src").select("src_id", "dst", "weight").join(end("dst"), "dst").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "weight")
    ways = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w"), "weight").select(F.col("w.a").alias("src"), F.col("w.b").alias("dst"), "weight")
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"edges_{uuid.uuid4().hex}"
    summed = ways.repartition(buckets, "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    summed.write.bucketBy(buckets, "dst").sortBy("dst").option("path", new_path(edges)).format("parquet").saveAsTable(name)
    both = spark.table(name)
    labels = ids.select(F.col("id").alias("node"), F.col("id").alias("community"), F.lit(None).cast("long").alias("best"))
    nodes, asked = ids.count(), None
    for step in range(1, rounds + 1):
        sent = both.join(labels.hint("shuffle_hash"), both["dst"] == labels["node"]).select("src", "community", "weight")
        # Votes go to the node they are for before they are summed: hardly two of a node's come from one task.
        sent = sent.repartition("src") if asked is None else sent.join(asked, "src")
        votes = sent.groupBy("src", "community").agg(F.round(F.sum("weight"), 9).alias("v"))
        found = votes.groupBy("src").agg(F.min(F.struct((-F.col("v")).alias("v"), "community")).alias("b")).select(F.col("src").alias("node"), F.col("b.community").alias("found"))
        seen = labels.join(found, "node", "left").select("node", F.col("community").alias("old"), F.coalesce("found", "best").alias("best"))
        moves = F.col("best") < F.col("old") if step % 2 == 0 else F.lit(True)
        labels = written(seen.select("node", "old", F.when(moves, F.col("best")).otherwise(F.col("old")).alias("community"), "best"))
        changed = labels.where("old <> community").select(F.col("node").alias("dst"))
        n = changed.count()
        if n == 0:
            break
        # Where no neighbour's label changed, the heaviest one stays as it was.
        asked = None if 2 * n > nodes else written(both.join(changed.hint("shuffle_hash"), "dst", "left_semi").select("src").distinct())
    named = labels.select(F.col("node").alias("id"), "community").join(ids, "id").select("node", F.col("community").alias("id"))
    out = written(named.join(ids.withColumnRenamed("node", "name"), "id").select("node", F.col("name").alias("community")))
    spark.sql(f"DROP TABLE {name}")
    return out


def community_signature(members: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """community, signature over its members (community, node) and, with edges (src, dst, created_at), its newest edge, without gathering them."""
    per = members.groupBy("community").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    if edges is None:
        return per.select("community", F.concat_ws(":", "n", "s").alias("signature"))
    ends = edges.select(F.col("src").alias("node"), "created_at").union(edges.select("dst", "created_at"))
    newest = members.join(ends.groupBy("node").agg(F.max("created_at").alias("at")), "node").groupBy("community").agg(F.max("at").alias("at"))
    return per.join(newest, "community", "left").select("community", F.concat_ws(":", "n", "s", F.col("at").cast("string")).alias("signature"))


def community_diff(old: DataFrame, new: DataFrame, old_edges: DataFrame | None = None, new_edges: DataFrame | None = None) -> DataFrame:
    """community, change: rebuild where the member set is new or other, or, with edges, where a member's newest edge is; drop where it is gone."""
    a, b = community_signature(old, old_edges).withColumnRenamed("signature", "was"), community_signature(new, new_edges)
    change = F.when(F.col("signature").isNull(), "drop").when(~F.col("signature").eqNullSafe(F.col("was")), "rebuild")
    return a.join(b, "community", "full").select("community", change.alias("change")).where("change IS NOT NULL")


def community_facts(members: DataFrame, facts: DataFrame, n: int = 20) -> DataFrame:
    """community, rank, fact_id: the n active facts of a community's members that are most trusted (ties: newest, then id)."""
    rows = facts.where("status = 'active' AND retracted_at IS NULL").join(members.select("community", F.col("node").alias("entity_id")), "entity_id")
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("confidence"), F.desc("valid_from"), "fact_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("community", "rank", "fact_id")


def community_profile(members: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """community, size, label: the name of its member with most edges (ties: the least node)."""
    degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    rows = members.join(degree, "node", "left").join(names, "node", "left")
    top = F.row_number().over(W.partitionBy("community").orderBy(F.desc_nulls_last("degree"), "node"))
    return rows.withColumn("r", top).groupBy("community").agg(F.count("*").alias("size"), F.max(F.when(F.col("r") == 1, F.coalesce("name", "node"))).alias("label"))


def merge_identities(links: DataFrame, hops: int = 32) -> DataFrame:
    """node, survivor, status (merged or cycle): merged_into is followed to its end by doubling; links: node, merged_into."""
    here = written(links.where("node <> merged_into").select("node", F.col("merged_into").alias("at")))
    for _ in range(max(1, hops.bit_length())):
        step = here.select(F.col("node").alias("__n"), F.col("at").alias("__at"))
        after = written(here.join(step, here["at"] == F.col("__n"), "left").select("node", F.coalesce("__at", "at").alias("next"), F.col("__n").isNotNull().alias("moved")))
        here = after.select("node", F.col("next").alias("at"))
        if after.where("moved").isEmpty():
            break
    ends = links.select(F.col("node").alias("__n")).distinct()
    return here.join(ends, here["at"] == ends["__n"], "left").select("node", F.col("at").alias("survivor"), F.when(F.col("__n").isNull(), "merged").otherwise("cycle").alias("status"))


#: New facts of a round of derived_closure that are sent to all tasks at most.
FEW = 100_000


def derived_closure(links: DataFrame, changed: DataFrame) -> DataFrame:
    """fact_id of everything derived, directly or not, from changed facts; links: fact_id, parent. Cycles are fine.

    While few facts are new, a round passes over links as they are. Before the first round of many, links become a table bucketed by
    the parent, so that such rounds shuffle new facts and no links; a bucket is read by one task, row by row.
    """
    start = changed.select("fact_id").distinct()
    spark, path = start.sparkSession, new_path(start)
    start.write.parquet(f"{path}/0")
    seen, turn, name, held = [f"{path}/0"], 0, f"links_{uuid.uuid4().hex}", None
    while True:
        frontier = spark.read.schema(start.schema).parquet(seen[-1]).select(F.col("fact_id").alias("parent"))
        n = frontier.count()
        if n == 0:
            break
        if n > FEW and held is None:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            apart = links.select("fact_id", "parent").repartition(buckets, "parent")
            apart.write.bucketBy(buckets, "parent").sortBy("parent").option("path", new_path(links)).format("parquet").saveAsTable(name)
            held = spark.table(name)
        few = F.broadcast if n <= FEW else lambda df: df
        known = spark.read.schema(start.schema).parquet(*seen)
        reached = (links if held is None else held).join(few(frontier), "parent").select("fact_id").distinct()
        turn += 1
        reached.join(known, "fact_id", "left_anti").write.parquet(f"{path}/{turn}")
        seen.append(f"{path}/{turn}")
    if held is not None:
        spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(start.schema).parquet(*seen[1:]) if seen[1:] else start.limit(0)


def cascade_retract(facts: DataFrame, links: DataFrame, changed: DataFrame, now: Column, reason: str) -> DataFrame:
    """facts with the changed ones and all derived from them retracted."""
    hit = derived_closure(links, changed).union(changed.select("fact_id").distinct()).withColumn("__hit", F.lit(True))
    gone = F.col("__hit") & F.col("retracted_at").isNull()
    return facts.join(hit, "fact_id", "left").withColumn("status", F.when(gone, "retracted").otherwise(F.col("status"))).withColumn("retraction_reason", F.when(gone, reason)).withColumn("retracted_at", F.when(gone, now).otherwise(F.col("retracted_at"))).drop("__hit")


def mark_stale(facts: DataFrame, links: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    hit = derived_closure(links, changed).withColumn("__hit", F.lit(True))
    return facts.join(hit, "fact_id", "left").withColumn("stale_at", F.when(F.col("__hit"), now)).drop("__hit")


def expand_edges(buckets: DataFrame, edges: DataFrame, alpha: float, seeds: int = 3, each: int = 5) -> DataFrame:
    """query_id, entity_id, score: new neighbours of each query's best entities inherit alpha x score x weight, the most of several."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rank_score"), "entity_id"))
    top = buckets.withColumn("r", rank).where(F.col("r") <= seeds).select("query_id", F.col("entity_id").alias("seed"), "rank_score")
    flat = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    reached = top.join(flat, F.col("seed") == F.col("src")).select("query_id", "seed", F.col("dst").alias("entity_id"), (alpha * F.col("rank_score") * F.col("weight")).alias("score"))
    fresh = reached.join(buckets.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
    nth = F.row_number().over(W.partitionBy("query_id", "seed").orderBy(F.desc("score"), "entity_id"))
    return fresh.withColumn("n", nth).where(F.col("n") <= each).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))


def graph_retrieve(names: DataFrame, entities: DataFrame, edges: DataFrame, facts: DataFrame, hints: list[str]) -> DataFrame:
    """query_id, entity_id, fact_id, score: entities named (query_id, name) score 1, neighbours 0.7; hinted facts 1, others 0.5.
    Of a neighbour only hinted facts count; per entity the newest fact of each predicate and object."""
    seed = names.select("query_id", F.lower("name").alias("k")).join(entities.select("entity_id", F.lower("canonical_name").alias("k")), "k").select("query_id", "entity_id", F.lit(1.0).alias("e"))
    flat = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = seed.join(flat, F.col("entity_id") == F.col("src")).select("query_id", F.col("dst").alias("entity_id"), F.lit(0.7).alias("e"))
    nodes = written(seed.union(near).groupBy("query_id", "entity_id").agg(F.max("e").alias("e")))
    # The newest by a fold that needs no order, and only of entities that are reached.
    reached = facts.select("entity_id", "predicate", "object", "valid_from", "fact_id").join(nodes.select("entity_id").distinct(), "entity_id", "left_semi")
    newest = reached.groupBy("entity_id", "predicate", "object").agg(F.max(F.struct("valid_from", "fact_id")).alias("m"))
    latest = newest.select("entity_id", "m.fact_id", F.col("predicate").isin(*hints).alias("hinted"))
    found = nodes.join(latest, "entity_id").where((F.col("e") == 1.0) | F.col("hinted"))
    return found.select("query_id", "entity_id", "fact_id", (F.col("e") * F.when(F.col("hinted"), 1.0).otherwise(0.5)).alias("score"))


def alias_union(candidates: DataFrame) -> DataFrame:
    """candidate_id, root: candidates of one type that share a folded name or canonical are one; root is the least of their names."""
    fold = lambda c: F.concat("type", F.lit("|"), F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "))
    named = candidates.select("candidate_id", fold("name").alias("a"), F.coalesce(fold("canonical"), fold("name")).alias("b"))
    roots = components(named.select("a", "b"))
    return named.join(roots, named["a"] == roots["node"], "left").select("candidate_id", F.coalesce("root", "a").alias("root"))
