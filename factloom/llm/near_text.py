"""Near-duplicate groups of texts: SimHash links first, completed by exact Jaccard similarity of word shingles.

Texts with equal sets of shingles are one class. Classes whose SimHash fingerprints are within two bits are found by
multi-index hashing and linked if their whole sets have a similarity of 0.8 or more. What fingerprints miss is found by
prefix filtering: two such sets share a shingle among the first n - ceil(0.8 n) + 1 of each, in any common order of
shingles. The order puts shingles that are frequent in a sample of the texts last; it decides what the search costs and
never what it finds. Of shingles that the very same classes share one is enough. Classes that share a prefix shingle are candidates: first with hubs, of which each is
verified with the likest, which joins dense groups of copies by few links; then all pairs that are not yet in one component and that
sizes, positions and sketches leave possible. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from factloom.llm import simhash
from factloom.llm.common import cut, lean, per_row
from factloom.llm.components import components

SEED = 42
WORDS_EACH = 5
#: Of SAMPLE texts one is counted for the order, and so many shingles at most are known as frequent.
SAMPLE, FREQUENT = 8, 100_000
#: Rounds in which classes meet hubs, the hubs a class is verified with in each, and the sets that a task remembers in order to
#: give a set's shingles once.
ROUNDS, TRIED, SEEN = 1, 3, 200_000
#: Ids of sets that are broadcast at most, to pick their rows and texts without a shuffle of all texts.
FEW = 1_000_000
#: Longs of a sketch: parities of the numbers of shingles by their low bits. Sets differ in as many shingles at least as their sketches in bits.
SKETCH = 8


def shingles_and_fingerprint(text: str | None, words_each: int = WORDS_EACH) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes of the shingles, and the SimHash fingerprint of all shingles; words as in simhash.fingerprint."""
    hashed = simhash.shingle_hashes(text, words_each)
    return np.unique(hashed.view(np.int64)), simhash.majority(hashed)


def shingles(text: str | None, words_each: int = WORDS_EACH) -> np.ndarray:
    """Sorted distinct hashes of the shingles. Fewer words are one shingle, none give none."""
    return np.unique(simhash.shingle_hashes(text, words_each).view(np.int64))


def _sketch(found: np.ndarray) -> list[int]:
    odd = np.bincount(found & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


BRIEF = ["id", "n", *(f"s{i}" for i in range(SKETCH))]
#: A row per document; body is a hash of its text; keys are the prefix shingles in order, those from `known` on are frequent in the sample.
SETS = StructType(
    [StructField(c, LongType()) for c in ["doc_id", "body", *BRIEF, "fp"]] + [StructField("known", IntegerType()), StructField("keys", ArrayType(LongType()))]
)
FOUND = StructType([StructField("id", LongType()), StructField("found", ArrayType(LongType()))])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, the most frequent last."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    each = per_row(some, lambda t: (0, shingles(t)), FOUND).select(F.explode("found").alias("key"))
    counts = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 2"))
    least, held = None, 0
    for texts, keys in sorted(map(tuple, counts.groupBy("texts").count().collect()), reverse=True):
        held += keys
        if held > FREQUENT:
            break
        least = texts
    known = counts.where(F.col("texts") >= least).collect() if least else []
    return np.array([r.key for r in sorted(known, key=lambda r: (r.texts, r.key))], np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """SETS for every row of docs. Of equal sets that a task reads one after the other only the first has keys."""
    last = _frequent(docs)
    by = np.argsort(last)
    sent = docs.sparkSession.sparkContext.broadcast((last[by], by))
    arrow = to_arrow_schema(SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc_id, body, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
                found, fp = shingles_and_fingerprint(text.as_py())
                n, of = len(found), _id(found)
                order, split = found, n
                if of in seen:
                    order = found[:0]
                elif n and len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    ranks = np.where(known[at] == found, rank[at], -1)
                    order, split = found[np.argsort(ranks, kind="stable")], int((ranks < 0).sum())
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(of)
                rows.append((doc_id, body, of, n, *_sketch(found), fp, split, order[: n - -(-4 * n // 5) + 1]))
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("body")).mapInArrow(run, SETS)


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ: so many shingles at least are in one of the sets only."""
    return reduce(add, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v of rows (u, v, text of u, text of v) whose whole sets have a similarity of 0.8 or more."""
    for batch in batches:
        stay = []
        for one, other in zip(batch.column(2), batch.column(3), strict=True):
            x, y = shingles(one.as_py()), shingles(other.as_py())
            shared = len(np.intersect1d(x, y, assume_unique=True))
            stay.append(5 * shared >= 4 * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(stay, pa.bool_()))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, doc_u, doc_v, differ of those pairs (u, v) of sets that sizes and sketches don't rule out.

    Sets of n and m with a similarity of 0.8 or more differ in (n + m) / 9 shingles at most.
    """
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    few = F.broadcast if ids.count() <= FEW else lambda df: df
    owners = sets.join(few(ids), "id", "left_semi").groupBy(*BRIEF).agg(F.min(F.struct("doc_id", "body")).alias("doc"))
    owners = cut(owners.select(F.struct("id").alias("of"), F.struct(*BRIEF).alias("a"), "doc"))
    side = lambda c: owners.select(F.col("of").alias(f"of_{c}"), F.col("a").alias(f"a_{c}"), F.col("doc").alias(f"doc_{c}"))
    both = pairs.withColumns({"of_u": F.struct(F.col("u").alias("id")), "of_v": F.struct(F.col("v").alias("id"))})
    n, m = F.col("a_u.n"), F.col("a_v.n")
    met = both.join(side("u"), "of_u").join(side("v"), "of_v").withColumn("differ", _differing("a_u", "a_v"))
    return met.where((5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * F.col("differ") <= n + m)).select("u", "v", "doc_u", "doc_v", "differ")


def _verified(possible: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (u, v) of _possible whose texts have sets with a Jaccard similarity of 0.8 or more."""
    near = cut(possible.select("u", "v", "doc_u", "doc_v"))
    asked = cut(near.select(F.explode(F.array("doc_u", "doc_v")).alias("doc")).select("doc.*").distinct())
    few = F.broadcast if asked.count() <= FEW else lambda df: df
    some = docs.select("doc_id", "text", F.xxhash64("text").alias("body")).join(few(asked), ["doc_id", "body"], "left_semi")
    texts = cut(some.dropDuplicates(["doc_id", "body"]).select(F.struct("doc_id", "body").alias("doc"), "text"))
    text = lambda c: texts.select(F.col("doc").alias(f"doc_{c}"), F.col("text").alias(f"text_{c}"))
    met = near.join(text("u"), "doc_u").join(text("v"), "doc_v").select("u", "v", "text_u", "text_v")
    return cut(met.mapInArrow(_similar, "u long, v long"))


def _shared(sets: DataFrame) -> DataFrame:
    """key, pos, id, n for each prefix shingle that more than one set may have, with its place in the set's order of n shingles.

    Shingles that the sample knows as frequent are shared; the others meet by key, and none of them is in very many sets.
    """
    rows = sets.select("id", "n", "known", F.posexplode("keys").alias("pos", "key"))
    by_key = W.partitionBy("key")
    rare = rows.where("pos < known").select("key", "pos", "id", "n")
    met = rare.withColumns({"lo": F.min("id").over(by_key), "hi": F.max("id").over(by_key)}).where("lo < hi")
    return met.select("key", "pos", "id", "n").unionByName(rows.where("pos >= known").select("key", "pos", "id", "n")).distinct()


def _one_of_each(held: DataFrame) -> DataFrame:
    """held with one shingle, the first in the common order, of those that the very same sets share.

    Copies share most of their prefix, and each of these shingles would give the same pairs. The first shingle that two sets
    share is the first of its kind: an earlier one that the same sets share would be shared by these two.
    """
    hashed = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    kinds = held.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), hashed(1).alias("a"), hashed(2).alias("b"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("pos", "id").alias("at"))
    firsts = kinds.where("sets > 1").groupBy("sets", "a", "b", "lo", "hi").agg(F.min_by("key", F.struct("at", "key")).alias("key"))
    rows = held.withColumn("of", F.struct("key"))
    return rows.join(firsts.select(F.struct("key").alias("of")), "of", "left_semi").select("key", "pos", "id", "n")


def _rooted(held: DataFrame, links: DataFrame) -> DataFrame:
    """held with root and size of its class's component so far."""
    roots = components(links)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select(F.struct("root").alias("of"), "size")
    sized = roots.withColumn("of", F.struct("root")).join(sizes, "of").select(F.struct(F.col("node").alias("id")).alias("who"), "root", "size")
    joined = held.withColumn("who", F.struct("id")).join(sized, "who", "left")
    return joined.select(F.struct("key").alias("at"), "pos", "id", "n", F.coalesce("root", "id").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes with equal fingerprints (each with the least id) or such within two bits, by multi-index hashing."""
    by_fp = cut(classes.groupBy("fp").agg(F.min("id").alias("id")))
    equal = classes.join(by_fp.select(F.col("fp"), F.col("id").alias("v")), "fp").select(F.col("id").alias("u"), "v").where("u <> v")
    side = lambda c: by_fp.select(F.col("fp").alias(c), F.col("id").alias(f"id_{c}"))
    near = simhash.near_links(by_fp.select("fp")).join(side("u"), "u").join(side("v"), "v")
    return equal.unionByName(near.select(F.greatest("id_u", "id_v").alias("u"), F.least("id_u", "id_v").alias("v")))


def near_links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of sets with a similarity of 0.8 or more."""
    classes = sets.select("id", "fp").distinct()
    links = _verified(_possible(_fingerprint_pairs(cut(classes)), sets), docs)
    held = cut(_one_of_each(cut(_shared(sets))))
    apart = (F.min("root") < F.max("root")).alias("apart")
    for turn in range(ROUNDS):
        rooted = _rooted(held, links)
        # All keys of a dense group prefer its largest component, so that the others flow into it.
        order = F.struct(-F.col("size"), "root", F.xxhash64("id", F.lit(turn)))
        hubs = rooted.groupBy("at").agg(F.min_by(F.struct("id", "root"), order).alias("hub"), apart).where("apart")
        met = rooted.join(hubs, "at").where(F.col("root") != F.col("hub.root"))
        ends = met.select(F.greatest("id", "hub.id").alias("u"), F.least("id", "hub.id").alias("v"), "id").distinct()
        known = cut(_possible(ends.select("u", "v"), sets))
        mine = known.join(ends, ["u", "v"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("differ", "u", "v", "doc_u", "doc_v"))).alias("best"))
        tried = mine.select(F.explode(F.slice("best", 1, TRIED)).alias("b")).select("b.*").distinct()
        links = cut(links.unionByName(_verified(tried, docs)))

    rooted = _rooted(held, links)
    still = rooted.groupBy("at").agg(apart).where("apart").select("at")
    sketches = [f"s{i}" for i in range(SKETCH)]
    brief = sets.select(F.struct("id").alias("who"), F.struct(*sketches).alias("s")).distinct()
    left = cut(rooted.join(still, "at").withColumn("who", F.struct("id")).join(brief, "who").select("at", "pos", "id", "n", "root", "s"))
    other = left.select("at", *(F.col(c).alias(f"{c}_b") for c in ("pos", "id", "n", "root", "s")))
    # At the first shingle that two sets share, no more than what stands from there on can be in both.
    most, both = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")), F.col("n") + F.col("n_b")
    alike = (5 * F.col("n") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n")) & (9 * most >= 4 * both) & (9 * _differing("s", "s_b") <= both)
    across = left.join(other, "at").where((F.col("id") > F.col("id_b")) & (F.col("root") != F.col("root_b")) & alike)
    return links.unionByName(_verified(_possible(across.select(F.col("id").alias("u"), F.col("id_b").alias("v")), sets), docs))


def _led(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, body, who for every row of docs with a doc_id, and who, leader: the least (doc_id, body) of the group of set `who`."""
    docs = docs.where("doc_id IS NOT NULL")
    with lean(docs.sparkSession):
        sets = cut(_sets(docs))
        roots = components(near_links(sets, docs)).select(F.struct(F.col("node").alias("id")).alias("who"), "root")
        firsts = sets.groupBy("id").agg(F.min(F.struct("doc_id", "body")).alias("first")).withColumn("who", F.struct("id"))
        placed = firsts.join(roots, "who", "left").select("who", "first", F.struct(F.coalesce("root", "id").alias("r")).alias("of"))
        leaders = placed.groupBy("of").agg(F.min("first").alias("leader"))
        led = cut(placed.join(leaders, "of").select("who", "leader"))
    return sets.select("doc_id", "body", F.struct("id").alias("who")), led


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text), group_id (the smallest doc_id reachable) for every row of docs with a doc_id, by five-word
    shingles and a similarity of 0.8.

    Texts without words are one group; so are texts with equal sets of shingles. Each row of a repeated id is grouped by its own text. An empty table gives an empty one. Other columns are not read.
    """
    rows, led = _led(docs)
    return rows.join(led, "who").select("doc_id", "body", F.col("leader.doc_id").alias("group_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (its columns) with one document of each group: the one with the smallest doc_id.

    Of equal rows with that id one stays, of unequal texts with that id in one group one too; texts of an id that are in
    groups of their own all stay. Documents without an id stay.
    """
    kept = _led(docs)[1].select("leader.*").distinct()
    hashed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("body"))
    once = hashed.join(kept, ["doc_id", "body"], "left_semi").dropDuplicates(["doc_id", "body"])
    return once.select("row.*").unionByName(docs.where("doc_id IS NULL"))
