"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint has two segments of 32 bits, each with a table of its own. A fingerprint stands in a table's bucket of
its segment and enumerates the small Hamming balls within segments to find others; what it meets is verified on the whole
distance. So that a dense group of near copies, which shares a segment, makes no hot bucket, each bucket is split by the same
principle on 16-bit parts of the other segment, with the distance that is left there.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import cut, per_row
from factloom.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 65_536


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """Hashes of all shingles of words_each words, repeats included; fewer words are one shingle, none give none.

    Words are runs without blanks [\\x20\\x09-\\x0D] after A-Z are lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashed = xxhash.xxh64_intdigest
    ends = starts[words_each:] or starts[-1:]
    return np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64)  # noqa: B905


def majority(hashed: np.ndarray) -> int:
    """The SimHash of shingle hashes as a signed long: bits that are set in over half of them; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashed), CHUNK):
        bits = np.unpackbits(hashed[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The 64-bit SimHash of a text's shingles, as a signed long."""
    return majority(shingle_hashes(text, words_each))


FINGERPRINTS = StructType([StructField("doc_id", LongType()), StructField("fp", LongType())])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    return per_row(docs.select("doc_id", "text"), lambda i, t: (i, fingerprint(t, words_each)), FINGERPRINTS)


#: Segments of 32 bits, and the two parts of 16 bits of each.
SEGMENTS, PARTS = (0, 32), (0, 16)


def _bucket(segment: int, part: int, fp: str) -> str:
    """The table's key: a whole segment and a part of the other one as they stand in fp, and where the part stands in two free bits."""
    other = 32 - segment + part
    tag = 2 * (segment == 32) + (part == 16)
    whole, half = f"shiftrightunsigned({fp}, {segment}) & 4294967295L", f"shiftrightunsigned({fp}, {other}) & 65535L"
    return f"(shiftleft({whole}, 18) | shiftleft({half}, 2) | {tag}L)"


def _flipped(at: int, width: int, segment: int, part: int) -> str:
    """Keys of fp with each of its zero bits [at, at + width) set: of two values that differ there, one meets the other so."""
    ones = f"filter(sequence({at}, {at + width - 1}), b -> getbit(fp, b) = 0)"
    return f"transform({ones}, b -> {_bucket(segment, part, '(fp | shiftleft(1L, b))')})"


def table_keys() -> str:
    """The four keys under which a fingerprint stands in the tables."""
    return f"array({', '.join(_bucket(s, p, 'fp') for s in SEGMENTS for p in PARTS)})"


def probe_keys() -> str:
    """The keys at which a fingerprint looks for others within two bits: balls of radius 1 in one segment or in a part of the other.

    Of two segments one differs in a bit at most. If the low one is equal, up to two bits are left to the high one, of
    whose two parts one differs in a bit at most; if it differs in one bit, one is left and a part is equal. If the low one
    differs in two bits, the high one is equal, and a part of the low one differs in one bit at most.
    """
    low, high = SEGMENTS
    balls = [table_keys()]
    balls += [_flipped(high + p, 16, low, p) for p in PARTS]  # the low segment equal, a part of the high one off by a bit
    balls += [_flipped(low, 32, low, p) for p in PARTS]  # the low segment off by a bit, a part of the high one equal
    balls += [_flipped(low + p, 16, high, p) for p in PARTS]  # the high segment equal, a part of the low one off by a bit
    return f"concat({', '.join(balls)})"


def near_links(fps: DataFrame) -> DataFrame:
    """All pairs (u, v) of fingerprints within two bits, u > v; fps has distinct fp.

    A probe meets what stands in its bucket, and whole distances are verified where they meet. Keys are structs, for which
    both sides are shuffled, so that Spark can split a bucket that is hot nevertheless.
    """
    key = lambda keys: F.explode(F.expr(keys)).alias("key")
    probes = fps.select(F.col("fp").alias("u"), key(probe_keys())).select("u", F.struct("key").alias("at"))
    table = fps.select(F.col("fp").alias("v"), key(table_keys())).select("v", F.struct("key").alias("at"))
    near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    return probes.join(table, "at").where(near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id (the smallest doc_id reachable) for every row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id are
    linked too but never name a component, unless it has no other rows: then component_id is null.
    Repeated rows keep one row each. An empty table gives an empty one. Other columns are not read.
    """
    rows = cut(fingerprints(docs, words_each))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(classes.select("fp")))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.struct(F.coalesce("root", "fp").alias("fp")).alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id")).select(
        F.struct("root").alias("of"), "component_id"
    )
    by_fp = placed.withColumn("of", F.struct("root")).join(named, "of").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
