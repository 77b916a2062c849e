"""Line dedup: which lines of a corpus repeat across documents, as compressed keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, cut

#: [\x20\x09-\x0D]
BLANK = " \t\n\x0b\x0c\r"
#: Slices by document that a hash is dealt in: so many at least, and one for so many lines of the corpus.
SLICES, SLICE_LINES = 32, 1_000_000


def line_index(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, body (a hash of the text), pos, h1, h2 for each line whose key has min_chars code points or more.

    h1 and h2 are 128 bits of the key: the line stripped of blanks at both ends, A-Z in lower case.
    """
    line = docs.select(
        "doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    key = line.select("doc_id", "body", "pos", F.btrim("line", F.lit(BLANK)).alias("key")).where(
        F.char_length("key") >= min_chars
    )
    low = ascii_lower(F.col("key"))
    return key.select("doc_id", "body", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2"))


def first_occurrences(lines: DataFrame, slices: int) -> DataFrame:
    """h1, h2, doc_id: each document's first line of a hash, in a sorted pass over range-partitioned hashes.

    Within a hash the largest doc_id comes first, then position; a row that starts a new document is a first occurrence.
    Hashes are dealt in slices by document, so that a line that a third of all documents hold is spread over many ranges.
    """
    dealt = lines.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("slice"), "doc_id", "pos")
    order = W.partitionBy("h1", "h2", "slice").orderBy(F.desc_nulls_last("doc_id"), "pos")
    passed = dealt.repartitionByRange("h1", "h2", "slice").withColumns(
        {"nth": F.row_number().over(order), "before": F.lag("doc_id").over(order)}
    )
    return passed.where((F.col("nth") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before"))).select("h1", "h2", "doc_id")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, body, words map<int,long>: bit p % 64 of words[p div 64] is set if line p stays.

    Words whose 64 lines all stay are left out, so a document that keeps every line has no row.

    Each range gives one count and one largest document per hash before anything meets by hash alone. Lines
    meet their hash again on one struct column, for which both sides are shuffled, so that Spark can split
    a hash with very many lines.
    """
    lines = cut(line_index(docs, min_chars))
    common = (
        first_occurrences(lines, max(SLICES, lines.count() // SLICE_LINES))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select(F.struct("h1", "h2").alias("key"), "keeper")
    )
    gone = lines.withColumn("key", F.struct("h1", "h2")).join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        gone.groupBy("doc_id", "body", (F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
        .groupBy("doc_id", "body")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("words"))
    )


def dropped_positions(words: Column) -> Column:
    """The line numbers whose bits are not set, ascending."""
    return F.flatten(
        F.transform(
            F.map_entries(words),
            lambda e: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(e["value"], b) == 0),
                lambda b: e["key"] * 64 + b,
            ),
        )
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' columns as c0, c1, ... in their order, then kept (the text without dropped lines), n_lines and n_dropped."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (F.col(names[docs.columns.index(c)]) for c in ("text", "doc_id"))
    lines = F.split(text, "\n", -1)
    joined = docs.toDF(*names).withColumn("mine", F.xxhash64(text)).join(
        bitmaps, doc_id.eqNullSafe(F.col("doc_id")) & (F.col("mine") == F.col("body")), "left"
    )
    gone, whole = dropped_positions(F.col("words")), F.col("words").isNull()
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)
    )
    return joined.select(
        *names,
        F.when(whole, text).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: each text without the lines that repeat in min_docs documents or more.

    Such lines stay only in the largest doc_id that holds them, there each time. A null or empty text
    is one empty line and stays. Rows that share a doc_id are one document in the counts and each lose
    their own lines; a null doc_id is one document below all others. An empty table gives an empty one.
    """
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = apply_bitmaps(mine, keep_bitmaps(mine, min_chars, min_docs))
    return found.select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", "kept")


def without_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs (its columns) with the kept text; a document all of whose lines went stays with an empty text.

    A null text stays null. Nulls, repeated ids and empty tables are as in dedup_lines. Columns may have any names.
    """
    found = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return found.select(*(F.col("kept" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
