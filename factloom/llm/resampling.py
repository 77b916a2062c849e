"""Importance resampling towards a target distribution, with hashed word runs found by an Aho-Corasick dictionary.

The dictionary holds words between their delimiters and carries each one's checksum and length. A scan of many texts at a
time emits these payloads; CRC-32 is linear over GF(2), so the checksum of a run of words is composed from those of
its neighbours without reading the text again. Words outside the dictionary get their payload from their bytes. Buckets of all
features are counted in both tables, weigh the documents, and the highest perturbed weights are drawn.
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import WORD_BYTES, word_list, written

#: Words of the dictionary at most, bytes of each at most, and the rows in which they are counted. They decide what a scan costs
#: and never what it gives.
DICTIONARY, LONGEST, SAMPLE = 50_000, 64, 50_000
#: Bytes of texts that are scanned together (a longer text is scanned alone), and distinct words that a counting task holds.
AT_ONCE, COUNTED = 4_000_000, 500_000
#: Rows to a part of the global order.
PART = 250_000
POLYNOMIAL = 0xEDB88320


@functools.cache
def _shift(k: int) -> np.ndarray:
    """Four tables of 256: what 2**k zero bytes behind a text make of each byte of its checksum."""
    if k == 0:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1)
        tables = np.zeros((4, 256), np.uint32)
        tables[0] = step
        for b in range(1, 4):
            tables[b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * (b - 1))
        return tables
    half = _shift(k - 1)
    return _through(half, half)


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums (uint32) of texts followed by texts, from both checksums and the second ones' lengths in bytes."""
    first, length, k = np.array(first, np.uint32), np.asarray(length, np.int64), 0
    while (length >> k).any():
        odd = np.flatnonzero(length >> k & 1)
        first[odd] = _through(_shift(k), first[odd])
        k += 1
    return first ^ second


class Scan(NamedTuple):
    """Words of some texts: checksum, length in bytes and text of each."""

    crc: np.ndarray
    length: np.ndarray
    text: np.ndarray


class Dictionary:
    """Words with their payloads in an automaton over bytes, each byte as one character."""

    def __init__(self, words: list[bytes]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        self.automaton.make_automaton()
        self.crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))

    def scan(self, texts: list[bytes]) -> Scan:
        """The words of texts (lower-cased, all else blank)."""
        joined = b" " + b"  ".join(texts) + b" "
        blank = np.frombuffer(joined, np.uint8) == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        crc, known = np.zeros(len(starts), np.uint32), np.zeros(len(starts), bool)
        if len(self.crc):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(joined.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, hits[:, 0])
            crc[at], known[at] = self.crc[hits[:, 1]], True
        unseen = np.flatnonzero(~known)
        crc[unseen] = [zlib.crc32(joined[a:b]) for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)]
        of = np.append(0, np.cumsum([len(t) + 2 for t in texts]))
        return Scan(crc, ends - starts, np.searchsorted(of, starts, "right") - 1)


def features(scan: Scan, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, checksum) of all runs of 1, 2, ... longest words of one text, joined by a blank."""
    blank = np.full(len(scan.crc), zlib.crc32(b" "), np.uint32)
    spaced = composed(blank, scan.crc, scan.length)
    run = scan.crc
    for n in range(1, longest + 1):
        if n > 1:
            run = composed(run[:-1], spaced[n - 1 :], scan.length[n - 1 :] + 1)
        whole = scan.text[: len(run)] == scan.text[n - 1 :]
        yield scan.text[: len(run)][whole], run[whole]


def common_words(docs: DataFrame, size: int = DICTIONARY, sample: int = SAMPLE) -> list[bytes]:
    """The `size` most frequent words of at most LONGEST bytes in about `sample` rows, taken by a hash of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                counts.update(w for w in word_list(text.as_py()) if len(w) <= LONGEST)
                if len(counts) > COUNTED:
                    yield give()
        yield give()

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // sample))) == 0)
    counted = some.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


#: The dictionary that a worker has built last, by its name.
_DICTIONARIES: dict[str, Dictionary] = {}


class Features:
    """Scans of tables with one dictionary, which is broadcast: at most DICTIONARY words of at most LONGEST bytes."""

    def __init__(self, docs: DataFrame, words: list[bytes], longest: int, buckets: int) -> None:
        self.words, self.name = docs.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex
        self.longest, self.buckets = longest, buckets

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, int, Scan]]:
        """(from, to, scan) of rows whose texts come to about AT_ONCE bytes."""
        if self.name not in _DICTIONARIES:
            _DICTIONARIES.clear()
            _DICTIONARIES[self.name] = Dictionary(self.words.value)
        at = 0
        while at < len(texts):
            some, size, start = [], 0, at
            while at < len(texts) and size < AT_ONCE:
                some.append((texts[at].as_py() or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES))
                size += len(some[-1])
                at += 1
            yield start, at, _DICTIONARIES[self.name].scan(some)

    def counts(self, texts: DataFrame) -> np.ndarray:
        """How many features of the column `text` fall into each bucket; a task gives one row a bucket."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(self.buckets, np.int64)
            for batch in batches:
                for _, _, scan in self.groups(batch.column(0)):
                    for _, crc in features(scan, self.longest):
                        total += np.bincount(crc % self.buckets, minlength=self.buckets)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

        out = np.zeros(self.buckets, np.int64)
        summed = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        for bucket, n in summed.collect():
            out[bucket] = n
        return out

    def weighed(self, docs: DataFrame, gains: np.ndarray) -> DataFrame:
        """doc_id, n_words, n_features, weight: the sum of the gains of each row's features."""
        sent = docs.sparkSession.sparkContext.broadcast(gains)
        fields = [docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end, scan in self.groups(batch.column(1)):
                    rows = end - start
                    n_features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                    for text, crc in features(scan, self.longest):
                        bounds = np.searchsorted(text, np.arange(rows + 1))
                        so_far = np.append(0, np.cumsum(sent.value[crc % self.buckets]))
                        n_features += np.diff(bounds)
                        weight += np.diff(so_far[bounds])
                    made = [pa.array(a, pa.int64()) for a in (np.bincount(scan.text, minlength=rows), n_features, weight)]
                    ids = batch.column(0).slice(start, rows)
                    yield pa.RecordBatch.from_arrays([ids, *made], names=[f.name for f in fields])

        return docs.select("doc_id", "text").mapInArrow(run, StructType(fields))


def log_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of how much likelier it is in the target, both smoothed by one count a bucket."""
    size, all_target, all_source = len(source), int(target.sum()), int(source.sum())
    ratios = ((float(t + 1) * float(all_source + size)) / (float(s + 1) * float(all_target + size)) for t, s in zip(target.tolist(), source.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def ranked(rows: DataFrame, n_rows: int, most: int, order: list[Column]) -> DataFrame:
    """The n_rows rows with rank (from 1, null beyond `most`) in a global order.

    Parts are ranges of the order, written once with their number; ranks count on from the rows of the parts before.
    Only parts that reach below `most` are ranked.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // PART)
    ordered, _ = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row a part
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ordered.join(F.broadcast(starts), "part")
    rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    drawn = placed.where(F.col("before") < most).withColumn("rank", rank)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    later = placed.where(F.col("before") >= most).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(later).drop("part", "before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20,
    seed: int = 2024, dictionary: int = DICTIONARY,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; the drawn `percent` of those with min_words have ranks.

    A null or empty text has no features and weight 0, and is never drawn while min_words is above 0. Ties of score go to
    smaller ids, a null id last (it is hashed as an empty one). Repeated rows are scored and drawn each for itself; rows
    that share an id share its random number. With an empty target all buckets are smoothed alike; an empty table gives an
    empty one. Other columns are not read. Two scans of docs, one of target; the driver holds `buckets` counts of both.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    using = Features(docs, common_words(docs, dictionary), longest, buckets)
    gains = log_gains(using.counts(target), using.counts(docs))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln(uniform)))
    scored, _ = written(using.weighed(docs, gains).withColumn("score", score))
    enough = scored.where(F.col("n_words") >= min_words)
    n = enough.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    found = ranked(enough, n, n * percent // 100, order).unionByName(rest)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """docs (its columns) of the drawn ids, each row that shares a drawn id; a null id is not looked up. Options as in resample()."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
