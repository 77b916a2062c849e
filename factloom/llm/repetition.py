"""Quality rules with suffix-array repetition: what a text says twice, found exactly and judged by share and length.

The words of some texts at a time become one sequence of numbers, in which each text has numbers of its own and ends in one
that occurs once; so a repeat never leaves its text. Prefix doubling sorts the suffixes and re-sorts only what is still tied.
The ranks of each doubling give the common prefixes of neighbours, whose intervals are the repeated passages: an interval is a
maximal repeat if its occurrences follow different words. Spans of all repeats are united; rules limit their share of the
text and the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

#: A repeat has at least so many words; repeats may cover so many percent of the words and be so many words long.
LEAST, MAX_COVERED, MAX_LONGEST = 10, 30, 200
#: Base rules: the fewest words, and the most percent of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
#: Characters of texts that are sorted together; a longer text is sorted alone.
AT_ONCE = 4_000_000
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


class Repeats(NamedTuple):
    """Of a sequence: suffix order, common prefix of neighbours in it, the longest repeat that starts at each place."""

    order: np.ndarray
    lcp: np.ndarray
    depth: np.ndarray


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place the last one at or before it where new holds."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """ranks[k]: the place of each suffix in order of its first 2**k symbols; equal ranks have these equal.

    The last symbol of a text must occur once in all. In the last ranks no two are equal.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.append(True, symbols[order[1:]] != symbols[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = _starts(new)
    ranks, size = [rank], 1
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        old = rank[tied].astype(np.int64)
        key = old * n + rank[tied + size]
        by = np.argsort(key)
        tied, old, key = tied[by], old[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[tied] = old + _starts(new) - _starts(np.append(True, old[1:] != old[:-1]))
        ranks.append(rank)
        tied = tied[~(new & np.append(new[1:], True))]
        size *= 2
    return ranks


def repeats(symbols: np.ndarray) -> Repeats:
    *ranks, last = suffix_ranks(symbols)
    order = np.empty(len(symbols), np.int64)
    order[last] = np.arange(len(symbols))
    lcp = np.zeros(max(len(symbols) - 1, 0), np.int64)
    if ranks:
        live = np.flatnonzero(ranks[0][order[:-1]] == ranks[0][order[1:]])
        a, b = order[:-1][live], order[1:][live]
        shared = np.zeros(len(live), np.int64)
        for k, rank in reversed(list(enumerate(ranks))):
            shared[rank[a + shared] == rank[b + shared]] += 1 << k
        lcp[live] = shared
    depth = np.zeros(len(symbols), np.int64)
    depth[order] = np.maximum(np.append(0, lcp), np.append(lcp, 0))
    return Repeats(order, lcp, depth)


def maximal_repeats(symbols: np.ndarray, found: Repeats, least: int) -> list[tuple[int, int, int]]:
    """(first place, words, occurrences) of each repeat of `least` words or more that no word more on either side keeps whole."""
    order, lcp = found.order, found.lcp
    before = np.where(order > 0, symbols[order - 1], -1)
    changes = np.append(0, np.cumsum(before[1:] != before[:-1]))
    out: list[tuple[int, int, int]] = []
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([False], long, [False])).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        open_: list[tuple[int, int]] = []  # (words, first place in the order) of intervals not yet closed
        for i, words in enumerate([*lcp[lo:hi].tolist(), 0], lo):
            start = i
            while open_ and open_[-1][0] > words:
                length, start = open_.pop()
                if changes[i] > changes[start]:
                    out.append((int(order[start : i + 1].min()), length, i + 1 - start))
            if words and (not open_ or open_[-1][0] < words):
                open_.append((words, start))
    return out


def covered(depth: np.ndarray, least: int, words: int | None = None) -> np.ndarray:
    """Where a repeat of `least` words or more lies; of each that starts somewhere, whole or only the first `words`."""
    at = np.flatnonzero(depth >= least)
    size = len(depth) + 1
    ends = at + (depth[at] if words is None else words)
    return np.cumsum(np.bincount(at, minlength=size) - np.bincount(ends, minlength=size))[:-1] > 0


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as symbols, each text closed by one of its own, and the place where each text starts."""
    known: dict[bytes, int] = {}
    each = [[known.setdefault(w, len(known)) for w in t.encode("utf-8", "surrogatepass").split()] for t in texts]
    sizes = np.fromiter((len(e) + 1 for e in each), np.int64, len(each))
    starts = np.append(0, np.cumsum(sizes))
    symbols = np.full(starts[-1], len(known), np.int64)
    for at, one in zip(starts.tolist(), each, strict=False):
        symbols[at : at + len(one)] = one
    return symbols + np.repeat(np.arange(len(each)), sizes) * (len(known) + 1), starts


def measures(texts: list[str], least: int, with_repeats: bool = False) -> list[list]:
    """Columns of MEASURES (and a list of maximal repeats) for the texts."""
    symbols, starts = _numbered(texts)
    found = repeats(symbols)
    at = starts[:-1]
    sums = lambda mask: np.add.reduceat(mask.astype(np.int64), at)
    lines = [[line for line in t.split("\n") if line.strip(WHITE)] for t in texts]
    columns = [
        np.diff(starts) - 1,
        [len(t) - sum(map(t.count, WHITE)) for t in texts],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        [len(one) - len(set(one)) for one in lines],
        sums(covered(found.depth, WINDOW, WINDOW)),
        sums(covered(found.depth, least)),
        np.where((deepest := np.maximum.reduceat(found.depth, at)) >= least, deepest, 0),
    ]
    if with_repeats:
        by_text: list[list[dict]] = [[] for _ in texts]
        for first, words, times in sorted(maximal_repeats(symbols, found, least)):
            text = int(np.searchsorted(starts, first, "right")) - 1
            by_text[text].append({"start": first - int(starts[text]), "words": words, "times": times})
        columns.append(by_text)
    return columns


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
REPEAT = StructType([StructField(c, LongType()) for c in ("start", "words", "times")])


def judged(
    docs: DataFrame, least: int = LEAST, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, with_repeats: bool = False
) -> DataFrame:
    """docs' columns as c0, c1, ... in their order, then MEASURES, base_failed, kept, and with with_repeats the list of repeats.

    repeats: (start, words, times) of each maximal repeat of `least` words or more, start being its first word's place.
    """
    at_text = docs.columns.index("text")
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    more = [StructField(c, LongType()) for c in MEASURES] + [StructField(c, BooleanType()) for c in ("base_failed", "kept")]
    schema = StructType(renamed.schema.fields + more + [StructField("repeats", ArrayType(REPEAT))] * with_repeats)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < AT_ONCE:
                    texts.append(batch.column(at_text)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                columns = measures(texts, least, with_repeats)
                n, _, _, _, repeated, inside, longest = map(np.asarray, columns[: len(MEASURES)])
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
                kept = ~failed & (100 * inside <= max_covered * n) & (longest <= max_longest)
                columns[len(MEASURES) : len(MEASURES)] = [failed, kept]
                mine = batch.slice(start, at - start).columns
                types = [f.type for f in list(arrow)[len(mine) :]]
                made = [pa.array(v, t) for v, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*mine, *made], schema=arrow)

    return renamed.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, MEASURES, base_failed and kept for every row of docs; limits as in judged().

    n_covered_words are words in repeats of `least` words or more, longest_repeat is the longest one's words (0: none).
    A null or empty text has no words and fails by MIN_WORDS. A row's verdict is of its own text alone, so repeated rows
    and ids, null ids included, get equal verdicts. An empty table gives an empty one. Other columns are not read.
    A text is sorted whole, however long; a worker holds the ranks of its doublings, 4 bytes a word each.
    """
    found = judged(docs.select("doc_id", "text"), **limits)
    return found.select(F.col("c0").alias("doc_id"), *MEASURES, "base_failed", "kept")


def keep_unrepetitive(docs: DataFrame, **limits: int) -> DataFrame:
    """docs (its columns, under any names) less the rows that quality_rules does not keep; nulls and repeats as there."""
    found = judged(docs, **limits).where("kept")
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
