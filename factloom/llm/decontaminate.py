"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

A document's words run through the automaton; after each word the state stands for the longest
suffix that is a word sequence of some item. A match of `window` words or more, or of a whole
shorter item, is a hit: all its words are marked and the items that hold the window are counted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from factloom.llm.common import cut, word_list

#: Items are joined into automata of about so many characters (near 0.2 GB each); more items make more automata,
#: through which the documents pass one after the other.
MAX_CHARS = 2_000_000


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words = frozenset(w for _, words in items for w in words)
        self.shortest = min((min(len(words), window) for _, words in items if words), default=window)
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.at_window = self._at_windows()
        self.items: list[set[int]] = [set() for _ in self.next]
        self.short: list[dict[int, set[int]]] = [{} for _ in self.next]
        for item, words in items:
            if 0 < len(words) < window:
                self._mark_short(item, words)
            else:
                self._mark_windows(item, words)
        self.up = self._nearest_short()

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the sequence so far and this word, made or split off as needed."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, known: int) -> int:
        """A state for the sequences of `known` that are one word longer than those of `at`, or shorter."""
        part = self._state(self.length[at] + 1)
        self.next[part] = dict(self.next[known])
        self.link[part] = self.link[known]
        self.link[known] = part
        while at != -1 and self.next[at].get(word) == known:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def _at_windows(self) -> list[int]:
        """For each state that stands for `window` words or more, the state of the last `window` of them."""
        at = list(range(len(self.next)))
        for state in sorted(at, key=self.length.__getitem__):
            if state and self.length[self.link[state]] >= self.window:
                at[state] = at[self.link[state]]
        return at

    def _mark_windows(self, item: int | None, words: list[bytes]) -> None:
        state = 0
        for n, word in enumerate(words, 1):
            state = self.next[state][word]
            if n >= self.window and item is not None:
                self.items[self.at_window[state]].add(item)

    def _mark_short(self, item: int | None, words: list[bytes]) -> None:
        state = 0
        for word in words:
            state = self.next[state][word]
        self.short[state].setdefault(len(words), set()).update([] if item is None else [item])

    def _nearest_short(self) -> list[int]:
        """For each state, itself or the nearest state up its links where a whole short item ends; -1: none."""
        up = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            if state:
                up[state] = state if self.short[state] else up[self.link[state]]
        return up

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Marked word intervals [from, to), disjoint and in order, and the items whose windows occur.

        Only runs of words that some item has can hold a match, so the automaton reads just those.
        """
        flags = bytes(map(self.words.__contains__, words))
        spans: list[list[int]] = []
        items: set[int] = set()
        for run in re.finditer(b"\x01{%d,}" % self.shortest, flags):
            state = length = 0
            for at in range(run.start(), run.end()):
                word = words[at]
                step = self.next[state].get(word)
                while step is None and state:
                    state = self.link[state]
                    length = self.length[state]
                    step = self.next[state].get(word)
                if step is None:
                    continue
                state, length = step, length + 1
                if length >= self.window:
                    self._mark(spans, at + 1 - length, at + 1)
                    items |= self.items[self.at_window[state]]
                short = self.up[state]
                while short != -1:
                    for n, which in self.short[short].items():
                        if n <= length:
                            self._mark(spans, at + 1 - n, at + 1)
                            items |= which
                    short = self.up[self.link[short]]
        return spans, items

    @staticmethod
    def _mark(spans: list[list[int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans[-1][0])
            spans.pop()
        spans.append([start, end])


def _item_groups(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct items (item_id, text) in parts of about MAX_CHARS; a single longer item makes its part larger."""
    sized = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = sized.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // MAX_CHARS))
    return [sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else sized for part in range(parts)]


class _Shared:
    """An automaton of some items, broadcast as their words and built once a worker."""

    def __init__(self, items: DataFrame, window: int) -> None:
        group = [(r["item_id"], word_list(r["text"])) for r in items.collect()]
        self.sent, self.name, self.window = items.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex, window

    def get(self) -> ItemAutomaton:
        if self.name not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[self.name] = ItemAutomaton(self.sent.value, self.window)
        return _AUTOMATA[self.name]


FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("spans", ArrayType(ArrayType(IntegerType()))),
        StructField("items", ArrayType(LongType())),
    ]
)

#: The automaton that a worker has built last, by its name.
_AUTOMATA: dict[str, ItemAutomaton] = {}


BODY = [StructField("a", LongType()), StructField("b", LongType())]


def _hits_by_text(docs: DataFrame, groups: list[DataFrame], window: int) -> DataFrame:
    """a, b (a hash of the text of 128 bits), spans and items of the texts that any of the groups hits.

    The groups are taken one after the other; each reads the texts and writes only what it hits.
    """
    texts = docs.select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")
    schema = StructType([*BODY, *FOUND.fields[1:]])
    arrow = to_arrow_schema(schema)
    out = None
    for group in groups:
        shared = _Shared(group, window)

        def run(batches: Iterator[pa.RecordBatch], shared: _Shared = shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.get()
            for batch in batches:
                rows, spans, items = [], [], []
                for i in range(batch.num_rows):
                    s, x = automaton.hits(word_list(batch.column(2)[i].as_py()))
                    if s:
                        rows.append(i)
                        spans.append(s)
                        items.append(sorted(x))
                hit = batch.take(pa.array(rows, pa.int64())).columns[:2]
                yield pa.RecordBatch.from_arrays([*hit, pa.array(spans, arrow.field(2).type), pa.array(items, arrow.field(3).type)], schema=arrow)

        found = cut(texts.mapInArrow(run, schema).dropDuplicates(["a", "b"]))
        shared.sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, cutting: bool = False) -> DataFrame:
    """docs' columns as c0, c1, ... in their order, then n_words, spans (disjoint [from, to) word intervals), items (sorted ids).

    With cutting the text comes without its spans. Items of about MAX_CHARS make one automaton and one pass. More are taken in
    such parts, so that one automaton at a time is in memory; what a part hits is kept by text, and met by the documents at last.
    """
    names, at_text = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    renamed, groups = docs.toDF(*names), _item_groups(benchmark)
    schema = StructType([*renamed.schema.fields, *FOUND.fields])
    arrow = to_arrow_schema(schema)
    shared = _Shared(groups[0], window) if len(groups) == 1 else None
    if shared is None:
        hits = _hits_by_text(docs, groups, window).select(F.struct("a", "b").alias("of"), "spans", "items")
        # On a struct, so that a text with very many copies can be split.
        keyed = renamed.withColumn("of", F.struct(F.xxhash64(names[at_text]).alias("a"), F.xxhash64(F.lit(1), names[at_text]).alias("b")))
        renamed = keyed.join(hits, "of", "left").select(*names, "spans", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items, clean = [], [], [], []
            text = batch.column(at_text)
            for i in range(batch.num_rows):
                mine = text[i].as_py()
                words = word_list(mine)
                if shared is None:
                    s, x = (batch.column(len(names) + k)[i].as_py() or [] for k in (0, 1))
                    s = merged(s)
                else:
                    s, x = shared.get().hits(words)
                n_words.append(len(words))
                spans.append(s)
                items.append(sorted(x))
                if cutting:
                    clean.append(without_spans(mine, s) if s else mine)
            kept = batch.columns[: len(names)]
            if cutting:
                kept[at_text] = pa.array(clean, kept[at_text].type)
            made = [pa.array(v, f.type) for v, f in zip((n_words, spans, items), list(arrow)[-3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return renamed.mapInArrow(run, schema)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids in order of their text), contaminated per row of docs.

    A null text has no words; neither has a null item, which has no window. Items may repeat; each id
    counts once; an item without an id hits words but is not counted. Documents may repeat; each row counts alone. With no items nothing is hit. Other
    columns are not read.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s[1] - s[0]).cast("long"))
    return find_hits(docs.select("doc_id", "text"), benchmark, window).select(
        F.col("c0").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text less the marked words and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5
) -> DataFrame:
    """docs (its columns) with hit spans cut from the texts; a document hit in over max_coverage of its words goes.

    A null text has no words, is hit nowhere and stays null; an empty one stays too. A text of hits alone goes. Rows with
    null or repeated ids are each judged by their own text. A null item has no window. With no items, or an empty table,
    nothing changes. Columns may have any names.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s[1] - s[0]).cast("long"))
    found = find_hits(docs, benchmark, window, cutting=True).where(n_hit <= max_coverage * F.col("n_words"))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
