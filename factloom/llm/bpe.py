"""BPE encoding and decoding: a transducer lexicon for frequent words, exact merges for the rest.

The words that are frequent in the corpus are compiled into a minimal acyclic automaton: states with
equal futures are shared, and each arc carries how many words it passes by, so the sum along a word's
path is the word's number and gives its ids. The automaton is one file of plain arrays; Spark hands it
to the executors, which memory-map it. All words of a batch walk it at once. Words outside of the
lexicon are merged pair by pair, in the order of the vocabulary's merges, so results don't depend on
the lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from factloom.llm.common import cut, shared_folder

#: Words of the lexicon, which the driver builds within its memory; words remembered by a worker;
#: characters whose words are looked up at once; words counted before a part of the counts is handed on.
LEXICON, REMEMBERED, AT_ONCE, COUNTED = 150_000, 250_000, 1_000_000, 200_000
#: Words of as many bytes at most are merged together, as rows of a matrix.
WIDTHS = (8, 16, 32)
#: The normaliser and pre-tokeniser that Words follows, as vocabulary files state them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _char_class(major: str) -> str:
    """A regular expression's inside of [] for all code points of a Unicode major category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Words:
    """Normal form and words of a text as the vocabulary file asks: NFC, lower case, white space dropped.

    No word goes over a blank, so a text is first split into runs without blanks; runs repeat and are
    looked into once.
    """

    BLANK = "\t-\r \x85\xa0  -     　"

    def __init__(self) -> None:
        letter, number = _char_class("L"), _char_class("N")
        self.find = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{self.BLANK}{letter}{number}]+"
        ).findall
        #: str.split() also splits at these, which are no blanks here.
        self.odd = re.compile("[\x1c-\x1f]").search
        self.blanks = re.compile(f"[{self.BLANK}]+").split

    def runs(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        return [r for r in self.blanks(text) if r] if self.odd(text) else text.split()

    def of_run(self, run: str) -> list[str]:
        return [run] if run.isalpha() else self.find(run)


_WORDS: list[Words] = []


def the_words() -> Words:
    if not _WORDS:
        _WORDS.append(Words())
    return _WORDS[0]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, tokens and merges of a vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, file: str) -> None:
        made = json.loads(file)
        model = made["model"]
        self._check(made)
        self.end = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank of a pair by its two ids in one number; the new id by rank.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.end] for c in letters]
        #: The same for many words at once: pairs in order with their ranks.
        pair = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(pair)
        self.pair, self.rank = pair[order], np.fromiter(self.ranks.values(), np.int64, len(pair))[order]
        self.made_ids, self.inner_ids, self.last_ids = (np.array(x, np.int64) for x in (self.made, self.inner, self.last))
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.decimal = {i: str(i) for t, i in (ids | self.special).items()}
        self.token_of = {self.decimal[i]: t for t, i in (ids | self.special).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _check(made: dict) -> None:
        """Refuses a file whose rules are not those of Words and of merge."""
        model, found = made["model"], []
        found.append((made.get("normalizer") or {}).get("normalizers") == NORMALIZERS)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        found.append(steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True)
        found.append([(s.get("type"), s.get("use_regex"), s.get("add_prefix_space")) for s in steps[1:]] == [("ByteLevel", False, False)])
        found.append(made.get("decoder") is None and model.get("type") == "BPE")
        found.append(not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")))
        found.append(not any(t.get(k) for t in made.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not all(found):
            raise ValueError("the vocabulary file asks for a normaliser, words, merges or a decoder other than those known here")

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all of them not empty: words of like length are merged together, a step at a time."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        least = 0
        for width in WIDTHS:
            mine = np.flatnonzero((lengths > least) & (lengths <= width))
            if len(mine):
                for i, ids in zip(mine.tolist(), self._merge_rows([words[i] for i in mine], lengths[mine], width), strict=True):
                    out[i] = ids
            least = width
        for i in np.flatnonzero(lengths > least).tolist():
            out[i] = self.merge(words[i])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; beyond all ranks where there is none, as where b is -1."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, want), max(0, len(self.pair) - 1))
        return np.where(self.pair[at] == want, self.rank[at], len(self.made)) if len(self.pair) else np.full(want.shape, len(self.made))

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[list[int]]:
        columns = np.arange(width)
        inside = columns < lengths[:, None]
        raw = np.zeros((len(words), width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.inner_ids[raw], -1)
        ends = np.arange(len(words)), lengths - 1
        ids[ends] = self.last_ids[raw[ends]]
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)  # a last column that is never taken
        ranks = np.where(ids[:, 1:] >= 0, self._ranks(ids[:, :-1], ids[:, 1:]), len(self.made))
        out, rows = ids.copy(), np.arange(len(ids))
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of equals
            rank = ranks[np.arange(len(rows)), at]
            going = rank < len(self.made)
            out[rows[~going]] = ids[~going]
            rows, ids, ranks, at, rank = rows[going], ids[going], ranks[going], at[going], rank[going]
            each = np.arange(len(rows))
            later = columns > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[each, at] = self.made_ids[rank]
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            after = ids[each, at + 1]
            ranks[each, at] = np.where(after >= 0, self._ranks(ids[each, at], after), len(self.made))
            left = each[at > 0]
            before = at[left] - 1
            ranks[left, before] = self._ranks(ids[left, before], ids[left, at[left]])
        sizes = (out >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(out.tolist(), sizes, strict=True)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair with the lowest rank is merged first, the leftmost of equals."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [self.made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        after, before, end = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1)), len(ids)
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b != -1 and (rank := self.ranks.get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (rank, a, ids[a], ids[b]))

        for a in range(end):
            offer(a)
        while heap:
            rank, a, x, y = heapq.heappop(heap)
            b = after[a]
            if ids[a] != x or b == -1 or ids[b] != y:
                continue
            ids[a], ids[b] = self.made[rank], -1
            after[a] = after[b]
            if after[b] != -1:
                before[after[b]] = a
            if before[a] != -1:
                offer(before[a])
            offer(a)
        return [i for i in ids if i != -1]

    def decode(self, ids: str) -> str:
        """The text of ids (in decimal, joined by blanks): their tokens joined by blanks, as the library does for a file
        without a decoder; special tokens stay and unknown ids are left out."""
        try:
            return " ".join(map(self.token_of.__getitem__, ids.split()))
        except KeyError:
            return " ".join(self.token_of[i] for i in ids.split() if i in self.token_of)


class Lexicon:
    """Minimal acyclic transducer of words in plain arrays."""

    PARTS = ("keys", "targets", "passed", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Lexicon:
        """words sorted and distinct. States are minimised as soon as no further word can reach them."""
        known: dict[tuple[bool, bytes], int] = {}  # state numbers by (final, arcs), children first; an arc is 5 bytes: letter, state

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            return known.setdefault((final, b"".join(bytes((b,)) + to.to_bytes(4, "little") for b, to in arcs)), len(known))

        path: list[list] = [[False, []]]  # unfinished states along the last word
        last = b""
        for word in [*words, None]:
            common = 0
            if word is not None:
                while common < min(len(word), len(last)) and word[common] == last[common]:
                    common += 1
            while len(path) > common + 1:
                done = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(*done)))
            if word is not None:
                path += [[False, []] for _ in word[common:]]
                path[-1][0] = True
                last = word
        root = settle(*path[0])
        count = array("q", bytes(8 * len(known)))
        keys, targets, passed = array("q"), array("i"), array("i")
        for state, (final, arcs) in enumerate(known):
            so_far = int(final)
            for at in range(0, len(arcs), 5):
                to = int.from_bytes(arcs[at + 1 : at + 5], "little")
                keys.append(state << 8 | arcs[at])
                targets.append(to)
                passed.append(so_far)
                so_far += count[to]
            count[state] = so_far
        final = np.array([f for f, _ in known] + [root], np.int32)
        offsets = np.cumsum([0, *map(len, ids)])
        flat = [i for one in ids for i in one]
        made = (keys, targets, passed, final, offsets, flat)
        return cls({p: np.asarray(a, np.int64 if p == "keys" else np.int32) for p, a in zip(cls.PARTS, made, strict=True)})

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, p) for p in self.PARTS]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        n = len(cls.PARTS)
        sizes, at, arrays = np.memmap(path, np.int64, "r", shape=(n,)), 8 * n, {}
        for part, size in zip(cls.PARTS, sizes, strict=True):
            kind = np.dtype(np.int64 if part == "keys" else np.int32)
            arrays[part] = np.memmap(path, kind, "r", at, (int(size),)) if size else np.zeros(0, kind)
            at += kind.itemsize * int(size)
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1; all words take a step together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths)
        flat, starts = np.frombuffer(b"".join(words), np.uint8), ends - lengths
        state, number = np.full(n, self.final[-1], np.int64), np.zeros(n, np.int64)
        alive, step = np.arange(n), 0
        if not len(self.keys):
            alive = alive[:0]
            number[:] = -1
        while len(alive):
            ended = lengths[alive] == step
            over = alive[ended]
            number[over] = np.where(self.final[state[over]] == 1, number[over], -1)
            alive = alive[~ended]
            want = state[alive] << 8 | flat[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            there = self.keys[arc] == want
            number[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            state[alive] = self.targets[arc]
            number[alive] += self.passed[arc]
            step += 1
        return number

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


class Encoder:
    """Ids of runs: words from the lexicon if there, else merged; the latest are remembered."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon, self.words = vocabulary, lexicon, the_words()
        self.ids: dict[str, str] = {}

    def learn(self, runs: set[str]) -> None:
        new = runs - self.ids.keys()
        if not new:
            return
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = runs
        mixed = {r: self.words.of_run(r) for r in new if not r.isalpha()}
        words = {r for r in new if r.isalpha()}
        words.update(w for parts in mixed.values() for w in parts)
        words = list(words - self.ids.keys())
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        decimal = self.vocabulary.decimal.__getitem__
        numbers = self.lexicon.numbers(raw).tolist()
        unseen = iter(self.vocabulary.merge_all([w for w, number in zip(raw, numbers, strict=True) if number < 0]))
        for word, number in zip(words, numbers, strict=True):
            self.ids[word] = " ".join(map(decimal, self.lexicon.ids_of(number) if number >= 0 else next(unseen)))
        for run, parts in mixed.items():
            if len(parts) != 1:
                self.ids[run] = " ".join(map(self.ids.__getitem__, parts))

    def parts(self, text: str) -> list[list[str] | str]:
        """Lists of runs, and between them special tokens, which are taken from the raw text."""
        if self.vocabulary.split is None or not any(map(text.__contains__, self.vocabulary.special)):
            return [self.words.runs(text)]
        pieces = self.vocabulary.split.split(text)
        return [p if i % 2 else self.words.runs(p) for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[str]:
        """Per text its ids in decimal, joined by blanks."""
        parted = [self.parts(t) for t in texts]
        self.learn({w for parts in parted for p in parts if not isinstance(p, str) for w in p})
        special = self.vocabulary.special
        out = []
        for parts in parted:
            ids = [str(special[p]) if isinstance(p, str) else " ".join(map(self.ids.__getitem__, p)) for p in parts]
            out.append(" ".join(filter(None, ids)))
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts; counts of a part of the rows are summed before the shuffle."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = the_words(), Counter()

        def give() -> pa.RecordBatch:
            counts: Counter[str] = Counter()
            for r, n in runs.items():
                for w in words.of_run(r):
                    counts[w] += n
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=arrow)

        for batch in batches:
            for text in batch.column(0):
                runs.update(words.runs(text.as_py() or ""))
                if len(runs) > COUNTED:
                    yield give()
        yield give()

    return docs.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON) -> Lexicon:
    """The most frequent words of docs, at most `size`: all those from the lowest eighth of a power of two on that fit.

    They are counted in all rows. Which words the lexicon has decides what encoding
    costs and never what it gives. Only the number of words per eighth of a power and the chosen words come to the driver.
    """
    eighth = F.floor(F.log2("n") * 8)
    counts = cut(count_words(docs).where("n > 1 AND word <> ''").withColumn("eighth", eighth))
    least, total = None, 0
    for r in counts.groupBy("eighth").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("eighth")).collect():
        total += r["words"]
        if total > size:
            break
        least = r["eighth"]
    chosen = [] if least is None else counts.where(F.col("eighth") >= least).select("word").collect()
    words = sorted(r["word"].encode() for r in chosen)
    return Lexicon.build(words, vocabulary.merge_all(words))


def share_file(docs: DataFrame, content: bytes) -> str:
    """Write content to the shared folder and have Spark hand it to every executor, later ones too."""
    spark = docs.sparkSession
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(content))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


_ENCODERS: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon_size: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids, for every row of docs.

    A null or empty text has no tokens. Rows may repeat; each is encoded. An empty table gives an empty
    one. Other columns are not read. vocabulary_path is read by the driver only.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        file = f.read()
    mine = docs.select("doc_id", "text")
    name = share_file(docs, compile_lexicon(mine, Vocabulary(file), lexicon_size).to_bytes())
    shared = docs.sparkSession.sparkContext.broadcast(file)
    fields = [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * with_ids)
    arrow = to_arrow_schema(schema)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(Vocabulary(shared.value), Lexicon.mapped(SparkFiles.get(name)))
        encoder = _ENCODERS[name]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < AT_ONCE:
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                made = encoder.encode(texts)
                columns = [
                    batch.column(0).slice(start, at - start),
                    pa.array([ids.count(" ") + 1 if ids else 0 for ids in made], pa.int64()),
                    pa.array(map(sha, made), pa.string()),
                    pa.array((sha(encoder.vocabulary.decode(ids)) for ids in made), pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([np.fromstring(ids, np.int32, sep=" ") for ids in made], arrow.field("ids").type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return mine.mapInArrow(run, schema)
