"""Resampling, quality rules and source divergence against brute force and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from factloom.llm import divergence, repetition, resampling

DOCS = "doc_id long, text string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "the mit licence and other words " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n\n "), (None, "no id here"), (None, None), (5, "same"), (5, "same"), (5, "other text"), (7, "ä ß Σ İ 漢字 \x00   x"), (8, LONG)]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def made_texts(seed, n, letters="abAé 東.9  "):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_checksums_compose_from_neighbours():
    texts = made_texts(1, 60)
    words = [WORDS.findall(low(t)) for t in texts]
    half = sorted({w for ws in words for w in ws})[::2]
    raw = [low(t).encode().translate(resampling.WORD_BYTES) for t in texts]
    for known in ([], half):
        scan = resampling.Dictionary([w.encode() for w in known]).scan(raw)
        for n, (text, crc) in enumerate(resampling.features(scan, 3), 1):
            want = [(i, zlib.crc32(" ".join(ws[j : j + n]).encode())) for i, ws in enumerate(words) for j in range(len(ws) - n + 1)]
            assert list(zip(text.tolist(), crc.tolist(), strict=True)) == want


def resampled(docs, target, longest, percent, buckets, min_words):
    def runs(text):
        w = WORDS.findall(low(text))
        return w, [zlib.crc32(" ".join(w[j : j + n]).encode()) % buckets for n in range(1, longest + 1) for j in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, enough = [], []
    for i, text in docs:
        w, found = runs(text)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        row = [i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(w) >= min_words:
            enough.append(row)
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k in range(len(enough) * percent // 100):
        enough[k][4] = k + 1
    return sorted(map(str, map(tuple, out)))


def test_resampling_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 7)
    docs = [*ODD, *enumerate(made_texts(2, 90), 100), *((i, "b a b a a b") for i in range(300, 320))]
    target = [*made_texts(3, 5), None, ""]
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    wide = frame.withColumns({c: F.lit(1) for c in ("score", "rank", "part", "n_words", "weight", "bucket")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for longest in (1, 3):
        want = resampled(docs, target, longest, 30, 50, 3)
        for rows in (frame, wide):
            got = resampling.resample(rows, bench, 30, longest, 50, 3)
            assert sorted(str(tuple(r)) for r in got.collect()) == want
    drawn = resampling.drawn_documents(wide, bench, percent=30, min_words=3)
    assert drawn.columns == wide.columns and drawn.count() > 0


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert resampling.resample(none, some).count() == 0
    assert sorted(r.n_features for r in resampling.resample(some, none, min_words=0, percent=100).collect()) == [0, 2]


def windows_twice(words, size):
    places = {}
    for j in range(len(words) - size + 1):
        places.setdefault(tuple(words[j : j + size]), []).append(j)
    return {k for at in places.values() if len(at) > 1 for j in at for k in range(j, j + size)}


def maximal(words, least):
    out = []
    for size in range(least, len(words)):
        places = {}
        for j in range(len(words) - size + 1):
            places.setdefault(tuple(words[j : j + size]), []).append(j)
        for at in places.values():
            before, after = ({words[j + k] if 0 <= j + k < len(words) else None for j in at} for k in (-1, size))
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                out.append((min(at), size, len(at)))
    return sorted(out)


def test_repeats_as_by_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        texts = [" ".join(rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(0, 16))) for _ in range(rng.randint(1, 5))]
        columns = repetition.measures(texts, 2, with_repeats=True)
        for i, text in enumerate(texts):
            words = text.split()
            sizes = [r[1] for r in maximal(words, 2)]
            assert [int(columns[k][i]) for k in (0, 4, 5, 6)] == [len(words), len(windows_twice(words, 3)), len(windows_twice(words, 2)), max(sizes, default=0)]
            assert [tuple(r.values()) for r in columns[7][i]] == maximal(words, 2)


def test_quality_rules(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {
        1: " ".join(words), 2: " ".join(words[:49]), 3: " ".join(words[:20] * 10), 4: " ".join([*words[:300], *words[:60]]), 5: " ".join([*words[:201], "x", *words[:201], *[f"v{i}" for i in range(2000)]]),
        6: " ".join([*words[:200], "x", *words[:200], *[f"v{i}" for i in range(2000)]]), 7: "#a *b\n\n#a *b\n \n#a *b\n<é> " + " ".join(words),
    }
    docs = spark.createDataFrame([*texts.items(), (8, None), (9, ""), (None, texts[1]), (1, texts[1]), (10, "w " * 300_000)], DOCS)
    wide = docs.withColumns({c: F.lit(1) for c in ("kept", "n_words", "c0", "repeats")})
    found = {(r.doc_id, r.n_words): r for r in repetition.quality_rules(wide).collect()}
    assert {i for (i, _), r in found.items() if r.kept} == {1, None, 6, 7}
    assert {i for (i, _), r in found.items() if r.base_failed} == {2, 3, 8, 9, 10}
    row = found[7, 407]
    assert (row.n_symbols, row.n_dup_lines, row.word_chars) == (8, 2, sum(map(len, words)) + 15)
    assert found[10, 300_000].longest_repeat == 299_999
    stay = repetition.keep_unrepetitive(wide)
    assert stay.columns == wide.columns and sorted(str(r.doc_id) for r in stay.collect()) == ["1", "1", "6", "7", "None"]
    assert repetition.quality_rules(docs.limit(0)).count() == 0 and repetition.keep_unrepetitive(wide.limit(0)).count() == 0
    twice = repetition.judged(docs.where("doc_id = 4"), with_repeats=True).first().repeats
    assert [tuple(r) for r in twice] == [(0, 60, 2)]


def diverging(docs, min_docs, top):
    terms = [(lang or "", source or "", Counter(LETTERS.findall(low(text)))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in terms}:
        df, all_ = Counter(), Counter()
        groups = {s: Counter() for g, s, _ in terms if g == lang}
        for g, s, c in terms:
            if g == lang:
                df.update(c.keys())
                all_.update(c)
                groups[s].update(c)
        kept = [t for t, n in df.items() if n >= min_docs]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, by = shares(all_), {s: shares(c) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = [(o, sum(f(by[s][t], by[o][t]) for t in kept)) for o in groups if o != s]
            own = [(t, f(by[s][t], q[t])) for t in kept if c[t] and by[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, t, x, k) for k, (t, x) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(map(str, out))


def test_divergence_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rng = random.Random(6)
    vocab = ["a", "B", "é", "東", "é1x", "Zz", "q-r", "ab"]
    docs = [(" ".join(rng.choices(vocab, k=rng.randint(0, 9))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", None])) for _ in range(80)]
    docs += [(None, "xx", "s1"), ("", "xx", "s2"), ("only once", "yy", "s1"), ("the same " * 5000, "en", "s1"), ("the same", "en", "s1"), ("the same", "en", "s1")]
    frame = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    wide = frame.withColumns({c: F.lit(1) for c in ("term", "n", "total", "item", "p", "value", "rank", "doc_id")})
    for min_docs, top in ((1, 10), (3, 2), (100, 10)):
        want = diverging(docs, min_docs, top)
        for rows in (frame, wide):
            assert sorted(str(tuple(r)) for r in divergence.source_divergence(rows, min_docs, top).collect()) == want
    assert divergence.source_divergence(wide.limit(0)).count() == 0


def test_counts_beyond_longs_times_a_billion(spark):
    row = spark.range(1).select(F.lit(10**15).alias("c"), F.lit(7 * 10**15).alias("n"), F.lit(3 * 10**9).alias("v"))
    assert row.select(divergence.share("c", "n", "v").alias("p")).first().p == 1 + 10**9 * (10**15 + 2) // (7 * 10**15 + 6 * 10**9)
