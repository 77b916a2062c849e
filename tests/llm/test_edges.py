"""Edge cases of the corpus operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, html_extract, license_scan, line_dedup, quality, sharding, simhash, topk, url_filter

DOCS = "doc_id long, text string"
LONG = "the mit licence and other words " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n\n "), (None, "no id here"), (None, None), (5, "same"), (5, "same"), (5, "other text"), (7, "ä ß Σ İ 漢字 \x00 \u2028 x"), (8, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_stages_keep_documents_with_any_columns(spark, rows):
    """keep_good, decontaminate, without_common_lines and near_text.keep_one on odd rows: nulls, repeats, long texts, names that they use themselves."""
    from factloom.llm import near_text

    long = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
    odd = [(1, None), (2, ""), (None, "no id here"), (None, None), (5, "same words"), (5, "same words"), (7, long), (8, "a line that many documents hold, indeed\nown"), (9, "a line that many documents hold, indeed"), (10, "A line that many documents hold, indeed ")]
    extra = "n_words spans items kept words body mine c0 c1 keeper key h1 h2 slice fp keys known id root score x label row".split()
    docs = spark.createDataFrame(odd, DOCS)
    wide = docs.withColumns({c: F.lit(1) for c in extra}).select(*extra[:5], "text", *extra[5:], "doc_id")
    bench = spark.createDataFrame([(1, "no id here"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 5, 7, 8, 9, 10)], "doc_id long, quality int")
    stages = {
        "quality": lambda d: quality.keep_good(d, labels),
        "lines": lambda d: line_dedup.without_common_lines(d),
        "near": near_text.keep_one,
        "decontamination": lambda d: decontaminate.decontaminate(d, bench),
    }
    for name, stage in stages.items():
        made = stage(wide)
        assert made.columns == wide.columns, name
        got = rows(made.select("doc_id", "text"))
        assert got == rows(stage(docs).select("doc_id", "text")), name
        if name == "quality":
            assert len(got) == len(odd)
        if name == "lines":
            assert [t for i, t in got if i in (8, 9, 10)] == ["A line that many documents hold, indeed ", "own", ""] or {t for i, t in got if i in (8, 9, 10)} == {"own", "", odd[-1][1]}
            assert (1, None) in got and len(got) == len(odd)
        if name == "near":
            assert len([1 for i, _ in got if i == 5]) == 1 and len([1 for i, _ in got if i is None]) == 2
        if name == "decontamination":
            assert (1, None) in got and (None, "no id here") not in got and (None, None) in got
        assert stage(wide.limit(0)).count() == 0


def test_line_hashes_are_passed_in_order(spark):
    lines = line_dedup.line_index(spark.createDataFrame(ODD, DOCS), 1)
    plan = line_dedup.first_occurrences(lines, 4)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Window" in plan and "hashpartitioning" not in plan and plan.index("Window") < plan.index("Sort ") < plan.index("rangepartitioning")


@pytest.fixture(scope="module")
def wide(odd):
    """Columns named like those that operators make."""
    extra = "shard slot size bucket word body kept h1 key fp hub score label x spans items n_words ids words page_id host rank v cell".split()
    return odd.withColumns({c: F.lit(1) for c in extra})


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


RUNS = {
    "licenses": lambda d, s: license_scan.scan_licenses(d),
    "bpe": lambda d, s: bpe.encode_documents(d, public_tokenizers.path("word_bpe_49k.json"), 50),
    "decontamination": lambda d, s: decontaminate.contamination(d, s.createDataFrame([(1, "no id here"), (2, None), (3, "")], "item_id long, text string")),
    "quality": lambda d, s: quality.score_quality(d, s.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1)], "doc_id long, quality int")),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "sharding": lambda d, s: sharding.shard_documents(d),
    "lines": lambda d, s: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_gets_one_row(spark, rows, odd, wide, name):
    plain = rows(RUNS[name](odd, spark))
    assert len(plain) == len(ODD)
    assert rows(RUNS[name](wide, spark)) == plain


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_gives_empty_table(spark, name):
    assert RUNS[name](spark.createDataFrame([], DOCS), spark).count() == 0


def test_sharding_law(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 7) AS text").union(spark.createDataFrame([(9, "dup"), (9, "dup"), (None, None)], DOCS))
    out = sharding.shard_documents(docs).collect()
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    assert 150 < sum(r.grown_shard == 8 for r in out) < 550 and min(sum(r.shard == s for r in out) for s in range(8)) > 250
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(1, 0)}
    assert all(r.text_crc32 == zlib.crc32(f"t{r.doc_id % 7}".encode()) for r in out if r.doc_id not in (None, 9))
    assert len({r.shard for r in out if r.doc_id == 9}) == 1


@pytest.mark.parametrize("n", [1, 3, 8, 11])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    tree = sharding.default_tree(n)
    for _ in range(2):
        a, b = (sharding.place(F.col("id"), t) for t in (tree, sharding.grow(tree)))
        assert spark.range(400).where((a != b) & (b != len(tree))).count() == 0
        tree = sharding.grow(tree)


def test_a_new_weight_moves_only_rows_of_its_subtree(spark):
    tree = sharding.default_tree(8)
    heavier = [(*leaf[:3], 3.0 if leaf[2] == 1 else 1.0) for leaf in tree]
    a, b = (sharding.place(F.col("id"), t) for t in (tree, heavier))
    moved = spark.range(2000).select(a.alias("a"), b.alias("b")).where("a <> b")
    assert moved.where("b >= 4").count() == 0 and moved.where("b < 2").count() > 0


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["A line that is long enough to count", " a LINE that is long enough to count\t", "short", "", "ÉCOLE line with accents, long enough", "école line with accents, long enough", "another quite long line of text here"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(None, pool[0]), (50, None), (39, pool[0])]
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(low(line), set()).add(i)
    gone = {k: max(x for x in ids if x is not None) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3}
    want = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x) not in gone or gone[low(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    pool = list("abcXYZ'sst dl  \t\n\x85\xa0 ΣσςİıÄéß漢한12½²!?.,-_$😀́‍\x1c\x00Ω") + ["<|endoftext|>", "<|startoftext|>", "'re", "n't", "I'VE"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["a" * 3000, "!?" * 500, "ab" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    vocabulary = bpe.Vocabulary(open(path, encoding="utf-8").read())
    for r in bpe.encode_documents(docs, path, 40, with_ids=True).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded), ids)
        assert vocabulary.decode(" ".join(map(str, ids))) == decoded


def test_lexicon_numbers_words_and_knows_no_others():
    listed = sorted({b"a", b"ab", b"abc", b"b", b"tap", b"taps", b"top", b"tops"})
    made = bpe.Lexicon.build(listed, [[i, i + 1] for i in range(len(listed))])
    assert made.numbers(listed).tolist() == list(range(len(listed)))
    assert set(made.numbers([b"", b"t", b"ta", b"tapsx", b"z"]).tolist()) == {-1}
    assert made.ids_of(3) == [3, 4]
    assert len(made.final) - 1 < sum(map(len, listed))
    assert bpe.Lexicon.build([], []).numbers([b"a"]).tolist() == [-1]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(6)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 6, 12, 15]))) for i in range(4, 9)] + [(20, None), (21, ""), (4, say(11)), (None, say(10))]
    docs = [(i, say(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "")) for i in range(60)]
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(i)
    want = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for window, ids in windows.items():
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found |= ids - {None}
        want[i] = (len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.contamination(spark.createDataFrame(docs, DOCS), bench).collect():
        assert tuple(r)[1:] == want[r.doc_id]


def test_decontamination_in_parts_gives_the_same(spark, monkeypatch, rows):
    items = spark.createDataFrame([(i, f"alpha beta w{i} gamma delta") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x alpha beta w{i} gamma delta y alpha beta w{i + 1} gamma delta") for i in range(9)], DOCS)
    whole = rows(decontaminate.contamination(docs, items))
    monkeypatch.setattr(decontaminate, "MAX_CHARS", 60)
    assert rows(decontaminate.contamination(docs, items)) == whole


def test_spans_are_cut_and_covered_documents_go(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    text = "Keep this. One two, three four five six seven eight nine TEN! " + "and more words stay here as well, " * 3
    docs = spark.createDataFrame([(1, text), (2, "one two three four five six seven eight nine ten."), (3, None)], DOCS)
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {1: text.replace("One two, three four five six seven eight nine TEN", ""), 3: None}


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_simhash_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.choice(["ka", "Lo", "mi", "no", "ru"]) + str(rng.randint(0, 9)) for _ in range(300)]
    docs = []
    for i in range(120):
        copy = base.copy()
        for _ in range(i % 4):
            copy[rng.randrange(300)] = "x"
        docs.append((i, " ".join(copy)))
    docs += [(200, None), (201, ""), (202, "one"), (203, "one two"), (None, docs[0][1]), (204, "  A\tb\x0bC d ")]
    fp = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == {(k, fp[i], least[find(i)]) for i, (k, _) in enumerate(docs)}


def test_topk_ties_nulls_and_lengths(spark):
    rng = random.Random(4)
    vecs = [(i, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(9)]) for i in range(200)]
    vecs += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 9), (303, [float("inf")] * 9), (None, [1.0] * 9), (304, []), (305, [1.0]), (40, vecs[40][1])]
    rows = [(i, [int(64 * x // 1) for x in v]) for i, v in vecs if i is not None and i not in (300, 301, 302, 303)]
    good = dict(rows)
    out = topk.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)), F.col("vec_id") % 20 == 0).collect()
    for q in (i for i in good if i % 20 == 0):
        want = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in rows if i != q)[:20]  # noqa: B905
        assert [(-r.score, r.vec_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_topk_of_scores_below_zero(spark):
    rng = random.Random(8)
    vecs = [(0, [-40.0] * 12)] + [(i, [rng.uniform(30, 31) for _ in range(12)]) for i in range(1, 900)]
    out = topk.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    score = lambda v: sum(-2560 * int(64 * x // 1) for x in v)
    assert [(r.vec_id, r.score) for r in out] == sorted(((i, score(v)) for i, v in vecs if i), key=lambda x: (-x[1], x[0]))[:20]


def test_topk_large_numbers_stay_exact(spark):
    vecs = [(i, [float(2**20 + i), float(2**21 - i)]) for i in range(40)]
    out = topk.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3, 2**10).orderBy("rank").collect()
    dot = lambda i: sum(int(a) * int(b) * 2**20 for a, b in zip(vecs[0][1], vecs[i][1], strict=True))
    assert [(r.vec_id, r.score) for r in out] == [(i, dot(i)) for i in sorted(range(1, 40), key=lambda i: (-dot(i), i))[:3]]


def test_license_base_places():
    text = "Under the MIT License! x under the mit-license; CC BY NC, cc by ncx Apache License, Version 2.0 und(er) the mit license"
    row = license_scan.scan_text(1, text)
    assert row[1:6] == (len(words(text)), 4, 0, 15, "apache-2,cc-by-nc,mit")
    assert 0 < row[7] <= 1
    assert license_scan.scan_text(1, None) == (1, 0, 0, None, None, "", "", 0.0)


def test_license_rules_suppress_contained_places():
    found = license_scan.detections(words_b("released under the apache license version 2 0 and all rights reserved"))
    assert [f[2] for f in found] == ["apache-2", "all-rights-reserved"]
    assert sum(map(len, license_scan.rules().values())) > 200
    assert len(license_scan.detections(words_b("gpl 3 licensed work " * 3000))) == 3000


def test_license_gates_lose_no_place(monkeypatch):
    rng = random.Random(9)
    names = [f"{a}gpl{b}{c}" for a in ("", "l", "a") for b in ("", " ", "v", "v ", " v", " v ", " version ", " version") for c in ("1", "1 0", "2", "2 1", "3", "3 0")]
    names += "expat,mit,freebsd,simplified bsd,gnu general public license v3,affero general public license 3,openrail m,cc0 1 0,cc by 4 0".split(",")
    texts = [f"licensed under the {n}" for n in names] + [f"{n} license" for n in names] + [f"x\u00a0{n}\u00a0license" for n in names]
    texts += ["permission is hereby granted free of charge to any person obtaining a copy", "without warranties of any kind", "without warranty of any kind", "all rights reserved"]
    texts += [" ".join(rng.choices(texts, k=5)) for _ in range(100)]
    gated = [license_scan.detections(words_b(t)) for t in texts]
    for text, label in (("licensed under the gplv3", "gpl-3.0"), ("lgplv3 license", "lgpl-3.0"), ("agplv3 license", "agpl-3.0"), ("gpl2 license", "gpl-2.0"), ("freebsd license", "bsd-2-clause"), ("expat license", "mit")):
        assert [f[2] for f in license_scan.detections(words_b(text))] == [label]
    monkeypatch.setattr(license_scan, "gates", lambda text: set(license_scan.rules()))
    assert [license_scan.detections(words_b(t)) for t in texts] == gated


def example(pattern, rng):
    """A random text that a rule's pattern matches."""
    import re._constants as c
    import re._parser as parser

    def made(parsed):
        out = ""
        for kind, value in parsed:
            if kind is c.LITERAL:
                out += chr(value)
            elif kind is c.IN:
                kind, value = rng.choice(value)
                out += {c.LITERAL: lambda: chr(value), c.RANGE: lambda: chr(rng.randint(*value)), c.CATEGORY: lambda: "word"}[kind]()
            elif kind is c.BRANCH:
                out += made(rng.choice(value[1]))
            elif kind is c.SUBPATTERN:
                out += made(value[3])
            elif kind in (c.MAX_REPEAT, c.MIN_REPEAT):
                least, most, inner = value
                out += "".join(made(inner) for _ in range(rng.randint(least, min(most, least + 1))))
            elif kind not in (c.ASSERT_NOT,):
                raise ValueError(kind)
        return out

    return made(parser.parse(pattern))


def test_every_license_rule_is_found_through_its_gate():
    rng = random.Random(12)
    every = {id(r): r for held in license_scan.rules().values() for r in held}.values()
    assert len(license_scan.SINGLES) > 100 and len(every) > 400
    for rule in every:
        for _ in range(12):
            text = example(rule.pattern.pattern, rng)
            assert rule.pattern.fullmatch(text), (rule, text)
            assert license_scan.gates(text) & set(rule.keywords.split()), (rule, text)
    assert license_scan.detections(words_b("nothing is said about the terms of use of gnu software or of php and ruby here")) == []


def test_plain_names_of_licenses():
    for text, label in (("released under the expat license", "mit"), ("licensed under gplv2", "gpl-2.0"), ("licensed under the bsd license", "bsd-unspecified"), ("gnu general public license v3", "gpl-3.0"),
                        ("apache 2 0", "apache-2"), ("opensource org licenses mit", "mit"), ("tous droits réservés", "all-rights-reserved"), ("spdx license identifier mpl 2 0", "mpl-2.0")):
        assert [f[2] for f in license_scan.detections(words_b(text))] == [label], text


def test_license_base_columns_by_brute_force(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in license_scan.scan_licenses(docs).collect()}
    for d in docs.collect():
        w, places = words(d.text), []
        for phrase, label in license_scan.BASE.items():
            want = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(want)] == want]
        starts = [i for i, _ in places]
        assert got[d.doc_id] == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def words_b(text):
    return text.encode().split()


def test_url_rules_and_globs_against_plain_matching(spark):
    import fnmatch

    rng = random.Random(6)
    hosts = ["example.org", "www.Example.ORG", "xexample.org", "a.com", "com", "spam-x.net", "ads.foo.net", "b.ads.net", "foo.net", ""]
    paths = ["/es/1", "/en/1", "/en/2", "/fr/", "/de/x", "/a.jpg", "", "/login", "/x/.example.org/es/", "/spam"]
    urls = [f"{rng.choice(['http://', 'https://', ''])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#top'])}" for _ in range(400)] + [None, "", "://", "a://b://c/d", "x" * 5000]
    for url, (host, path, rule, verdict) in zip(urls, url_filter.UrlRules(url_filter.SITE_RULES, url_filter.BLOCK_GLOBS).judge(urls), strict=True):
        assert (host, path) == url_filter.split_url(url)
        fit = [(h + p, v) for h, p, v in url_filter.SITE_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        want = max(fit, key=lambda f: len(f[0])) if fit else (None, "block" if any(fnmatch.fnmatchcase(host + path, g) for g in url_filter.BLOCK_GLOBS) else "allow")
        assert (rule, verdict) == want, url
    pages = spark.createDataFrame([(1, None), (1, "http://a.org/x"), (None, "")], "page_id long, url string").withColumn("host", F.lit(1))
    assert url_filter.judge_urls(pages).count() == 3
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_one_very_long_url_in_a_full_batch():
    urls = [f"http://a{i}.net/x{i}.jpg" for i in range(10_000)] + ["http://b.net/" + "y" * 1_000_000 + "casino"]
    made = url_filter.UrlRules(url_filter.SITE_RULES, url_filter.BLOCK_GLOBS).judge(urls)
    assert {verdict for *_, verdict in made} == {"block"} and len(made) == len(urls)


def test_html_of_open_quotes_has_no_markup():
    texts = [p for n in html_extract.read_page('<p class="x>Hello</p><p>there</p>') for p in n.parts if isinstance(p, str)]
    assert texts == ["Hello", "there"]


def article_by_hand(page):
    """The text of pages whose main part is one article, by plain replacing."""
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<br>", " ", re.sub(r"<!--.*?-->", "", inner, flags=re.S))
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", inner)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(filter(None, blocks))


def test_html_finds_the_article_with_and_without_names(spark):
    """Every article is found whole where pages name their roles; without any names nearly all characters and few others."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: article_by_hand(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.99 * len(want)
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer)\\b", "<$1div"), ' class="[^"]*"', "")
    blocks = [(set(t.split("\n")), set(want[i].split("\n"))) for i, t in ((r.page_id, r.text) for r in html_extract.extract_text(pages.withColumn("html", bare)).collect())]
    size = lambda parts: sum(map(len, parts))
    both = sum(size(a & b) for a, b in blocks)
    assert both >= 0.9 * sum(size(b) for _, b in blocks) and both >= 0.9 * sum(size(a) for a, _ in blocks)


def test_html_pages(spark):
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head&amp;line</h1><p>First  para,\n with words.<p>Second <b>one</b>.<br>More</article><div class='comments'><p>Nice!</p></div><footer>&copy; x</footer><script>var a='<p>';</script>"
    pages = [(i, "u", page) for i in range(30)] + [(None, None, None), (50, "u", ""), (51, "u", "<p>cut <b"), (50, "u", page)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("x", F.lit(1))
    out = html_extract.extract_text(table).collect()
    want = "Head&line\nFirst para, with words.\nSecond one. More"
    assert len(out) == len(pages) and sum(r.text == want and r.n_chars == len(want) for r in out) == 31
    assert {r.text for r in out if r.page_id is None} == {""}
    assert html_extract.extract_text(table.limit(0)).count() == 0


def test_html_decoding_never_contradicts():
    nodes = html_extract.read_page("<div><p>aaaa aaaa</p><div><p>bbbb bbbb</p></div></div>" * 3)
    rng = random.Random(0)
    for _ in range(200):
        kept = html_extract.choose(nodes, [rng.uniform(-3, 3) for _ in nodes])
        assert all(id(n.up) in kept for n in nodes if id(n) in kept and n.up)


def test_quality_learns_and_hides_held_out_rows(spark):
    docs = [(i, ("word " * 3 + f"thing{i} said. ") * 20 if i % 3 else "BUY!! NOW!! ### $$$ " * 30) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    table = spark.createDataFrame(docs, DOCS)
    out = quality.score_quality(table, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.doc_id % 3 > 0) == int(r.score >= 0.3) for r in out)
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, round(r.score, 9)) for r in quality.score_quality(table, wrong).collect()} == {(r.doc_id, round(r.score, 9)) for r in out}
    assert {r.score for r in quality.score_quality(table, labels.limit(0)).collect()} == {0.5}


def test_the_lexicon_counts_words_of_all_rows(spark):
    """100,000 rows of 5,000 words, each word in 20 rows that stand together."""
    from factloom.llm import bpe

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    docs = spark.sql("SELECT id AS doc_id, translate(concat('q', CAST(id DIV 20 AS STRING)), '0123456789', 'abcdefghij') AS text FROM range(100000)")
    seen, keep = {}, bpe.count_words
    try:
        bpe.count_words = lambda rows: seen.setdefault("counts", keep(rows))
        lexicon = bpe.compile_lexicon(docs, vocabulary)
    finally:
        bpe.count_words = keep
    assert {r.n for r in seen["counts"].collect()} == {20}
    words = [r.text.encode() for r in docs.select("text").distinct().collect()]
    assert len(words) == 5000 and (lexicon.numbers(words) >= 0).all()
