"""The near-duplicate stage against a brute-force search on planted near copies."""

import random

import corpus_pipeline
from factloom.llm import near_text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Copies of some texts with words exchanged, beside texts that share a common passage."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocab, k=12))
    bases = [rng.choices(vocab, k=rng.choice([3, 7, 40, 120, 400])) for _ in range(40)]
    texts = [None, "", " \n", "one two", "One  TWO"]
    for base in bases:
        texts.append(" ".join(base) + " " + passage)
        for changes in (1, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy) + " " + passage)
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_force(docs):
    sets, root = {}, {i: i for i, _ in docs}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and (5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_near_copies_as_by_brute_force(spark):
    docs = planted()
    want = brute_force(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near_text.near_groups(frame).collect()} == want
    stage = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in docs], COLUMNS), "")
    assert sorted(r.doc_id for r in stage.collect()) == sorted(set(want.values()))


def test_ids_that_are_null_or_repeat(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (9, text), (9, None)], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in near_text.keep_one(docs).collect()))) == ["4", "9", "None", "None"]


def test_texts_that_share_an_id_are_not_lost(spark):
    a, b = "a b c d e f g", "r s t u v w x"
    near = [" ".join(f"w{i}" for i in range(100)) + f" end{k}" for k in range(2)]
    rows = [(4, a), (9, a), (9, b), (7, near[0]), (7, near[1]), (8, b), (9, b)]
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        kept = near_text.keep_one(spark.createDataFrame(order, "doc_id long, text string").repartition(2)).collect()
        texts = [r.text for r in kept]
        assert sorted(r.doc_id for r in kept) == [4, 7, 8] and a in texts and b in texts and sum(t in near for t in texts) == 1


def test_steps_leave_no_shuffles_and_hand_few_texts_to_python(spark, monkeypatch, tmp_path):
    """Within the search a shuffle is gone once its step is written, Python gets few rows at once, and the session's settings come back."""
    from factloom.llm import common

    rows, drop = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, kept = (spark.conf.get(rows), spark.conf.get(drop)), [], near_text.near_links
    monkeypatch.setattr(near_text, "near_links", lambda *a: (seen.append((spark.conf.get(rows), spark.conf.get(drop))), kept(*a))[1])
    docs = spark.createDataFrame([(i, f"word {i % 7} and some more of the same text here") for i in range(60)], "doc_id long, text string")
    got = near_text.near_groups(docs).groupBy("group_id").count().collect()
    assert sorted((r.group_id, r["count"]) for r in got)[0] == (0, 9) and sum(r["count"] for r in got) == 60
    assert seen == [("1000", "true")] and (spark.conf.get(rows), spark.conf.get(drop)) == before
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    files = lambda: sum(1 for d in manager.diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in d)
    was = files()
    with common.lean(spark):
        common.cut(docs.repartition(3, "doc_id"))
        assert files() <= was
    common.cut(docs.repartition(3, "doc_id"))
    assert files() > was
