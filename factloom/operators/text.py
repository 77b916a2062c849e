"""Jobs over document texts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from factloom.functions.vectors import cosine
from factloom.operators.graph import written

# Stop words by language, ranges of scripts with their thresholds, month names.
STOP_WORDS = {
    "en": "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she "
    "is are was were what which who where when how",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este ha son",
    "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mais comme ou si leur",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou",
    "it": "di a da in su per con tra il lo la i gli le un una uno che non è sono ho ha mi ti si come più anche ma",
}
SCRIPTS = {
    "latin": r"[A-Za-zÀ-ɏḀ-ỿ]",
    "cyrillic": r"[Ѐ-ӿ]",
    "arabic": r"[؀-ۿ]",
    "devanagari": r"[ऀ-ॿ]",
    "kana": r"[぀-ゟ゠-ヿ]",
    "hangul": r"[가-힯]",
    "han": r"[一-鿿㐀-䶿\x{20000}-\x{2A6DF}]",
}
# Letters of scripts that set words apart by blanks; trailers, markers, types and the least length of a body by which commits are judged.
SPACED = "A-Za-zÀ-ɏЀ-ӿ"
TRAILERS = ("decision", "why", "rationale", "breaking change", "breaking-change", "gotcha", "invariant")
MARKERS = ("because", "so that", "in order to", "instead of", "rather than", "to avoid", "to prevent", "otherwise", "the reason")
SELDOM, DECIDING, BODY = ("chore", "style", "ci", "build", "test", "docs"), ("feat", "fix", "refactor", "perf", "revert"), 80
MONTHS = "january february march april may june july august september october november december".split()


#: What masks look for, in order: class, rule, mask, and a plainer rule that finds something in every text where the first does, by which
#: most texts are passed over. Between digits of one number stand blanks, dots, hyphens and brackets.
_GAP = r"[\s().\-]"
_YEAR = r"(?:19|20)\d\d"
MASKS = [
    ("email", r"[\p{Alnum}._%+\-]+@(?:[\p{Alnum}\-]+\.)+\p{Alpha}{2,}", "[EMAIL]", "@"),
    # 9 to 16 digits that no further digit precedes or follows, unless they begin with a date or are years only.
    ("phone", rf"(?<!\d{_GAP}{{0,8}})(?!{_YEAR}-\d\d-\d\d)(?!{_YEAR}(?:{_GAP}+{_YEAR})+(?!{_GAP}*\d))\+?\d(?:{_GAP}*\d){{8,15}}+(?!{_GAP}*\d)", "[PHONE]", rf"\d(?:{_GAP}*+\d){{8}}"),
    ("number", r"(?<!\w)\d{9,}(?!\w)", "[NUM]", r"\d{9}"),
]


def redact_pii(df: DataFrame, column: str = "text") -> DataFrame:
    """df with e-mails, phone- or card-like numbers and long digit runs masked, and pii_classes of what was found."""
    out, found = df, []
    for name, rule, mask, sign in MASKS:
        before, after = column if not found else f"__{len(found)}", f"__{len(found) + 1}"
        has = F.contains(F.col(before), F.lit(sign)) if sign == "@" else F.regexp_like(F.col(before), F.lit(sign))
        out = out.withColumn(after, F.when(has, F.regexp_replace(before, rule, mask)).otherwise(F.col(before)))
        found.append(F.when(F.col(after) != F.col(before), name))
    last = f"__{len(MASKS)}"
    marked = out.withColumn("pii_classes", F.array_compact(F.array(*found))).withColumn(column, F.col(last))
    return marked.drop(*(f"__{i}" for i in range(1, len(MASKS) + 1)))


def pii_report(redacted: DataFrame) -> DataFrame:
    # Outer, for otherwise Spark asks first, below the masks, whether there are classes, which finds them twice.
    each = redacted.select("source", F.explode_outer("pii_classes").alias("pii_class")).where("pii_class IS NOT NULL")
    return each.groupBy("source", "pii_class").agg(F.count("*").alias("n"))


@pandas_udf(StringType())
def fold_object(texts: pd.Series) -> pd.Series:
    """Trimmed, in lower case and without accents."""
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.strip().lower()) if not unicodedata.combining(c))
    return texts.map(lambda t: None if t is None else plain(t))


def letter_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda t: t != "")


def tag_language(df: DataFrame, column: str = "text") -> DataFrame:
    """df with language and script: a script above its share decides, else the most stop words (ties: the order above).

    Letters are counted only in texts that have some of another script than Latin. Words are split once, and reduced to stop
    words of any language before each language counts its own.
    """
    others = [s for s in SCRIPTS if s != "latin"]
    text = F.trim(F.col(column))
    mixed = F.regexp_like(text, F.lit("|".join(SCRIPTS[s] for s in others)))
    count = lambda s: F.when(mixed, F.regexp_count(text, F.lit(SCRIPTS[s]))).otherwise(0).alias(s)
    stops = {w for stop in STOP_WORDS.values() for w in stop.split()}
    rows = df.withColumns({
        "__n": F.struct(*map(count, SCRIPTS)), "__letters": mixed | F.regexp_like(text, F.lit(SCRIPTS["latin"])),
        "__w": F.filter(letter_words(text), lambda t: t.isin(*sorted(stops))),
    })
    known = lambda stop: F.size(F.filter("__w", lambda t: t.isin(*stop.split())))
    hits = [F.struct(known(stop).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, stop) in enumerate(STOP_WORDS.items())]
    rows = rows.withColumn("__best", F.greatest(*hits))
    n = {s: F.col(f"__n.{s}") for s in SCRIPTS}
    total = reduce(lambda a, b: a + b, n.values())
    share = {s: c / F.when(total > 0, total) for s, c in n.items()}
    named = [("ru", "Cyrl", share["cyrillic"] > 0.4), ("ko", "Hang", share["hangul"] > 0.3), ("ja", "Hira", share["kana"] > 0.2), ("zh", "Hani", share["han"] > 0.3),
             ("ar", "Arab", share["arabic"] > 0.3), ("hi", "Deva", share["devanagari"] > 0.3)]
    none = ~F.coalesce("__letters", F.lit(False))
    language, script = F.when(none, "und"), F.when(none, "Zyyy")
    for lang, code, holds in named:
        language, script = language.when(holds, lang), script.when(holds, code)
    best = F.col("__best")
    tagged = rows.withColumn("language", language.otherwise(F.when(best["n"] > 0, best["lang"]).otherwise("en"))).withColumn("script", script.otherwise("Latn"))
    return tagged.drop("__n", "__letters", "__w", "__best")


def language_mix(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("language").agg(F.count("*").alias("n"))


def normal_span(text: Column) -> Column:
    """In lower case, trimmed, each run of white space one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}\x{FEFF}]+", " ")))


def holds_span(text: Column, span: Column) -> Column:
    """Does a normal text hold a normal span? At an edge that is a letter of a script with spaces between words, the span
    must not go on as such a letter; other scripts need no bounds. An empty span is in no text."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(span, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    bound = lambda edge, rule: F.when(F.regexp_like(edge, F.lit(f"[{SPACED}]")), rule).otherwise("")
    before, after = bound(F.substring(span, 1, 1), f"(?<![{SPACED}])"), bound(F.substring(span, -1, 1), f"(?![{SPACED}])")
    return F.coalesce((span != "") & F.regexp_like(text, F.concat(before, quoted, after)), F.lit(False))


def check_grounding(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (claim_id, entity_id, doc_id, name, value) with reason: null where the document holds both the entity's name and the
    value as spans of their own, else ungrounded_entity or ungrounded_value."""
    joined = claims.join(docs.select("doc_id", normal_span(F.col("text")).alias("__text")), "doc_id", "left")
    inside = lambda span: holds_span(F.col("__text"), normal_span(F.col(span)))
    reason = F.when(~inside("name"), "ungrounded_entity").when(~inside("value"), "ungrounded_value")
    return joined.withColumn("reason", reason).drop("__text")


def chunk_documents(docs: DataFrame, target: int = 12_000, most: int = 16_000, overlap: int = 400, least_share: float = 0.5) -> DataFrame:
    """doc_id, seq, text, char_start, char_end: a text of at most `most` characters is one chunk; longer ones are cut at about
    `target`, at a paragraph, line or sentence end in the window's later part, else hard; chunks overlap."""
    target, overlap = min(target, most), min(overlap, min(target, most) // 4)

    @pandas_udf("array<struct<seq: int, text: string, char_start: int, char_end: int>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            chunks, start = [], 0
            while text and start < len(text):
                end = len(text)
                if end - start > most:
                    ends = (text.rfind(b, start, start + target) + len(b) for b in ("\n\n", "\n", ". "))
                    end = next((e for e, b in zip(ends, (2, 1, 2), strict=True) if e - b >= start + int(target * least_share)), start + target)
                chunks.append((len(chunks), text[start:end], start, end))
                if end == len(text):
                    break
                start = end - overlap
            out.append(chunks)
        return pd.Series(out)

    return docs.select("doc_id", F.explode(cut("text")).alias("c")).select("doc_id", "c.*")


def route_documents(docs: DataFrame, packs: list[dict], min_sim: float = 0.3) -> DataFrame:
    """doc_id, pack, rule for each pack (name, always, verticals, keywords, vector) that a document goes to.

    Rules come first: always, the document's source, a keyword as whole words anywhere in its text. A pack with a vector also takes
    documents (of tables with an embedding) that none of its rules takes and that are as near as min_sim.
    """
    low = F.lower("text")
    word = lambda kw: F.regexp_like(low, F.lit(r"(?<![\p{L}\p{N}])\Q" + kw.lower() + r"\E(?![\p{L}\p{N}])"))
    routes = []
    for p in packs:
        by_word = reduce(lambda a, b: a | b, map(word, p.get("keywords", [])), F.lit(False))
        rule = F.when(F.lit(bool(p.get("always"))), "always").when(F.col("source").isin(*p.get("verticals", [""])), "vertical").when(by_word, "keyword")
        if p.get("vector") and "embedding" in docs.columns:
            rule = rule.when(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, p["vector"])))) >= min_sim, "embedding")
        routes.append(F.struct(F.lit(p["name"]).alias("pack"), rule.alias("rule")))
    return docs.select("doc_id", F.explode(F.array(*routes)).alias("r")).select("doc_id", "r.*").where("rule IS NOT NULL")


def extract_periods(df: DataFrame, column: str = "text") -> DataFrame:
    """df with period_from and period_to, the hull of the dates it names: days beat months, months beat years."""
    text, month = F.col(column), "|".join(MONTHS)
    every = lambda rule, group: F.regexp_extract_all(text, F.lit(rule), F.lit(group))
    number = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    iso = F.transform(every(r"\b(\d{4}-\d{2}-\d{2})\b", 1), lambda d: F.try_to_date(d))
    rule = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)? ({month}),? (\d{{4}})\b"
    named = F.zip_with(F.zip_with(every(rule, 3), every(rule, 2), lambda y, m: F.concat(y, F.lit("-"), number[F.lower(m)])), every(rule, 1), lambda ym, d: F.try_to_date(F.concat(ym, F.lit("-"), F.lpad(d, 2, "0"))))
    other = rf"(?i)\b({month}) (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b"
    american = F.zip_with(F.zip_with(every(other, 3), every(other, 1), lambda y, m: F.concat(y, F.lit("-"), number[F.lower(m)])), every(other, 2), lambda ym, d: F.try_to_date(F.concat(ym, F.lit("-"), F.lpad(d, 2, "0"))))
    days = F.array_compact(F.concat(iso, named, american))
    in_month = rf"(?i)\b({month}),? (\d{{4}})\b"
    months = F.array_compact(F.zip_with(every(in_month, 2), every(in_month, 1), lambda y, m: F.try_to_date(F.concat(y, F.lit("-"), number[F.lower(m)], F.lit("-01")))))
    years = F.array_compact(F.transform(every(r"\b((?:19|20)\d{2})\b", 1), lambda y: F.try_to_date(F.concat(y, F.lit("-01-01")))))
    pick = lambda d, m, y: F.when(F.size(days) > 0, d).when(F.size(months) > 0, m).when(F.size(years) > 0, y)
    return df.withColumn("period_from", pick(F.array_min(days), F.array_min(months), F.array_min(years))).withColumn(
        "period_to", pick(F.date_add(F.array_max(days), 1), F.add_months(F.array_max(months), 1), F.add_months(F.array_max(years), 12))
    )


def classify_commits(commits: DataFrame) -> DataFrame:
    """commits (subject, body, perhaps pr_body) with rule, the first that holds, and decision (does the commit record one?).

    Rules in order: merge; a decision trailer in the body; a type that seldom decides, without a body of BODY characters or a
    marker of rationale in body or pr_body; such a marker; a type that decides, with such a body; such a body of any type.
    """
    subject, body = F.trim(F.coalesce("subject", F.lit(""))), F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    more = F.coalesce("pr_body", F.lit("")) if "pr_body" in commits.columns else F.lit("")
    prose = F.lower(F.concat_ws("\n", body, more))
    kind = F.regexp_extract(subject, r"^([a-z]+)(?:\([^)]*\))?!?:", 1)
    trailer = F.regexp_like(body, F.lit(rf"(?im)^[^\S\n]*(?:{'|'.join(TRAILERS)}):[^\S\n]+\S"))
    why = reduce(lambda a, b: a | b, (F.contains(prose, F.lit(m)) for m in MARKERS))
    long = F.char_length(body) >= BODY
    rule = (
        F.when(F.regexp_like(subject, F.lit(r"^Merge (branch|pull request|remote-tracking) ")), "merge").when(trailer, "trailer")
        .when(kind.isin(*SELDOM) & ~long & ~why, "routine").when(why, "rationale").when(kind.isin(*DECIDING) & long, "typed_body").when(long, "body").otherwise("short")
    )
    return commits.withColumn("rule", rule).withColumn("decision", F.col("rule").isin("trailer", "rationale", "typed_body", "body"))


def gate_pipeline(extra: list[str], features: int = 1 << 15) -> Pipeline:
    """Hashed words and word pairs with further columns as one vector. Needs words (array)."""
    return Pipeline(stages=[
        NGram(n=2, inputCol="words", outputCol="pairs"), HashingTF(numFeatures=features, inputCol="words", outputCol="f1", binary=True), HashingTF(numFeatures=features, inputCol="pairs", outputCol="f2", binary=True),
        VectorAssembler(inputCols=["f1", "f2", *extra], outputCol="features"),
    ])


#: Columns of a text's shape beside its words.
SHAPE = ["size", "word_length", "variety", "digits", "marks", "lines"]


def gate_features(df: DataFrame, column: str = "text") -> DataFrame:
    """df with words and the columns SHAPE: logarithm of the length, mean length of words, share of distinct ones among them,
    shares of digits and of marks among the characters, logarithm of the lines. Null texts are empty."""
    text, words = F.coalesce(F.col(column), F.lit("")), F.col("words")
    n, size = F.greatest(F.size(words), F.lit(1)), F.greatest(F.char_length(text), F.lit(1))
    of = lambda rule: F.regexp_count(text, F.lit(rule)) / size
    return df.withColumn("words", letter_words(text)).withColumns({
        "size": F.log1p(F.char_length(text)), "word_length": F.char_length(F.array_join(words, "")) / n, "variety": F.size(F.array_distinct(words)) / n,
        "digits": of(r"\p{N}"), "marks": of(r"[^\p{L}\p{M}\p{N}\s]"), "lines": F.log1p(F.regexp_count(text, F.lit("\n"))),
    })


def gate_vectors(rows: DataFrame, extra: list[str]) -> DataFrame:
    """rows with features instead of words, as a table: training reads them twice and scoring once more, but they are made once."""
    made = gate_pipeline(extra).fit(rows).transform(rows)
    return written(made.drop("words", "pairs", "f1", "f2"))


def train_gate(labelled: DataFrame) -> LogisticRegressionModel:
    """An L2 logistic model of features and label."""
    return LogisticRegression(maxIter=20, regParam=0.01).fit(labelled)


def gate_score(model: LogisticRegressionModel, vectors: DataFrame) -> DataFrame:
    """vectors with score, the probability of label 1."""
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _overlapping(sets: DataFrame, share: float) -> DataFrame:
    """early, late: ids of sets (id, query_id, t) of one query, ids in their order, that share `share` or more of the smaller one's words.

    The smaller of two such sets has a shared word among its size - ceil(share * size) + 1 rarest words of the query.
    """
    size = F.size("t")
    words = sets.select("query_id", "id", F.explode("t").alias("w"))
    many = words.groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.join(many, ["query_id", "w"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("by_n"))
    sized = sets.withColumn("s", size).select("id", "query_id", "s").join(ranked, "id")
    posts = sized.select("query_id", "id", "s", F.posexplode(F.transform("by_n", lambda x: x["w"])).alias("at", "w"))
    first = posts.where(F.col("at") < F.col("s") - F.ceil(F.lit(share) * F.col("s")) + 1).select("query_id", "w", F.col("id").alias("a"), F.col("s").alias("s_a"))
    larger = (F.col("s") > F.col("s_a")) | (F.col("s") == F.col("s_a")) & (F.col("id") > F.col("a"))
    met = first.join(posts, ["query_id", "w"]).where(larger).select("a", F.col("id").alias("b")).distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("t").alias(f"t_{c}"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    near = met.join(side("a"), "a").join(side("b"), "b").where(shared >= share * F.least(F.size("t_a"), F.size("t_b")))
    return near.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))


#: Lines of fewer words are no repeats.
LEAST_WORDS = 3


def mention_words(text: Column) -> Column:
    """The sorted distinct words of a line, without what stands before it: a mark in brackets and a name with a colon."""
    return F.sort_array(F.array_distinct(letter_words(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[[^\]]*\]\s*", ""), r"^[^:]{0,40}:\s*", ""))))


def dedupe_mentions(lines: DataFrame, least: int = LEAST_WORDS, share: float = 0.7) -> DataFrame:
    """lines (query_id, seq, text) without those of whose smaller word set `share` or more is in an earlier kept line's.

    Lines of fewer than `least` words stay and drop none. Of lines with equal words only the first can stay. Then pairs of
    overlapping sets are found, and rounds settle lines: one that no unsettled or kept line comes before stays, and drops
    those it overlaps. Lines of one seq stand in order of their text; null texts have no words.
    """
    rows = lines.select("query_id", "seq", "text", mention_words(F.col("text")).alias("t"))
    nth = F.row_number().over(W.partitionBy("query_id", "t").orderBy("seq", "text"))
    long = F.size("t") >= least
    ones = rows.where(long).withColumn("n", nth).where("n = 1").drop("n")
    # Ids in the order of the lines stand for their texts from here on.
    sets = written(ones.orderBy("query_id", "seq", "text").withColumn("id", F.monotonically_increasing_id()))
    pairs, dropped = written(_overlapping(sets, share)), []
    while not pairs.isEmpty():
        waiting = pairs.select(F.col("late").alias("early")).distinct()
        gone = written(pairs.join(waiting, "early", "left_anti").select("late").distinct())
        dropped.append(gone)
        left = pairs.join(gone, "late", "left_anti").join(gone.select(F.col("late").alias("early")), "early", "left_anti")
        # What comes before no unsettled line is settled: its pairs went with those it dropped.
        pairs = written(left)
    stay = sets
    if dropped:
        stay = sets.join(reduce(DataFrame.unionByName, dropped).select(F.col("late").alias("id")), "id", "left_anti")
    columns = ["query_id", "seq", "text"]
    return rows.where(~long).select(columns).unionByName(stay.select(columns))


def prefix_table(names: DataFrame, shortest: int = 2, longest: int = 15, k: int = 10) -> DataFrame:
    """prefix, rank, entity_id, name: for each prefix the k names with most facts (weight), then by name.

    Names of one length that are equal but for case share all their prefixes, so more than their k best are in none; these are found before
    names become prefixes.
    """
    first = F.row_number().over(W.partitionBy("__low", F.char_length("name")).orderBy(F.desc("weight"), "name", "entity_id"))
    best = names.select("entity_id", "name", "weight", F.lower("name").alias("__low")).withColumn("__n", first).where(F.col("__n") <= k)
    rows = best.drop("__low", "__n").withColumn("n", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.char_length("name"))))).where(F.char_length("name") >= shortest)
    rank = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("weight"), "name", "entity_id"))
    return rows.withColumn("prefix", F.expr("substring(lower(name), 1, n)")).withColumn("rank", rank).where(F.col("rank") <= k).select("prefix", "rank", "entity_id", "name")
