"""Source divergence audit: how far each source's use of words is from its language's and from each other source's.

Terms with equal counts have equal values, so values are found per cell of counts, not per term. A source's terms are grouped by
(count in the source, count in the language); cells of equal value are merged, the highest values are taken until they hold
enough terms, and only these cells are expanded into terms. Pairs of sources sum over terms: those that both have are gone
through term by term, all pairs of a term's sources at once in arrays, the others are known from each source's own cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import written

#: A-Z to a-z in UTF-8 bytes, every byte outside [A-Za-z\x80-\xFF] to a space.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct terms that a counting task holds, and their bytes.
HELD, HELD_BYTES = 300_000, 64_000_000
#: Copies of the list of sources that the histograms of a language are dealt to.
DEALT = 16
#: Pairs of sources that are evaluated at once. A pair's value is at most 4 * 10^9, so sums of so many are exact in doubles too.
AT_ONCE = 1_000_000
GROUP = ["lang", "source"]


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), summed up within parts of tasks; lang and source null: ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(n), pa.string()),
                        "source": pa.array([source] * len(n), pa.string()),
                        "term": pa.array([t.decode("utf-8", "surrogatepass") for t in n], pa.string()),
                        "n": pa.array(n.values(), pa.int64()),
                        "d": pa.array((d[t] for t in n), pa.int64()),
                    }
                )
            held.clear()

        new = size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                once = Counter((text.as_py() or "").encode("utf-8", "surrogatepass").translate(LETTER_BYTES).split())
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(once)
                d.update(once.keys())
                if len(n) > before:
                    new += len(n) - before
                    size += sum(map(len, once))
                if new > HELD or size > HELD_BYTES:
                    yield from give()
                    new = size = 0
        yield from give()

    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in GROUP), "text")
    return named.mapInArrow(run, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, total (n of the language) of the terms in min_docs rows of their language, where n > 0.

    One shuffle, by language and term, serves the sums of each source and of the language.
    """
    each = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = W.partitionBy("lang", "term")
    of_lang = each.withColumns({"total": F.sum("n").over(by_term), "df": F.sum("d").over(by_term)})
    return of_lang.where(F.col("df") >= min_docs).select("lang", "source", "term", "n", "total")


def share(count: Column | str, n: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 terms)), exact; null without terms."""
    over = F.col(n).cast("decimal(20,0)") + 2 * F.col(terms).cast("decimal(18,0)")
    scaled = F.lit(10**9).cast("decimal(10,0)") * (F.col(count) if isinstance(count, str) else count).cast("decimal(19,0)")
    more = F.lit(2 * 10**9).cast("decimal(10,0)")
    return F.when(F.col(terms) > 0, F.lit(1) + F.call_function("div", scaled + more, F.nullif(over, F.lit(0).cast("decimal(1,0)"))))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exact: shares are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, lang_n, terms and p0 (the share of a term that the source lacks) for every group that occurs."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in GROUP)).distinct()
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang")
    langs = langs.agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    joined = groups.join(sums, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["n", "terms", "lang_n"])
    return joined.withColumn("p0", share(F.lit(0), "n", "terms"))


def distant_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the `top` terms of each group that it uses more than its language, by value."""
    cells = kept.groupBy(*GROUP, "n", "total").agg(F.count(F.lit(1)).alias("many"))
    sides = groups.select(*GROUP, F.col("n").alias("group_n"), "lang_n", "terms")
    p, q = share("n", "group_n", "terms"), share("total", "lang_n", "terms")
    valued = cells.join(sides, GROUP).select(*GROUP, "n", "total", "many", p.alias("p"), q.alias("q")).where("p > q")
    valued = valued.withColumn("value", gap(F.col("p"), F.col("q")))
    falling = W.partitionBy(*GROUP).orderBy(F.desc("value"))
    merged = valued.groupBy(*GROUP, "value").agg(F.sum("many").alias("many"))
    # Each value has a term, so the `top` highest values are enough; then by how many terms lie before.
    first = merged.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("many").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("before", before).where(F.col("before") < top).select(*GROUP, "value")
    wanted = valued.join(taken, [*GROUP, "value"]).select(F.struct(*GROUP, "n", "total").alias("cell"), "value")
    # On one struct column, so that a cell with very many terms can be split.
    found = kept.select(*GROUP, "term", F.struct(*GROUP, "n", "total").alias("cell")).join(wanted, "cell")
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select(*GROUP, F.col("term").alias("item"), "value", "rank")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PairSums:
    """Sums of values by pair of a language's sources."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        code = a * (1 << 31) + b
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.codes.append(code[first])
        self.values.append(np.add.reduceat(values[order], first))
        self.held += len(first)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        if self.codes:
            names = pa.array(self.names, pa.string())
            code, at = np.unique(np.concatenate(self.codes), return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, at, np.concatenate(self.values))
            columns = [pa.array([lang] * len(code), pa.string()), names.take(pa.array(code >> 31)), names.take(pa.array(code & (1 << 31) - 1)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])
        self.codes, self.values, self.held = [], [], 0


def _pair_up(sums: PairSums, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
    """Add what terms (rows) give to the pairs of their sources (columns, as many for each)."""
    k = source.shape[1]
    left, right = np.triu_indices(k, 1)
    step, width = max(1, AT_ONCE // max(1, len(left))), max(1, min(len(left), AT_ONCE))
    for row in range(0, len(source), step):
        part = slice(row, row + step)
        for at in range(0, len(left), width):
            i, j = left[at : at + width], right[at : at + width]
            a, b = p[part][:, i], p[part][:, j]
            a0, b0 = p0[part][:, i], p0[part][:, j]
            values = _gaps(a, b) - _gaps(a, b0) - _gaps(a0, b) + _gaps(a0, b0)
            sums.add(source[part][:, i].ravel(), source[part][:, j].ravel(), values.ravel())


def shared_terms(shares: DataFrame) -> DataFrame:
    """lang, source, item, value: for pairs source < item the sum over terms of both of f(a, b) - f(a, 0) - f(0, b) + f(0, 0).

    A term's rows stand together, at most one a source; a task sums pairs up over its terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, sums = None, PairSums()
        rest: pa.Table | None = None

        def take(rows: pa.Table, last: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
            """All rows but those of the last term, which may go on."""
            nonlocal lang, sums
            out: list[pa.RecordBatch] = []
            langs, terms = rows["lang"].to_pylist(), rows["term"].to_pylist()
            new = np.array([True, *(x != y for x, y in zip(zip(langs, terms, strict=True), zip(langs[1:], terms[1:], strict=True), strict=False))])
            starts = np.append(np.flatnonzero(new), len(terms))
            done = len(starts) - 1 if last else len(starts) - 2
            names, p, p0 = rows["source"].to_pylist(), rows["p"].to_numpy(), rows["p0"].to_numpy()
            at = 0
            while at < done:
                end = at
                while end < done and langs[starts[end]] == langs[starts[at]]:
                    end += 1
                if langs[starts[at]] != lang:
                    out += sums.rows(lang)
                    lang, sums = langs[starts[at]], PairSums()
                known = np.array([sums.names.setdefault(n, len(sums.names)) for n in names[starts[at] : starts[end]]], np.int64)
                sizes = np.diff(starts[at : end + 1])
                for k in np.unique(sizes[sizes > 1]).tolist():
                    index = starts[at:end][sizes == k][:, None] + np.arange(k)
                    _pair_up(sums, known[index - starts[at]], p[index], p0[index])
                    if sums.held > 4 * AT_ONCE:
                        out += sums.rows(lang)
                at = end
            return (None if last else rows.slice(int(starts[done]))), out

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            if rows.num_rows:
                rest, out = take(rows, False)
                yield from out
        if rest is not None and rest.num_rows:
            yield from take(rest, True)[1]
        yield from sums.rows(lang)

    ordered = shares.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").select("lang", "term", "source", "p", "p0")
    return ordered.mapInArrow(run, "lang string, source string, item string, value long")


def distant_sources(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: each other source of the language, by the summed gap over all kept terms.

    With a and b the counts of a term in two sources and f(a, b) its gap, the sum is that of f(a, 0) - f(0, 0) over one's
    terms, of f(0, b) - f(0, 0) over the other's, of f(0, 0) over all, and of f(a, b) - f(a, 0) - f(0, b) + f(0, 0) over
    terms of both. f is symmetric, so terms of both meet once a pair.
    """
    sides = groups.select("lang", "source", "n", "terms", "p0")
    shares = kept.join(sides.withColumnRenamed("n", "group_n"), GROUP).select(*GROUP, "term", share("n", "group_n", "terms").alias("p"), "p0")
    shares, _ = written(shares)
    other = sides.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "terms")

    copies = other.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    own = shares.groupBy(*GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("many")).withColumn("deal", F.pmod(F.xxhash64(*GROUP, "p"), F.lit(DEALT)))
    p, p0, q, q0 = map(F.col, ("p", "p0", "q", "q0"))
    own = own.join(copies, ["lang", "deal"]).where("source <> item").select(*GROUP, "item", (F.col("many") * (gap(p, q0) - gap(p0, q0))).alias("value"))

    both = shared_terms(shares)

    pairs = sides.select("lang", "source", "p0").join(other, "lang").where("source <> item")
    base = pairs.select(*GROUP, "item", F.coalesce(F.col("terms") * gap(p0, q0), F.lit(0)).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = base.unionByName(own).unionByName(turned(own)).unionByName(both).unionByName(turned(both)).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    return summed.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` names each group's other sources, part `term` its `top` terms.

    Null texts, languages and sources are ''. Every row is a document of its own, also when rows or ids repeat. A language
    without kept terms has pairs of value 0, ranked by name. Ties go to the smaller item in UTF-8 order. Terms of any length
    are whole. An empty table gives an empty one. Other columns are not read.
    """
    docs = docs.select(*GROUP, "text")
    kept, _ = written(kept_terms(docs, min_docs))
    groups, _ = written(_groups(docs, kept))
    part = lambda df, name: df.select(*GROUP, F.lit(name).alias("part"), "item", "value", "rank")
    return part(distant_sources(kept, groups), "pair").unionByName(part(distant_terms(kept, groups, top), "term"))
