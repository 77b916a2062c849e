"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal density. Its covariance is shrunk towards the covariance pooled over classes and
that towards its diagonal. A score compares Mahalanobis distances and log-determinants through
Cholesky factors that are computed once. Statistics and class sums cover all documents and all labelled
rows; nothing is sampled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from factloom.llm.common import cut, per_row

_DIGITS, _UPPER = b"0123456789", bytes(range(65, 91))
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?")
_STOPS = b".,;:?"
_BEYOND = bytes(range(128, 256))
#: Everyday words of the four languages.
_COMMON = frozenset(
    "the of and to in is it that for was on are as with be by this a an he at from or der die das und nicht den von zu mit sich "
    "ein eine im auf des dem als le la les de des et un une en que qui dans est pour par sur pas au du avec el los se del con "
    "las su al lo como para y no".encode().split()
)
N_FEATURES = 14
#: Counts are taken as if so many more had been seen, so that a few words don't give extreme shares.
MORE_BYTES, MORE_WORDS, MORE_LINES = 40, 12, 4


def statistics(text: str | None) -> list[float]:
    """Ratios and sizes of a text, transformed (logarithm, square root) towards normal shapes; zeros for no text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower().split()
    if not low:
        return [0.0] * N_FEATURES
    size, n = len(raw), len(low)
    share = lambda these: (size - len(raw.translate(None, these))) / (size + MORE_BYTES)
    counts = Counter(low)
    lines = raw.split(b"\n")
    return [
        math.log1p(n),
        math.log((size + 6 * MORE_WORDS) / (n + MORE_WORDS)),
        (n - len(counts)) / (n + MORE_WORDS),
        math.sqrt(share(_SYMBOLS)),
        math.sqrt(share(_DIGITS)),
        math.sqrt(share(_UPPER)),
        math.sqrt(share(_STOPS)),
        share(_BEYOND),
        math.log1p((n + MORE_WORDS) / (len(lines) + 1)),
        (len(lines) - len(set(lines))) / (len(lines) + MORE_LINES),
        math.sqrt(max(counts.values()) / (n + MORE_WORDS)),
        sum(counts[w] for w in _COMMON if w in counts) / (n + MORE_WORDS),
        math.sqrt(share(b"|")),
        math.sqrt(share(b"!")),
    ]


STATISTICS = StructType([StructField("doc_id", LongType()), StructField("x", ArrayType(DoubleType()))])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5. No id counts as kept."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def class_sums(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Per class of (label, x) the sum of outer products of (1, x): count, means and covariance in one matrix.

    Each partition is reduced to one matrix a class before anything is shuffled.
    """
    schema = StructType([StructField("label", IntegerType()), StructField("k", IntegerType()), StructField("v", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(labels):
                continue
            x = batch.column(1).flatten().to_numpy().reshape(len(labels), -1)
            z = np.hstack([np.ones((len(x), 1)), x])
            for label in np.unique(labels).tolist():
                part = z[labels == label]
                sums[label] = sums.get(label, 0.0) + part.T @ part
        for label, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, label), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], schema=arrow
            )

    rows = labelled.select("label", "x").mapInArrow(run, schema).groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out = {r["label"]: np.zeros((N_FEATURES + 1) ** 2) for r in rows}
    for r in rows:
        out[r["label"]][r["k"]] = r["v"]
    return {label: m.reshape(N_FEATURES + 1, -1) for label, m in out.items()}


@dataclass(frozen=True)
class Discriminant:
    """A fitted classifier of label 1 against label 0; without both classes, the share of label 1 (or one half)."""

    prior: float
    means: tuple[np.ndarray, ...] = ()
    inverses: tuple[np.ndarray, ...] = ()
    logs: tuple[float, ...] = ()

    @classmethod
    def fit(cls, sums: dict[int, np.ndarray], to_pooled: float = 0.3, to_diagonal: float = 0.02, floor: float = 1e-5) -> Discriminant:
        counts = {c: sums[c][0, 0] if c in sums else 0.0 for c in (0, 1)}
        prior = counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5
        if not all(counts.values()):
            return cls(prior)
        means = [sums[c][0, 1:] / counts[c] for c in (0, 1)]
        scatter = [sums[c][1:, 1:] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = sum(scatter) / sum(counts.values())
        inverses, logs = [], []
        for c in (0, 1):
            own = scatter[c] / counts[c]
            mixed = (1 - to_pooled) * own + to_pooled * pooled
            shrunk = (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(mixed)) + floor * np.eye(len(mixed))
            factor = np.linalg.cholesky(shrunk)
            inverses.append(np.linalg.inv(factor))
            logs.append(2 * float(np.log(np.diag(factor)).sum()))
        return cls(prior, tuple(means), tuple(inverses), tuple(logs))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of x."""
        if not self.means:
            return np.full(len(x), self.prior)
        density = [
            -0.5 * ((((x - m) @ inv.T) ** 2).sum(axis=1) + log) for m, inv, log in zip(self.means, self.inverses, self.logs, strict=True)
        ]
        odds = density[1] - density[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_quality(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """From rows of STATISTICS and labels.quality (0 or 1; others and nulls are left out), without held-out ids."""
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    return Discriminant.fit(class_sums(rows.where(~held_out(F.col("doc_id"))).join(known, "doc_id")))


def _statistics_of(docs: DataFrame) -> DataFrame:
    return per_row(docs.select("doc_id", "text"), lambda i, t: (i, statistics(t)), STATISTICS)


SCORES = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType())])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (chance of label 1), predicted (1 if score >= threshold) for every row of docs.

    It learns from labels.quality of rows that are not held out; a row without an id is held out. A null
    or empty text has all statistics zero and is scored like any other. Repeated rows are scored each, and
    each label row counts. Without labels of both classes the score is the share of label 1, one half
    without any. An empty table gives an empty one. Other columns are not read.
    """
    rows = cut(_statistics_of(docs))
    model = fit_quality(rows, labels)
    arrow = to_arrow_schema(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=arrow)

    return rows.mapInArrow(run, SCORES).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs (its columns) without the rejected rows; each row is judged by its own text, with or without an id."""
    model = fit_quality(_statistics_of(docs), labels)

    @arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        scores = [model.score(np.array([statistics(t.as_py())]))[0] for t in texts]
        return pa.array([bool(s >= threshold) for s in scores], pa.bool_())

    return docs.where(good("text"))
