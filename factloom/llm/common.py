"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A-Z to a-z in UTF-8 bytes, every byte outside [0-9A-Za-z\x80-\xFF] to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a temporary folder, but only if Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that it is computed once and outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that a task hands to Python at once within lean().
ROWS_AT_ONCE = 1_000


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Settings for a job of many steps whose results are all written: shuffles go once their step is written, instead of when the
    driver happens to collect its garbage, and tasks hand whole texts to Python a few at a time. The session's own settings come back."""
    rows, drop = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = {key: spark.conf.get(key) for key in (rows, drop)}
    most = int(own[rows])
    spark.conf.set(rows, min(most, ROWS_AT_ONCE) if most > 0 else ROWS_AT_ONCE)
    spark.conf.set(drop, True)
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table of its own in the shared folder, and the table's path for removed().

    Unlike a checkpoint, which keeps the size that Spark guessed for df (a product over all joins so far), the table has a
    size of its own. Loops of joins need that: else the guesses get longer with each round until planning never ends.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made and nothing reads any more."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)


def word_list(text: str | None) -> list[bytes]:
    """Words [0-9a-z and all beyond ASCII]+ after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def ascii_lower(line: Column) -> Column:
    """A-Z to a-z, nothing else; whole-ASCII strings take the cheap built-in."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(
        F.translate(line, upper, upper.lower())
    )


def per_row(df: DataFrame, row: Callable[..., tuple], schema: StructType) -> DataFrame:
    """df's columns through row(*values) -> a tuple of schema's fields, in Arrow batches, one output row per row."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row(*(c[i].as_py() for c in batch.columns)) for i in range(batch.num_rows)]
            columns = list(zip(*made, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)
