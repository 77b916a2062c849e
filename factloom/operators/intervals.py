"""Joins on half-open intervals [valid_from, valid_until) within keys, where a key may hold very many; a null end is open.

A key beyond a size gets a grid of cells over its starts, so that each cell holds about as many. A pair of overlapping
intervals meets once, in the cell where the later one starts: the later one is there alone, the earlier one is in each
cell that it reaches. So beyond pairs that overlap only those within a cell are compared.

What covers a moment is found by a sweep through each cell in order of time, with a stack of what has started. A fact that
ends in a later cell is handed to that cell; of those that cover a cell wholly only the latest can be an answer there. They
are found by binary blocks of cells: a fact covers few blocks, and each block keeps its latest fact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

#: Intervals of a key to a cell: in joins, where all pairs of a cell are compared, and in sweeps, which are linear.
PAIRED, SWEPT = 64, 100_000
#: Binary levels of cells at most.
LEVELS = 40


def ticks(name: str, kind: S.DataType) -> Column:
    """A column's place on its axis as a double, in order."""
    if isinstance(kind, S.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(kind, S.TimestampNTZType):
        return F.expr(f"CAST(CAST({name} - TIMESTAMP_NTZ '1970-01-01' AS INTERVAL SECOND) AS DECIMAL(20, 6))").cast("double")
    return F.unix_date(name).cast("double") if isinstance(kind, S.DateType) else F.col(name).cast("double")


def grid_of(starts: DataFrame, size: int) -> DataFrame:
    """__key, __lo, __hi, __width, __cells of each key with more than `size` rows (__key, __start)."""
    counted = starts.groupBy("__key").agg(F.count("__start").alias("n"), F.min("__start").alias("__lo"), F.max("__start").alias("__hi"))
    cells = F.ceil(F.col("n") / size)
    return counted.where(F.col("n") > size).select("__key", "__lo", "__hi", ((F.col("__hi") - F.col("__lo")) / cells).alias("__width"), cells.alias("__cells"))


def cell(at: str) -> Column:
    """The cell of a place; 0 for keys without a grid and for places before it, the last one for all behind it."""
    place = F.floor((F.least(at, "__hi") - F.col("__lo")) / F.nullif("__width", F.lit(0.0)))
    return F.greatest(F.coalesce(F.least(place, F.col("__cells") - 1), F.lit(0)), F.lit(0))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], size: int = PAIRED) -> DataFrame:
    """Pairs with equal keys whose half-open intervals overlap; b's other columns get the suffix _b.

    Rows with a null key or start meet nothing. An interval that ends where it starts overlaps those around it.
    """
    right = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    kind = a.schema["valid_from"].dataType
    placed = lambda df, suffix: df.where(F.col(f"valid_from{suffix}").isNotNull()).withColumns(
        {"__key": F.struct(*keys), "__start": ticks(f"valid_from{suffix}", kind), "__end": F.coalesce(ticks(f"valid_until{suffix}", kind), F.lit(float("inf")))}
    )
    left, right = placed(a, ""), placed(right, "_b")
    grid = grid_of(left.select("__key", "__start").unionByName(right.select("__key", "__start")), size)
    left, right = (df.join(grid, "__key", "left").withColumn("__cell", cell("__start")) for df in (left, right))
    reach = lambda df: df.withColumn("__cell", F.explode(F.sequence("__cell", F.greatest(F.col("__cell"), cell("__end")))))
    side = lambda df, names: df.select(*names, "__cell", *(F.col(c).alias(f"{c}_l") for c in ("__start", "__end")))
    other = lambda df, names: df.select(*names, "__cell", *(F.col(c).alias(f"{c}_r") for c in ("__start", "__end")))
    ours, theirs = a.columns, [c for c in right.columns if not c.startswith("__")]
    out = [*a.columns, *(f"{c}_b" for c in b.columns if c not in keys)]
    meet = (F.col("__start_l") < F.col("__end_r")) & (F.col("__start_r") < F.col("__end_l"))
    on = [*keys, "__cell"]
    first = side(reach(left), ours).join(other(right, theirs), on).where(meet & (F.col("__start_l") <= F.col("__start_r")))
    second = side(left, ours).join(other(reach(right), theirs), on).where(meet & (F.col("__start_l") > F.col("__start_r")))
    return first.select(*out).unionByName(second.select(*out))


def blocks(lo: Column, hi: Column) -> Column:
    """The binary blocks (level, number) that make up the cells lo to hi - 1."""
    one = lambda level, n: F.array(F.struct(level.cast("int").alias("level"), n.alias("n")))
    none = F.array().cast("array<struct<level:int,n:bigint>>")

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["lo"], acc["hi"]
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        found = F.concat(acc["found"], F.when(odd_a, one(level, a)).otherwise(none), F.when(odd_b, one(level, b - 1)).otherwise(none))
        return F.struct(F.shiftright(a + a % 2, 1).alias("lo"), F.shiftright(b, 1).alias("hi"), found.alias("found"))

    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda acc: acc["found"])


def covering_lookup(probes: DataFrame, facts: DataFrame, keys: list[str], order: list[str], size: int = SWEPT) -> DataFrame:
    """Each row of probes (keys, at) with facts' other columns, of the latest fact by (valid_from, *order) that covers `at`.

    Null where none does. Keys are equal when both are null. Facts with a null start cover nothing. Equal probes are looked
    up once. A cell's task holds what is open at one moment.
    """
    kind = facts.schema["valid_from"].dataType
    values = [c for c in facts.columns if c not in keys]
    held = F.struct("__start", *(F.col(c).alias(f"__by_{c}") for c in order), *values)
    mine = facts.where("valid_from IS NOT NULL").withColumns(
        {"__key": F.struct(*keys), "__start": ticks("valid_from", kind), "__end": F.coalesce(ticks("valid_until", kind), F.lit(float("inf")))}
    )
    grid = grid_of(mine.select("__key", "__start"), size)
    # What lies behind the last start is one more cell; open facts reach beyond it.
    behind = lambda at: F.when(F.col(at) > F.col("__hi"), F.col("__cells")).otherwise(cell(at))
    last = F.when(F.col("__end") < float("inf"), behind("__end")).otherwise(F.coalesce(F.col("__cells") + 1, F.lit(0)))
    mine = mine.select("__key", "__start", "__end", held.alias("__fact")).where("__start < __end").join(grid, "__key", "left")
    mine = mine.withColumns({"__cell": cell("__start"), "__last": last})
    asked = probes.select(F.struct(*keys).alias("__key"), "at").distinct().withColumn("__start", ticks("at", kind)).join(grid, "__key", "left")
    asked = asked.withColumn("__cell", behind("__start"))

    empty = F.lit(None).cast(mine.schema["__fact"].dataType)
    fact = lambda df: df.select("__key", "__cell", "__start", "__end", "__fact", F.lit(None).cast(asked.schema["at"].dataType).alias("at"))
    over = mine.where("__last > __cell + 1").withColumn("b", F.explode(blocks(F.col("__cell") + 1, F.col("__last"))))
    best = over.groupBy("__key", "b").agg(F.max(F.struct("__fact", "__start", "__end")).alias("best"))
    above = asked.where("__cells IS NOT NULL").select("__key", "__cell").distinct()
    above = above.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    above = above.select("__key", "__cell", F.struct("level", F.expr("shiftright(__cell, level)").alias("n")).alias("b"))
    whole = above.join(best, ["__key", "b"]).groupBy("__key", "__cell").agg(F.max("best").alias("best"))
    # Of facts that end at once only the latest can be an answer in the cell where they end.
    ending = mine.where("__last > __cell AND __last <= __cells").groupBy("__key", F.col("__last").alias("__cell"), "__end").agg(F.max("__fact").alias("__fact"))
    parts = [
        fact(mine), fact(ending.withColumn("__start", F.col("__fact.__start"))), fact(whole.select("__key", "__cell", "best.*")),
        asked.select("__key", "__cell", "__start", F.lit(None).cast("double").alias("__end"), empty.alias("__fact"), "at"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    ordered = rows.withColumn("__probe", F.col("__end").isNull()).repartition("__key", "__cell")
    ordered = ordered.sortWithinPartitions("__key", "__cell", "__start", "__probe", "__fact")
    columns = ordered.select("__key", "at", "__fact", "__cell", "__start", "__end")
    schema = S.StructType([columns.schema[c] for c in ("__key", "at", "__fact")])
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stack by start: a top that has ended, or ends before a later one does, is never an answer again."""
        here, stack = None, []
        for batch in batches:
            keyed = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
            starts, ends = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            asked_at, answers = [], []
            for i, place in enumerate(keyed):
                if place != here:
                    here, stack = place, []
                passed = starts[i] if ends[i] is None else max(starts[i], ends[i])
                while stack and stack[-1][0] <= passed:
                    stack.pop()
                if ends[i] is not None:
                    stack.append((ends[i], batch.column(2)[i]))
                else:
                    asked_at.append(i)
                    answers.append(stack[-1][1].as_py() if stack else None)
            at = pa.array(asked_at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(answers, arrow.field(2).type)], schema=arrow)

    found = columns.mapInArrow(sweep, schema).withColumnsRenamed({"__key": "__k", "at": "__at"})
    joined = probes.withColumn("__key", F.struct(*keys)).join(found, F.col("__key").eqNullSafe(F.col("__k")) & F.col("at").eqNullSafe(F.col("__at")), "left")
    return joined.select(*probes.columns, *(F.col(f"__fact.{c}").alias(c) for c in values))
