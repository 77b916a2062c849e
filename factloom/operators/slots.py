"""Slots of which one fact is active (single_active), resolved by a scan that splits hot slots.

Such a slot is a chain: a fact takes over from the active one if it starts no earlier, unless it says the same from another
origin (then it corroborates) or starts earlier (then it is history). Slots of up to RUN facts are followed whole. A larger
one is cut into runs in order of arrival. What a run does to an active fact that enters it depends only on the first fact of
the run that takes over, and from there on the run itself is known; so a run is summed up by its possible first takers, each
with the fact that is active at the end. A taker is possible if some fact that may enter is passed by all before it: that is
if those that start late enough all have one object, and it has another object or an origin that they have not. Summaries
are composed slot by slot, then all runs are followed side by side, each from the fact that really enters.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import chain, groupby, islice
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.operators.graph import written

#: Facts of a slot that are followed in one go; larger slots are cut into runs of about so many.
RUN = 200_000
#: What is carried of a fact from run to run.
STATE = (
    "fact_id string, object string, origin_key string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, "
    "confidence double, learned_trust double, authority double"
)
CARRIED = [part.split()[0] for part in STATE.split(", ")]
DIMENSIONS = ("confidence", "source_trust", "recency", "authority")
YEAR = 365 * 86400.0


class Fact(NamedTuple):
    fact_id: str
    object: str
    origin_key: str | None
    valid_from: datetime
    valid_until: datetime | None
    recorded_at: datetime
    confidence: float
    learned_trust: float
    authority: float
    declared_trust: float = 0.0
    stored: bool = False
    status: str | None = None


FACT = list(Fact._fields)


def agrees(x: Fact, active: Fact) -> bool:
    return x.object == active.object and x.origin_key != active.origin_key


def takes_over(x: Fact, active: Fact) -> bool:
    return x.valid_from >= active.valid_from and not agrees(x, active)


def follow(rows: Iterable[Fact], now: datetime, cfg, active: Fact | None = None, closed_by: tuple[str, datetime] | None = None) -> Iterator[dict]:
    """OUT rows of a run's facts in order of arrival.

    active: the fact that enters; its own row belongs to the run it came in. closed_by: (fact_id, valid_from) of the fact of a
    later run that takes over from the one that is active at the end.
    """
    pool: list[tuple[Fact, dict]] = [] if active is None else [(active, {})]

    def row(f: Fact, **more) -> dict:
        blank = dict.fromkeys(("prior_valid_until", "superseded_by", "corroborates", "outcome", "score", "best_opponent", "dominant", "opponent"))
        return {"fact_id": f.fact_id, "status": "active", "valid_until": f.valid_until} | blank | more

    def closed(f: Fact, made: dict, by: str, start: datetime) -> dict:
        end = min(start, f.valid_until) if cfg.clamp_end and f.valid_until is not None else start
        return made | {"status": "superseded", "superseded_by": by, "prior_valid_until": f.valid_until, "valid_until": end}

    for x in rows:
        if x.stored:
            made = row(x, status=x.status)
            if x.status == "active":
                pool.append((x, made))
            else:
                yield made
            continue
        parts = (cfg.confidence * x.confidence, cfg.trust * x.declared_trust, cfg.recency, cfg.authority * x.authority)
        score = sum(parts)
        same = [f for f, _ in pool if agrees(x, f)]
        if same:
            target = max(same, key=lambda f: (f.recorded_at, f.fact_id))
            yield row(x, status="corroborating", outcome="CORROBORATED", score=score, corroborates=target.fact_id)
            continue
        later = [f for f, _ in pool if f.valid_from > x.valid_from]
        if later:
            after = min(later, key=lambda f: (f.valid_from, f.fact_id))
            yield row(x, status="superseded", outcome="INSERTED_HISTORICAL", score=score, superseded_by=after.fact_id, prior_valid_until=x.valid_until, valid_until=after.valid_from)
            continue
        made = row(x, outcome="INSERTED", score=score)
        if pool:
            age = lambda f: math.exp(-(now - f.recorded_at).total_seconds() / YEAR)
            scored = [(cfg.confidence * f.confidence, cfg.trust * f.learned_trust, cfg.recency * age(f), cfg.authority * f.authority) for f, _ in pool]
            best = max(scored, key=sum)
            gaps = [abs(a - b) for a, b in zip(parts, best, strict=True)]
            made |= {"outcome": "SUPERSEDED", "best_opponent": sum(best), "dominant": DIMENSIONS[gaps.index(max(gaps))], "opponent": pool[scored.index(best)][0].fact_id}
            yield from (closed(f, old, x.fact_id, x.valid_from) for f, old in pool if old)
        pool = [(x, made)]
    for f, made in pool:
        if made:
            yield made if closed_by is None else closed(f, made, *closed_by)


class Chain:
    """Ways into a run that have met: the fact active now, and the takers by which they came in."""

    __slots__ = ("active", "takers", "over")

    def __init__(self, active: Fact, takers: list[int]) -> None:
        self.active, self.takers, self.over = active, takers, False


def summary(rows: Iterable[Fact], latest: datetime | None) -> tuple[Fact | None, list[tuple[Fact, Fact]]]:
    """Of a run: the fact active at its end if none enters, and each possible first taker with the fact active at the end.

    latest: the greatest start before the run, beyond which no fact that enters starts; null: none enters.
    """
    fresh: Chain | None = None
    takers: list[Fact] = []
    chains: list[Chain] = []
    by_object: dict[str, list] = {}
    by_origin: dict[tuple, list] = {}
    origins: dict[tuple, datetime] = {}  # the greatest start so far of an object and origin
    first = second = None  # (start, object) of the two objects with the greatest starts so far

    def met(heap: list, start: datetime) -> Iterator[Chain]:
        while heap and (heap[0][2].over or heap[0][0] <= start):
            way = heapq.heappop(heap)[2]
            if not way.over:
                way.over = True
                yield way

    for n, x in enumerate(rows):
        if x.stored and x.status != "active":
            continue
        mine, start = (x.object, x.origin_key), x.valid_from
        over, came = [], []
        if not x.stored:
            over = [c for o, heap in by_object.items() if o != x.object for c in met(heap, start)]
            over += met(by_origin.get(mine, []), start)
            came = [t for c in over for t in c.takers]
            if latest is not None:
                least = min(start, latest)
                one = first is not None and first[0] >= least and (second is None or second[0] < least)
                new_origin = mine not in origins or origins[mine] < least
                if first is None or first[0] < least or one and (first[1] != x.object or new_origin):
                    came.append(len(takers))
                    takers.append(x)
        if came or over or fresh is None:
            way = Chain(x, came)
            if fresh is None or fresh.over:
                fresh = way
            chains.append(way)
            heapq.heappush(by_object.setdefault(x.object, []), (start, n, way))
            heapq.heappush(by_origin.setdefault(mine, []), (start, n, way))
            by_object = {o: h for o, h in by_object.items() if h}
        if first is None or x.object == first[1]:
            first = (max(start, first[0]) if first else start, x.object)
        elif start > first[0]:
            first, second = (start, x.object), first
        elif second is None or start > second[0]:
            second = (start, x.object)
        origins[mine] = max(origins.get(mine, start), start)
    ends = {t: c.active for c in chains if not c.over for t in c.takers}
    return (fresh.active if fresh else None), [(f, ends[t]) for t, f in enumerate(takers)]


def composed(runs: Iterable[dict]) -> Iterator[dict]:
    """part, active (the fact that enters) and closed_by of the runs of one slot, from their summaries in order."""
    active, born, out = None, None, []
    for run in runs:
        made = {"part": run["part"], "active": active, "closed_by": None}
        out.append(made)
        if active is None:
            active, born = run["fresh"], made
            continue
        first = next((t for t in run["takers"] if takes_over(Fact(**t["first"]), Fact(**active))), None)
        if first is not None:
            born["closed_by"] = {"fact_id": first["first"]["fact_id"], "valid_from": first["first"]["valid_from"]}
            active, born = first["last"], made
    return iter(out)


def _slots(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal keys."""
    names: list[str] = []

    def rows() -> Iterator[tuple[tuple, tuple]]:
        nonlocal names
        for batch in batches:
            names = batch.schema.names
            columns = [c.to_pylist() for c in batch.columns]
            at = [names.index(k) for k in keys]
            for values in zip(*columns, strict=True):
                yield tuple(values[i] for i in at), values

    for key, some in groupby(rows(), key=lambda r: r[0]):
        yield key, (dict(zip(names, values, strict=True)) for _, values in some)


def _facts(rows: Iterator[dict]) -> Iterator[Fact]:
    return (Fact(*(r[c] for c in FACT)) for r in rows)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def resolve_single(rows: DataFrame, slot: list[str], now: str, cfg, out: str, run: int = RUN) -> DataFrame:
    """The columns `out` for each of rows (as resolution.taking_part gives them, semantics single_active), at most one stored
    active fact to a slot.

    What is known of slots beyond `run` facts are a row or two a run; all else is dealt by key and sorted.
    """
    moment, arrow = pd.Timestamp(now, tz="UTC"), to_arrow_schema(StructType.fromDDL(out))
    arrival = [F.desc("stored"), F.asc("recorded_at"), F.asc("fact_id")]
    key = F.struct(*slot).alias("slot")
    mine = rows.select(key, *FACT)
    counts = mine.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run)
    large = written(counts)
    total = large.agg(F.sum("n").alias("n")).first()["n"] or 0
    arrived = ["slot", "part"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for _, facts in _slots(batches, arrived):
                head = next(facts)
                enters, closed = head["active"], head["closed_by"]
                yield from follow(_facts(chain([head], facts)), moment, cfg, Fact(**enters) if enters else None, tuple(closed.values()) if closed else None)

        return _batches(made(), arrow)

    entering = f"active struct<{STATE.replace(' string', ': string').replace(' timestamp', ': timestamp').replace(' double', ': double')}>, closed_by struct<fact_id: string, valid_from: timestamp>"
    nothing = {"part": F.lit(0), "active": F.lit(None), "closed_by": F.lit(None)}
    kinds = {f.name: f.dataType for f in StructType.fromDDL(entering)}
    columns = [*arrived, *FACT, "active", "closed_by"]
    if not total:
        small = mine.withColumns({c: v.cast(kinds.get(c, "int")) for c, v in nothing.items()})
        return small.repartition("slot").sortWithinPartitions("slot", *arrival).select(*columns).mapInArrow(whole, out)

    small = mine.join(large.select("slot"), "slot", "left_anti").withColumns({c: v.cast(kinds.get(c, "int")) for c, v in nothing.items()})
    hot = mine.join(large.select("slot"), "slot", "left_semi")
    # Ranges of (slot, arrival) are the runs; one range holds several slots only where they begin or end.
    ordered = written(hot.repartitionByRange(total // run + 1, F.col("slot"), *arrival).withColumn("part", F.spark_partition_id()))
    latest = F.max("start").over(W.partitionBy("slot").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = ordered.groupBy(*arrived).agg(F.max("valid_from").alias("start")).select(F.struct(*arrived).alias("run"), latest.alias("latest"))
    state = f"struct<{entering.split('struct<', 1)[1].split('>')[0]}>"
    summed = f"{key_type(mine)}, part int, fresh {state}, takers array<struct<first: {state}, last: {state}>>"
    summed_arrow = to_arrow_schema(StructType.fromDDL(summed))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for _, facts in _slots(batches, arrived):
                head = next(facts)
                fresh, takers = summary(_facts(chain([head], facts)), head["latest"])
                carried = lambda f: {c: getattr(f, c) for c in CARRIED}
                pairs = [{"first": carried(a), "last": carried(b)} for a, b in takers]
                yield {"slot": head["slot"], "part": head["part"], "fresh": carried(fresh) if fresh else None, "takers": pairs}

        return _batches(made(), summed_arrow, 50)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"slot": k[0]} | r for k, some in _slots(batches, ["slot"]) for r in composed(some)), composed_arrow, 50)

    composed_schema = f"{key_type(mine)}, part int, {entering}"
    composed_arrow = to_arrow_schema(StructType.fromDDL(composed_schema))
    in_runs = ordered.withColumn("run", F.struct(*arrived)).join(runs, "run").drop("run")
    summaries = in_runs.repartition(*arrived).sortWithinPartitions(*arrived, *arrival).mapInArrow(summarise, summed)
    entered = summaries.repartition("slot").sortWithinPartitions("slot", "part").mapInArrow(compose, composed_schema)
    entered = entered.select(F.struct(*arrived).alias("run"), "active", "closed_by")
    known = ordered.withColumn("run", F.struct(*arrived)).join(entered, "run").select(*columns)
    every = small.select(*columns).unionByName(known)
    return every.repartition(*arrived).sortWithinPartitions(*arrived, *arrival).mapInArrow(whole, out)


def key_type(rows: DataFrame) -> str:
    return f"slot {rows.schema['slot'].dataType.simpleString()}"
