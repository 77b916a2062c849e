"""Keyed state: facts resolved as they arrive, and changes put in the order of their versions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.resolution import NEEDED, OUT, SLOT, Config, fold_arrivals

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MOMENTS = ("valid_from", "valid_until", "recorded_at", "prior_valid_until")
#: Moments are microseconds in rows and in state.
MADE = OUT.replace("timestamp", "long").replace("fact_id string, ", "")
HELD = (
    "fact_id string, object string, semantics string, confidence double, declared_trust double, learned_trust double, authority double, "
    f"origin_key string, embedding array<double>, valid_from long, recorded_at long, {MADE}"
)
FIELDS = [part.split()[0] for part in HELD.split(", ")]
RESULT = [part.split()[0] for part in OUT.split(", ")]
Resolved = Row(*RESULT, "revision")


class SlotResolver(StatefulProcessor):
    """Folds the facts of a slot batch by batch; its state is the slot's open facts and a count of batches."""

    def __init__(self, now: str, cfg: Config, zone: str) -> None:
        self.now, self.cfg, self.zone = now, cfg, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", HELD)
        self.batches = handle.getValueState("batches", "n long")
        zone = ZoneInfo(self.zone)
        self.moment = datetime.fromisoformat(self.now).replace(tzinfo=timezone.utc)
        self.read = lambda us: None if us is None else (EPOCH + timedelta(microseconds=us)).astimezone(zone)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = [self._fact(dict(zip(FIELDS, kept, strict=True))) for kept in self.open.get()]
        before = {f["fact_id"]: self._result(f) for f in held}
        arrived = sorted((self._fact(r.asDict()) for r in rows), key=lambda f: (f["recorded_at"], f["fact_id"]))
        settled = list(fold_arrivals(arrived, held, self.moment, self.cfg))
        number = (self.batches.get()[0] if self.batches.exists() else 0) + 1
        self.batches.update((number,))
        if held:
            self.open.put([tuple(self._plain(f.get(c)) for c in FIELDS) for f in held])
        else:
            self.open.clear()
        for f in [*settled, *held]:
            made = self._result(f)
            if before.get(f["fact_id"]) != made:
                yield Resolved(*made, number)

    def _fact(self, values: dict) -> dict:
        return values | {c: self.read(values[c]) for c in MOMENTS if c in values}

    @staticmethod
    def _plain(value: object) -> object:
        return (value - EPOCH) // timedelta(microseconds=1) if isinstance(value, datetime) else value

    def _result(self, fact: dict) -> tuple:
        return tuple(self._plain(fact.get(c)) for c in RESULT)


def resolve_stream(facts: DataFrame, now: str, cfg: Config = Config()) -> DataFrame:
    """OUT columns and `revision` for each fact of a stream when it arrives and whenever a later one changes it; update mode.

    facts as resolution.resolve_facts takes them, all incoming, none append-only; each batch is taken in order of (recorded_at,
    fact_id) behind those before. State holds the open facts of a slot, so a batch costs what arrives and what is open. Of a
    fact's rows the one with the greatest revision is the last: see latest_revision(). Needs the RocksDB state store.
    """
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in MOMENTS else F.col(c) for c in NEEDED]
    zone = facts.sparkSession.conf.get("spark.sql.session.timeZone")
    made = facts.select(*SLOT, *micros).groupBy(*SLOT).transformWithState(
        SlotResolver(now, cfg, zone), OUT.replace("timestamp", "long") + ", revision long", "Update", "None"
    )
    return made.select(*(F.timestamp_micros(c).alias(c) if c in MOMENTS else F.col(c) for c in RESULT), "revision")


def latest_revision(resolved: DataFrame) -> DataFrame:
    """Each fact as its last revision left it."""
    last = F.max_by(F.struct(*(c for c in resolved.columns if c not in ("fact_id", "revision"))), "revision").alias("r")
    return resolved.groupBy("fact_id").agg(last).select("fact_id", "r.*").select(*(c for c in resolved.columns if c != "revision"))


CHANGE = "op string, record_id string, row string, version long, at timestamp"
NAMES = [part.split()[0] for part in CHANGE.split(", ")]
Ordered = Row("source", *NAMES, "place")


class ChangeOrder(StatefulProcessor):
    """Holds a source's changes until the watermark has passed them, and gives them by version behind a cursor."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", CHANGE.replace("at timestamp", "at long"))
        self.cursor = handle.getValueState("cursor", "version long")

    def _release(self, key: tuple, more: list[tuple], watermark: int) -> Iterator[Row]:
        passed = self.cursor.get()[0] if self.cursor.exists() else None
        by_key = {(c[3], c[1]): c for c in [*self.waiting.get(), *more] if passed is None or c[3] > passed}
        due = [c[3] for c in by_key.values() if c[4] // 1000 <= watermark]
        upto = max(due, default=None)
        out = sorted(k for k in by_key if upto is not None and k[0] <= upto)
        left = [c for k, c in by_key.items() if upto is None or k[0] > upto]
        if upto is not None:
            self.cursor.update((upto,))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        for place, k in enumerate(out):
            yield Ordered(*key, *by_key[k], place)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        arrived = [tuple(r[c] for c in NAMES) for r in rows]
        for at in {c[4] // 1000 for c in arrived}:
            self.handle.registerTimer(at + 1)
        yield from self._release(key, arrived, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield from self._release(key, [], timerValues.getCurrentWatermarkInMs())


def ordered_changes(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """source, op, record_id, row, version, at, place: each source's changes in the order of their versions, each version once.

    changes: source and the columns of CHANGE. A change leaves when the watermark (delay behind the latest `at`) has passed it
    or a higher version; lower versions that wait leave before it. The highest version that has left is the source's cursor: it
    is kept with the state, committed with the batch, and nothing at or below it leaves again, however late it comes. Within
    a batch a source's rows come in order, numbered by place.
    """
    late = changes.withWatermark("at", delay)
    micros = [F.unix_micros("at").alias("at") if c == "at" else F.col(c) for c in NAMES]
    made = late.select("source", *micros, F.col("at").alias("event")).groupBy("source")
    out = made.transformWithState(ChangeOrder(), "source string, " + CHANGE.replace("at timestamp", "at long") + ", place int", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))
