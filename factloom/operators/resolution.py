"""Resolution of incoming facts against stored ones, slot by slot.

A slot is (entity_id, predicate, user_id, derived_version), where a predicate's alias stands for it. append_only predicates
need no fold and are done with windows; the others fold their facts in arrival order (recorded_at, fact_id), one slot at a time.

Facts may come with `stored` (true: it is in the table already, with a `status`), `retracted_at` and `predicate_alias`.
Retracted facts, and stored ones that are neither active nor competing, take no part and give no row. Stored facts come
before all incoming ones, keep what they are and give a row without an outcome that says what they have become.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.operators.graph import derived_closure, written
from factloom.operators.slots import RUN, resolve_single

SLOT = ["entity_id", "predicate", "user_id", "derived_version"]
OUT = (
    "fact_id string, status string, valid_until timestamp, prior_valid_until timestamp, superseded_by string, corroborates string, "
    "outcome string, score double, best_opponent double, dominant string, opponent string"
)


NEEDED = "fact_id object semantics confidence declared_trust learned_trust authority origin_key embedding valid_from valid_until recorded_at".split()


@dataclass(frozen=True)
class Config:
    confidence: float = 0.30
    trust: float = 0.40
    recency: float = 0.20
    authority: float = 0.10
    reject: float = 0.30
    margin: float = 0.15
    similarity: float = 0.85
    event_similarity: float = 0.90
    clamp_end: bool = False


def taking_part(facts: DataFrame) -> DataFrame:
    """The facts that resolution looks at, with canonical predicates, and with stored and status (null: incoming)."""
    rows = facts
    if "predicate_alias" in facts.columns:
        rows = rows.withColumn("predicate", F.coalesce("predicate_alias", "predicate"))
    if "retracted_at" in facts.columns:
        rows = rows.where("retracted_at IS NULL")
    if "stored" not in facts.columns:
        return rows.withColumns({"stored": F.lit(False), "status": F.lit(None).cast("string")})
    rows = rows.withColumn("stored", F.coalesce("stored", F.lit(False)))
    return rows.withColumn("status", F.when(F.col("stored"), F.col("status"))).where("NOT stored OR status IN ('active', 'competing')")


def append_only(facts: DataFrame) -> DataFrame:
    """fact_id, outcome, status, corroborates of each incoming fact of append-only slots.

    A fact corroborates the latest earlier active fact of its slot and object whose origin is another one; without such it is
    INSERTED and active. So among incoming facts only those of one origin stay active: that of the first, unless a stored active
    fact came before. Where stored active facts have several origins, every incoming fact finds one of another origin.
    """
    group = W.partitionBy(*SLOT, "object")
    order = group.orderBy(F.desc("stored"), "recorded_at", "fact_id")
    held = F.when(F.col("stored") & (F.col("status") == "active"), F.struct("recorded_at", "fact_id", F.col("origin_key").alias("o")))
    rows = taking_part(facts).where("NOT stored OR status = 'active'").withColumn("__top", F.max(held).over(group))
    elsewhere = F.when(~F.col("origin_key").eqNullSafe(F.col("__top.o")), held)
    rows = rows.withColumns({"__second": F.max(elsewhere).over(group), "__origin": F.first("origin_key").over(order)})
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    same = F.col("origin_key").eqNullSafe(F.col("__origin"))
    latest = F.last(F.when(same, F.col("fact_id")), ignorenulls=True).over(earlier)
    several = F.when(F.col("origin_key").eqNullSafe(F.col("__top.o")), F.col("__second.fact_id")).otherwise(F.col("__top.fact_id"))
    target = F.when(F.col("__second").isNotNull(), several).when(~same, latest)
    return rows.withColumn("__target", target).where("NOT stored").select(
        "fact_id",
        F.when(F.col("__target").isNotNull(), "CORROBORATED").otherwise("INSERTED").alias("outcome"),
        F.when(F.col("__target").isNotNull(), "corroborating").otherwise("active").alias("status"),
        F.col("__target").alias("corroborates"),
    )


def _overlaps(a: dict, b: dict) -> bool:
    return (b["valid_until"] is None or a["valid_from"] < b["valid_until"]) and (a["valid_until"] is None or b["valid_from"] < a["valid_until"])


def _cosine(a, b) -> float:
    if a is None or b is None:
        return 0.0
    n = min(len(a), len(b))
    x, y = a[:n], b[:n]
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return sum(v * w for v, w in zip(x, y, strict=True)) / size if size else 0.0


def fold_slot(rows: Iterable[dict], now: datetime, cfg: Config) -> Iterator[dict]:
    """The rows of one slot, in arrival order, with what became of each."""
    held: list[dict] = []
    yield from fold_arrivals(rows, held, now, cfg)
    yield from held


def fold_arrivals(rows: Iterable[dict], held: list[dict], now: datetime, cfg: Config) -> Iterator[dict]:
    """Rows that are settled by facts arriving in a slot; held, its facts that are active or competing, changes with them."""
    year = 365 * 86400.0
    for new in rows:
        kind, event = new["semantics"], new["semantics"] == "events"
        age = lambda moment: math.exp(-(now - moment).total_seconds() / year)
        blank = {"score": None, "outcome": None, "superseded_by": None, "corroborates": None, "prior_valid_until": None, "best_opponent": None, "dominant": None, "opponent": None}
        if new.get("stored"):
            held.append(new | blank)
            continue
        parts = (cfg.confidence * new["confidence"], cfg.trust * new["declared_trust"], cfg.recency * (age(new["valid_from"]) if event else 1.0), cfg.authority * new["authority"])
        new |= blank | {"score": sum(parts), "status": "active", "outcome": "INSERTED"}
        if kind in ("bitemporal", "events") and new["score"] < cfg.reject:
            yield new | {"outcome": "REJECTED", "status": "rejected"}
            continue
        pool = [f for f in held if f["status"] == "active" or event]
        if kind != "single_active":
            gate = cfg.event_similarity if event else cfg.similarity
            pool = [f for f in pool if _overlaps(f, new) and _cosine(f["embedding"], new["embedding"]) >= gate]
        same = [f for f in pool if f["object"] == new["object"] and f["origin_key"] != new["origin_key"]]
        if same:
            yield new | {"outcome": "CORROBORATED", "status": "corroborating", "corroborates": max(same, key=lambda f: (f["recorded_at"], f["fact_id"]))["fact_id"]}
            continue
        if not pool:
            held.append(new)
            continue
        day = lambda f: f["valid_from"].date() if event else f["valid_from"]
        later = [f for f in pool if day(f) > day(new)] if kind != "bitemporal" else []
        if later:
            after = min(later, key=lambda f: (f["valid_from"], f["fact_id"]))
            yield new | {"outcome": "INSERTED_HISTORICAL", "status": "superseded", "superseded_by": after["fact_id"], "prior_valid_until": new["valid_until"], "valid_until": after["valid_from"]}
            continue
        scored = [
            (cfg.confidence * f["confidence"], cfg.trust * f["learned_trust"], cfg.recency * age(f["valid_from"] if event else f["recorded_at"]), cfg.authority * f["authority"])
            for f in pool
        ]
        best = max(scored, key=sum)
        gaps = [abs(a - b) for a, b in zip(parts, best, strict=True)]
        new |= {"best_opponent": sum(best), "dominant": ("confidence", "source_trust", "recency", "authority")[gaps.index(max(gaps))], "opponent": pool[scored.index(best)]["fact_id"]}
        losers = [f for f in pool if day(f) < day(new)] if event else pool
        if kind == "single_active" or event and losers or not event and new["score"] >= sum(best) + cfg.margin:
            new["outcome"] = "SUPERSEDED"
            for f in losers:
                end = new["valid_from"]
                if cfg.clamp_end and f["valid_until"] is not None:
                    end = min(end, f["valid_until"])
                f |= {"status": "superseded", "superseded_by": new["fact_id"], "prior_valid_until": f["valid_until"], "valid_until": end}
            for f in pool:
                if event and day(f) >= day(new):
                    f["status"] = "competing"
            yield from losers
            held[:] = [f for f in held if f["status"] != "superseded"]
        else:
            new |= {"outcome": "COMPETING", "status": "competing"}
            for f in pool:
                f["status"] = "competing"
        held.append(new)


def resolve_facts(facts: DataFrame, now: str, cfg: Config = Config(), run: int = RUN) -> DataFrame:
    """OUT columns for each fact of slots that are not append-only, as taking_part() has them.

    facts: SLOT, fact_id, object, semantics (single_active, bitemporal or events), confidence, declared_trust, learned_trust,
    authority, origin_key, embedding, valid_from, valid_until, recorded_at. Scores and trust are joined on before; only the
    decision that depends on arrival order is folded: slots of one active fact by slots.resolve_single, which splits hot ones,
    the others one slot at a time.
    """
    arrow = to_arrow_schema(StructType.fromDDL(OUT))
    cut = pd.Timestamp(now, tz="UTC")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, slot in groupby(rows, key=lambda r: tuple(r[c] for c in SLOT)):
            done = fold_slot(slot, cut, cfg)
            while some := list(islice(done, 5_000)):
                yield pa.RecordBatch.from_pylist(some, schema=arrow)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots are small; a few thousand rows make a batch."""
        some: list[pa.RecordBatch] = []
        for batch in fold(batches):
            some.append(batch)
            if sum(b.num_rows for b in some) >= 5_000:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some = []
        yield from pa.Table.from_batches(some, schema=arrow).combine_chunks().to_batches()

    stamps = {c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_until", "recorded_at")}
    # Read by the count of slots, by chains and by the fold: what made the facts must not be done for each of them.
    rows = written(taking_part(facts).select(*SLOT, *NEEDED, "stored", "status").withColumns(stamps))
    chained = F.col("semantics").eqNullSafe("single_active")
    if "stored" in facts.columns:
        # A slot with several stored active facts is no chain yet; its next fact makes it one.
        active = F.when(F.col("stored") & (F.col("status") == "active"), 1)
        rows = rows.withColumn("__several", F.count(active).over(W.partitionBy(*SLOT)) > 1)
        chained = chained & ~F.col("__several")
    single = resolve_single(rows.where(chained).drop("__several"), SLOT, now, cfg, OUT, run)
    rows = rows.where(~chained).drop("__several")
    sorted_slots = rows.repartition(*SLOT).sortWithinPartitions(*SLOT, F.desc("stored"), "recorded_at", "fact_id")
    return single.unionByName(sorted_slots.mapInArrow(gathered, OUT))


def conflict_details(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, opponent, outcome, dominant, margin, and whether the two differ in predicate, object, valid_from and source, of
    each fact that met an opponent. The source is origin_key; facts may have any further columns."""
    sides = ("predicate", "object", "valid_from", "origin_key")
    known = written(facts.select("fact_id", *sides))
    of = lambda key, end: known.select(F.col("fact_id").alias(key), *(F.col(c).alias(f"{c}_{end}") for c in sides))
    met = resolved.where("opponent IS NOT NULL").select("fact_id", "opponent", "outcome", "dominant", (F.col("score") - F.col("best_opponent")).alias("margin"))
    both = met.join(of("fact_id", "a"), "fact_id").join(of("opponent", "b"), "opponent")
    differ = lambda c, name: (~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{name}_differs")
    return both.select("fact_id", "opponent", "outcome", "dominant", "margin", differ("predicate", "predicate"), differ("object", "object"), differ("valid_from", "start"), differ("origin_key", "source"))


def explain_conflicts(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """Per outcome and dominant dimension: decisions, mean margin, and how many differ in each part of the slot's claim."""
    parts = ("predicate_differs", "object_differs", "start_differs", "source_differs")
    return conflict_details(resolved, facts).groupBy("outcome", "dominant").agg(F.count("*").alias("n"), F.avg("margin").alias("margin"), *(F.count_if(c).alias(c) for c in parts))


def predict_outcomes(current: DataFrame, candidates: DataFrame, now: str, cfg: Config = Config()) -> DataFrame:
    """The outcome each candidate alone would meet, nothing written: each meets its own copy of what its slot has open.

    current: stored facts as resolve_facts takes them. Without `stored` they are first resolved among themselves, once, so
    that only facts that are still active or competing are copied, not whole slots. What that leaves is written once.
    """
    if "stored" not in current.columns:
        ended = resolve_facts(current, now, cfg).where("status IN ('active', 'competing')").select("fact_id", "status", F.col("valid_until").alias("__until"))
        plain = current.drop("status", "retracted_at").join(ended, "fact_id")
        current = plain.withColumn("valid_until", F.col("__until").cast(current.schema["valid_until"].dataType)).drop("__until").withColumn("stored", F.lit(True))
        current = written(current.select(*(c for c in dict.fromkeys([*SLOT, "predicate_alias", *NEEDED, "stored", "status"]) if c in current.columns)))
    stored = taking_part(current)
    asked = taking_part(candidates.drop("stored"))
    copies = asked.select(*(F.col(c).alias(f"__{c}") for c in SLOT), F.col("fact_id").alias("__case"))
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SLOT]
    columns = [*SLOT, *NEEDED, "stored", "status", "__case"]
    copied = stored.join(copies, match).select(columns)
    every = copied.unionByName(asked.withColumn("__case", F.col("fact_id")).select(columns))
    own = every.withColumn("derived_version", F.concat_ws("\u0001", "derived_version", "__case")).drop("__case")
    resolved = resolve_facts(own, now, cfg).where("outcome IS NOT NULL")
    return resolved.select("fact_id", "outcome", "score", "best_opponent", "dominant")


def retract(facts: DataFrame, ids: DataFrame, links: DataFrame, now: Column, reason: str) -> DataFrame:
    """facts with those of ids (fact_id) retracted, all that derives from them (links: fact_id, parent) as well, and facts that
    they had superseded active again with their earlier end.

    A fact that is retracted already keeps its state, and nothing goes or comes back because of it; nor does the cascade pass
    through it. The end of a retracted fact stays if it has one and is `now` otherwise; what is derived ends now. Only facts
    superseded by one of ids come back, with retraction_reason 'superseded' where facts have that column.
    """
    open_ = facts.where("retracted_at IS NULL").select("fact_id")
    hit = written(ids.select("fact_id").distinct().join(open_, "fact_id", "left_semi"))
    below = derived_closure(written(links.select("fact_id", "parent").join(open_, "fact_id", "left_semi")), hit)
    old_reason = F.col("retraction_reason") if "retraction_reason" in facts.columns else F.lit(None).cast("string")
    may = F.col("status") == "superseded"
    if "retraction_reason" in facts.columns:
        may = may & F.coalesce(old_reason == "superseded", F.lit(False))
    # A narrow row for each fact that changes: whole facts meet them by one key, and by none that is often null.
    freed = facts.where(may).select("fact_id", F.col("superseded_by").alias("by")).join(hit.select(F.col("fact_id").alias("by")), "by", "left_semi")
    mark = lambda df, hit, low, by: df.select("fact_id", F.lit(hit).alias("hit"), F.lit(low).alias("low"), by.alias("by"))
    none = F.lit(None).cast(facts.schema["superseded_by"].dataType)
    marks = mark(hit, True, False, none).union(mark(below, False, True, none)).union(mark(freed, False, False, F.col("by")))
    marks = marks.groupBy(F.col("fact_id").alias("__id")).agg(F.max("hit").alias("__hit"), F.max("low").alias("__low"), F.collect_set("by").alias("__by"))
    marked = facts.join(marks, F.col("fact_id").eqNullSafe(F.col("__id")), "left")
    root, low = (F.coalesce(f"__{n}", F.lit(False)) for n in ("hit", "low"))
    back = may & F.coalesce(F.array_contains("__by", F.col("superseded_by")), F.lit(False)) & ~root & ~low
    end = F.when(root, F.coalesce("valid_until", now)).when(low, now).when(back, F.col("prior_valid_until")).otherwise(F.col("valid_until"))
    made = {
        "status": F.when(root | low, "retracted").when(back, "active").otherwise(F.col("status")),
        "retracted_at": F.when(root | low, now).otherwise(F.col("retracted_at")),
        "valid_until": end,
        "superseded_by": F.when(~back, F.col("superseded_by")),
        "prior_valid_until": F.when(~back, F.col("prior_valid_until")),
        "retraction_reason": F.when(root, reason).when(low, f"parent retracted: {reason}").when(~back, old_reason),
    }
    return marked.select(*(c for c in facts.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def apply_corroboration(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """facts with younger ones of pairs (younger, elder) corroborating, and origin_count of elders: their distinct other origins."""
    young = pairs.select(F.col("younger").alias("fact_id"), "elder")
    origins = young.join(facts.select("fact_id", "origin_key"), "fact_id").groupBy(F.col("elder").alias("fact_id")).agg(F.count_distinct("origin_key").alias("origin_count"))
    joined = facts.join(young, "fact_id", "left").join(origins, "fact_id", "left")
    return joined.withColumn("status", F.when(F.col("elder").isNotNull(), "corroborating").otherwise(F.col("status"))).withColumnRenamed("elder", "corroborates")


def _rooted(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    known = roots.select(F.col("candidate_id").alias(f"__{name}"), F.col("root").alias(name)).dropDuplicates([f"__{name}"])
    return rows.join(known, F.col(column) == F.col(f"__{name}"), "left").drop(f"__{name}")


def _placed_facts(facts: DataFrame, roots: DataFrame) -> DataFrame:
    reason = F.when(F.col("entity").isNull(), "orphan_entity").when(F.col("predicate").isNull() | F.col("object").isNull(), "malformed_fact")
    return _rooted(facts, roots, "subject", "entity").withColumn("reason", reason)


def _placed_relations(relations: DataFrame, roots: DataFrame) -> DataFrame:
    ends = _rooted(_rooted(relations, roots, "from_id", "src"), roots, "to_id", "dst")
    lost = F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") == F.col("dst"))
    return ends.withColumn("reason", F.when(lost, "orphan_relation"))


def merge_candidates(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """entity, predicate, object, confidence, leader, contributors: staged facts (candidate_id, subject, predicate, object,
    confidence) of one entity that say the same, over roots (candidate_id of the subject, root).

    Objects are equal up to white space. The leader has the greatest confidence, of several the least id, and gives the object.
    What rejected_candidates names takes no part.
    """
    plain = F.regexp_replace(F.trim("object"), r"\s+", " ")
    placed = _placed_facts(facts, roots).where("reason IS NULL").withColumn("__same", plain)
    lead = F.struct(-F.col("confidence"), F.col("candidate_id"))
    merged = placed.groupBy("entity", "predicate", "__same").agg(
        F.max("confidence").alias("confidence"), F.min_by(F.struct("candidate_id", "object"), lead).alias("l"), F.count("*").alias("contributors")
    )
    return merged.select("entity", "predicate", F.col("l.object").alias("object"), "confidence", F.col("l.candidate_id").alias("leader"), "contributors")


def merge_relations(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """src, dst, kind, confidence (the greatest), leader (the least id), contributors of staged relations (candidate_id, from_id, to_id,
    kind, confidence) whose ends are two known entities."""
    placed = _placed_relations(relations, roots).where("reason IS NULL")
    return placed.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min("candidate_id").alias("leader"), F.count("*").alias("contributors"))


def rejected_candidates(facts: DataFrame, relations: DataFrame, roots: DataFrame) -> DataFrame:
    """candidate_id, kind, reason: facts of no known entity (orphan_entity) or without predicate or object (malformed_fact), and
    relations without two known and different ends (orphan_relation)."""
    lost = _placed_facts(facts, roots).select("candidate_id", F.lit("fact").alias("kind"), "reason")
    return lost.unionByName(_placed_relations(relations, roots).select("candidate_id", F.lit("relation").alias("kind"), "reason")).where("reason IS NOT NULL")


def refresh_summaries(summaries: DataFrame, links: DataFrame, facts: DataFrame, hops: int = 8, summary: Callable[[Column], Column] | None = None) -> DataFrame:
    """fact_id, n, text, confidence, valid_from, valid_until, derived_from of stale summaries rebuilt from their parents' current
    facts, by start; n = 0: no parent is left, retract.

    Parents (links: fact_id, parent) are followed along superseded_by for `hops` steps at most, as long as the successor exists;
    retracted ends drop out. Two parents with one current fact count it twice. valid_until is the last one's end, or its start
    if it is open. summary makes the text of the array of objects; by default they are joined.
    """
    joined = summary or (lambda lines: F.array_join(lines, "; "))
    at = links.select("fact_id", "parent").distinct().join(summaries.select("fact_id"), "fact_id", "left_semi").select("fact_id", F.col("parent").alias("at"))
    step = facts.where("superseded_by IS NOT NULL").select(F.col("fact_id").alias("__f"), F.col("superseded_by").alias("__n"))
    step = step.join(facts.select(F.col("fact_id").alias("__n")), "__n", "left_semi")
    for _ in range(hops):
        at = at.join(step, F.col("at") == F.col("__f"), "left").select("fact_id", F.coalesce("__n", "at").alias("at"))
    live = facts.where("retracted_at IS NULL").select(F.col("fact_id").alias("at"), "object", "confidence", "valid_from", "valid_until")
    built = at.join(live, "at").groupBy("fact_id").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("valid_from", "at", "object", "valid_until"))).alias("l")
    )
    last = F.element_at("l", -1)
    built = built.select(
        "fact_id", "n", joined(F.transform("l", lambda x: x["object"])).alias("text"), "confidence", F.col("l")[0]["valid_from"].alias("valid_from"),
        F.coalesce(last["valid_until"], last["valid_from"]).alias("valid_until"), F.transform("l", lambda x: x["at"]).alias("derived_from"),
    )
    return summaries.select("fact_id").join(built, "fact_id", "left").na.fill({"n": 0})


def apply_refresh(facts: DataFrame, refreshed: DataFrame, now: Column) -> DataFrame:
    """facts (with stale_at) with the summaries of refresh_summaries rewritten and no longer stale, and those without parents retracted."""
    new = refreshed.select("fact_id", *(F.col(c).alias(f"__{c}") for c in ("n", "text", "confidence", "valid_from", "valid_until")))
    joined = facts.join(new, "fact_id", "left")
    made, gone = F.coalesce(F.col("__n") > 0, F.lit(False)), F.coalesce(F.col("__n") == 0, F.lit(False))
    of = {"object": "text", "confidence": "confidence", "valid_from": "valid_from", "valid_until": "valid_until"}
    changed = {c: F.when(made, F.col(f"__{n}")).otherwise(F.col(c)) for c, n in of.items()} | {
        "status": F.when(gone, "retracted").otherwise(F.col("status")), "retracted_at": F.when(gone, F.coalesce("retracted_at", now)).otherwise(F.col("retracted_at")),
        "stale_at": F.when(~(made | gone), F.col("stale_at")),
    }
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in facts.columns))


def artifact_invalidation(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    """artifacts (entity_id) with dirty set where a fact of their entity changed."""
    hit = changed.select("entity_id").distinct().withColumn("__hit", F.lit(True))
    return artifacts.join(hit, "entity_id", "left").withColumn("dirty", F.coalesce("__hit", F.lit(False))).drop("__hit")


def build_artifacts(facts: DataFrame, predicates: list[str]) -> DataFrame:
    """One row per entity with its current objects of each predicate, newest first."""
    values = lambda p: F.transform(F.sort_array(F.collect_list(F.when(F.col("predicate") == p, F.struct("valid_from", "fact_id", "object"))), asc=False), lambda x: x["object"])
    return facts.where("status = 'active'").groupBy("entity_id").agg(*(F.array_join(values(p), ", ").alias(p) for p in predicates))


def compile_artifacts(facts: DataFrame, entities: DataFrame, templates: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    """entity_id, type, text: one page for each entity whose type has a template.

    A template is a list of (title, predicate, form): `latest` shows the newest active object, `list` all of them, newest first,
    `count` how many there are. A section without facts is left out; a page without sections has an empty text.
    """
    objects = lambda p: F.transform(F.sort_array(F.collect_list(F.when(F.col("predicate") == p, F.struct("valid_from", "fact_id", "object"))), asc=False), lambda x: x["object"])
    used = sorted({p for sections in templates.values() for _, p, _ in sections})
    held = facts.where("status = 'active'").where(F.col("predicate").isin(*used)).groupBy("entity_id").agg(*(objects(p).alias(f"__{i}") for i, p in enumerate(used)))
    pages = entities.where(F.col("type").isin(*templates)).select("entity_id", "type").join(held, "entity_id", "left")
    text = None
    for kind, sections in templates.items():
        parts = []
        for title, predicate, form in sections:
            said = F.col(f"__{used.index(predicate)}")
            shown = {"latest": said[0], "list": F.array_join(said, ", "), "count": F.size(said).cast("string")}[form]
            parts.append(F.when(F.size(said) > 0, F.concat(F.lit(f"{title}: "), shown)))
        made = F.concat_ws("\n", *parts)
        text = F.when(F.col("type") == kind, made) if text is None else text.when(F.col("type") == kind, made)
    return pages.select("entity_id", "type", text.alias("text"))


def propositions_to_facts(props: DataFrame, turns: DataFrame) -> DataFrame:
    """fact rows of propositions (prop_id, subject, predicate, object, date_text, turn_indexes) of a session's turns (session_id,
    turn_index, occurred_at, user_id): the stated date if it is one, else the session's; dropped without turns, with a turn
    outside of the session, or with turns of two users."""
    session = turns.groupBy("session_id").agg(F.max("turn_index").alias("last"), F.min("occurred_at").alias("session_at"))
    cited = props.join(session, "session_id").select("*", F.explode("turn_indexes").alias("turn_index"))
    met = cited.join(turns.select("session_id", "turn_index", F.col("user_id").alias("turn_user"), F.col("occurred_at").alias("turn_at")), ["session_id", "turn_index"], "left")
    rows = met.groupBy("prop_id", "subject", "predicate", "object", "date_text", "session_at").agg(
        F.count_if(F.col("turn_at").isNull()).alias("outside"), F.count_distinct("turn_user").alias("users"), F.min("turn_user").alias("user_id"),
        F.min_by("turn_at", "turn_index").alias("mentioned_at"), F.min("turn_index").alias("turn_index"),
    ).where("outside = 0 AND users <= 1")
    return rows.select("prop_id", "subject", "predicate", "object", F.coalesce(F.expr("try_to_timestamp(date_text, 'yyyy-MM-dd')"), F.col("session_at").cast("timestamp")).alias("valid_from"), "mentioned_at", "turn_index", "user_id")
