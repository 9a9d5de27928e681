"""Event journeys, funnels and times between steps; subjects are partitions, nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import time as T
from metrolith.functions.errors import PlanError
from metrolith.plans.frames import Frame
from metrolith.plans.model import Event, Participant, Validity
from metrolith.plans.planner import safety


@dataclass(frozen=True)
class Step:
    event: str
    key: str


def step(*, event: str, key: str) -> Step:
    return Step(event, key)


def sequence(*steps: Step) -> tuple[Step, ...]:
    if len(steps) < 2 or len({s.key for s in steps}) < len(steps):
        raise PlanError("pattern-invalid")
    return steps


@dataclass(frozen=True)
class Matching:
    kind: str = "first_per_subject"
    assignment: str = "exclusive"


def first_per_subject() -> Matching:
    return Matching()


def every_start(*, completion_assignment: str) -> Matching:
    if completion_assignment not in ("exclusive", "shared"):
        raise PlanError("assignment-unknown", completion_assignment)
    return Matching("every_start", completion_assignment)


def _occurrence_key(e: Event) -> tuple[Column, Column]:
    """(id, ts) of an event's rows; a missing one is an error."""
    ts = F.col(e.occurred_at).cast("timestamp_ntz")
    missing = ts.isNull() | reduce(lambda a, b: a | b, (F.col(c).isNull() for c in e.identity))
    safe = F.when(missing, F.raise_error(F.lit(f"event-identity-missing: {e.name}"))).otherwise(ts)
    return F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(e.identity))).alias("id"), safe.cast("timestamp_ntz").alias("ts")


def occurrences(
    catalog, events: list[str], start: datetime | None = None, end: datetime | None = None, cohort: DataFrame | None = None, role: str | None = None
) -> DataFrame:
    """(event, subject, id, ts) of every occurrence in [start, end); subject and id are structs of key columns.

    ``role`` takes the participants of a named role of each event as subjects; the
    cohort then keeps the occurrences in which a member has that role.
    """
    parts = []
    for name in dict.fromkeys(events):
        e = catalog.events[name]
        if role is not None and role not in e.roles:
            raise PlanError("event-role-unknown", f"{name}: {role}")
        subject = e.roles[role] if role is not None else e.subject
        df = catalog.frame(e.entity)
        if isinstance(subject, Participant):
            df, subject = _along(catalog, e, df, subject)
        if e.where is not None:
            df = df.where(e.where(df))
        ts = F.col(e.occurred_at).cast("timestamp_ntz")
        if start is not None:
            df = df.where(ts >= T._ntz(start))
        if end is not None:
            df = df.where(ts < T._ntz(end))
        parts.append(
            df.select(
                F.lit(name).alias("event"), F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(subject))).alias("subject"),
                *_occurrence_key(e),
            )
        )
    out = reduce(DataFrame.unionByName, parts)
    if cohort is not None:
        out = out.join(cohort.select(F.col("subject_identity").alias("_s")), F.col("subject") == F.col("_s"), "left_semi")
    return out


def _along(catalog, e: Event, df: DataFrame, p: Participant, mark: str = "_p") -> tuple[DataFrame, list[str]]:
    """The event's rows with the participant's key, by left joins; a step that could multiply rows is refused."""
    at, prefix = e.entity, ""
    for i, name in enumerate(p.path):
        r = catalog.relationships[name]
        if r.left != at and r.right != at:
            raise PlanError("event-path-broken", f"{e.name}: {name} does not start at {at}")
        forward = r.left == at
        if safety(catalog, r, forward) not in ("one_to_one", "many_to_one"):
            raise PlanError("event-participant-cardinality", f"{e.name}: {name}")
        far = r.right if forward else r.left
        keys = [(a, b) if forward else (b, a) for a, b in r.keys]
        right = catalog.frame(far)
        right = right.select(*(F.col(c).alias(f"{mark}{i}_{c}") for c in right.columns))
        on = reduce(lambda x, y: x & y, (df[f"{prefix}{a}"] == right[f"{mark}{i}_{b}"] for a, b in keys))
        df, at, prefix = df.join(right, on, "left"), far, f"{mark}{i}_"
    if at != p.entity:
        raise PlanError("event-path-broken", f"{e.name}: the path ends at {at}, not {p.entity}")
    return df, [f"{prefix}{c}" for c in catalog.entities[at].primary_key]


def participants(catalog, event: str, roles: list[str]) -> DataFrame:
    """(id, ts, role...) of every occurrence: the participant of each role, as a struct of keys.

    One pass over the event's rows, so rows that repeat an identity are occurrences of their own.
    """
    if not roles or len(set(roles)) < len(roles):
        raise PlanError("event-participant-cardinality", f"{event}: roles must be named, each once")
    e = catalog.events[event]
    for role in roles:
        if role not in e.roles:
            raise PlanError("event-role-unknown", f"{event}: {role}")
    df, found = catalog.frame(e.entity), []
    if e.where is not None:
        df = df.where(e.where(df))
    for n, role in enumerate(roles):
        subject = e.roles[role]
        if isinstance(subject, Participant):
            df, subject = _along(catalog, e, df, subject, f"_r{n}_")
        found.append(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(subject))).alias(role))
    ident, ts = _occurrence_key(e)
    return df.select(ident, ts, *found)


def occurrence_bounds(catalog, event: str) -> DataFrame:
    e = catalog.events[event]
    df = catalog.frame(e.entity)
    df = df.where(e.where(df)) if e.where is not None else df
    return df.agg(F.min(e.occurred_at).alias("first_at"), F.max(e.occurred_at).alias("last_at"), F.count("*").alias("n"))


def watermark(catalog, events: list[str]) -> DataFrame:
    """(event, observed_from, observed_through, occurrences) of each event; what a receipt of coverage states."""
    found = occurrences(catalog, events).groupBy("event").agg(F.min("ts").alias("observed_from"), F.max("ts").alias("observed_through"), F.count("*").alias("occurrences"))
    known = catalog.spark.createDataFrame([(e,) for e in dict.fromkeys(events)], "event string")
    return known.join(found, "event", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def covered_by(receipt: DataFrame) -> datetime | None:
    """The moment through which every event of a watermark is observed; None if one never occurred."""
    r = receipt.agg(F.min("observed_through").alias("t"), F.count_if(F.col("observed_through").isNull()).alias("n")).first()
    return None if r["n"] else r["t"]


def duplicate_identities(catalog, event: str) -> DataFrame:
    """Identities that occur more than once."""
    e = catalog.events[event]
    df = catalog.frame(e.entity)
    df = df.where(e.where(df)) if e.where is not None else df
    return df.groupBy(*e.identity).count().where("count > 1")


def _walk(steps: tuple[Step, ...], ordered: Column, begin: Column) -> Column:
    """The occurrence taken for each step, by one fold over a subject's ordered occurrences."""
    names = F.array(*(F.lit(s.event) for s in steps))
    empty = F.array().cast("array<struct<ts:timestamp_ntz,event:string,id:string>>")

    def merge(acc, o):
        n = F.size(acc)
        tied = (n > 0) & (F.get(acc, n - 1)["ts"] == o["ts"]) & (F.get(acc, n - 1)["event"] != o["event"])
        fits = (n < len(steps)) & (F.get(names, n) == o["event"]) & ((n > 0) | begin(o))
        bad = F.raise_error(F.lit("ambiguous-event-order")).cast("array<struct<ts:timestamp_ntz,event:string,id:string>>")
        return F.when(fits & tied, bad).when(fits, F.concat(acc, F.array(o))).otherwise(acc)

    return F.aggregate(ordered, empty, merge)


_OCCURRENCE = "struct<ts:timestamp_ntz,event:string,id:string>"


def _every_start(steps: tuple[Step, ...], assignment: str, ordered: Column, begin: Column) -> Column:
    """The paths of all journeys of a subject, by one fold over its ordered occurrences.

    Each start takes the earliest later occurrence of each next step.  An exclusive
    occurrence goes to the first journey, by start, that waits for it, and is then no
    start itself; a shared one goes to all.  Journeys that are complete wait no more.
    """
    names = F.array(*(F.lit(s.event) for s in steps))
    empty = F.array().cast(f"array<array<{_OCCURRENCE}>>")
    bad = F.raise_error(F.lit("ambiguous-event-order")).cast(f"array<{_OCCURRENCE}>")

    def merge(acc, o):
        def waits(path):
            return (F.size(path) < len(steps)) & (F.get(names, F.size(path)) == o["event"])

        def taken(path):
            last = F.get(path, F.size(path) - 1)
            tied = (last["ts"] == o["ts"]) & (last["event"] != o["event"])
            return F.when(tied, bad).otherwise(F.concat(path, F.array(o)))

        some = F.exists(acc, waits)
        if assignment == "shared":
            moved = F.transform(acc, lambda p: F.when(waits(p), taken(p)).otherwise(p))
            starts = (o["event"] == steps[0].event) & begin(o)
        else:
            first = F.array_position(F.transform(acc, waits), True) - 1
            moved = F.transform(acc, lambda p, i: F.when(i == first, taken(p)).otherwise(p))
            starts = (o["event"] == steps[0].event) & begin(o) & ~some
        moved = F.when(some, moved).otherwise(acc)
        return F.when(starts, F.concat(moved, F.array(F.array(o)))).otherwise(moved)

    return F.aggregate(ordered, empty, merge)


def match(catalog, *, pattern: tuple[Step, ...], cohort_window: T.TimeScope, completion_through, matching: Matching = Matching(), covered_through=None, cohort=None, role: str | None = None) -> Frame:
    """Journeys: one row for each journey and step, reached or not."""
    through = T._moment(completion_through)
    covered = T._moment(covered_through) if covered_through else through
    rows = occurrences(catalog, [s.event for s in pattern], cohort_window.start, through, cohort, role)
    flat = rows.select("subject", F.struct("ts", "event", F.to_json("id").alias("id")).alias("o"))
    listed = flat.groupBy("subject").agg(F.array_sort(F.collect_list("o")).alias("os"))
    limit = T._ntz(cohort_window.end)
    if matching.kind == "first_per_subject":
        journeys = listed.select("subject", _walk(pattern, F.col("os"), lambda o: o["ts"] < limit).alias("path")).where(F.size("path") > 0)
        journeys = journeys.withColumn("nth", F.lit(0))
    else:
        paths = _every_start(pattern, matching.assignment, F.col("os"), lambda o: o["ts"] < limit)
        journeys = listed.select("subject", F.posexplode(paths).alias("nth", "path"))
    done = F.size("path") == len(pattern)
    status = F.when(done, "complete").when(F.lit(covered >= through), "incomplete").otherwise("coverage_censored")
    journeys = journeys.withColumn("completion_status", status).withColumn("journey_id", F.concat(F.to_json("subject"), F.lit("#"), F.col("nth")))
    keys = F.array(*(F.lit(s.key) for s in pattern))
    each = journeys.select("journey_id", "completion_status", "subject", "path", F.posexplode(keys).alias("place", "step_key"))
    here, before, start = F.get("path", F.col("place")), F.get("path", F.col("place") - 1), F.get("path", F.lit(0))
    out = each.select(
        "journey_id", "completion_status", F.col("subject").alias("subject_identity"), "place", "step_key", here["id"].alias("event_identity"),
        here["ts"].alias("occurred_at"), (here["ts"] - start["ts"]).alias("elapsed_from_start"),
        F.when(F.col("place") > 0, here["ts"] - before["ts"]).alias("elapsed_from_previous"),
    )
    return Frame(out, "event", ("journey_id",), None, ("occurred_at",), scope=cohort_window, meta={"pattern": pattern, "kind": "journey"})


def funnel(journeys: Frame, *, axes: DataFrame | None = None, by: list[str] | None = None) -> Frame:
    """Counts and conversions of each step, whole or by axes of the subject (subject_identity, axis...)."""
    df, by = journeys.df, list(by or ())
    if axes is not None:
        known = axes.select(F.col("subject_identity").alias("_s"), *by)
        df = df.join(known, F.col("subject_identity") == F.col("_s"), "left")
    reached, censored = F.col("occurred_at").isNotNull(), F.col("completion_status") == "coverage_censored"
    w = Window.partitionBy("journey_id").orderBy("place")
    df = df.withColumn("_reached", reached).withColumn("_entered", F.coalesce(F.lag(reached).over(w), F.lit(True)))
    counted = df.groupBy(*by, "place", "step_key").agg(
        F.count("*").alias("cohort_count"), F.count_if(~censored).alias("resolved_cohort_count"), F.count_if("_entered").alias("entry_count"),
        F.count_if("_reached").alias("reached_count"), F.count_if(F.col("_entered") & ~F.col("_reached") & censored).alias("coverage_censored_count"),
    )
    resolved = F.col("entry_count") - F.col("coverage_censored_count")
    first = F.first("reached_count").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("place"))
    out = counted.select(
        *by, "step_key", "cohort_count", "resolved_cohort_count", "entry_count", resolved.alias("resolved_entry_count"), "reached_count",
        (resolved - F.col("reached_count")).alias("lost_count"), F.try_divide(F.col("reached_count"), first).alias("conversion_from_first"),
        F.try_divide(F.col("reached_count"), resolved).alias("conversion_from_previous"),
        F.try_divide(resolved - F.col("reached_count"), resolved).alias("loss_rate_from_previous"), "coverage_censored_count",
    )
    return Frame(out, "event", tuple(by), None, ("reached_count",), meta={**journeys.meta, "kind": "funnel"})


def time_to_event(journeys: Frame, *, start_step: str, end_step: str) -> Frame:
    """One row for each journey that has the start step: how long until the end step."""

    def at(key, c):
        return F.max(F.when(F.col("step_key") == key, F.col(c)))

    out = journeys.df.groupBy("journey_id", "subject_identity", "completion_status").agg(
        at(start_step, "event_identity").alias("start_event_identity"), at(start_step, "occurred_at").alias("start_time"),
        at(end_step, "event_identity").alias("end_event_identity"), at(end_step, "occurred_at").alias("end_time"),
    )
    out = out.where("start_time is not null").withColumn("duration", F.col("end_time") - F.col("start_time"))
    return Frame(out, "event", ("journey_id",), None, ("duration",), meta={**journeys.meta, "kind": "time_to_event"})


def dropped_before(journeys: Frame, key: str) -> DataFrame:
    """(subject_identity): subjects that entered a step and, by full coverage, did not reach it."""
    w = Window.partitionBy("journey_id").orderBy("place")
    reached = F.col("occurred_at").isNotNull()
    df = journeys.df.withColumn("_entered", F.coalesce(F.lag(reached).over(w), F.lit(True)))
    lost = (F.col("step_key") == key) & F.col("_entered") & ~reached & (F.col("completion_status") != "coverage_censored")
    return df.where(lost).select("subject_identity").distinct()


def subject_axes_as_of(subjects: DataFrame, entry: str, snapshot: DataFrame, key: str, partition: str, columns: list[str]) -> DataFrame:
    """Each subject's attributes from the latest partition not after its entry."""
    s = subjects.select("subject_identity", F.col("subject_identity")["k0"].alias("_k"), F.col(entry).cast("date").alias("_at"))
    p = snapshot.select(F.col(key).cast("string").alias("_key"), F.col(partition).cast("date").alias("_p"), *columns)
    joined = s.join(p, (F.col("_k") == F.col("_key")) & (F.col("_p") <= F.col("_at")), "left")
    return joined.groupBy("subject_identity").agg(*(F.max_by(c, "_p").alias(c) for c in columns))


def subject_axes_valid(subjects: DataFrame, entry: str, versions: DataFrame, key: str, v: Validity, columns: list[str]) -> DataFrame:
    """Each subject's attributes from the version that holds at its entry; several that hold are an error, none gives nulls."""
    s = subjects.select("subject_identity", F.col("subject_identity")["k0"].alias("_k"), F.col(entry).alias("_at"))
    p = versions.select(F.col(key).cast("string").alias("_key"), F.col(v.valid_from).alias("_low"), F.col(v.valid_to).alias("_high"), *columns)
    open_ = F.col("_high").isNull()
    for x in v.open_end:
        open_ = open_ if x is None else open_ | (F.col("_high") == F.lit(x))
    upper = F.col("_at") < F.col("_high") if v.interval == "closed_open" else F.col("_at") <= F.col("_high")
    joined = s.join(p, (F.col("_k") == F.col("_key")) & (F.col("_low") <= F.col("_at")) & (open_ | upper), "left")
    found = joined.groupBy("subject_identity").agg(F.count("_key").alias("_n"), *(F.first(c).alias(c) for c in columns))
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("versions-overlap: "), F.to_json("subject_identity")))).otherwise(F.lit(True)).cast("boolean")
    return found.where(one).select("subject_identity", *columns)
