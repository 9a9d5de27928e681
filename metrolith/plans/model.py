"""The semantic layer: entities, fields, metrics, relationships, events, state models.

A ``Catalog`` holds the declarations of one project and checks them when they are
made.  Field bodies are Spark expressions: a column name, or a callable that
takes the entity's DataFrame and returns a Column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrolith.functions import periods
from metrolith.functions.errors import PlanError
from metrolith.functions.time import Grain, Parse

Body = str | Callable[[DataFrame], Column]
AGGREGATES = ("sum", "count", "count_distinct", "min", "max", "mean", "median")


@dataclass(frozen=True)
class SemiAdditive:
    """Adds over everything but ``over``, along which it is folded."""

    over: str
    fold: str | tuple[str, float]


@dataclass(frozen=True)
class Snapshot:
    """One whole copy of the entity for each day partition."""

    partition: str
    format: str | None = None


@dataclass(frozen=True)
class Validity:
    """Rows hold from valid_from to valid_to; null or a sentinel means still open."""

    valid_from: str
    valid_to: str
    interval: str = "closed_open"
    open_end: tuple = (None,)


@dataclass(frozen=True)
class Entity:
    name: str
    source: Callable[[SparkSession], DataFrame]
    primary_key: tuple[str, ...] = ()
    versioning: Snapshot | Validity | None = None


@dataclass(frozen=True)
class Field:
    name: str
    entity: str
    body: Body
    kind: str = "dimension"  # dimension | time | measure
    granularity: str | None = None
    parse: Parse = Parse()
    default: bool = False
    additivity: str | SemiAdditive = "additive"
    unit: str | None = None

    @property
    def id(self) -> str:
        return f"{self.entity}.{self.name}"

    def of(self, df: DataFrame) -> Column:
        return df[self.body] if isinstance(self.body, str) else self.body(df)


@dataclass(frozen=True)
class Relationship:
    name: str
    left: str
    right: str
    keys: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Metric:
    """kind: aggregate, count, weighted_mean, body, ratio, linear, cumulative, slice."""

    name: str
    kind: str
    entity: str | None = None
    measure: str | None = None
    agg: str | tuple[str, float] | None = None
    weight: str | None = None
    where: tuple[tuple[str, Any], ...] = ()
    children: tuple[tuple[int, str], ...] = ()  # (sign, metric name)
    body: Callable[[DataFrame], Column] | None = None
    fanout: str = "block"
    additivity: str | SemiAdditive = "additive"
    anchor: Grain | CalendarAnchor | tuple[int, str] | None = None  # Grain, CalendarAnchor: to date; (n, unit): trailing
    over: str | None = None
    zero_division: str = "null"
    unit: str | None = None
    sql: str | None = None


@dataclass(frozen=True)
class Participant:
    """An entity that an event's own entity reaches along relationships, each to one row at most; known by its primary key."""

    entity: str
    path: tuple[str, ...]


@dataclass(frozen=True)
class Event:
    name: str
    entity: str
    identity: tuple[str, ...]
    occurred_at: str
    subject: tuple[str, ...]
    where: Callable[[DataFrame], Column] | None = None
    roles: Mapping[str, tuple[str, ...] | Participant] = field(default_factory=dict)  # other participants: name -> key columns, or a path


@dataclass(frozen=True)
class StateModel:
    """States, the events that begin a life, and (from, event, to) transitions."""

    name: str
    subject: str
    states: tuple[str, ...]
    initial: str
    terminal: tuple[str, ...]
    inceptions: tuple[str, ...]
    transitions: tuple[tuple[str, str, str], ...]


@dataclass(frozen=True)
class PeriodCalendar:
    """Civil date -> period keys by level, as a small table; checked to be exhaustive and contiguous."""

    name: str
    source: Callable[[SparkSession], DataFrame]
    date: str
    levels: Mapping[str, str]
    correspondences: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # name -> (level, column of the baseline key)


@dataclass(frozen=True)
class CalendarAnchor:
    """To date within the periods of a calendar's level."""

    calendar: str
    level: str


def additivity_of(parts: list[str | SemiAdditive]) -> str:
    """A linear combination adds up only if every term does."""
    return "additive" if all(p == "additive" for p in parts) else "non_additive"


def derived_unit(kind: str, units: list[str | None]) -> str | None:
    """Units of a ratio (cancel or a/b) and of a sum (alike or none)."""
    if kind == "ratio":
        a, b = units
        return None if a is None and b is None else "1" if a == b else f"{a or '1'}/{b or '1'}"
    return units[0] if len(set(units)) == 1 else None


class Catalog:
    """One project's declarations."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entities: dict[str, Entity] = {}
        self.fields: dict[str, Field] = {}
        self.metrics: dict[str, Metric] = {}
        self.relationships: dict[str, Relationship] = {}
        self.events: dict[str, Event] = {}
        self.state_models: dict[str, StateModel] = {}
        self.calendars: dict[str, PeriodCalendar] = {}
        self.edges: list[tuple[str, str, str]] = []  # ontology: (from, kind, to)
        self._frames: dict[str, DataFrame] = {}

    def _add(self, table: dict, key: str, value):
        if key in table:
            raise PlanError("duplicate-name", key)
        table[key] = value
        return key

    def _entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise PlanError("entity-unknown", name)
        return self.entities[name]

    def field(self, ref: str) -> Field:
        """By ``entity.name``, or by a bare name that only one entity has."""
        if ref in self.fields:
            return self.fields[ref]
        found = [f for f in self.fields.values() if f.name == ref]
        if len(found) != 1:
            raise PlanError("field-ref-ambiguous" if found else "field-unknown", ref)
        return found[0]

    def metric_of(self, ref: str | Metric) -> Metric:
        if isinstance(ref, Metric):
            return ref
        if ref not in self.metrics:
            raise PlanError("metric-unknown", ref)
        return self.metrics[ref]

    # --- declarations -----------------------------------------------------------

    def entity(self, name, source, *, primary_key=(), versioning=None) -> str:
        made = source if callable(source) else lambda spark: source
        return self._add(self.entities, name, Entity(name, made, tuple(primary_key), versioning))

    def dimension(self, name, entity, body: Body | None = None) -> str:
        self._entity(entity)
        return self._add(self.fields, f"{entity}.{name}", Field(name, entity, body or name))

    def time_dimension(self, name, entity, body=None, *, granularity="day", parse=Parse(), default=False) -> str:
        self._entity(entity)
        made = Field(name, entity, body or name, "time", granularity, parse, default)
        return self._add(self.fields, made.id, made)

    def measure(self, name, entity, body=None, *, additivity="additive", unit=None) -> str:
        self._entity(entity)
        made = Field(name, entity, body or name, "measure", additivity=additivity, unit=unit)
        return self._add(self.fields, made.id, made)

    def relationship(self, name, left, right, keys) -> str:
        self._entity(left), self._entity(right)
        return self._add(self.relationships, name, Relationship(name, left, right, tuple(map(tuple, keys))))

    def _metric(self, m: Metric) -> str:
        return self._add(self.metrics, m.name, m)

    def aggregate(self, name, measure, agg, *, where=None, unit=None) -> str:
        f = self.field(measure)
        ok = agg in AGGREGATES or (isinstance(agg, tuple) and agg[0] == "percentile" and 0 <= agg[1] <= 1)
        if not ok:
            raise PlanError("aggregate-unknown", str(agg))
        if f.additivity == "non_additive" and agg == "sum":
            raise PlanError("sum-of-non-additive", f.id)
        return self._metric(
            Metric(
                name, "aggregate", f.entity, f.id, agg, where=tuple((where or {}).items()),
                additivity=f.additivity if agg == "sum" else "additive" if agg == "count" else "non_additive",
                unit=unit or f.unit,
            )
        )

    def count(self, name, entity, *, where=None) -> str:
        self._entity(entity)
        return self._metric(Metric(name, "count", entity, where=tuple((where or {}).items())))

    def weighted_mean(self, name, value, weight, *, where=None) -> str:
        v, w = self.field(value), self.field(weight)
        if v.entity != w.entity:
            raise PlanError("weighted-mean-entities", f"{v.id}, {w.id}")
        return self._metric(
            Metric(name, "weighted_mean", v.entity, v.id, weight=w.id, where=tuple((where or {}).items()), additivity="non_additive")
        )

    def metric(self, name, entity, body, *, additivity="non_additive", fanout="block", sql=None) -> str:
        if fanout not in ("block", "aggregate_then_join"):
            raise PlanError("fanout-policy-unknown", fanout)
        self._entity(entity)
        return self._metric(Metric(name, "body", entity, body=body, additivity=additivity, fanout=fanout, sql=sql))

    def ratio(self, name, numerator, denominator, *, zero_division="null") -> str:
        parts = [self.metric_of(numerator), self.metric_of(denominator)]
        return self._metric(
            Metric(
                name, "ratio", children=((1, parts[0].name), (1, parts[1].name)), additivity="non_additive",
                zero_division=zero_division, unit=derived_unit("ratio", [p.unit for p in parts]),
            )
        )

    def linear(self, name, add, subtract=()) -> str:
        kids = [(1, m) for m in add] + [(-1, m) for m in subtract]
        parts = [self.metric_of(m) for _, m in kids]
        return self._metric(
            Metric(
                name, "linear", children=tuple(kids), additivity=additivity_of([p.additivity for p in parts]),
                unit=derived_unit("linear", [p.unit for p in parts]),
            )
        )

    def cumulative(self, name, base, *, over=None, anchor=None) -> str:
        b = self.metric_of(base)
        if b.kind == "aggregate" and b.agg not in ("sum", "count", "count_distinct") or b.kind not in ("aggregate", "count", "weighted_mean"):
            raise PlanError("cumulative-base", b.name)
        return self._metric(Metric(name, "cumulative", b.entity, children=((1, b.name),), anchor=anchor, over=over, additivity="non_additive"))

    def slice(self, name, metric, by) -> str:
        return self._metric(Metric(name, "slice", children=((1, self.metric_of(metric).name),), where=tuple(by.items())))

    def event(self, name, entity, *, identity, occurred_at, subject, where=None, roles=None) -> str:
        self._entity(entity)
        named = {k: v if isinstance(v, Participant) else tuple(v) for k, v in (roles or {}).items()}
        for p in named.values():
            for r in p.path if isinstance(p, Participant) else ():
                if r not in self.relationships:
                    raise PlanError("relationship-unknown", r)
        return self._add(self.events, name, Event(name, entity, tuple(identity), occurred_at, tuple(subject), where, named))

    def state_model(self, name, subject, *, states, initial, inceptions, transitions, terminal=()) -> str:
        known = set(states)
        used = {initial, *terminal, *(s for a, _, b in transitions for s in (a, b))}
        if used - known:
            raise PlanError("state-unknown", ", ".join(sorted(used - known)))
        if len({(a, e) for a, e, _ in transitions}) < len(transitions):
            raise PlanError("state-model-not-deterministic", name)
        for e in {*inceptions, *(e for _, e, _ in transitions)} - set(self.events):
            raise PlanError("event-unknown", e)
        return self._add(
            self.state_models, name,
            StateModel(name, subject, tuple(states), initial, tuple(terminal), tuple(inceptions), tuple(transitions)),
        )

    def period_calendar(self, name, source, *, date, levels, correspondences=None) -> str:
        return self._add(self.calendars, name, PeriodCalendar(name, source, date, levels, correspondences or {}))

    def influences(self, a: str, b: str) -> None:
        self.edges.append((a, "influences", b))

    def related_to(self, a: str, b: str) -> None:
        self.edges.append((a, "related_to", b))

    # --- use ----------------------------------------------------------------------

    def frame(self, entity: str) -> DataFrame:
        """The entity's rows, built once."""
        if entity not in self._frames:
            self._frames[entity] = self._entity(entity).source(self.spark)
        return self._frames[entity]

    def default_time(self, entity: str) -> Field:
        found = [f for f in self.fields.values() if f.entity == entity and f.kind == "time"]
        chosen = [f for f in found if f.default] or found
        if len(chosen) != 1:
            raise PlanError("time-dimension-ambiguous" if chosen else "time-dimension-missing", entity)
        return chosen[0]

    def children(self, m: Metric) -> list[Metric]:
        return [self.metrics[c] for _, c in m.children]

    def depth(self, m: Metric, seen: tuple[str, ...] = ()) -> int:
        """Depth of a metric's expression; refuses cycles and depths beyond ten."""
        if m.name in seen:
            raise PlanError("metric-cycle", " > ".join((*seen, m.name)))
        found = 1 + max((self.depth(c, (*seen, m.name)) for c in self.children(m)), default=0)
        if found > 10:
            raise PlanError("metric-too-deep", m.name)
        return found

    def occurrences(self, m: Metric) -> int:
        """How many metrics an expression names, repeats included."""
        return 1 + sum(self.occurrences(c) for c in self.children(m))

    def verify(self) -> list[str]:
        """Problems that show without running a query: references, cycles, columns of keys, fields, events and calendars."""
        problems = []
        for f in self.fields.values():
            if isinstance(f.body, str) and f.body not in self.frame(f.entity).columns:
                problems.append(f"field-column-missing: {f.id} ({f.body})")
        for e in self.events.values():
            for column in dict.fromkeys([*e.identity, e.occurred_at, *e.subject, *(x for r in e.roles.values() if not isinstance(r, Participant) for x in r)]):
                if column not in self.frame(e.entity).columns:
                    problems.append(f"event-column-missing: {e.name} ({column})")
        for c in self.calendars.values():
            there = c.source(self.spark).columns
            problems += [f"calendar-column-missing: {c.name} ({x})" for x in (c.date, *c.levels.values()) if x not in there]
        for m in self.metrics.values():
            try:
                self.depth(m)
            except PlanError as e:
                problems.append(str(e))
        for r in self.relationships.values():
            for a, b in r.keys:
                for entity, column in ((r.left, a), (r.right, b)):
                    if column not in self.frame(entity).columns:
                        problems.append(f"key-missing: {entity}.{column}")
        return problems

    def calendar_days(self, calendar: str, level: str) -> DataFrame:
        """(_cal_day, period_key) of a calendar's level; a row for each civil day."""
        if calendar not in self.calendars:
            raise PlanError("calendar-unknown", calendar)
        c = self.calendars[calendar]
        if level not in c.levels:
            raise PlanError("calendar-level-unknown", level)
        return c.source(self.spark).select(F.col(c.date).cast("date").alias("_cal_day"), F.col(c.levels[level]).alias("period_key"))

    def periods(self, calendar: str, level: str, through: str | None = None) -> DataFrame:
        """(period_key, period_start, period_end, ordinal, is_complete) of a certified level, in order.

        The end is exclusive; a period is complete if it ends by ``through`` (None: all are).
        """
        spans = self.calendar_days(calendar, level).groupBy("period_key").agg(
            F.min("_cal_day").alias("period_start"), F.date_add(F.max("_cal_day"), 1).alias("period_end")
        )
        ordinal = (F.row_number().over(Window.orderBy("period_start")) - 1).cast("bigint")  # a row for each period
        done = F.lit(True) if through is None else F.col("period_end") <= F.lit(through).cast("date")
        return spans.select("period_key", "period_start", "period_end", ordinal.alias("ordinal"), done.alias("is_complete"))

    def period_on(self, calendar: str, level: str, day: str):
        """The row of ``periods`` that holds a day."""
        at = F.lit(day).cast("date")
        found = self.periods(calendar, level).where((F.col("period_start") <= at) & (at < F.col("period_end"))).first()
        if found is None:
            raise PlanError("period-missing", f"{calendar}.{level} on {day}")
        return found

    def period_before(self, calendar: str, level: str, day: str):
        """The row of ``periods`` of the latest period that ends by the beginning of a day."""
        found = self.periods(calendar, level).where(F.col("period_end") <= F.lit(day).cast("date")).orderBy(F.desc("period_start")).first()
        if found is None:
            raise PlanError("period-missing", f"{calendar}.{level} before {day}")
        return found

    def period_positions(self, calendar: str, level: str, within: str) -> DataFrame:
        """(period_key, within_key, ordinal_within): each period's one containing period and its place there, from 0.

        A period that lies in several periods of the other level has null for both.
        """
        inner = self.periods(calendar, level).select("period_key", "period_start")
        a, b = self.calendar_days(calendar, level), self.calendar_days(calendar, within).select(F.col("_cal_day").alias("_d"), F.col("period_key").alias("_w"))
        held = a.join(b, F.col("_cal_day") == F.col("_d"), "left").groupBy("period_key").agg(
            F.count_distinct("_w").alias("_n"), F.count_if(F.col("_w").isNull()).alias("_out"), F.min("_w").alias("_w")
        )
        one = F.when((F.col("_n") == 1) & (F.col("_out") == 0), F.col("_w"))
        placed = inner.join(held.select("period_key", one.alias("within_key")), "period_key")
        place = F.row_number().over(Window.partitionBy("within_key").orderBy("period_start")) - 1  # periods, not days
        return placed.select("period_key", "within_key", F.when(F.col("within_key").isNotNull(), place).cast("bigint").alias("ordinal_within"))

    def period_progress(self, calendar: str, level: str, moments: DataFrame, column: str) -> DataFrame:
        """The rows with period_key, day_ordinal and microseconds_of_day of a civil moment; a moment outside the calendar has nulls."""
        first = self.calendar_days(calendar, level).groupBy("period_key").agg(F.min("_cal_day").alias("_first"))
        days = self.calendar_days(calendar, level).join(first, "period_key")
        t = F.col(column).cast("timestamp_ntz")
        joined = moments.join(days, t.cast("date") == F.col("_cal_day"), "left")
        micros = periods.progress(t, "day")["microseconds_of_day"]
        return joined.select(
            *(moments[c] for c in moments.columns), "period_key", F.datediff(t.cast("date"), F.col("_first")).alias("day_ordinal"),
            F.when(F.col("period_key").isNotNull(), micros).alias("microseconds_of_day"),
        )

    def correspondence(self, calendar: str, name: str) -> DataFrame:
        """(period_key, baseline_key): a calendar's named correspondence, from its table's columns of the current and baseline key."""
        c = self.calendars[calendar]
        if name not in c.correspondences:
            raise PlanError("correspondence-unknown", f"{calendar}.{name}")
        level, baseline = c.correspondences[name]
        found = c.source(self.spark).select(F.col(c.levels[level]).alias("period_key"), F.col(baseline).alias("baseline_key")).distinct()
        twice = F.count("*").over(Window.partitionBy("period_key")) > 1
        bad = F.raise_error(F.concat(F.lit("correspondence-not-unique: "), F.col("period_key").cast("string"))).cast(dict(found.dtypes)["baseline_key"])
        return found.select("period_key", F.when(twice, bad).otherwise(F.col("baseline_key")).alias("baseline_key"))

    def certify(self, calendar: str, level: str) -> dict[str, int]:
        """Repeated dates, dates missing between the first and last, and periods that are not contiguous."""
        c = self.calendars[calendar]
        df = c.source(self.spark).select(F.col(c.date).cast("date").alias("d"), F.col(c.levels[level]).alias("k"))
        whole = df.agg(F.count("*").alias("n"), F.count_distinct("d").alias("u"), F.min("d").alias("a"), F.max("d").alias("b")).first()
        spans = df.groupBy("k").agg(F.count_distinct("d").alias("n"), (F.datediff(F.max("d"), F.min("d")) + 1).alias("w"))
        days = 0 if whole["a"] is None else (whole["b"] - whole["a"]).days + 1
        return {"repeated": whole["n"] - whole["u"], "missing": days - whole["u"], "broken": spans.where("n <> w").count()}

    def parity(self, metric: str, scalar, tolerance: float = 0.0) -> bool:
        """Whether an observed scalar equals the metric's own SQL."""
        sql = self.metric_of(metric).sql
        expected = self.spark.sql(sql).first()[0]
        return abs(float(expected) - float(scalar)) <= tolerance * max(1.0, abs(float(expected)))
