"""Time: grains, half-open scopes, encodings of time columns, buckets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import PlanError

UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
SECONDS = {"second": 1, "minute": 60, "hour": 3600}


@dataclass(frozen=True)
class Grain:
    """A calendar unit, or a number of sub-day units."""

    unit: str
    count: int = 1

    def __post_init__(self):
        if self.unit not in UNITS or self.count < 1:
            raise PlanError("grain-invalid", f"no grain of {self.count} {self.unit}")
        if self.count > 1 and self.unit not in SECONDS:
            raise PlanError("grain-invalid", "only second, minute and hour can be counted")

    @property
    def rank(self) -> int:
        return UNITS.index(self.unit)


def grain(unit: str | Grain, *, count: int = 1) -> Grain:
    return unit if isinstance(unit, Grain) else Grain(unit, count)


def _moment(x: date | datetime | str) -> datetime:
    if isinstance(x, datetime):
        return x
    return datetime(x.year, x.month, x.day) if isinstance(x, date) else datetime.fromisoformat(x)


@dataclass(frozen=True)
class TimeScope:
    """The half-open window [start, end); a date is its midnight."""

    start: datetime
    end: datetime

    def __post_init__(self):
        if self.end <= self.start:
            raise PlanError("window-empty", f"{self.end} is not after {self.start}")


def time_scope(*, start, end) -> TimeScope:
    return TimeScope(_moment(start), _moment(end))


@dataclass(frozen=True)
class Parse:
    """How a time column is stored: datetime, timestamp, strptime text or number, or an hour under a day column."""

    kind: str = "datetime"
    format: str | None = None
    timezone: str | None = None
    prefix: str | None = None
    sample_interval: tuple[int, str] | None = None


def as_datetime(*, timezone=None, sample_interval=None) -> Parse:
    return Parse("datetime", timezone=timezone, sample_interval=sample_interval)


def as_timestamp(*, timezone=None, sample_interval=None) -> Parse:
    return Parse("timestamp", timezone=timezone, sample_interval=sample_interval)


def strptime(format: str, /, *, timezone=None, sample_interval=None) -> Parse:
    java_pattern(format)
    return Parse("strptime", format, timezone, sample_interval=sample_interval)


def hour_prefix(prefix: str, /, *, sample_interval=None) -> Parse:
    return Parse("hour_prefix", prefix=prefix, sample_interval=sample_interval)


# Directives of strptime and the letters Java uses for them.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "VV",
}


def java_pattern(format: str) -> str:
    """The Java pattern of a strptime format; letters are quoted, unknown directives refused."""
    out = ""
    for literal, directive in re.findall(r"([^%]+)|%(.)", format):
        if literal:
            out += re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", literal)
        elif directive == "%":
            out += "%"
        elif directive in DIRECTIVES:
            out += DIRECTIVES[directive]
        else:
            raise PlanError("strptime-unsupported", f"%{directive}")
    return out


def sorts_by_time(format: str) -> bool:
    """Whether text in this format sorts as its times do (so bounds can be compared as text)."""
    found = re.findall(r"%(.)", format)
    order = [x for x in "YmdHMSf"]
    return found == order[: len(found)] and bool(found)


def civil(df: DataFrame, column: str | Column, parse: Parse, report_tz: str | None = None) -> Column:
    """The column as timestamp without time zone, in the report's zone."""
    c = F.col(column) if isinstance(column, str) else column
    if parse.kind == "strptime":
        c = F.try_to_timestamp(c.cast("string"), F.lit(java_pattern(parse.format)))
    elif parse.kind == "hour_prefix":
        day = F.try_to_timestamp(F.col(parse.prefix).cast("string"), F.lit("yyyyMMdd"))
        c = F.coalesce(day, F.col(parse.prefix).try_cast("timestamp")) + F.make_dt_interval(F.lit(0), c.cast("int"))
    c = c.cast("timestamp_ntz")
    if parse.timezone and report_tz and parse.timezone != report_tz:
        c = F.convert_timezone(F.lit(parse.timezone), F.lit(report_tz), c)
    return c


def bucket(c: Column, g: Grain) -> Column:
    """The start of the bucket that holds a civil time: date from day on, else timestamp_ntz."""
    if g.unit in SECONDS:
        if g.count == 1:
            return F.date_trunc(g.unit, c).cast("timestamp_ntz")
        width = SECONDS[g.unit] * g.count
        day = F.date_trunc("day", c).cast("timestamp_ntz")
        since = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(since / width) * width).cast("decimal(18,6)"))
    return F.date_trunc(g.unit, c).cast("date")


def inside(column: Column, kind: str, scope: TimeScope, parse: Parse | None = None, shifted: bool = False) -> Column:
    """[start, end) on the bare column where its type allows, so that scans can prune."""
    parse = parse or Parse()
    if not shifted and parse.kind == "strptime" and kind == "string" and sorts_by_time(parse.format):
        low, high = scope.start.strftime(parse.format), scope.end.strftime(parse.format)
        exact = datetime.strptime(high, parse.format) == scope.end
        return (column >= low) & ((column < high) if exact else (column <= high))
    if kind == "date":
        high = scope.end if scope.end == _midnight(scope.end) else _midnight(scope.end) + timedelta(days=1)
        low = scope.start if scope.start == _midnight(scope.start) else _midnight(scope.start) + timedelta(days=1)
        return (column >= F.lit(low.date())) & (column < F.lit(high.date()))
    return (column >= _ntz(scope.start)) & (column < _ntz(scope.end))


def prefix_days(df: DataFrame, parse: Parse, scope: TimeScope) -> Column:
    """The scope's days on the bare prefix column, so that day partitions are pruned before hours are read."""
    last = scope.end - timedelta(microseconds=1)
    kind = dict(df.dtypes).get(parse.prefix, "string")
    c = F.col(parse.prefix)

    def between(day: str) -> Column:
        low, high = (F.lit(t.strftime(day)).cast(kind) for t in (scope.start, last))
        return c.between(low, high)

    # Text may be written either way; integers hold yyyyMMdd.
    return between("%Y-%m-%d") if kind == "date" else between("%Y%m%d") | between("%Y-%m-%d") if kind == "string" else between("%Y%m%d")


def _midnight(t: datetime) -> datetime:
    return datetime(t.year, t.month, t.day)


def _ntz(t: datetime) -> Column:
    return F.lit(t.isoformat(" ")).cast("timestamp_ntz")


def step(t: datetime, g: Grain, n: int = 1) -> datetime:
    """A bucket start moved by n buckets."""
    if g.unit in SECONDS:
        return t + timedelta(seconds=SECONDS[g.unit] * g.count * n)
    if g.unit in ("day", "week"):
        return t + timedelta(days=(7 if g.unit == "week" else 1) * n)
    months = {"month": 1, "quarter": 3, "year": 12}[g.unit] * n
    at = t.year * 12 + t.month - 1 + months
    return t.replace(year=at // 12, month=at % 12 + 1)


def floor(t: datetime, g: Grain) -> datetime:
    day = _midnight(t)
    if g.unit in SECONDS:
        width = SECONDS[g.unit] * g.count
        return day + timedelta(seconds=int((t - day).total_seconds()) // width * width)
    if g.unit == "week":
        return day - timedelta(days=day.weekday())
    if g.unit == "month":
        return day.replace(day=1)
    if g.unit == "quarter":
        return day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1)
    return day.replace(month=1, day=1) if g.unit == "year" else day


def buckets(scope: TimeScope, g: Grain) -> list[datetime]:
    """Every bucket start that meets the scope, in order."""
    out, t = [], floor(scope.start, g)
    while t < scope.end:
        out.append(t)
        t = step(t, g)
    return out


def spine(spark, scope: TimeScope, g: Grain, name: str = "bucket_start") -> DataFrame:
    """(ordinal, bucket) of every bucket of the scope, made by a sequence on the cluster."""
    first, last = floor(scope.start, g), buckets(scope, g)[-1]
    every = {"week": "7 days", "quarter": "3 months"}.get(g.unit, f"{g.count} {g.unit}")
    seq = F.sequence(_ntz(first), _ntz(last), F.expr(f"interval {every}"))
    kind = "timestamp_ntz" if g.unit in SECONDS else "date"
    return spark.range(1).select(F.posexplode(seq).alias("ordinal", "t")).select("ordinal", F.col("t").cast(kind).alias(name))
