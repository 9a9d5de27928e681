"""Periods of the Gregorian and ISO calendar as columns; certified calendars answer the same questions in the catalog.

Keys: day 1996-02-29, week 1996-W09, month 1996-02, quarter 1996-Q1, year 1996.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.errors import PlanError

LEVELS = ("day", "week", "month", "quarter", "year")
#: What lies wholly inside what.
ROLLS_UP = {"day": ("week", "month", "quarter", "year"), "week": (), "month": ("quarter", "year"), "quarter": ("year",), "year": ()}


def _level(level: str) -> str:
    if level not in LEVELS:
        raise PlanError("calendar-level-unknown", level)
    return level


def rolls_up_to(source: str, target: str) -> bool:
    return _level(target) in ROLLS_UP[_level(source)]


def start(day: Column, level: str) -> Column:
    d = day.cast("date")
    return d if _level(level) == "day" else F.trunc(d, level)


def end(day: Column, level: str) -> Column:
    """The first day after the period."""
    s = start(day, level)
    return {"day": F.date_add(s, 1), "week": F.date_add(s, 7)}[level] if level in ("day", "week") else F.add_months(s, {"month": 1, "quarter": 3, "year": 12}[level])


def key(day: Column, level: str) -> Column:
    s = start(day, level)
    year = F.lpad(F.year(s).cast("string"), 4, "0")
    if level == "day":
        return F.date_format(s, "yyyy-MM-dd")
    if level == "week":  # the ISO year is that of the week's Thursday
        iso = F.lpad(F.year(F.date_add(s, 3)).cast("string"), 4, "0")
        return F.concat(iso, F.lit("-W"), F.lpad(F.weekofyear(s).cast("string"), 2, "0"))
    if level == "month":
        return F.date_format(s, "yyyy-MM")
    return F.concat(year, F.lit("-Q"), F.quarter(s).cast("string")) if level == "quarter" else year


def first_day(text: Column, level: str) -> Column:
    """The first day of the period of a key; null for text that is no key of the level."""
    whole = {"day": r"^\d{4}-\d{2}-\d{2}$", "week": r"^\d{4}-W\d{2}$", "month": r"^\d{4}-\d{2}$", "quarter": r"^\d{4}-Q[1-4]$", "year": r"^\d{4}$"}[_level(level)]
    year = F.substring(text, 1, 4)
    if level == "week":
        jan4 = F.concat(year, F.lit("-01-04")).try_cast("date")  # it lies in week 1
        found = F.date_add(F.trunc(jan4, "week"), (F.substring(text, 7, 2).try_cast("int") - 1) * 7)
        found = F.when(key(found, "week") == text, found)
    elif level == "quarter":
        found = F.add_months(F.concat(year, F.lit("-01-01")).try_cast("date"), (F.substring(text, 7, 1).try_cast("int") - 1) * 3)
    else:
        found = F.concat(text, F.lit({"day": "", "month": "-01", "year": "-01-01"}[level])).try_cast("date")
    return F.when(text.rlike(whole), found)


def before(day: Column, level: str) -> Column:
    """The first day of the latest period that ends no later than a day begins."""
    return start(F.date_sub(start(day, level), 1), level)


def progress(moment: Column, level: str) -> Column:
    """struct<day_ordinal, microseconds_of_day>: how far a civil moment lies in its period."""
    t = moment.cast("timestamp_ntz")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    micros = (seconds.cast("bigint") * 1_000_000) + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return F.struct(F.datediff(t.cast("date"), start(t, level)).alias("day_ordinal"), micros.alias("microseconds_of_day"))


def ordinal_within(day: Column, level: str, target: str) -> Column:
    """The place, from 0, of a day's period among those of its target period; null where it does not lie wholly inside."""
    if level == target:
        return F.lit(0)
    s, t = start(day, level), start(start(day, level), _level(target))
    inside = end(day, level) <= end(s, target)
    if level == "day":
        n = F.datediff(s, t)
    elif level == "week":
        n = F.floor(F.datediff(s, t) / 7).cast("int")
    else:
        months = {"month": 1, "quarter": 3, "year": 12}
        n = F.floor(F.months_between(s, t) / months[level]).cast("int")
    return F.when(inside, n)


def containing(day: Column, level: str, target: str) -> Column:
    """The key of the one target period that holds a day's period whole; null where none does."""
    s = start(day, level)
    return F.when(end(day, level) <= end(s, target), key(s, target))
