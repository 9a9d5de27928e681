"""Cumulative metrics: all history, to date, trailing; dense over buckets and observed groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import time as T
from metrolith.functions.errors import PlanError

from .frames import Frame
from .model import CalendarAnchor, Metric
from .planner import Observation, leaf_columns


def _flow(catalog, base: Metric, ob: Observation) -> DataFrame:
    columns = [(n, c) for n, c in leaf_columns(catalog, base, ob, {}) if base.kind != "weighted_mean" or n != base.name]
    return ob.df.groupBy(*ob.axes).agg(*(c.cast("double").alias(n) for n, c in columns))


def _names(base: Metric) -> list[str]:
    return [f"{base.name}__sum", f"{base.name}__weight"] if base.kind == "weighted_mean" else [base.name]


def _value(base: Metric):
    if base.kind == "weighted_mean":
        return F.try_divide(F.col(f"{base.name}__sum"), F.col(f"{base.name}__weight"))
    return F.col(base.name)


def first_seen(catalog, base: Metric, ob: Observation, period: Column | None) -> DataFrame:
    """Distinct counting as a flow: each key is counted in the bucket where it is first seen (in its period)."""
    key = ob._column(ob.df, catalog.field(base.measure))
    by = [F.col(f"d_{f.name}").alias(f.name) for f in ob.dimensions]
    extra = [] if period is None else [period.alias("_period")]
    seen = ob.df.where(key.isNotNull()).groupBy(key.alias("_key"), *by, *extra).agg(F.min("_t").alias("_t"))
    names = [f.name for f in ob.dimensions]
    return seen.groupBy(T.bucket(F.col("_t"), ob.grain).alias("bucket_start"), *names).agg(
        F.count("*").cast("double").alias(base.name)
    )


def observe_cumulative(catalog, m: Metric, scope, grain, dimensions=(), where=None, report_tz=None) -> Frame:
    base = catalog.children(m)[0]
    anchor, distinct = m.anchor, base.agg == "count_distinct"
    names = _names(base)
    dims = [catalog.field(d).name for d in dimensions]
    if scope is None:
        raise PlanError("cumulative-needs-scope", m.name)
    if isinstance(anchor, T.Grain) and grain and (anchor.rank < grain.rank or (grain.unit == "week" and anchor.unit != "week")):
        raise PlanError("cumulative-grain", f"{grain.unit} under {anchor.unit}")

    def rows(start, end, g):
        return Observation(
            catalog, base.entity, scope=T.TimeScope(start, end), grain=g, dimensions=dimensions, where=where, time=m.over, report_tz=report_tz
        )

    far_past = T._moment("0001-01-01")
    days = None
    if isinstance(anchor, CalendarAnchor):
        if grain is None or grain.unit != "day":
            raise PlanError("cumulative-grain", "a calendar's periods need the grain day")
        days = catalog.calendar_days(anchor.calendar, anchor.level)
        opened = catalog.period_on(anchor.calendar, anchor.level, str(scope.start.date()))
    if grain is None:
        from datetime import timedelta

        last = scope.end - timedelta(microseconds=1)
        if isinstance(anchor, T.Grain):
            start = T.floor(last, anchor)
        elif anchor:
            start = T.step(scope.end, T.Grain(anchor[1]), -anchor[0])
        else:
            start = far_past
        ob = rows(start, scope.end, None)
        cols = leaf_columns(catalog, base, ob, {})
        out = ob.df.groupBy(*ob.axes).agg(*(c.cast("double").alias(n) for n, c in cols)).select(*dims, _value(base).alias("value"))
        return Frame(out, "metric", tuple(dims), None, ("value",), None, scope, "non_additive", meta={"metrics": [m.name], "cumulative": anchor})

    if isinstance(anchor, tuple):
        return _trailing(catalog, m, base, scope, grain, dims, rows, names, distinct)
    lower = T.floor(scope.start, anchor) if isinstance(anchor, T.Grain) else T._moment(str(opened["period_start"])) if days is not None else far_past
    ob = rows(lower, scope.end, grain)
    if days is not None:
        ob.df = _in_period(ob.df, days, "_t")
    if distinct:
        flow = first_seen(catalog, base, ob, T.bucket(F.col("_t"), anchor) if isinstance(anchor, T.Grain) else F.col("_key_of_period") if days is not None else None)
    else:
        flow = _flow(catalog, base, ob)
    flow = flow.withColumn("_at", F.greatest("bucket_start", F.lit(str(T.floor(scope.start, grain))).cast(dict(flow.dtypes)["bucket_start"])))
    if days is not None:
        flow = _in_period(flow, days, "bucket_start").withColumnRenamed("_key_of_period", "_period")
    else:
        flow = flow.withColumn("_period", T.bucket(F.col("bucket_start").cast("timestamp_ntz"), anchor) if isinstance(anchor, T.Grain) else F.lit(0))
    # Flow before the scope is carried into its first bucket (same period only).
    merged = flow.groupBy("_period", "_at", *dims).agg(*(F.sum(n).alias(n) for n in names)).withColumnRenamed("_at", "bucket_start")
    spine = T.spine(catalog.spark, scope, grain).drop("ordinal")
    if days is not None:
        spine = _in_period(spine, days, "bucket_start").withColumnRenamed("_key_of_period", "_period")
    else:
        spine = spine.withColumn("_period", T.bucket(F.col("bucket_start").cast("timestamp_ntz"), anchor) if isinstance(anchor, T.Grain) else F.lit(0))
    out = _dense(spine, merged, dims, names)
    w = Window.partitionBy("_period", *dims).orderBy("bucket_start").rowsBetween(Window.unboundedPreceding, 0)
    for n in names:
        out = out.withColumn(n, F.sum(F.coalesce(n, F.lit(0.0))).over(w))
    out = out.select("bucket_start", *dims, _value(base).alias("value"))
    return Frame(out, "metric", tuple(dims), "bucket_start", ("value",), grain, scope, "non_additive", meta={"metrics": [m.name], "cumulative": anchor})


def _in_period(df: DataFrame, days: DataFrame, time: str) -> DataFrame:
    """Adds the key of the calendar period of each row's day; a day that the calendar lacks is an error."""
    known = days.select("_cal_day", F.col("period_key").cast("string").alias("_key_of_period"))
    joined = df.join(known, F.col(time).cast("date") == F.col("_cal_day"), "left")
    lost = F.raise_error(F.concat(F.lit("calendar-day-missing: "), F.col(time).cast("string"))).cast("string")
    return joined.withColumn("_key_of_period", F.coalesce("_key_of_period", lost)).drop("_cal_day")


def _dense(spine: DataFrame, flow: DataFrame, dims: list[str], names: list[str]) -> DataFrame:
    """Every bucket for every observed group; the spine is as long as the window is wide."""
    groups = flow.select(*dims).distinct() if dims else None
    full = spine if groups is None else groups.join(F.broadcast(spine))
    on = F.col("bucket_start").eqNullSafe(F.col("_b")) & F.col("_period").eqNullSafe(F.col("_p"))
    right = flow.select(F.col("bucket_start").alias("_b"), F.col("_period").alias("_p"), *(F.col(d).alias(f"_{d}") for d in dims), *names)
    for d in dims:
        on = on & F.col(d).eqNullSafe(F.col(f"_{d}"))
    return full.join(right, on, "left").select("bucket_start", "_period", *dims, *names)


def _trailing(catalog, m, base, scope, grain, dims, rows, names, distinct) -> Frame:
    """The last n units up to and with each bucket; distinct keys fan out to the buckets that see them."""
    count, unit = m.anchor
    span = T.Grain(unit)
    width = len(T.buckets(T.TimeScope(T.step(T.floor(scope.start, grain), span, -count), T.floor(scope.start, grain)), grain))
    start = T.step(T.floor(scope.start, grain), grain, -(width - 1))
    ob = rows(start, scope.end, grain)
    first, coverage = F.lit(str(T.floor(scope.start, grain))), None
    if distinct:
        key = ob._column(ob.df, catalog.field(base.measure))
        every = {"week": "7 days", "quarter": "3 months"}.get(grain.unit, f"{grain.count} {grain.unit}")
        ahead = F.sequence("bucket_start", F.expr(f"bucket_start + {width - 1} * interval {every}").cast(dict(ob.df.dtypes)["bucket_start"]), F.expr(f"interval {every}"))
        by = [F.col(f"d_{f.name}").alias(f.name) for f in ob.dimensions]
        seen = ob.df.where(key.isNotNull()).select("bucket_start", *by, key.alias("_key")).distinct()
        fanned = seen.select(F.explode(ahead).alias("bucket_start"), *dims, "_key")
        last = F.lit(str(T.buckets(scope, grain)[-1]))
        inside = fanned.where((F.col("bucket_start") >= first.cast("timestamp_ntz")) & (F.col("bucket_start") <= last.cast("timestamp_ntz")))
        counted = inside.groupBy("bucket_start", *dims).agg(F.count_distinct("_key").cast("double").alias(base.name)).withColumn("_period", F.lit(0))
        out = _dense(T.spine(catalog.spark, scope, grain).drop("ordinal").withColumn("_period", F.lit(0)), counted, dims, names)
        out = out.select("bucket_start", *dims, F.coalesce(base.name, F.lit(0.0)).alias("value"))
    else:
        flow = _flow(catalog, base, ob).withColumn("_period", F.lit(0))
        wide = T.spine(catalog.spark, T.TimeScope(start, scope.end), grain).drop("ordinal").withColumn("_period", F.lit(0))
        out = _dense(wide, flow, dims, names)
        w = Window.partitionBy(*dims).orderBy("bucket_start").rowsBetween(-(width - 1), 0)
        seen = F.count(F.col(names[0])).over(w)
        for n in names:
            out = out.withColumn(f"_{n}", F.sum(F.coalesce(n, F.lit(0.0))).over(w))
        out = out.withColumn("coverage_ratio", seen / F.lit(float(width))).drop(*names).withColumnsRenamed({f"_{n}": n for n in names})
        out = out.where(F.col("bucket_start") >= first.cast("timestamp_ntz"))
        coverage = out.select("bucket_start", *dims, "coverage_ratio")
        out = out.select("bucket_start", *dims, _value(base).alias("value"))
    return Frame(out, "metric", tuple(dims), "bucket_start", ("value",), grain, scope, "non_additive", coverage=coverage, meta={"metrics": [m.name], "cumulative": m.anchor, "width": width})
