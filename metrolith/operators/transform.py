"""Frame transforms: filter, slice, window, rollup, top and bottom k, rank, normalize."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import time as T
from metrolith.functions.errors import PlanError
from metrolith.functions.ranks import by_value, running
from metrolith.plans.frames import Frame
from metrolith.plans.planner import predicate

from .compare import delta_columns, finite


class Transforms:
    """``frame.transform``: every method returns a new lazy frame."""

    def __init__(self, frame: Frame):
        self.f = frame

    def _series(self) -> list[str]:
        return list(self.f.keys)

    def _known(self, name: str) -> str:
        if name not in self.f.df.columns:
            raise PlanError("column-unknown", name)
        return name

    def filter(self, *, predicate: Callable[[DataFrame], Column]) -> Frame:
        return self.f.having(self.f.df.where(predicate(self.f.df)))

    def slice(self, *, slice_by: dict) -> Frame:
        """A scalar drops its axis and is remembered; a pair is a range, a list is membership."""
        df, keys, where = self.f.df, list(self.f.keys), dict(self.f.where)
        for k, v in slice_by.items():
            self._known(k)
            df = df.where(F.col(k).between(*v) if isinstance(v, tuple) and len(v) == 2 else predicate(F.col(k), v))
            if not isinstance(v, (list, tuple, dict)):
                df, where[k] = df.drop(k), v
                keys.remove(k)
        return self.f.having(df, keys=tuple(keys), where=where)

    def window(self, *, window: T.TimeScope) -> Frame:
        kind = dict(self.f.df.dtypes)[self.f.time]
        return self.f.having(self.f.df.where(T.inside(F.col(self.f.time), kind, window)), scope=window)

    def rollup(self, *, drop_axes=None, grain=None, last=False) -> Frame:
        """Sum over dropped axes, or into coarser buckets (or each bucket's last row)."""
        f = self.f
        if f.additivity != "additive" and not last:
            raise PlanError("rollup-not-additive")
        keys = [k for k in f.keys if k not in (drop_axes or ())]
        time = None if f.time in (drop_axes or ()) else f.time
        df, g = f.df, f.grain
        if grain:
            g = T.grain(grain)
            if f.grain and g.rank <= f.grain.rank:
                raise PlanError("rollup-grain", f"{g.unit} from {f.grain.unit}")
            df = df.withColumn("_old", F.col(time)).withColumn(time, T.bucket(F.col(time).cast("timestamp_ntz"), g))
        by = ([time] if time else []) + keys
        if f.family == "delta":
            out = df.groupBy(*by).agg(F.sum("current").alias("current"), F.sum("baseline").alias("baseline"))
            out = out.select(*by, "current", "baseline", *delta_columns("current", "baseline"))
        elif last:
            out = df.groupBy(*by).agg(*(F.max_by(v, "_old").alias(v) for v in f.values))
        else:
            out = df.groupBy(*by).agg(*(F.sum(v).alias(v) for v in f.values))
        return f.having(out, keys=tuple(keys), time=time, grain=g)

    def rollup_calendar(self, calendar: DataFrame, date: str, level: str) -> Frame:
        """Sum days into a calendar's periods."""
        f = self.f
        days = calendar.select(F.col(date).cast("date").alias("_d"), F.col(level).alias("_p"))
        joined = f.df.join(days, F.col(f.time).cast("date") == F.col("_d"))
        out = joined.groupBy(F.col("_p").alias("period_key"), *f.keys).agg(*(F.sum(v).alias(v) for v in f.values))
        return f.having(out, time="period_key", grain=None)

    def _tail(self) -> list[Column]:
        return [F.col(a).asc_nulls_last() for a in self.f.axes if a in self.f.df.columns]

    def topk(self, *, by: str, limit: int) -> Frame:
        return self.f.having(self.f.df.orderBy(F.col(self._known(by)).desc_nulls_last(), *self._tail()).limit(limit))

    def bottomk(self, *, by: str, limit: int) -> Frame:
        return self.f.having(self.f.df.orderBy(F.col(self._known(by)).asc_nulls_last(), *self._tail()).limit(limit))

    def rank(self, *, by: str, method: str = "ordinal", rank_column: str = "rank") -> Frame:
        """Descending rank, of doubles; ordinal breaks ties on the axes; null and non-finite values are refused."""
        if method not in ("ordinal", "dense", "min", "max"):
            raise PlanError("rank-method", method)
        x = F.col(self._known(by))
        safe = F.when(finite(x.cast("double")), x).otherwise(F.raise_error(F.lit("rank-of-null")))
        df = self.f.df.withColumn(by, safe.cast(dict(self.f.df.dtypes)[by]))
        if method == "ordinal":
            out = running(df, by, F.lit(1), rank_column, descending=True, ties=self._tail())
            return self.f.having(out.withColumn(rank_column, (F.col(rank_column) + 1).cast("bigint")))
        found = {"dense": F.col("_place") + 1, "min": F.col("_less") + 1, "max": F.col("_less") + F.col("_n")}[method]
        values = by_value(df, by, descending=True).select(F.col("_v"), found.cast("bigint").alias(rank_column))
        return self.f.having(df.join(values, F.col(by) == F.col("_v"), "left").drop("_v"))

    def normalize(self, *, mode: str, baseline=None) -> Frame:
        """index (to the series' first or a bucket), share, pct_change, per_unit, z_score."""
        f, v = self.f, F.col(self.f.value).cast("double")
        series = Window.partitionBy(*f.keys) if f.keys else Window.partitionBy(F.lit(0))
        df = f.df
        if mode == "index":
            base = F.first(v).over(series.orderBy(f.time)) if baseline is None else F.max(F.when(F.col(f.time) == F.lit(baseline), v)).over(series)
            out = F.try_divide(v, base) * 100
        elif mode == "share":
            whole = Window.partitionBy(f.time) if f.time and f.keys else Window.partitionBy(F.lit(0))
            out = F.try_divide(v, F.sum(v).over(whole))
        elif mode == "pct_change":
            before = F.lag(v).over(series.orderBy(f.time))
            out = F.try_divide(v - before, before)
        elif mode == "per_unit":
            out = F.try_divide(v, F.lit(float(baseline)))
        elif mode == "z_score":
            out = F.try_divide(v - F.avg(v).over(series), F.stddev_pop(v).over(series))
        else:
            raise PlanError("normalize-mode", mode)
        return f.having(df.withColumn(f.value, out), additivity="non_additive")
