"""Semi-additive measures: aggregate over space first, then fold over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import time as T

from .planner import Observation, aggregate_column


def fold(catalog, m, ob: Observation) -> DataFrame:
    """Sum the measure at each sample point of each group, then fold the points by mean, min, max, first, last or percentile."""
    how = m.additivity.fold
    x = ob._column(ob.df, catalog.field(m.measure))
    t = catalog.field(m.additivity.over)
    point = t.of(ob.df) if t.entity == ob.root else F.col("_t")
    spatial = ob.df.groupBy(*ob.axes, point.alias("_point")).agg(F.sum(x).alias("_x"))
    v = F.col("_x").cast("double")
    column = {
        "mean": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v),
        "first": lambda: F.min_by(v, "_point"), "last": lambda: F.max_by(v, "_point"),
    }.get(how if isinstance(how, str) else "", lambda: aggregate_column(how, v))()
    return spatial.groupBy(*ob.axis_names).agg(column.alias(m.name))


def expected_points(catalog, m, grain: T.Grain | None) -> int | None:
    """How many sample points a bucket should have; None where neither grain nor sampling has a fixed length."""
    t = catalog.field(m.additivity.over)
    every = t.parse.sample_interval or (1, t.granularity)
    lengths = {**T.SECONDS, "day": 86_400, "week": 604_800}
    if grain is None or grain.unit not in lengths or every[1] not in lengths:
        return None
    return lengths[grain.unit] * grain.count // (lengths[every[1]] * every[0]) or None


def coverage(catalog, m, ob: Observation, expected: int) -> DataFrame:
    """Distinct sample points of each group against those expected."""
    t = catalog.field(m.additivity.over)
    found = ob.df.groupBy(*ob.axes).agg(F.count_distinct(t.of(ob.df)).alias("sample_points"))
    ratio = F.col("sample_points") / F.lit(float(expected))
    return found.withColumn("expected_points", F.lit(expected)).withColumn("coverage", ratio).withColumn(
        "status", F.when(ratio == 1, "complete").otherwise("partial")
    )


def snapshot_rows(df: DataFrame, key: list[str], time: str, groups: list[str], how: str = "last") -> DataFrame:
    """Per group and business key, the rows at its first or last time."""
    pick = (F.max if how == "last" else F.min)(time).over(Window.partitionBy(*groups, *key))
    return df.withColumn("_pick", pick).where(F.col(time) == F.col("_pick")).drop("_pick")
