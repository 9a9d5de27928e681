"""Comparison of two frames: delta math, presence, and ways to pair their buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import time as T
from metrolith.functions.errors import PlanError
from metrolith.plans.frames import Frame

STATUSES = ("computed", "from_zero_growth", "from_zero_decline", "zero_baseline_no_change", "not_computable")


@dataclass(frozen=True)
class Alignment:
    """How buckets of the two windows are paired."""

    kind: str = "ordinal_bucket"
    strict: bool = False
    within: T.Grain = T.Grain("month")
    unmatched: str = "drop"
    anchor: str = "start"
    mapping: DataFrame | None = None  # correspondence: (current, baseline); schedule: (day, is_working)


def window_bucket(*, mode="ordinal_bucket", strict_lengths=False) -> Alignment:
    return Alignment(mode, strict_lengths)


def day_of_week(*, within=T.Grain("month"), unmatched="fail") -> Alignment:
    return Alignment("day_of_week", within=within, unmatched=unmatched)


def period_progress(*, unmatched="fail") -> Alignment:
    return Alignment("period_progress", unmatched=unmatched)


def period_correspondence(*, mapping, unmatched="fail") -> Alignment:
    return Alignment("period_correspondence", mapping=mapping, unmatched=unmatched)


def occurrence_progress(*, anchor="start", unmatched="fail") -> Alignment:
    return Alignment("occurrence_progress", anchor=anchor, unmatched=unmatched)


def working_day_progress(*, schedule, unmatched="fail") -> Alignment:
    return Alignment("working_day_progress", mapping=schedule, unmatched=unmatched)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def delta_columns(current: str, baseline: str) -> list[Column]:
    """delta, pct_change over |baseline|, and why pct_change is what it is."""
    c, b = F.col(current).cast("double"), F.col(baseline).cast("double")
    ok = finite(c) & finite(b)
    delta = F.when(ok, c - b)
    pct = F.when(ok, F.try_divide(c - b, F.abs(b)))
    status = (
        F.when(~F.coalesce(ok, F.lit(False)), "not_computable")
        .when(b != 0, "computed")
        .when(c > 0, "from_zero_growth")
        .when(c < 0, "from_zero_decline")
        .otherwise("zero_baseline_no_change")
    )
    return [delta.alias("delta"), pct.alias("pct_change"), status.alias("pct_change_status")]


def _sides(a: DataFrame, b: DataFrame, keys: list[str], va: str, vb: str, keep_a=(), keep_b=()) -> DataFrame:
    """Null-safe full outer join with markers of presence."""
    left = a.select(*keys, F.col(va).cast("double").alias("current"), *keep_a, F.lit(True).alias("_a"))
    right = b.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(vb).cast("double").alias("baseline"), *keep_b, F.lit(True).alias("_b"))
    if not keys:
        return left.crossJoin(right)  # one row each
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = left.join(right, on, "full")
    rest = [c for c in both.columns if c not in keys and c not in {f"_{k}" for k in keys}]
    return both.select(*(F.when(F.col("_a"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys), *rest)


def _presence(df: DataFrame) -> DataFrame:
    """New groups have baseline 0, churned ones current 0."""
    status = F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "new").otherwise("churned")
    return (
        df.withColumn("presence_status", status)
        .withColumn("current", F.when(F.col("_a"), F.col("current")).otherwise(F.lit(0.0)))
        .withColumn("baseline", F.when(F.col("_b"), F.col("baseline")).otherwise(F.lit(0.0)))
        .drop("_a", "_b")
    )


def _with_ordinal(f: Frame) -> DataFrame:
    """Rows with the ordinal of their bucket among the window's expected buckets."""
    if f.scope is None or f.grain is None:
        raise PlanError("alignment-needs-window")
    spine = T.spine(f.df.sparkSession, f.scope, f.grain, "_bucket")
    return f.df.join(F.broadcast(spine), F.col(f.time) == F.col("_bucket")).drop("_bucket")


def coordinate(f: Frame, how: Alignment) -> Column:
    """The coordinate on which a policy pairs buckets."""
    day, first = F.col(f.time).cast("date"), F.lit(str(f.scope.start.date())).cast("date")
    if how.kind == "day_of_week":
        # The period's place in the window, the week in the period, the ISO weekday.
        within = T.grain(how.within)
        period, start = T.bucket(day.cast("timestamp_ntz"), within), F.lit(str(T.floor(f.scope.start, within).date())).cast("date")
        months = {"month": 1, "quarter": 3, "year": 12}.get(within.unit)
        days = {"week": 7, "day": 1}.get(within.unit)
        if months is None and days is None:
            raise PlanError("alignment-grain", within.unit)
        nth = F.months_between(period, start) / months if months else F.datediff(period, start) / days
        return F.concat_ws("-", F.round(nth).cast("int"), F.floor(F.datediff(day, period) / 7).cast("int"), F.weekday(day) + 1)
    if how.kind == "period_progress":
        ordinal = F.datediff(day, first).cast("string")
        if f.grain is not None and f.grain.unit in T.SECONDS:
            return F.concat(ordinal, F.date_format(F.col(f.time).cast("timestamp_ntz"), " HH:mm:ss"))
        return ordinal
    if how.kind == "occurrence_progress":
        last = F.lit(str(f.scope.end.date())).cast("date")
        return (F.datediff(day, first) if how.anchor == "start" else F.datediff(day, last)).cast("string")
    raise PlanError("alignment-unknown", how.kind)


def _policy(current: Frame, baseline: Frame, how: Alignment) -> DataFrame:
    keys = list(current.keys)
    a, b = current.df, baseline.df
    if how.kind == "period_correspondence":
        m = how.mapping.toDF("_cur", "_base")
        a = a.join(m, F.col(current.time).eqNullSafe(F.col("_cur"))).withColumn("align_key", F.col("_base").cast("string")).drop("_cur", "_base")
        b = b.withColumn("align_key", F.col(baseline.time).cast("string"))
    elif how.kind == "working_day_progress":
        s = how.mapping.toDF("_day", "_works")

        def nth(f: Frame, df):
            days = s.where((F.col("_day") >= F.lit(str(f.scope.start.date())).cast("date")) & (F.col("_day") < F.lit(str(f.scope.end.date())).cast("date")))
            n = F.sum(F.col("_works").cast("int")).over(Window.orderBy("_day"))  # one row per calendar day
            numbered = days.withColumn("align_key", n.cast("string")).where("_works").select("_day", "align_key")
            return df.join(numbered, F.col(f.time).cast("date") == F.col("_day")).drop("_day")

        a, b = nth(current, a), nth(baseline, b)
    else:
        a, b = a.withColumn("align_key", coordinate(current, how)), b.withColumn("align_key", coordinate(baseline, how))
    both = _sides(
        a, b, [*keys, "align_key"], current.value, baseline.value,
        [F.col(current.time).alias("bucket_start_a")], [F.col(baseline.time).alias("bucket_start_b")],
    )
    matched = F.col("_a") & F.col("_b")
    if how.unmatched == "fail":
        bad = F.when(~F.coalesce(matched, F.lit(False)), F.raise_error(F.concat(F.lit("alignment-unmatched: "), F.col("align_key"))))
        both = both.withColumn("align_quality", F.coalesce(bad.cast("string"), F.lit("exact")))
    else:
        both = both.where(matched).withColumn("align_quality", F.lit("exact"))
    return both.withColumn("presence_status", F.lit("matched")).drop("_a", "_b")


def compare(current: Frame, baseline: Frame, alignment: Alignment | None = None) -> Frame:
    """Compare two frames of one shape; the delta frame stays lazy."""
    if current.shape != baseline.shape or current.keys != baseline.keys:
        raise PlanError("compare-shape", f"{current.shape} and {baseline.shape}")
    if current.meta.get("cumulative") != baseline.meta.get("cumulative") or current.meta.get("width") != baseline.meta.get("width"):
        raise PlanError("compare-cumulative", "anchors or spans differ")
    how = alignment or Alignment()
    keys = list(current.keys)
    if current.time is None:
        joined = _sides(current.df, baseline.df, keys, current.value, baseline.value)
        rows = _presence(joined) if keys else joined.drop("_a", "_b")
        out = rows.select(*keys, *(["presence_status"] if keys else []), "current", "baseline", *delta_columns("current", "baseline"))
        axes = tuple(keys)
    elif how.kind in ("ordinal_bucket", "calendar_bucket"):
        if how.kind == "ordinal_bucket":
            if how.strict and len(T.buckets(current.scope, current.grain)) != len(T.buckets(baseline.scope, baseline.grain)):
                raise PlanError("alignment-lengths")
            spark = current.df.sparkSession
            a, b = _with_ordinal(current), _with_ordinal(baseline)
            sa = T.spine(spark, current.scope, current.grain, "_sa").toDF("_oa", "_sa")
            sb = T.spine(spark, baseline.scope, baseline.grain, "_sb").toDF("_ob", "_sb")
            joined = _sides(a, b, [*keys, "ordinal"], current.value, baseline.value)
            joined = joined.join(F.broadcast(sa), F.col("ordinal") == F.col("_oa"), "left").join(F.broadcast(sb), F.col("ordinal") == F.col("_ob"), "left")
            joined = joined.withColumn("bucket_start", F.col("_sa")).withColumn("bucket_start_b", F.col("_sb"))
        else:
            joined = _sides(current.df, baseline.df, [*keys, current.time], current.value, baseline.value).withColumn("bucket_start_b", F.col(current.time))
        rows = _presence(joined) if keys else joined
        lead = ["bucket_start", "bucket_start_b", *keys]
        out = rows.select(*lead, *(["presence_status"] if keys else []), "current", "baseline", *delta_columns("current", "baseline"))
        axes = tuple(keys)
    else:
        rows = _policy(current, baseline, how)
        out = rows.select(
            *keys, "align_key", "align_quality", "presence_status", "bucket_start_a", "bucket_start_b", "current", "baseline",
            *delta_columns("current", "baseline"),
        )
        axes = tuple(keys)
    time = current.time and ("bucket_start" if "bucket_start" in out.columns else "bucket_start_a")
    components = None
    if current.components is not None and baseline.components is not None and current.time is None:
        pieces = [c for c in current.components.columns if c.endswith(("__sum", "__weight"))]
        renamed = ["current_sum", "current_weight", "baseline_sum", "baseline_weight"]
        s, w = (next(p for p in pieces if p.endswith(x)) for x in ("__sum", "__weight"))
        left = current.components.select(*keys, F.col(s).alias("current_sum"), F.col(w).alias("current_weight"))
        right = baseline.components.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(s).alias("baseline_sum"), F.col(w).alias("baseline_weight"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        components = left.join(right, on, "full") if keys else left.crossJoin(right)
        components = components.select(*(F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys), *renamed)
    return Frame(
        out, "delta", axes, time, ("delta",), current.grain, current.scope, current.additivity, components,
        meta={"current": current, "baseline": baseline, "metrics": current.meta.get("metrics")},
    )


def compare_funnels(current: Frame, baseline: Frame) -> Frame:
    """Funnels step by step: counts 0-filled, rates as differences."""
    counts = ["cohort_count", "entry_count", "resolved_entry_count", "reached_count", "lost_count"]
    rates = ["conversion_from_first", "conversion_from_previous", "loss_rate_from_previous"]
    keys = [*current.keys, "step_key"]
    left = current.df.select(*keys, *(F.col(c).alias(f"current_{c}") for c in counts + rates))
    right = baseline.df.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"baseline_{c}") for c in counts + rates))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = left.join(right, on, "full")
    out = both.select(
        *(F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys),
        *(F.coalesce(f"{s}_{c}", F.lit(0)).alias(f"{s}_{c}") for c in counts for s in ("current", "baseline")),
        *(F.col(f"{s}_{r}") for r in rates for s in ("current", "baseline")),
        *((F.col(f"current_{r}") - F.col(f"baseline_{r}")).alias(f"{r}_delta") for r in rates),
    )
    return Frame(out, "delta", tuple(current.keys), None, ("loss_rate_from_previous_delta",), meta={"kind": "funnel"})
