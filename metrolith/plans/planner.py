"""Plans observations: joins along relationships, windows, filters, fused aggregates, composition.

Every observation is one lazy DataFrame.  Leaves that read the same entity over
the same axes share one aggregate; their filters become conditional aggregates.
"""

from __future__ import annotations

from collections import deque
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import time as T
from metrolith.functions.errors import PlanError

from .frames import Frame
from .model import Catalog, Field, Metric, Relationship, SemiAdditive, Snapshot, Validity


def predicate(c: Column, value: Any) -> Column:
    """A scalar: equal; a list: one of; a dict of one operator: == != in > >= < <= between."""
    if isinstance(value, dict):
        ((op, v),) = value.items()
        table = {
            "==": lambda: c == v, "!=": lambda: c != v, "in": lambda: c.isin(*v), ">": lambda: c > v, ">=": lambda: c >= v,
            "<": lambda: c < v, "<=": lambda: c <= v, "between": lambda: c.between(*v),
        }
        if op not in table:
            raise PlanError("slice-operator-unknown", op)
        return table[op]()
    return c.isin(*value) if isinstance(value, (list, tuple, set)) else c.eqNullSafe(F.lit(value)) if value is None else c == value


def path(catalog: Catalog, start: str, goal: str) -> list[tuple[Relationship, bool]]:
    """The one shortest chain of relationships from an entity to another (True: along its direction)."""
    if start == goal:
        return []
    best: dict[str, int] = {start: 0}
    ways: dict[str, list[list]] = {start: [[]]}
    queue = deque([start])
    while queue:
        at = queue.popleft()
        for r in catalog.relationships.values():
            for a, b, forward in ((r.left, r.right, True), (r.right, r.left, False)):
                if a != at:
                    continue
                if b not in best:
                    best[b] = best[at] + 1
                    ways[b] = []
                    queue.append(b)
                if best[b] == best[at] + 1:
                    ways[b] += [w + [(r, forward)] for w in ways[at]]
    if goal not in ways:
        raise PlanError("path-missing", f"{start} to {goal}")
    if len(ways[goal]) > 1:
        raise PlanError("path-ambiguous", f"{start} to {goal}")
    return ways[goal][0]


def safety(catalog: Catalog, r: Relationship, forward: bool) -> str:
    """one_to_one, many_to_one, one_to_many or unknown, from primary keys; version columns are not part of a key."""

    def unique(entity: str, columns: set[str]) -> bool:
        e = catalog.entities[entity]
        key = set(e.primary_key)
        if isinstance(e.versioning, Snapshot):
            key -= {e.versioning.partition}
        if isinstance(e.versioning, Validity):
            key -= {e.versioning.valid_from, e.versioning.valid_to}
        return bool(key) and key <= columns

    near, far = (r.left, r.right) if forward else (r.right, r.left)
    a, b = ({k[0] for k in r.keys}, {k[1] for k in r.keys}) if forward else ({k[1] for k in r.keys}, {k[0] for k in r.keys})
    one_far, one_near = unique(far, b), unique(near, a)
    if one_far:
        return "one_to_one" if one_near else "many_to_one"
    return "one_to_many" if one_near else "unknown"


def _version_rows(right: DataFrame, v, how: str, at: str | None):
    """Rows of a versioned entity that hold now (latest) or at a given day."""
    if isinstance(v, Snapshot):
        if how == "latest":
            if at is not None:
                return right.where(F.col(v.partition) == F.lit(at))
            newest = right.agg(F.max(v.partition).alias("_newest"))  # one row; partitions are pruned by it at run time
            return right.join(F.broadcast(newest), F.col(v.partition) == F.col("_newest"), "left_semi")
    if isinstance(v, Validity) and how == "latest":
        still = F.lit(False)
        for x in v.open_end:
            still = still | (F.col(v.valid_to).isNull() if x is None else F.col(v.valid_to) == F.lit(x))
        return right.where(still)
    return right


def join_step(catalog, left: DataFrame, r: Relationship, forward: bool, *, needed: list[Field], how="left", versions="latest", root_time=None, fanout="block", filtered=None):
    """Join the next entity of a path, keeping the rows of the left side unless the policy says otherwise."""
    far = r.right if forward else r.left
    keys = [(a, b) if forward else (b, a) for a, b in r.keys]
    e = catalog.entities[far]
    right = catalog.frame(far)
    kind = safety(catalog, r, forward)
    if e.versioning:
        right = _version_rows(right, e.versioning, versions, None)
    extra = [F.col(c) for c in right.columns]
    names = [f"{far}.{c}" for c in right.columns]
    renamed = right.select(*(c.alias(n) for c, n in zip(extra, names, strict=True)))
    condition = F.lit(True)
    for a, b in keys:
        condition = condition & (left[f"`{a}`"] == renamed[f"`{far}.{b}`"])
    if kind in ("one_to_many", "unknown") and not (e.versioning and versions == "root_time"):
        if fanout != "aggregate_then_join":
            raise PlanError("fanout-blocked", f"{r.name} is {kind}")
        keep = sorted({f"{far}.{b}" for _, b in keys} | {f"{far}.{f.name}" for f in needed if f.entity == far})
        for f in needed:
            if f.entity == far and f"{far}.{f.name}" not in renamed.columns:
                renamed = renamed.withColumn(f"{far}.{f.name}", f.of(right))
        if filtered is not None:
            renamed = renamed.where(filtered(renamed))
            how = "inner"
        renamed = renamed.select(*(F.col(f"`{c}`") for c in keep)).distinct()
    if e.versioning and versions == "root_time":
        t = F.col(root_time)
        if isinstance(e.versioning, Validity):
            v = e.versioning
            low, high = F.col(f"`{far}.{v.valid_from}`"), F.col(f"`{far}.{v.valid_to}`")
            open_ = high.isNull()
            for x in v.open_end:
                open_ = open_ | (high == F.lit(x)) if x is not None else open_
            upper = t < high if v.interval == "closed_open" else t <= high
            condition = condition & (t >= low) & (open_ | upper)
        else:
            return as_of(left, renamed, keys, far, e.versioning, root_time)
    return left.join(renamed, condition, how)


def as_of(left: DataFrame, right: DataFrame, keys, far: str, v: Snapshot, root_time: str) -> DataFrame:
    """Each root day takes the greatest partition not after it; a day before all partitions is an error.

    Only distinct days and partitions are put in one order; then rows join on equal keys.
    """
    part = f"`{far}.{v.partition}`"
    day = F.col(part).cast("date") if not v.format else F.try_to_timestamp(F.col(part), F.lit(T.java_pattern(v.format))).cast("date")
    partitions = right.select(day.alias("_day"), F.col(part).alias("_part"), F.lit(0).alias("_asked")).distinct()
    days = left.select(F.col(root_time).cast("date").alias("_day")).distinct()
    both = partitions.unionByName(days.withColumns({"_part": F.lit(None).cast(dict(partitions.dtypes)["_part"]), "_asked": F.lit(1)}))
    upto = Window.orderBy("_day", "_asked").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day and partition
    mapped = both.where("_day is not null or _asked = 1").withColumn("_p", F.last("_part", True).over(upto)).where("_asked = 1").select("_day", "_p")
    checked = mapped.withColumn(
        "_p",
        F.when(F.col("_day").isNotNull() & F.col("_p").isNull(), F.raise_error(F.concat(F.lit("as-of-partition-missing: "), F.col("_day").cast("string"))))
        .otherwise(F.col("_p")),
    )
    anchored = left.join(checked, F.col(root_time).cast("date").eqNullSafe(F.col("_day")), "left")
    condition = F.col("_p") == F.col(part)
    for a, b in keys:
        condition = condition & (anchored[f"`{a}`"] == right[f"`{far}.{b}`"])
    return anchored.join(right, condition, "left").drop("_day", "_p")


class Observation:
    """One entity's rows, joined, windowed and bucketed, ready to aggregate."""

    def __init__(self, catalog: Catalog, root: str, *, scope=None, grain=None, dimensions=(), where=None, time=None, report_tz=None, fanout="block", versions="latest", cohort=None, period=None):
        self.catalog, self.root, self.scope, self.grain = catalog, root, scope, grain
        self.joined = {root}
        self.dimensions = [catalog.field(d) for d in dimensions]
        df = catalog.frame(root)
        self.time = None
        if scope or grain or time or period:
            self.time = catalog.field(time) if time else catalog.default_time(root)
            raw = self.time.of(df)
            kind = dict(df.dtypes).get(self.time.body if isinstance(self.time.body, str) else "", "timestamp_ntz")
            if scope:
                p = self.time.parse
                if p.kind == "hour_prefix" and not p.timezone:
                    df = df.where(T.prefix_days(df, p, scope))
                if p.kind in ("datetime", "timestamp") and not p.timezone:
                    df = df.where(T.inside(raw, kind, scope, p))
                else:
                    if p.kind == "strptime" and isinstance(self.time.body, str):
                        df = df.where(T.inside(raw, kind, scope, p)) if T.sorts_by_time(p.format) and kind == "string" and not p.timezone else df
                    df = df.where(T.inside(T.civil(df, self.time.of(df), p, report_tz), "timestamp_ntz", scope))
            df = df.withColumn("_t", T.civil(df, self.time.of(df), self.time.parse, report_tz))
            if period:
                calendar, level = period
                c = catalog.calendars[calendar]
                days = c.source(catalog.spark).select(F.col(c.date).cast("date").alias("_cal_day"), F.col(c.levels[level]).alias("bucket_start"))
                df = df.join(days, F.col("_t").cast("date") == F.col("_cal_day")).drop("_cal_day")
            elif grain:
                df = df.withColumn("bucket_start", T.bucket(F.col("_t"), grain))
        slices = [(catalog.field(k), v) for k, v in (where or {}).items()]
        for f, v in slices:
            if f.entity == root:
                df = df.where(predicate(f.of(df), v))
        needed = self.dimensions + [f for f, _ in slices]
        self.df = self._reach(df, needed, slices, fanout, versions)
        if cohort is not None:
            on, members = cohort
            if on in self.df.columns:
                mine = self.df[f"`{on}`"]
            else:  # a field of an entity that each row has one of
                f = catalog.field(on)
                self.df = self._reach(self.df, [f], [], "block", versions)
                mine = self._column(self.df, f)
            self.df = self.df.join(members, mine.eqNullSafe(members[members.columns[0]]), "left_semi")

    def _reach(self, df, needed, slices, fanout, versions):
        catalog, joined = self.catalog, self.joined
        for f in needed:
            at = self.root
            for r, forward in path(catalog, self.root, f.entity):
                far = r.right if forward else r.left
                if far not in joined:
                    names = {a for k in r.keys for a in k}
                    left = df
                    if at != self.root:
                        for n in names:
                            if f"{at}.{n}" in df.columns:
                                left = left.withColumn(n, F.col(f"`{at}.{n}`"))
                    mine = [(g, v) for g, v in slices if g.entity == far]
                    apply = None
                    if mine:
                        apply = lambda x, mine=mine, far=far: self._all(x, mine, far)
                    df = join_step(catalog, left, r, forward, needed=needed, fanout=fanout, versions=versions, root_time="_t" if self.time else None, filtered=apply)
                    joined.add(far)
                at = far
        for f, v in slices:
            if f.entity != self.root:
                df = df.where(predicate(self._column(df, f), v))
        for f in self.dimensions:
            df = df.withColumn(f"d_{f.name}", self._column(df, f))
        return df

    @staticmethod
    def _all(df, slices, far):
        out = F.lit(True)
        for f, v in slices:
            out = out & predicate(F.col(f"`{far}.{f.name}`") if not isinstance(f.body, str) else F.col(f"`{far}.{f.body}`"), v)
        return out

    def _column(self, df: DataFrame, f: Field) -> Column:
        if f.entity == self.root:
            return f.of(df)
        if isinstance(f.body, str):
            found = f"{f.entity}.{f.body}" if f"{f.entity}.{f.body}" in df.columns else f"{f.entity}.{f.name}"
            return F.col(f"`{found}`")
        if f"{f.entity}.{f.name}" in df.columns:
            return F.col(f"`{f.entity}.{f.name}`")
        plain = df.select("*", *(F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in df.columns if c.startswith(f"{f.entity}.") and c.split(".", 1)[1] not in df.columns))
        return f.body(plain) if plain.columns == df.columns else f.body(_Prefixed(df, f.entity))

    @property
    def axes(self) -> list[Column]:
        out = [F.col("bucket_start")] if "bucket_start" in self.df.columns else []
        return out + [F.col(f"d_{f.name}").alias(f.name) for f in self.dimensions]

    @property
    def axis_names(self) -> list[str]:
        return (["bucket_start"] if "bucket_start" in self.df.columns else []) + [f.name for f in self.dimensions]


class _Prefixed:
    """Looks columns of a joined entity up by their bare names."""

    def __init__(self, df, entity):
        self.df, self.entity = df, entity

    def __getitem__(self, name):
        return F.col(f"`{self.entity}.{name}`")

    def __getattr__(self, name):
        return F.col(f"`{self.entity}.{name}`")


def aggregate_column(agg, x: Column) -> Column:
    if isinstance(agg, tuple):
        return F.percentile(x, F.lit(agg[1]))
    return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median}[agg](x)


def leaf_columns(catalog: Catalog, m: Metric, ob: Observation, extra: dict) -> list[tuple[str, Column]]:
    """(name, aggregate) of a leaf, its filter folded into the aggregate; components beside means."""
    df = ob.df
    cond = None
    for k, v in {**dict(m.where), **extra}.items():
        p = predicate(ob._column(df, catalog.field(k)), v)
        cond = p if cond is None else cond & p

    def only(x: Column) -> Column:
        return x if cond is None else F.when(cond, x)

    if m.kind == "count":
        return [(m.name, F.count(only(F.lit(1))))]
    if m.kind == "body":
        source = df if cond is None else df.where(cond)
        return [(m.name, m.body(source))]
    x = ob._column(df, catalog.field(m.measure))
    if m.kind == "weighted_mean":
        w = ob._column(df, catalog.field(m.weight))
        top = F.sum(only((x * w).cast("double")))
        bottom = F.sum(only(F.when(x.isNotNull() & w.isNotNull(), w).cast("double")))
        return [(m.name, F.try_divide(top, bottom)), (f"{m.name}__sum", top), (f"{m.name}__weight", bottom)]
    out = [(m.name, aggregate_column(m.agg, only(x)))]
    if m.agg == "mean":
        out += [(f"{m.name}__sum", F.sum(only(x)).cast("double")), (f"{m.name}__weight", F.count(only(x)).cast("double"))]
    return out


def leaves(catalog: Catalog, m: Metric, extra: dict | None = None) -> list[tuple[Metric, dict]]:
    """The physical leaves of a metric with the slices that were pushed down to them."""
    extra = extra or {}
    if m.kind == "slice":
        return leaves(catalog, catalog.children(m)[0], {**extra, **dict(m.where)})
    if m.kind in ("ratio", "linear"):
        return [x for c in catalog.children(m) for x in leaves(catalog, c, extra)]
    return [(m, extra)]


def outer_join(frames: list[DataFrame], axes: list[str]) -> DataFrame:
    """FULL OUTER on null-safe keys; absent sides give NULL."""
    out = frames[0]
    for right in frames[1:]:
        r = right.select(*(F.col(a).alias(f"_r_{a}") for a in axes), *(c for c in right.columns if c not in axes))
        if not axes:
            out = out.crossJoin(r)  # one row by one row
            continue
        on = F.lit(True)
        for a in axes:
            on = on & F.col(a).eqNullSafe(F.col(f"_r_{a}"))
        both = out.withColumn("_in_l", F.lit(True)).join(r, on, "full")
        rest = [c for c in both.columns if c not in axes and not c.startswith("_r_") and c != "_in_l"]
        keys = [F.when(F.col("_in_l"), F.col(a)).otherwise(F.col(f"_r_{a}")).alias(a) for a in axes]
        out = both.select(*keys, *rest)
    return out


def value_of(catalog: Catalog, m: Metric, extra: dict | None = None) -> Column:
    """A metric's value from the columns of its leaves; absent or NULL parts give NULL."""
    extra = extra or {}
    if m.kind == "slice":
        return value_of(catalog, catalog.children(m)[0], {**extra, **dict(m.where)})
    kids = catalog.children(m)
    if m.kind == "ratio":
        a, b = (value_of(catalog, k, extra).cast("double") for k in kids)
        if m.zero_division == "error":
            b = F.when(b == 0, F.raise_error(F.lit(f"zero-division: {m.name}"))).otherwise(b)
        return F.try_divide(a, b)
    if m.kind == "linear":
        out = None
        for (sign, _), k in zip(m.children, kids, strict=True):
            x = value_of(catalog, k, extra).cast("double") * sign
            out = x if out is None else out + x
        return out
    return F.col(f"`{leaf_name(m, extra)}`")


def leaf_name(m: Metric, extra: dict) -> str:
    return m.name if not extra else f"{m.name}|{sorted(extra.items(), key=repr)!r}"


def observe(catalog: Catalog, metrics, *, time_scope=None, grain=None, dimensions=(), slice_by=None, time_dimension=None, report_tz=None, versions="latest", cohort=None, calendar=None) -> Frame:
    """Observe one metric or several over the same axes, as one lazy plan."""
    from .cumulative import observe_cumulative

    many = isinstance(metrics, (list, tuple))
    wanted = [catalog.metric_of(m) for m in (metrics if many else [metrics])]
    if isinstance(grain, str):
        grain = T.Grain(grain)
    for m in wanted:
        catalog.depth(m)
        if catalog.occurrences(m) > 256:
            raise PlanError("metric-too-wide", m.name)
    if not many and wanted[0].kind == "cumulative":
        return observe_cumulative(catalog, wanted[0], time_scope, grain, dimensions, slice_by, report_tz)
    groups: dict[tuple, dict[str, tuple[Metric, dict]]] = {}
    for m in wanted:
        for leaf, extra in leaves(catalog, m):
            semi = isinstance(leaf.additivity, SemiAdditive)
            alone = leaf.name if leaf.kind == "body" or semi else None
            groups.setdefault((leaf.entity, leaf.fanout, alone), {})[leaf_name(leaf, extra)] = (leaf, extra)
    parts, axes, covered = [], [], None
    for (entity, fanout, _), members in groups.items():
        conditional = {k for leaf, extra in members.values() for k in {**dict(leaf.where), **extra}}
        reach = [k for k in conditional if catalog.field(k).entity != entity]
        ob = Observation(
            catalog, entity, scope=time_scope, grain=grain, dimensions=dimensions, where=slice_by, time=time_dimension,
            report_tz=report_tz, fanout=fanout, versions=versions, cohort=cohort, period=calendar,
        )
        if reach:
            ob.df = ob._reach(ob.df, [catalog.field(k) for k in reach], [], fanout, versions)
        axes = ob.axis_names
        first = next(iter(members.values()))[0]
        if isinstance(first.additivity, SemiAdditive):
            from .folds import coverage, expected_points, fold

            parts.append(fold(catalog, first, ob))
            points = expected_points(catalog, first, grain)
            covered = coverage(catalog, first, ob, points) if points and not many else None
            continue
        columns = []
        for leaf, extra in members.values():
            own = leaf_columns(catalog, leaf, ob, extra)
            rename = leaf_name(leaf, extra)
            columns += [(rename if n == leaf.name else n, c) for n, c in own]
        aggregated = ob.df.groupBy(*ob.axes).agg(*(c.alias(n) for n, c in columns))
        parts.append(aggregated)
    joined = outer_join(parts, axes)
    names = [m.name for m in wanted] if many else ["value"]
    extra = [c for c in joined.columns if c.endswith(("__sum", "__weight"))]
    out = joined.select(*axes, *(value_of(catalog, m).alias(n) for m, n in zip(wanted, names, strict=True)))
    components = joined.select(*axes, *extra) if extra else None
    if wanted[0].kind == "ratio" and not many:
        a, b = catalog.children(wanted[0])
        components = joined.select(
            *axes, value_of(catalog, a).cast("double").alias("value__sum"), value_of(catalog, b).cast("double").alias("value__weight")
        )
    return Frame(
        out, "metric", tuple(a for a in axes if a != "bucket_start"), "bucket_start" if "bucket_start" in axes else None,
        tuple(names), grain, time_scope,
        "additive" if all(m.additivity == "additive" for m in wanted) else "non_additive",
        components, covered, where=dict(slice_by or {}), meta={"metrics": [m.name for m in wanted]},
    )
