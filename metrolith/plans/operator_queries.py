"""More queries over the relational tables: calendars, alignments, roles, dispatch, failing checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.functions import periods
from metrolith.functions import time as T
from metrolith.operators import attribute, compare, events, lifecycle, quality, stats
from metrolith.plans.catalog_queries import (  # noqa: F401
    COHORT,
    DAILY,
    DELTA,
    HISTORY_SQL,
    IN96,
    IN97,
    MONTH,
    ORACLE_SQL,
    QUERIES,
    SHARES,
    STARTS,
    Y96,
    Y97,
    _change,
    _daily,
    _journeys,
    _replay,
    _two,
    query,
)
from metrolith.plans.model import CalendarAnchor, Participant, SemiAdditive, Validity
from metrolith.plans.planner import observe
from metrolith.plans.session import Session
from metrolith.sources import inspect, readers

# --- calendars ----------------------------------------------------------------------

#: Periods of four weeks, 13 a year, from 1995-01-02 on; what is left of a year joins its last.
PERIODS_SQL = """cal as (select cast(d as date) d, 'P' || lpad(cast(datediff('day', date '1995-01-02', d) // 28 as varchar), 3, '0') p
from generate_series(date '1995-01-02', date '1998-12-31', interval '1 day') g(d))"""


def _calendar(c):
    days = c.spark.sql("select explode(sequence(date'1995-01-02', date'1998-12-31', interval 1 day)) d")
    days = days.select("d", F.concat(F.lit("P"), F.lpad(F.floor(F.datediff("d", F.lit("1995-01-02").cast("date")) / 28).cast("string"), 3, "0")).alias("p"))
    c.period_calendar("four_weeks", lambda s: days, date="d", levels={"period": "p"})


@query(f"with {PERIODS_SQL} select p as bucket_start, round(sum(o_totalprice), 4) as value from orders join cal on cast(o_orderdate as date) = d where {IN96} group by all")
def observe_calendar_periods(c):
    _calendar(c)
    return observe(c, "revenue", time_scope=Y96, calendar=("four_weeks", "period"))


@query(f"with {PERIODS_SQL}, x as (select p, min(d) a, max(d) + 1 z from cal group by all) select p as period_key, a as period_start, cast(z as date) as period_end, row_number() over (order by a) - 1 as ordinal, z <= date '1996-12-31' as is_complete from x")
def calendar_period_attributes(c):
    _calendar(c)
    return c.periods("four_weeks", "period", through="1996-12-31")


@query(f"with {PERIODS_SQL} select count(*) - count(distinct d) as repeated, max(d) - min(d) + 1 - count(distinct d) as missing, 0::bigint as broken from cal")
def calendar_certified(c):
    _calendar(c)
    found = c.certify("four_weeks", "period")
    return c.spark.createDataFrame([tuple(found.values())], "repeated bigint, missing bigint, broken bigint")


@query(f"""with {PERIODS_SQL}, x as (select d b, p from cal where d >= '1996-01-01' and d < '1996-04-01')
select b as bucket_start, round((select coalesce(sum(o_totalprice), 0) from orders join cal on cast(o_orderdate as date) = cal.d where cal.p = x.p and cal.d <= b), 2) as value from x""")
def cumulative_calendar_to_date(c):
    _calendar(c)
    c.cumulative("revenue_ptd", "revenue", anchor=CalendarAnchor("four_weeks", "period"))
    return observe(c, "revenue_ptd", time_scope=T.time_scope(start="1996-01-01", end="1996-04-01"), grain="day").df.withColumn("value", F.round("value", 2))


@query(f"""with {PERIODS_SQL}, x as (select d b, p from cal where d >= '1996-01-01' and d < '1996-04-01')
select b as bucket_start, (select count(distinct o_custkey) from orders join cal on cast(o_orderdate as date) = cal.d where cal.p = x.p and cal.d <= b)::double as value from x""")
def cumulative_calendar_distinct(c):
    _calendar(c)
    c.cumulative("customers_ptd", "customers", anchor=CalendarAnchor("four_weeks", "period"))
    return observe(c, "customers_ptd", time_scope=T.time_scope(start="1996-01-01", end="1996-04-01"), grain="day")


@query(f"""with {PERIODS_SQL}, h as (select p, sum(o_totalprice) y from orders join cal on cast(o_orderdate as date) = d where d >= '1996-01-01' and d < '1996-12-01' group by all),
n as (select p, row_number() over (order by p) i from (select distinct p from cal)), z as (select i, y from h join n using (p) order by i desc limit 1)
select n.p as time, round(z.y, 2) as predicted, n.i - z.i as horizon_index from z join n on n.i between z.i + 1 and z.i + 3""")
def forecast_certified_periods(c):
    _calendar(c)
    history = observe(c, "revenue", time_scope=T.time_scope(start="1996-01-01", end="1996-12-01"), calendar=("four_weeks", "period"))
    out = stats.forecast(history, horizon=3, model="naive", periods=c.periods("four_weeks", "period")).df
    return out.select("time", F.round("predicted", 2).alias("predicted"), "horizon_index")


@query(f"select b as bucket_start, round(least(3, (select count(distinct {MONTH}) from orders where o_orderdate >= b - interval '2 months' and o_orderdate < b + interval '1 month')) / 3.0, 4)::double as coverage_ratio from (select cast(unnest(generate_series(date '1992-01-01', date '1992-06-01', interval '1 month')) as date) b)")
def cumulative_trailing_coverage(c):
    return observe(c, "revenue_trailing", time_scope=T.time_scope(start="1992-01-01", end="1992-07-01"), grain="month").coverage


# --- time encodings, versions -----------------------------------------------------------


@query("select strftime(ts, '%Y%m%d') as dt, count(*) as value from events where ts >= '2024-01-03 06:00:00' and ts < '2024-01-05 18:00:00' group by all")
def observe_hour_prefix(c):
    base = c.frame("events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("dt"), F.hour("ts").alias("hh"))
    c.entity("hourly_parts", base, primary_key=["event_id"])
    c.time_dimension("hh", "hourly_parts", granularity="hour", parse=T.hour_prefix("dt"))
    c.dimension("dt", "hourly_parts")
    c.count("part_count", "hourly_parts")
    return observe(c, "part_count", time_scope=T.time_scope(start="2024-01-03 06:00:00", end="2024-01-05 18:00:00"), dimensions=["dt"])


@query(f"select 'gold' as level, count(*) as value from orders join customer on o_custkey = c_custkey where {IN96} group by all")
def join_validity_latest(c):
    base = c.frame("customer").select("c_custkey")
    old = base.select("c_custkey", F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit("1996-07-04").cast("date").alias("valid_to"), F.lit("silver").alias("level"))
    now = base.select("c_custkey", F.lit("1996-07-04").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("gold").alias("level"))
    c.entity("levels", old.union(now), primary_key=["c_custkey", "valid_from"], versioning=Validity("valid_from", "valid_to"))
    c.relationship("order_level", "orders", "levels", [("o_custkey", "c_custkey")])
    c.dimension("level", "levels")
    return observe(c, "order_count", time_scope=Y96, dimensions=["level"])


# --- transforms ---------------------------------------------------------------------------


@query("select o_orderpriority, round(sum(o_totalprice), 4) as value from orders where o_orderpriority like '%I%' group by all")
def transform_filter(c):
    return observe(c, "revenue", dimensions=["o_orderpriority"]).transform.filter(predicate=lambda df: F.col("o_orderpriority").contains("I"))


@query("select o_orderstatus, count(*) as order_count from orders group by all")
def transform_metric_projection(c):
    return observe(c, ["revenue", "order_count"], dimensions=["o_orderstatus"]).metric("order_count")


@query("select o_orderpriority, o_orderstatus, count(*) as value from orders group by all")
def frame_stable_order(c):
    return observe(c, "order_count", dimensions=["o_orderpriority", "o_orderstatus"]).sorted()


# --- alignments ---------------------------------------------------------------------------

JAN97, JAN96 = T.time_scope(start="1997-01-01", end="1997-02-01"), T.time_scope(start="1996-02-01", end="1996-03-01")
ALIGNED = "'exact' as align_quality, 'matched' as presence_status, a.t as bucket_start_a, b.t as bucket_start_b"


def _days(window: str, name: str) -> str:
    return f"select cast(o_orderdate as date) t, sum(o_totalprice) {name} from orders where {window} group by all"


def _day_of_week(within: str, a: str, b: str, nth: str) -> str:
    """Days keyed by the period's place in the window, the week in the period, the weekday."""
    key = f"({nth}) || '-' || (datediff('day', cast(date_trunc('{within}', t) as date), t) // 7) || '-' || isodow(t)"
    return f"""with a as (select *, {key.replace("FIRST", "(select min(t) from x)")} k from (with x as ({_days(a, 'c')}) select x.*, (select min(t) from x) f from x)),
    b as (select *, {key.replace("FIRST", "(select min(t) from x)")} k from (with x as ({_days(b, 'b')}) select x.*, (select min(t) from x) f from x))
    select a.k as align_key, {ALIGNED}, {DELTA} from a join b on a.k = b.k"""


def _daily_two(c, current, baseline):
    return (observe(c, "revenue", time_scope=T.time_scope(start=s, end=e), grain="day") for s, e in (current, baseline))


def _between(a, b):
    return f"o_orderdate >= '{a}' and o_orderdate < '{b}'"


@query(_day_of_week("month", _between("1997-01-01", "1997-03-01"), _between("1996-03-01", "1996-05-01"), "datediff('month', date_trunc('month', f), date_trunc('month', t))"))
def compare_day_of_week_month(c):
    sides = _daily_two(c, ("1997-01-01", "1997-03-01"), ("1996-03-01", "1996-05-01"))
    return compare.compare(*sides, compare.day_of_week(unmatched="drop"))


@query(_day_of_week("week", _between("1997-01-06", "1997-02-03"), _between("1996-01-01", "1996-01-29"), "datediff('day', cast(date_trunc('week', f) as date), cast(date_trunc('week', t) as date)) // 7"))
def compare_day_of_week_week(c):
    sides = _daily_two(c, ("1997-01-06", "1997-02-03"), ("1996-01-01", "1996-01-29"))
    return compare.compare(*sides, compare.day_of_week(within=T.Grain("week"), unmatched="drop"))


@query(_day_of_week("quarter", _between("1997-01-01", "1997-04-01"), _between("1996-01-01", "1996-04-01"), "datediff('quarter', date_trunc('quarter', f), date_trunc('quarter', t))"))
def compare_day_of_week_quarter(c):
    sides = _daily_two(c, ("1997-01-01", "1997-04-01"), ("1996-01-01", "1996-04-01"))
    return compare.compare(*sides, compare.day_of_week(within=T.Grain("quarter"), unmatched="drop"))


@query(f"with a as ({_days(IN97, 'c')}), b as ({_days(IN96, 'b')}) select cast(datediff('day', date '1998-01-01', a.t) as varchar) as align_key, {ALIGNED}, {DELTA} from a join b on datediff('day', date '1998-01-01', a.t) = datediff('day', date '1997-01-01', b.t)")
def compare_occurrence_progress_from_end(c):
    return compare.compare(*_two(c, grain="day"), compare.occurrence_progress(anchor="end", unmatched="drop"))


@query(
    f"""with a as (select {MONTH} t, sum(o_totalprice) c from orders where o_orderdate >= '1996-04-01' and o_orderdate < '1996-10-01' and o_orderstatus = 'F' group by all),
    b as (select {MONTH} t, sum(o_totalprice) b from orders where o_orderdate >= '1996-06-01' and o_orderdate < '1996-12-01' and o_orderstatus = 'O' group by all)
    select coalesce(a.t, b.t) as bucket_start, coalesce(a.t, b.t) as bucket_start_b, round(c, 4) as current, round(b, 4) as baseline, round(c - b, 4) as delta, round((c - b) / nullif(abs(b), 0), 4) as pct_change,
    case when c is null or b is null then 'not_computable' when b <> 0 then 'computed' else 'other' end as pct_change_status from a full join b on a.t = b.t"""
)
def compare_calendar_buckets(c):
    a = observe(c, "revenue", time_scope=T.time_scope(start="1996-04-01", end="1996-10-01"), grain="month", slice_by={"o_orderstatus": "F"})
    b = observe(c, "revenue", time_scope=T.time_scope(start="1996-06-01", end="1996-12-01"), grain="month", slice_by={"o_orderstatus": "O"})
    return compare.compare(a, b, compare.window_bucket(mode="calendar_bucket"))


# --- attribution ----------------------------------------------------------------------------


@query(f"with x as ({_change('o_orderpriority')}) select 1 as attribution_level, o_orderpriority as attribution_path, {SHARES} from x")
def attribute_at_resolution(c):
    d = compare.compare(*_two(c, dimensions=["o_orderpriority", "o_orderstatus"]))
    level = attribute.at_resolution(attribute.additive(d, ["o_orderpriority", "o_orderstatus"], "hierarchy"), ["o_orderpriority"]).df
    return level.select("attribution_level", "attribution_path", "contribution", "share_of_total_delta", "share_of_positive_pool", "share_of_negative_pool")


@query(
    f"""with a as (select distinct o_orderpriority p, o_custkey k from orders where {IN97}), b as (select distinct o_orderpriority p, o_custkey k from orders where {IN96}),
    x as (select p, sum(1.0::double / n) w from (select *, count(*) over (partition by k) n from a) group by p), y as (select p, sum(1.0::double / n) w from (select *, count(*) over (partition by k) n from b) group by p),
    z as (select coalesce(x.p, y.p) p, coalesce(x.w, 0) - coalesce(y.w, 0) d from x full join y on x.p = y.p)
    select p as o_orderpriority, {SHARES}, row_number() over (order by abs(d) desc, p) as rank from z"""
)
def attribute_session_distinct(c):
    sides = [observe(c, "customers", time_scope=s) for s in (Y97, Y96)]
    out = Session(c).attribute(compare.compare(*sides), axes=["o_orderpriority"]).df
    return out.select("o_orderpriority", "contribution", "share_of_total_delta", "share_of_positive_pool", "share_of_negative_pool", F.col("rank").cast("bigint").alias("rank"))


def shapley_sql(players: list[str], axis: str, measure: str, q: float) -> str:
    """Shapley values of a quantile by all coalitions: each player's marginal change, weighted by the coalition's size."""
    n = len(players)
    fact = [1]
    for i in range(1, n + 1):
        fact.append(fact[-1] * i)
    weights = ", ".join(f"({k}, {fact[k] * fact[n - k - 1] / fact[n]!r}::double)" for k in range(n))
    names = ", ".join(f"({i}, '{p}')" for i, p in enumerate(players))
    return f"""with p(i, name) as (values {names}), w(size, weight) as (values {weights}), s(mask) as (select unnest(range({1 << n}))),
    r as (select p.i, {measure} v, o_orderdate >= '1997-01-01' now from orders join p on {axis} = p.name where o_orderdate >= '1996-01-01' and o_orderdate < '1998-01-01' and {measure} is not null),
    worth as (select mask, quantile_cont(v, {q}) x from s, r where now = ((mask >> i) & 1 = 1) group by mask),
    d as (select p.name k, sum(weight * (b.x - a.x)) d from p, worth a join worth b on true join w on w.size = bit_count(a.mask::bigint) where (a.mask >> p.i) & 1 = 0 and b.mask = a.mask + (1 << p.i) group by all)"""


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"{shapley_sql(PRIORITIES, 'o_orderpriority', 'o_totalprice', 0.9)} select k as o_orderpriority, {SHARES}, row_number() over (order by abs(d) desc, k) as rank from d")
def attribute_quantile(c):
    """The 90th percentile of the prices themselves."""
    o = c.frame("orders")
    sides = [o.where(T.inside(F.col("o_orderdate"), "timestamp_ntz", s)) for s in (Y97, Y96)]
    return attribute.quantile(*sides, "o_orderpriority", "o_totalprice", 0.9).df.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"{shapley_sql(PRIORITIES, 'o_orderpriority', 'o_totalprice', 0.5)} select k as o_orderpriority, round(d, 4) as contribution from d")
def attribute_session_median(c):
    sides = [observe(c, "median_price", time_scope=s) for s in (Y97, Y96)]
    return Session(c).attribute(compare.compare(*sides), axes=["o_orderpriority"]).df.select("o_orderpriority", "contribution")


@query(f"with x as (select o_orderpriority, sum(case when o_orderdate < '1998-01-01' then o_totalprice else 0 end) - sum(case when o_orderdate < '1997-01-01' then o_totalprice else 0 end) d from orders where o_orderdate < '1998-01-01' group by all) select o_orderpriority, round(d, 2) as contribution from x")
def attribute_cumulative_axis(c):
    sides = [observe(c, "revenue_to_date", time_scope=s) for s in (Y97, Y96)]
    out = Session(c).attribute(compare.compare(*sides), axes=["o_orderpriority"]).df
    return out.select("o_orderpriority", F.round("contribution", 2).alias("contribution"))


# --- statistics --------------------------------------------------------------------------------


@query("with s as (select row_number() over (order by e, d) i, e, d, v from (" + DAILY + ") where d >= '2024-01-01' and d < '2024-02-01'), p as (select a.e, sign(epoch(a.d) - epoch(b.d)) * sign(a.v - b.v) s, 1 x, abs(sign(a.v - b.v)) y from s a join s b on a.e = b.e and a.i < b.i) select round(sum(s) / sqrt(sum(x) * sum(y)), 4) as correlation from p where e = 'view'")
def correlate_kendall_with_ties(c):
    daily = _daily(c)
    f = daily.having(daily.df.where("event_type = 'view'").drop("event_type"), keys=())
    t = f.having(f.df.withColumn("value", F.datediff("bucket_start", F.lit("2024-01-01").cast("date"))))
    return stats.correlate(t, f, method="kendall").df.select("correlation")


# --- events, lifecycles ----------------------------------------------------------------------------

QUEUE = """e as (select user_id u, ts, event_type t, event_id, row_number() over (partition by user_id order by ts, event_type, event_id::varchar) i from events
where (event_type = 'view' and ts >= '2024-01-01' and ts < '2024-01-31') or (event_type = 'purchase' and ts >= '2024-01-01' and ts < '2024-01-31')),
s as (select * from e where t = 'purchase' or ts < '2024-01-20'),
b as (select *, sum(case when t = 'view' then 1 else 0 end) over w v, sum(case when t = 'purchase' then 1 else 0 end) over w p from s window w as (partition by u order by i)),
l as (select *, greatest(0, -min(v - p) over (partition by u order by i)) lost from b),
m as (select *, p - lost n, lost - coalesce(lag(lost) over (partition by u order by i), 0) fresh from l),
j as (select a.u, cast(a.v - 1 as bigint) nth, a.ts t0, z.ts t1 from m a left join m z on z.u = a.u and z.t = 'purchase' and z.fresh = 0 and z.n = a.v where a.t = 'view')"""


@query(f"with {QUEUE} select cast(u as varchar) as subject, nth, 'view' as step_key, t0 as occurred_at, case when t1 is null then 'incomplete' else 'complete' end as completion_status from j union all select cast(u as varchar), nth, 'purchase', t1, case when t1 is null then 'incomplete' else 'complete' end from j")
def events_match_every_start(c):
    pattern = events.sequence(events.step(event="view", key="view"), events.step(event="purchase", key="purchase"))
    out = events.match(c, pattern=pattern, cohort_window=COHORT, completion_through="2024-01-31", matching=events.every_start(completion_assignment="exclusive")).df
    nth = F.element_at(F.split("journey_id", "#"), -1).cast("bigint").alias("nth")
    return out.select(F.col("subject_identity.k0").alias("subject"), nth, "step_key", "occurred_at", "completion_status")


@query("with v as (select user_id u, ts t0, event_id from events where event_type = 'view' and ts >= '2024-01-01' and ts < '2024-01-20') select cast(u as varchar) as subject, t0 as start_time, (select min(ts) from events where user_id = u and event_type = 'purchase' and ts > t0 and ts < '2024-01-31') as end_time from v")
def events_match_every_start_shared(c):
    pattern = events.sequence(events.step(event="view", key="view"), events.step(event="purchase", key="purchase"))
    found = events.match(c, pattern=pattern, cohort_window=COHORT, completion_through="2024-01-31", matching=events.every_start(completion_assignment="shared"))
    return events.time_to_event(found, start_step="view", end_step="purchase").df.select(F.col("subject_identity.k0").alias("subject"), "start_time", "end_time")


def _axes(journeys):
    return journeys.df.select("subject_identity").distinct().withColumn("parity", F.col("subject_identity.k0").cast("bigint") % 2)


GROUPED = f"{STARTS}, g as (select *, u % 2 as parity from p)"


@query(f"{GROUPED} select parity, 'signup' as step_key, count(*) as entry_count, count(*) as reached_count, 0::bigint as lost_count from g group by parity union all select parity, 'view', count(*), count(t1), count(*) - count(t1) from g group by parity union all select parity, 'purchase', count(t1), count(t2), count(t1) - count(t2) from g group by parity")
def events_grouped_funnel(c):
    j = _journeys(c)
    return events.funnel(j, axes=_axes(j), by=["parity"]).df.select("parity", "step_key", "entry_count", "reached_count", "lost_count")


def _half(c, start, end):
    pattern = events.sequence(events.step(event="signup", key="signup"), events.step(event="purchase", key="purchase"))
    j = events.match(c, pattern=pattern, cohort_window=T.time_scope(start=start, end=end), completion_through=end, covered_through=end)
    return events.funnel(j, axes=_axes(j), by=["parity"])


def _half_sql(name, start, end):
    return f"""{name} as (select u % 2 as parity, count(*) n, count(t1) r from (select u, t0, (select min(ts) from events where user_id = u and event_type = 'purchase' and ts > t0 and ts < '{end}') t1
    from (select user_id u, min(ts) t0 from events where event_type = 'signup' and ts >= '{start}' and ts < '{end}' group by all)) group by all)"""


HALVES = f"with {_half_sql('a', '2024-01-15', '2024-01-29')}, {_half_sql('b', '2024-01-01', '2024-01-15')}"


@query(f"{HALVES} select parity, 'signup' as step_key, a.n as current_reached_count, b.n as baseline_reached_count, 0.0::double as loss_rate_from_previous_delta from a join b using (parity) union all select parity, 'purchase', a.r, b.r, round((a.n - a.r) / a.n - (b.n - b.r) / b.n, 4) from a join b using (parity)")
def compare_funnels(c):
    d = compare.compare_funnels(_half(c, "2024-01-15", "2024-01-29"), _half(c, "2024-01-01", "2024-01-15")).df
    return d.select("parity", "step_key", "current_reached_count", "baseline_reached_count", "loss_rate_from_previous_delta")


@query(f"{HALVES}, t as (select parity, a.n - a.r lc, b.n - b.r lb, sum(a.n) over () nc, sum(b.n) over () nb from a join b using (parity)) select parity, 'loss' as contribution_kind, round((lc - lb) / nc, 4) as contribution from t union all select parity, 'denominator_mix', round(lb * (1.0::double / nc - 1.0::double / nb), 4) from t")
def attribute_funnel_loss(c):
    sides = [_half(c, s, e).df for s, e in (("2024-01-15", "2024-01-29"), ("2024-01-01", "2024-01-15"))]
    return attribute.funnel_loss(*sides, ["parity"], "purchase").df.select("parity", "contribution_kind", "contribution")


@query("select event_type as event, min(ts) as observed_from, max(ts) as observed_through, count(*) as occurrences from events where event_type in ('signup', 'purchase') group by all")
def events_watermark(c):
    return events.watermark(c, ["signup", "purchase"])


@query("select cast(l_suppkey as varchar) as supplier, count(*) as n from lineitem where l_shipdate >= '1996-01-01' and l_shipdate < '1997-01-01' and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) group by all")
def events_by_role(c):
    c.event("shipped", "lineitem", identity=["l_orderkey", "l_linenumber"], occurred_at="l_shipdate", subject=["l_orderkey"], roles={"supplier": ["l_suppkey"], "part": ["l_partkey"]})
    members = c.frame("supplier").where("s_acctbal > 0").select(F.struct(F.col("s_suppkey").cast("string").alias("k0")).alias("subject_identity"))
    found = events.occurrences(c, ["shipped"], Y96.start, Y96.end, members, role="supplier")
    return found.groupBy(F.col("subject.k0").alias("supplier")).agg(F.count("*").alias("n"))


VIOLATIONS = """select case when t0 is null or ts < t0 then 'ignored_pre_inception' when t2 is not null and ts > t2 then 'transition_from_terminal' else 'illegal_transition' end as violation_kind, count(*) as n
from (select e.user_id u, e.ts, e.event_type t from events e where event_type in ('signup', 'purchase', 'error') and ts < '2024-02-01') x left join (select * from p) p using (u)
where not (t = 'signup' and ts = t0) and not (t = 'purchase' and ts is not distinct from t1) and not (t = 'error' and ts is not distinct from t2) group by all"""


@query(f"{HISTORY_SQL} {VIOLATIONS}")
def lifecycle_violations(c):
    return lifecycle.violations(_replay(c)).groupBy("violation_kind").agg(F.count("*").alias("n"))


SECONDS = "floor(epoch(z)) - floor(epoch(a))"


@query(f"{HISTORY_SQL} select s as model_state, count(*) as interval_count, count(z) as completed_count, round(avg({SECONDS}), 2) as mean_duration, round(median({SECONDS}), 2) as median_duration, round(quantile_cont({SECONDS}, 0.9), 2) as p90_duration from h group by all")
def lifecycle_dwell_durations(c):
    names = ["mean_duration", "median_duration", "p90_duration"]
    return lifecycle.dwell(_replay(c)).select("model_state", "interval_count", "completed_count", *(F.round(n, 2).alias(n) for n in names))


@query(f"{HISTORY_SQL}, x as (select 'active' f, 'customer' t, count(*) filter (where t1 is not null) n from p union all select 'active', 'failed', count(*) filter (where t1 is null and t2 is not null) from p union all select 'customer', 'failed', count(*) filter (where t1 is not null and t2 is not null) from p) select f as from_model_state, t as to_model_state, round(n / sum(n) over (), 4) as share_of_modeled_transitions from x")
def lifecycle_transition_shares(c):
    return lifecycle.transitions(_replay(c)).select("from_model_state", "to_model_state", "share_of_modeled_transitions")


@query(f"{HISTORY_SQL} select cast(u as varchar) as subject from h where s = 'active' and a <= '2024-01-10' and coalesce(z, timestamp '2024-02-01') > '2024-01-10'")
def subjects_in_active_state(c):
    return lifecycle.in_state(_replay(c), "active", "2024-01-10 00:00:00").select(F.col("subject_identity.k0").alias("subject"))


@query("""with s as (select user_id u, min(ts) t0 from events where event_type = 'signup' and ts >= '2024-01-01' and ts < '2024-01-03' group by all)
select cast(u as varchar) as subject from s where not exists (select 1 from events where user_id = u and event_type = 'purchase' and ts > t0 and ts < '2024-01-03')""")
def subjects_dropped_in_two_days(c):
    pattern = events.sequence(events.step(event="signup", key="signup"), events.step(event="purchase", key="purchase"))
    j = events.match(c, pattern=pattern, cohort_window=T.time_scope(start="2024-01-01", end="2024-01-03"), completion_through="2024-01-03", covered_through="2024-01-03")
    return events.dropped_before(j, "purchase").select(F.col("subject_identity.k0").alias("subject"))


# --- quality, with failing checks --------------------------------------------------------------------


@query(f"with x as (select {MONTH} t from orders where {IN96} group by all) select 'duplicate_keys' as check_id, 'blocking' as severity, cast(count(*) as varchar) as details from x union all select 'row_count', 'ok', cast(2 * count(*) as varchar) from x union all select 'null_ratio:value', 'warning', '0.5' union all select 'time_coverage', 'warning', count(*) || '/24' from x")
def quality_metric_failing(c):
    f = observe(c, "revenue", time_scope=Y96, grain="month")
    twice = f.df.union(f.df.withColumn("value", F.lit(None).cast("double")))
    wide = f.having(twice, scope=T.time_scope(start="1996-01-01", end="1998-01-01"))
    return quality.assess_quality(wide).df.where("check_id in ('duplicate_keys', 'row_count', 'null_ratio:value', 'time_coverage')").select("check_id", "severity", "details")


@query(f"with a as (select o_orderpriority from orders where {IN96} or {IN97} group by all) select 'delta_row_contract' as check_id, 'ok' as severity, '' as details union all select 'delta_math', 'blocking', cast(count(*) as varchar) from a")
def quality_delta_failing(c):
    d = compare.compare(*_two(c, dimensions=["o_orderpriority"]))
    return quality.assess_quality(d.having(d.df.withColumn("delta", F.col("delta") + 1))).df.select("check_id", "severity", "details")


@query(f"{STARTS} select 'event_ordering' as check_id, 'blocking' as severity, cast(count(t1) + count(t2) as varchar) as details from p")
def quality_events_failing(c):
    j = _journeys(c)
    back = F.col("occurred_at") - F.make_dt_interval(F.col("place") * 100)
    return quality.assess_quality(j.having(j.df.withColumn("occurred_at", back))).df.where("check_id = 'event_ordering'").select("check_id", "severity", "details")


# --- sources ---------------------------------------------------------------------------------------------


@query("select o_orderstatus as status, count(*) as n from orders group by all")
def source_table(c):
    c.frame("orders").createOrReplaceTempView("metrolith_orders_table")
    read = readers.table("metrolith_orders_table", columns={"status": ("o_orderstatus", "string"), "id": ("o_orderkey", "int64")})
    return read(c.spark).groupBy("status").agg(F.count("id").alias("n"))


@query("select event_type as kind, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k from events group by all")
def source_json_records(c):
    """An envelope of records, unpacked, each with one array that is traversed."""
    item = F.struct(F.col("event_type").alias("kind"), F.array(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"))).alias("items"))
    body = c.frame("events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(item).alias("records"))).alias("value")).select("value")
    rows = readers.from_payload(body, schema={"kind": "string", "k": "int64"}, records_path="records", field_paths={"kind": "kind", "k": "items[*].k"})
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("select least(200, count(*)) as n from orders")
def source_sample(c):
    return inspect.sample(c.frame("orders"), max_rows=200)[0].agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as rows from orders group by all order by 1, 2 limit 7")
def source_partitions(c):
    return inspect.partitions(c.frame("orders"), ["o_orderstatus", "o_orderpriority"], 7)


@query("select min(o_orderdate)::timestamp as first, max(o_orderdate)::timestamp as last, count(*) as rows, count(*) - count(o_orderdate) as missing, count(distinct cast(o_orderdate as date)) as days from orders")
def source_extent(c):
    return inspect.extent(c.frame("orders"), "o_orderdate")


@query("select count(*) as rows, count(*) - count(event_type) as nulls, count(distinct event_type) as distinct, round((select max(n) from (select count(*) n from events where event_type is not null group by event_type)) / count(*), 4) as top_share from events")
def source_dimension_evidence(c):
    return inspect.dimension_evidence(c.frame("events"), "event_type")


@query("select count(*) as rows, count(*) - count(value) as nulls, count(*) filter (value < 0) as negatives, count(*) filter (value = 0) as zeros, round(sum(value), 4) as total, round(min(value), 4) as least, round(max(value), 4) as most from events")
def source_measure_evidence(c):
    return inspect.measure_evidence(c.frame("events"), "value")


@query("select n_name, count(*) as value from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where c_mktsegment in ('BUILDING') group by all")
def subjects_cohort_by_path(c):
    """A cohort of market segments, along the path from orders to customers."""
    members = c.frame("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_mktsegment").alias("member")).distinct()
    return observe(c, "order_count", dimensions=["n_name"], cohort=("c_mktsegment", members))


@query("with s as (select date_trunc('hour', ts) h from events where ts >= '2024-01-02' and ts < '2024-01-06' group by all) select cast(h as date) as bucket_start, count(*) as sample_points, 24 as expected_points, round(count(*) / 24, 4) as coverage, case when count(*) = 24 then 'complete' else 'partial' end as status from s group by all")
def fold_coverage(c):
    c.entity("hourly", c.frame("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), primary_key=["event_id"])
    c.time_dimension("hour", "hourly", granularity="hour")
    c.measure("level", "hourly", "value", additivity=SemiAdditive("hourly.hour", "mean"))
    c.aggregate("mean_level", "level", "sum")
    return observe(c, "mean_level", time_scope=T.time_scope(start="2024-01-02", end="2024-01-06"), grain="day").coverage


@query(f"{HALVES} select 'funnel_delta_math' as check_id, 'blocking' as severity, cast((select count(*) from a join b using (parity)) as varchar) as details union all select 'funnel_delta_counts', 'ok', '0'")
def quality_funnel_delta(c):
    d = compare.compare_funnels(_half(c, "2024-01-15", "2024-01-29"), _half(c, "2024-01-01", "2024-01-15"))
    off = F.when(F.col("step_key") == "purchase", F.col("loss_rate_from_previous_delta") + 1).otherwise(F.col("loss_rate_from_previous_delta"))
    return quality.assess_quality(d.having(d.df.withColumn("loss_rate_from_previous_delta", off))).df.select("check_id", "severity", "details")


@query(f"{HALVES} select 'funnel_attribution_kinds' as check_id, 'blocking' as severity, cast(count(*) as varchar) as details from a join b using (parity)")
def quality_funnel_attribution(c):
    sides = [_half(c, s, e).df for s, e in (("2024-01-15", "2024-01-29"), ("2024-01-01", "2024-01-15"))]
    found = attribute.funnel_loss(*sides, ["parity"], "purchase")
    cut = found.having(found.df.where("contribution_kind = 'loss'"))
    return quality.assess_quality(cut).df.where("check_id = 'funnel_attribution_kinds'").select("check_id", "severity", "details")


@query(f"{HISTORY_SQL} select 'lifecycle_history_trace' as check_id, 'blocking' as severity, cast(count(*) filter (where s <> 'active') as varchar) as details from h union all select 'lifecycle_censoring', 'warning', cast(count(*) filter (where z is null) as varchar) from h")
def quality_lifecycle(c):
    h = _replay(c)
    moved = h.df.withColumn("entered_by_event_ref", F.lit("unknown"))
    return quality.assess_quality(h.having(moved)).df.where("check_id in ('lifecycle_history_trace', 'lifecycle_censoring')").select("check_id", "severity", "details")


# --- period resolvers, participants, populations ---------------------------------------------------------


@query("""with x as (select cast(o_orderdate as date) d from orders where d < '1994-01-01')
select strftime(d, '%G-W%V') as week, strftime(d, '%Y-%m') as month, year(d) || '-Q' || quarter(d) as quarter, date_diff('day', date_trunc('quarter', d), d) as day_in_quarter, month(d) - 1 as month_in_year,
case when month(date_trunc('week', d)) = month(date_trunc('week', d) + interval 6 days) then strftime(date_trunc('week', d), '%Y-%m') end as whole_month, count(*) as n from x group by all""")
def calendar_gregorian_periods(c):
    d = F.col("o_orderdate").cast("date")
    found = {
        "week": periods.key(d, "week"), "month": periods.key(d, "month"), "quarter": periods.key(d, "quarter"),
        "day_in_quarter": periods.ordinal_within(d, "day", "quarter").cast("bigint"), "month_in_year": periods.ordinal_within(d, "month", "year").cast("bigint"),
        "whole_month": periods.containing(d, "week", "month"),
    }
    return c.frame("orders").where("o_orderdate < '1994-01-01'").groupBy(*(v.alias(k) for k, v in found.items())).agg(F.count("*").alias("n"))


def _nested_calendar(c):
    days = c.spark.sql("select explode(sequence(date'1995-01-02', date'1998-12-31', interval 1 day)) d").withColumn("n", F.datediff("d", F.lit("1995-01-02").cast("date")))
    numbered = days.select("d", F.floor(F.col("n") / 28).alias("p"), F.floor(F.col("n") / 364).alias("y"), F.floor(F.col("n") / 100).alias("h"), (F.floor(F.col("n") / 28) - 13).alias("was"))
    c.period_calendar("nested", lambda s: numbered, date="d", levels={"period": "p", "year": "y", "hundred": "h"}, correspondences={"last_year": ("period", "was")})


NESTED_SQL = "cal as (select d, n // 28 p, n // 364 y, n // 100 h from (select cast(d as date) d, date_diff('day', date '1995-01-02', d) n from generate_series(date '1995-01-02', date '1998-12-31', interval '1 day') g(d)))"


@query(f"""with {NESTED_SQL}, x as (select p, min(d) a, case when count(distinct y) = 1 then min(y) end w, case when count(distinct h) = 1 then min(h) end v from cal group by p)
select p as period_key, w as year_key, case when w is not null then row_number() over (partition by w order by a) - 1 end as place, v as hundred_key from x""")
def calendar_period_positions(c):
    _nested_calendar(c)
    year = c.period_positions("nested", "period", "year").select("period_key", F.col("within_key").alias("year_key"), F.col("ordinal_within").alias("place"))
    return year.join(c.period_positions("nested", "period", "hundred").select("period_key", F.col("within_key").alias("hundred_key")), "period_key")


@query(f"with {NESTED_SQL}, x as (select p, min(d) a from cal group by p) select cal.p as period_key, date_diff('day', a, cal.d) as day_ordinal, count(*) as n from orders left join cal on cast(o_orderdate as date) = cal.d left join x on x.p = cal.p group by all")
def calendar_period_progress(c):
    _nested_calendar(c)
    found = c.period_progress("nested", "period", c.frame("orders").select("o_orderdate"), "o_orderdate")
    return found.groupBy("period_key", F.col("day_ordinal").cast("bigint").alias("day_ordinal")).agg(F.count("*").alias("n"))


@query(f"with {NESTED_SQL} select distinct p as period_key, p - 13 as baseline_key from cal")
def calendar_correspondence(c):
    _nested_calendar(c)
    return c.correspondence("nested", "last_year")


@query("select l_suppkey % 10 as supplier_digit, c_nationkey as nation, count(*) as n from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey group by all")
def events_participants_along_paths(c):
    """Who supplied and, along items, orders and customers, who bought: two roles of each occurrence."""
    roles = {"supplier": ["l_suppkey"], "buyer": Participant("customer", ("item_order", "order_customer"))}
    c.event("delivered", "lineitem", identity=["l_orderkey", "l_linenumber"], occurred_at="l_shipdate", subject=["l_orderkey"], roles=roles)
    found = events.participants(c, "delivered", ["supplier", "buyer"])
    buyers = c.frame("customer").select(F.col("c_custkey").cast("string").alias("_k"), F.col("c_nationkey").alias("nation"))
    named = found.join(buyers, F.col("buyer.k0") == F.col("_k"), "left")
    return named.groupBy((F.col("supplier.k0").cast("bigint") % 10).alias("supplier_digit"), "nation").agg(F.count("*").alias("n"))


@query(f"{HISTORY_SQL} select s as model_state, count(*) as n from h where u % 2 = 0 group by all")
def lifecycle_replay_population(c):
    """The even subjects that have an inception, as a stated population."""
    known = c.frame("events").where("event_type = 'signup' and user_id % 2 = 0 and ts < '2024-02-01'").select("user_id").distinct()
    members = known.select(F.struct(F.col("user_id").cast("string").alias("k0")).alias("subject_identity"))
    h = lifecycle.replay(c, "visitor", window=T.time_scope(start="2024-01-01", end="2024-02-01"), population=members)
    return h.df.groupBy("model_state").agg(F.count("*").alias("n"))


@query("""with s as (select user_id u, min(ts) t from events where event_type = 'signup' group by all)
select cast(u as varchar) as subject, case when t < timestamp '2024-01-10' then 'old' else 'new' end as level from s""")
def subject_axes_by_validity(c):
    base = c.frame("events").select("user_id").distinct()
    at = F.lit("2024-01-10").cast("timestamp_ntz")
    old = base.select("user_id", F.lit("1990-01-01").cast("timestamp_ntz").alias("valid_from"), at.alias("valid_to"), F.lit("old").alias("level"))
    new = base.select("user_id", at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("new").alias("level"))
    entries = c.frame("events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("entry"))
    subjects = entries.select(F.struct(F.col("user_id").cast("string").alias("k0")).alias("subject_identity"), "entry")
    found = events.subject_axes_valid(subjects, "entry", old.union(new), "user_id", Validity("valid_from", "valid_to"), ["level"])
    return found.select(F.col("subject_identity.k0").alias("subject"), "level")


@query("with x as (select o_custkey, sum(o_totalprice) a, count(*) n from orders group by all), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 ra, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 rn from x) select round(corr(ra, rn), 6) as correlation from r", places=6)
def correlate_spearman_many_groups(c):
    """Ranks over many aggregated rows, many of them tied."""
    both = [observe(c, m, dimensions=["orders.o_custkey"]) for m in ("revenue", "order_count")]
    return stats.correlate(*both, method="spearman").df.select(F.round("correlation", 6).alias("correlation"))
