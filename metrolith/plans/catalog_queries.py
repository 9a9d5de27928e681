"""Queries over the relational tables, one or more for each operator family, with their oracle SQL.

Double columns are rounded on both sides, because sums of doubles depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions import time as T
from metrolith.operators import attribute, compare, discover, events, lifecycle, quality, stats
from metrolith.plans.folds import fold, snapshot_rows
from metrolith.plans.frames import Frame
from metrolith.plans.model import Catalog, SemiAdditive, Snapshot, Validity
from metrolith.plans.planner import Observation, observe, outer_join
from metrolith.sources import inspect

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, places: int = 4):
    """Registers a query; ``places`` is to how many its double columns are rounded, as in its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: _run(f, spark, sf_dir, places)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _run(f, spark: SparkSession, sf_dir: str, places: int = 4) -> DataFrame:
    out = f(catalog(spark, sf_dir))
    return rounded(out.df if isinstance(out, Frame) else out, places)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The model of the relational tables that the queries share."""
    c = Catalog(spark)

    def table(name):
        return lambda s: s.read.parquet(f"{sf_dir}/{name}.parquet")

    for name, key in (
        ("region", ["r_regionkey"]), ("nation", ["n_nationkey"]), ("customer", ["c_custkey"]), ("supplier", ["s_suppkey"]),
        ("part", ["p_partkey"]), ("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("events", ["event_id"]),
    ):
        c.entity(name, table(name), primary_key=key)
    c.relationship("order_customer", "orders", "customer", [("o_custkey", "c_custkey")])
    c.relationship("customer_nation", "customer", "nation", [("c_nationkey", "n_nationkey")])
    c.relationship("nation_region", "nation", "region", [("n_regionkey", "r_regionkey")])
    c.relationship("item_order", "lineitem", "orders", [("l_orderkey", "o_orderkey")])
    c.time_dimension("o_orderdate", "orders", default=True)
    c.time_dimension("l_shipdate", "lineitem", default=True)
    c.time_dimension("ts", "events", granularity="second", default=True)
    for d, e in (("o_orderpriority", "orders"), ("o_orderstatus", "orders"), ("c_mktsegment", "customer"), ("n_name", "nation"), ("r_name", "region"), ("l_returnflag", "lineitem"), ("l_linestatus", "lineitem"), ("event_type", "events")):
        c.dimension(d, e)
    c.measure("o_totalprice", "orders", unit="usd")
    c.measure("o_custkey", "orders", additivity="non_additive")
    c.measure("l_quantity", "lineitem")
    c.measure("l_extendedprice", "lineitem", unit="usd")
    c.measure("l_discount", "lineitem", additivity="non_additive")
    c.measure("revenue_net", "lineitem", lambda df: df["l_extendedprice"] * (1 - df["l_discount"]), unit="usd")
    c.measure("value", "events")
    c.measure("user_id", "events", additivity="non_additive")
    c.aggregate("revenue", "o_totalprice", "sum")
    c.aggregate("mean_price", "o_totalprice", "mean")
    c.aggregate("median_price", "o_totalprice", "median")
    c.aggregate("p90_price", "o_totalprice", ("percentile", 0.9))
    c.aggregate("least_price", "o_totalprice", "min")
    c.aggregate("most_price", "o_totalprice", "max")
    c.aggregate("customers", "orders.o_custkey", "count_distinct")
    c.count("order_count", "orders")
    c.count("urgent_count", "orders", where={"o_orderpriority": "1-URGENT"})
    c.count("item_count", "lineitem")
    c.aggregate("net", "revenue_net", "sum")
    c.weighted_mean("discount_by_price", "l_discount", "l_extendedprice")
    c.ratio("urgent_share", "urgent_count", "order_count")
    c.ratio("price_per_customer", "revenue", "customers")
    c.linear("not_urgent", ["order_count"], ["urgent_count"])
    c.linear("order_revenue_less_items", ["revenue"], ["net"])
    c.cumulative("revenue_to_date", "revenue")
    c.cumulative("revenue_mtd", "revenue", anchor=T.Grain("quarter"))
    c.cumulative("revenue_trailing", "revenue", anchor=(3, "month"))
    c.cumulative("customers_to_date", "customers")
    c.cumulative("customers_trailing", "customers", anchor=(3, "month"))
    c.aggregate("event_value", "value", "sum")
    c.count("event_count", "events")
    c.aggregate("users", "user_id", "count_distinct")
    for e in ("view", "click", "signup", "purchase", "error"):
        c.event(e, "events", identity=["event_id"], occurred_at="ts", subject=["user_id"], where=lambda df, e=e: df["event_type"] == e)
    c.state_model(
        "visitor", "user", states=["active", "customer", "failed"], initial="active", terminal=["failed"], inceptions=["signup"],
        transitions=[("active", "purchase", "customer"), ("active", "error", "failed"), ("customer", "error", "failed")],
    )
    return c


Y96 = T.time_scope(start="1996-01-01", end="1997-01-01")
Y97 = T.time_scope(start="1997-01-01", end="1998-01-01")
IN96 = "o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01'"
IN97 = "o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'"
MONTH = "cast(date_trunc('month', o_orderdate) as date)"
TO_NATION = "orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey"

# --- observe ------------------------------------------------------------------------


@query(f"select {MONTH} as bucket_start, n_name, round(sum(o_totalprice), 4) as value from {TO_NATION} where {IN96} group by all")
def observe_panel(c):
    return observe(c, "revenue", time_scope=Y96, grain="month", dimensions=["n_name"])


@query(f"select round(sum(o_totalprice), 4) as value from orders where {IN96}")
def observe_scalar(c):
    return observe(c, "revenue", time_scope=Y96)


@query(f"select cast(date_trunc('week', o_orderdate) as date) as bucket_start, round(sum(o_totalprice), 4) as value from orders where {IN96} group by all")
def observe_time_series_week(c):
    return observe(c, "revenue", time_scope=Y96, grain="week")


@query("select o_orderpriority, round(sum(o_totalprice), 4) as value from orders group by all")
def observe_segmented(c):
    return observe(c, "revenue", dimensions=["o_orderpriority"])


@query("select time_bucket(interval '15 minutes', ts) as bucket_start, count(*) as value from events where ts >= '2024-01-02' and ts < '2024-01-04' group by all")
def observe_fifteen_minutes(c):
    return observe(c, "event_count", time_scope=T.time_scope(start="2024-01-02", end="2024-01-04"), grain=T.Grain("minute", 15))


@query(
    """select o_orderstatus, round(sum(o_totalprice), 4) as revenue, round(avg(o_totalprice), 4) as mean_price,
    round(median(o_totalprice), 4) as median_price, round(quantile_cont(o_totalprice, 0.9), 4) as p90_price, round(min(o_totalprice), 4) as least_price,
    round(max(o_totalprice), 4) as most_price, count(distinct o_custkey) as customers, count(*) as order_count,
    count(*) filter (where o_orderpriority = '1-URGENT') as urgent_count from orders group by all"""
)
def observe_all_aggregates_fused(c):
    names = ["revenue", "mean_price", "median_price", "p90_price", "least_price", "most_price", "customers", "order_count", "urgent_count"]
    return observe(c, names, dimensions=["o_orderstatus"])


@query("select l_returnflag, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 4) as value from lineitem group by all")
def observe_weighted_mean(c):
    return observe(c, "discount_by_price", dimensions=["l_returnflag"])


@query(f"select {MONTH} as bucket_start, round(count(*) filter (where o_orderpriority = '1-URGENT') / nullif(count(*), 0)::double, 4) as value from orders where {IN96} group by all")
def observe_ratio(c):
    return observe(c, "urgent_share", time_scope=Y96, grain="month")


@query("select o_orderstatus, (count(*) - count(*) filter (where o_orderpriority = '1-URGENT'))::double as value from orders group by all")
def observe_linear(c):
    return observe(c, "not_urgent", dimensions=["o_orderstatus"])


@query(
    """with a as (select o_orderpriority k, sum(o_totalprice) x from orders group by all),
    b as (select o_orderpriority k, sum(l_extendedprice * (1 - l_discount)) y from lineitem left join orders on l_orderkey = o_orderkey group by all)
    select coalesce(a.k, b.k) as o_orderpriority, round(x - y, 2) as value from a full join b on a.k is not distinct from b.k"""
)
def observe_two_roots(c):
    out = observe(c, "order_revenue_less_items", dimensions=["o_orderpriority"])
    return out.having(out.df.withColumn("value", F.round("value", 2)))


@query("select r_name, count(*) as value from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where c_mktsegment in ('BUILDING', 'AUTOMOBILE') group by all")
def observe_four_hops_sliced(c):
    return observe(c, "item_count", dimensions=["r_name"], slice_by={"c_mktsegment": ["BUILDING", "AUTOMOBILE"]})


@query("select count(*) as value from orders where o_totalprice between 1000 and 200000 and o_orderstatus <> 'F'")
def observe_slice_operators(c):
    c.dimension("price", "orders", "o_totalprice")
    return observe(c, "order_count", slice_by={"price": {"between": (1000, 200000)}, "o_orderstatus": {"!=": "F"}})


@query("with x as (select distinct l_orderkey, l_returnflag from lineitem) select l_returnflag, round(sum(o_totalprice), 4) as value from orders left join x on l_orderkey = o_orderkey group by all")
def observe_fanout_aggregate_then_join(c):
    c.metric("revenue_once", "orders", lambda df: F.sum(df["o_totalprice"]), fanout="aggregate_then_join")
    return observe(c, "revenue_once", dimensions=["l_returnflag"])


@query("select sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as f, count(*) as n from orders")
def observe_metric_slice_fused(c):
    c.slice("f", "order_count", {"o_orderstatus": "F"})
    return observe(c, ["f", "order_count"]).df.withColumnRenamed("order_count", "n")


@query("select strftime(ts, '%Y%m%d')::varchar as day, round(sum(value), 4) as value from events where ts >= '2024-01-05' and ts < '2024-01-08' group by all")
def observe_strptime_column(c):
    base = c.frame("events").withColumn("day_text", F.date_format("ts", "yyyyMMdd"))
    c.entity("texts", base, primary_key=["event_id"])
    c.time_dimension("day_text", "texts", parse=T.strptime("%Y%m%d"))
    c.dimension("day", "texts", "day_text")
    c.measure("text_value", "texts", "value")
    c.aggregate("text_sum", "text_value", "sum")
    out = observe(c, "text_sum", time_scope=T.time_scope(start="2024-01-05", end="2024-01-08"), dimensions=["day"])
    return out.df


@query("select cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) as bucket_start, count(*) as value from events where (ts at time zone 'UTC') at time zone 'America/New_York' >= '2024-01-03' and (ts at time zone 'UTC') at time zone 'America/New_York' < '2024-01-06' group by all")
def observe_report_time_zone(c):
    c.entity("utc_events", c.frame("events"), primary_key=["event_id"])
    c.time_dimension("at", "utc_events", "ts", parse=T.as_datetime(timezone="UTC"))
    c.count("utc_count", "utc_events")
    return observe(c, "utc_count", time_scope=T.time_scope(start="2024-01-03", end="2024-01-06"), grain="day", report_tz="America/New_York")


# --- versioned joins and folds ------------------------------------------------------------


def _snapshots(c):
    """Customer copies at two days; the tier changes between them."""
    base = c.frame("customer").select("c_custkey", "c_acctbal")
    days = [("1996-01-01", "old_"), ("1996-07-01", "new_")]
    parts = [base.select("c_custkey", F.lit(d).cast("date").alias("dt"), F.concat(F.lit(p), F.when(F.col("c_acctbal") > 0, "plus").otherwise("minus")).alias("tier")) for d, p in days]
    c.entity("tiers", parts[0].union(parts[1]), primary_key=["c_custkey", "dt"], versioning=Snapshot("dt"))
    c.relationship("order_tier", "orders", "tiers", [("o_custkey", "c_custkey")])
    c.dimension("tier", "tiers")


@query(f"select case when o_orderdate < '1996-07-01' then 'old_' else 'new_' end || case when c_acctbal > 0 then 'plus' else 'minus' end as tier, count(*) as value from orders join customer on o_custkey = c_custkey where {IN96} group by all")
def join_as_of_snapshot(c):
    _snapshots(c)
    return observe(c, "order_count", time_scope=Y96, dimensions=["tier"], versions="root_time")


@query(f"select 'new_' || case when c_acctbal > 0 then 'plus' else 'minus' end as tier, count(*) as value from orders join customer on o_custkey = c_custkey where {IN96} group by all")
def join_latest_snapshot(c):
    _snapshots(c)
    return observe(c, "order_count", time_scope=Y96, dimensions=["tier"])


@query(f"select case when o_orderdate < '1996-07-04' then 'silver' else 'gold' end as level, count(*) as value from orders join customer on o_custkey = c_custkey where {IN96} group by all")
def join_validity_interval(c):
    base = c.frame("customer").select("c_custkey")
    none = F.lit(None).cast("date")
    silver = base.select("c_custkey", F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit("1996-07-04").cast("date").alias("valid_to"), F.lit("silver").alias("level"))
    gold = base.select("c_custkey", F.lit("1996-07-04").cast("date").alias("valid_from"), none.alias("valid_to"), F.lit("gold").alias("level"))
    c.entity("levels", silver.union(gold), primary_key=["c_custkey", "valid_from"], versioning=Validity("valid_from", "valid_to"))
    c.relationship("order_level", "orders", "levels", [("o_custkey", "c_custkey")])
    c.dimension("level", "levels")
    return observe(c, "order_count", time_scope=Y96, dimensions=["level"], versions="root_time")


@query("with s as (select event_type, date_trunc('hour', ts) h, sum(value) x from events group by all) select event_type, round(avg(x), 4) as value from s group by all")
def fold_semi_additive_mean(c):
    hourly = c.frame("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    c.entity("hourly", hourly, primary_key=["event_id"])
    c.time_dimension("hour", "hourly", granularity="hour")
    c.dimension("hourly_type", "hourly", "event_type")
    c.measure("level", "hourly", "value", additivity=SemiAdditive("hourly.hour", "mean"))
    c.aggregate("mean_level", "level", "sum")
    return observe(c, "mean_level", dimensions=["hourly_type"]).df.withColumnRenamed("hourly_type", "event_type")


@query("with s as (select date_trunc('hour', ts) h, sum(value) x from events group by all) select round(arg_max(x, h), 4) as last_x, round(arg_min(x, h), 4) as first_x from s")
def fold_first_and_last(c):
    c.entity("hourly", c.frame("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), primary_key=["event_id"])
    c.time_dimension("hour", "hourly", granularity="hour")
    out = []
    for how in ("last", "first"):
        c.measure(f"v_{how}", "hourly", "value", additivity=SemiAdditive("hourly.hour", how))
        m = c.metric_of(c.aggregate(f"{how}_x", f"v_{how}", "sum"))
        out.append(fold(c, m, Observation(c, "hourly")))
    return outer_join(out, [])


@query("select user_id, max(ts) as ts, count(*) as n from (select *, max(ts) over (partition by user_id) m from events) where ts = m group by all")
def fold_snapshot_rows(c):
    return snapshot_rows(c.frame("events"), ["user_id"], "ts", []).groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))


# --- cumulative -----------------------------------------------------------------------------

SPINE96 = "select cast(unnest(generate_series(date '1996-01-01', date '1996-12-01', interval '1 month')) as date) as b"


@query(f"with s as ({SPINE96}) select b as bucket_start, round((select coalesce(sum(o_totalprice), 0) from orders where o_orderdate < b + interval '1 month'), 2) as value from s")
def cumulative_all_history(c):
    return observe(c, "revenue_to_date", time_scope=Y96, grain="month").df.withColumn("value", F.round("value", 2))


@query(f"with s as ({SPINE96}) select b as bucket_start, round((select coalesce(sum(o_totalprice), 0) from orders where o_orderdate < b + interval '1 month' and o_orderdate >= date_trunc('quarter', b)), 2) as value from s")
def cumulative_to_date(c):
    return observe(c, "revenue_mtd", time_scope=Y96, grain="month").df.withColumn("value", F.round("value", 2))


@query(f"with s as ({SPINE96}) select b as bucket_start, round((select coalesce(sum(o_totalprice), 0) from orders where o_orderdate < b + interval '1 month' and o_orderdate >= b - interval '2 months'), 2) as value from s")
def cumulative_trailing(c):
    return observe(c, "revenue_trailing", time_scope=Y96, grain="month").df.withColumn("value", F.round("value", 2))


@query(f"with s as ({SPINE96}), g as (select distinct o_orderpriority from orders where o_orderdate < '1997-01-01') select b as bucket_start, o_orderpriority, (select count(distinct o_custkey) from orders o where o_orderdate < b + interval '1 month' and o.o_orderpriority = g.o_orderpriority)::double as value from s, g")
def cumulative_distinct_first_seen(c):
    return observe(c, "customers_to_date", time_scope=Y96, grain="month", dimensions=["o_orderpriority"])


@query(f"with s as ({SPINE96}) select b as bucket_start, (select count(distinct o_custkey) from orders where o_orderdate < b + interval '1 month' and o_orderdate >= b - interval '2 months')::double as value from s")
def cumulative_distinct_trailing(c):
    return observe(c, "customers_trailing", time_scope=Y96, grain="month")


@query("select o_orderstatus, round(sum(o_totalprice), 2) as value from orders where o_orderdate < '1997-01-01' group by all")
def cumulative_segmented_as_of_end(c):
    return observe(c, "revenue_to_date", time_scope=Y96, dimensions=["o_orderstatus"]).df.withColumn("value", F.round("value", 2))


# --- compare ----------------------------------------------------------------------------------

DELTA = """round(c, 4) as current, round(b, 4) as baseline, round(c - b, 4) as delta, round((c - b) / nullif(abs(b), 0), 4) as pct_change,
case when b <> 0 then 'computed' when c > 0 then 'from_zero_growth' when c < 0 then 'from_zero_decline' else 'zero_baseline_no_change' end as pct_change_status"""


def _two(c, **options):
    return observe(c, "revenue", time_scope=Y97, **options), observe(c, "revenue", time_scope=Y96, **options)


@query(f"select {DELTA} from (select (select sum(o_totalprice) from orders where {IN97}) c, (select sum(o_totalprice) from orders where {IN96}) b)")
def compare_scalar(c):
    return compare.compare(*_two(c))


@query(
    f"""with a as (select n_name k, sum(o_totalprice) c from {TO_NATION} where {IN97} group by all), b as (select n_name k, sum(o_totalprice) b from {TO_NATION} where {IN96} group by all)
    select coalesce(a.k, b.k) as n_name, case when a.c is null then 'churned' when b.b is null then 'new' else 'matched' end as presence_status, {DELTA.replace("c, 4", "coalesce(c, 0), 4").replace("(b, 4", "(coalesce(b, 0), 4")}
    from a full join b on a.k = b.k"""
)
def compare_segmented(c):
    return compare.compare(*_two(c, dimensions=["n_name"]))


@query(
    f"""with a as (select {MONTH} t, sum(o_totalprice) c from orders where {IN97} group by all), b as (select {MONTH} t, sum(o_totalprice) b from orders where {IN96} group by all)
    select a.t as bucket_start, b.t as bucket_start_b, {DELTA} from a join b on month(a.t) = month(b.t)"""
)
def compare_ordinal_buckets(c):
    return compare.compare(*_two(c, grain="month"))


@query(
    f"""with a as (select {MONTH} t, o_orderpriority p, sum(o_totalprice) c from orders where {IN97} group by all), b as (select {MONTH} t, o_orderpriority p, sum(o_totalprice) b from orders where {IN96} group by all)
    select cast(coalesce(a.t, b.t + interval '1 year') as date) as bucket_start, cast(coalesce(b.t, a.t - interval '1 year') as date) as bucket_start_b, coalesce(a.p, b.p) as o_orderpriority,
    case when a.c is null then 'churned' when b.b is null then 'new' else 'matched' end as presence_status, round(coalesce(c, 0), 4) as current, round(coalesce(b, 0), 4) as baseline,
    round(coalesce(c, 0) - coalesce(b, 0), 4) as delta, round((coalesce(c, 0) - coalesce(b, 0)) / nullif(abs(coalesce(b, 0)), 0), 4) as pct_change,
    case when coalesce(b, 0) <> 0 then 'computed' when c > 0 then 'from_zero_growth' else 'zero_baseline_no_change' end as pct_change_status from a full join b on month(a.t) = month(b.t) and a.p = b.p"""
)
def compare_panel(c):
    return compare.compare(*_two(c, grain="month", dimensions=["o_orderpriority"]))


@query(
    f"""with a as (select cast(o_orderdate as date) t, sum(o_totalprice) c from orders where {IN97} group by all), b as (select cast(o_orderdate as date) t, sum(o_totalprice) b from orders where {IN96} group by all)
    select cast(datediff('day', date '1997-01-01', a.t) as varchar) as align_key, 'exact' as align_quality, 'matched' as presence_status, a.t as bucket_start_a, b.t as bucket_start_b, {DELTA}
    from a join b on datediff('day', date '1997-01-01', a.t) = datediff('day', date '1996-01-01', b.t)"""
)
def compare_period_progress(c):
    return compare.compare(*_two(c, grain="day"), compare.period_progress(unmatched="drop"))


@query(
    f"""with k as (select cast(unnest(generate_series(date '1996-01-01', date '1997-12-31', interval '1 day')) as date) d),
    w as (select d, cast(row_number() over (partition by year(d) order by d) as varchar) n from k where isodow(d) <= 5),
    a as (select cast(o_orderdate as date) t, sum(o_totalprice) c from orders where {IN97} group by all), b as (select cast(o_orderdate as date) t, sum(o_totalprice) b from orders where {IN96} group by all)
    select x.n as align_key, 'exact' as align_quality, 'matched' as presence_status, a.t as bucket_start_a, b.t as bucket_start_b, {DELTA}
    from a join w x on x.d = a.t join w y on y.n = x.n and year(y.d) = 1996 join b on b.t = y.d"""
)
def compare_working_day_progress(c):
    days = c.spark.sql("select explode(sequence(date'1996-01-01', date'1997-12-31', interval 1 day)) d").selectExpr("d", "weekday(d) < 5 as w")
    return compare.compare(*_two(c, grain="day"), compare.working_day_progress(schedule=days, unmatched="drop"))


@query(
    f"""with a as (select {MONTH} t, sum(o_totalprice) c from orders where {IN97} group by all), b as (select {MONTH} t, sum(o_totalprice) b from orders where {IN96} group by all)
    select cast(b.t as varchar) as align_key, 'exact' as align_quality, 'matched' as presence_status, a.t as bucket_start_a, b.t as bucket_start_b, {DELTA} from a join b on b.t = a.t - interval '1 year'"""
)
def compare_period_correspondence(c):
    m = c.spark.sql("select m, cast(add_months(m, -12) as date) from (select explode(sequence(date'1997-01-01', date'1997-12-01', interval 1 month)) m)")
    return compare.compare(*_two(c, grain="month"), compare.period_correspondence(mapping=m))


# --- transforms --------------------------------------------------------------------------------


@query(f"select {MONTH} as bucket_start, round(sum(o_totalprice), 4) as value from {TO_NATION} where {IN96} and n_name is not null group by all")
def transform_rollup_axes(c):
    return observe_panel(c).transform.filter(predicate=lambda df: df["n_name"].isNotNull()).transform.rollup(drop_axes=["n_name"])


@query(f"select cast(date_trunc('quarter', o_orderdate) as date) as bucket_start, round(sum(o_totalprice), 4) as value from orders where {IN96} group by all")
def transform_rollup_grain(c):
    return observe(c, "revenue", time_scope=Y96, grain="month").transform.rollup(grain="quarter")


@query(f"select year(o_orderdate) || '-P' || ((month(o_orderdate) - 1) // 2) as period_key, round(sum(o_totalprice), 4) as value from orders where {IN96} group by all")
def transform_rollup_calendar(c):
    days = c.spark.sql("select d, concat(year(d), '-P', cast(floor((month(d) - 1) / 2) as int)) p from (select explode(sequence(date'1996-01-01', date'1996-12-31', interval 1 day)) d)")
    return observe(c, "revenue", time_scope=Y96, grain="day").transform.rollup_calendar(days, "d", "p")


@query("select n_name, round(sum(o_totalprice), 4) as value from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all order by sum(o_totalprice) desc nulls last, n_name limit 5")
def transform_topk(c):
    return observe(c, "revenue", dimensions=["n_name"]).transform.topk(by="value", limit=5)


@query("select n_name, round(sum(o_totalprice), 4) as value from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all order by sum(o_totalprice) nulls last, n_name limit 5")
def transform_bottomk(c):
    return observe(c, "revenue", dimensions=["n_name"]).transform.bottomk(by="value", limit=5)


@query("with x as (select c_mktsegment, o_orderpriority, count(*) v from orders left join customer on o_custkey = c_custkey group by all) select c_mktsegment, o_orderpriority, v as value, row_number() over (order by v desc, c_mktsegment, o_orderpriority) as ordinal, dense_rank() over (order by v desc) as dense, rank() over (order by v desc) as low, count(*) over (order by v desc) as high from x")
def transform_rank(c):
    f = observe(c, "order_count", dimensions=["c_mktsegment", "o_orderpriority"])
    for method, name in (("ordinal", "ordinal"), ("dense", "dense"), ("min", "low"), ("max", "high")):
        f = f.transform.rank(by="value", method=method, rank_column=name)
    return f


@query(f"select o_orderpriority, round(sum(o_totalprice), 4) as value from orders where {IN96} and o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') group by all")
def transform_slice(c):
    f = observe(c, "revenue", time_scope=Y96, dimensions=["o_orderpriority", "o_orderstatus"])
    return f.transform.slice(slice_by={"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query(f"select {MONTH} as bucket_start, round(sum(o_totalprice), 4) as value from orders where o_orderdate >= '1996-03-01' and o_orderdate < '1996-06-01' group by all")
def transform_window(c):
    return observe(c, "revenue", time_scope=Y96, grain="month").transform.window(window=T.time_scope(start="1996-03-01", end="1996-06-01"))


PANEL96 = f"select {MONTH} as t, o_orderpriority p, sum(o_totalprice) v from orders where {IN96} group by all"


def _panel(c):
    return observe(c, "revenue", time_scope=Y96, grain="month", dimensions=["o_orderpriority"])


@query(f"with x as ({PANEL96}) select t as bucket_start, p as o_orderpriority, round(v / sum(v) over (partition by t), 4) as value from x")
def transform_normalize_share(c):
    return _panel(c).transform.normalize(mode="share")


@query(f"with x as ({PANEL96}) select t as bucket_start, p as o_orderpriority, round(v / first_value(v) over (partition by p order by t) * 100, 4) as value from x")
def transform_normalize_index(c):
    return _panel(c).transform.normalize(mode="index")


@query(f"with x as ({PANEL96}), y as (select *, lag(v) over (partition by p order by t) l from x) select t as bucket_start, p as o_orderpriority, round((v - l) / l, 4) as value from y")
def transform_normalize_pct_change(c):
    return _panel(c).transform.normalize(mode="pct_change")


@query(f"with x as ({PANEL96}) select t as bucket_start, p as o_orderpriority, round((v - avg(v) over (partition by p)) / stddev_pop(v) over (partition by p), 4) as value from x")
def transform_normalize_z_score(c):
    return _panel(c).transform.normalize(mode="z_score")


# --- attribution ----------------------------------------------------------------------------------

SHARES = """round(d, 4) as contribution, round(d / sum(d) over (), 4) as share_of_total_delta, round(case when d > 0 then d / sum(case when d > 0 then d end) over () end, 4) as share_of_positive_pool,
round(case when d < 0 then -d / sum(case when d < 0 then d end) over () end, 4) as share_of_negative_pool"""


def _change(cols):
    return f"select {cols}, sum(case when {IN97} then o_totalprice else 0 end) - sum(case when {IN96} then o_totalprice else 0 end) d from {TO_NATION} where o_orderdate >= '1996-01-01' and o_orderdate < '1998-01-01' group by all"


@query(f"with x as ({_change('n_name')}) select n_name, {SHARES}, row_number() over (order by abs(d) desc, n_name) as rank from x")
def attribute_single_axis(c):
    return attribute.additive(compare.compare(*_two(c, dimensions=["n_name"])), ["n_name"]).df.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"with x as ({_change('o_orderpriority, o_orderstatus')}) select o_orderpriority, o_orderstatus, {SHARES}, row_number() over (order by abs(d) desc, o_orderpriority, o_orderstatus) as rank, round(d, 4) as value_effect, 0.0::double as mix_effect, 0.0::double as residual from x")
def attribute_joint(c):
    d = compare.compare(*_two(c, dimensions=["o_orderpriority", "o_orderstatus"]))
    return attribute.additive(d, ["o_orderpriority", "o_orderstatus"], "joint").df.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"with x as ({_change('o_orderpriority')}), y as ({_change('o_orderpriority, o_orderstatus')}) select 1 as attribution_level, o_orderpriority as attribution_path, round(d, 4) as contribution from x union all select 2, o_orderpriority || ' > ' || o_orderstatus, round(d, 4) from y")
def attribute_hierarchy(c):
    d = compare.compare(*_two(c, dimensions=["o_orderpriority", "o_orderstatus"]))
    return attribute.additive(d, ["o_orderpriority", "o_orderstatus"], "hierarchy").df.select("attribution_level", "attribution_path", "contribution")


@query(
    f"""with x as (select o_orderstatus k, count(*) filter (where {IN97}) nc, count(*) filter (where {IN96}) nb, count(*) filter (where {IN97} and o_orderpriority = '1-URGENT') uc, count(*) filter (where {IN96} and o_orderpriority = '1-URGENT') ub
    from orders where o_orderdate >= '1996-01-01' and o_orderdate < '1998-01-01' group by all),
    y as (select k, nc / sum(nc) over () sc, nb / sum(nb) over () sb, coalesce(uc / nullif(nc, 0), 0) vc, coalesce(ub / nullif(nb, 0), 0) vb from x)
    select k as o_orderstatus, round(sc, 4) as current_share, round(sb, 4) as baseline_share, round(vc, 4) as current_value, round(vb, 4) as baseline_value, round(sc * vc - sb * vb, 4) as contribution,
    round(sc * (vc - vb), 4) as value_effect, round((sc - sb) * vb, 4) as mix_effect from y"""
)
def attribute_ratio_mix(c):
    a = observe(c, "urgent_share", time_scope=Y97, dimensions=["o_orderstatus"])
    b = observe(c, "urgent_share", time_scope=Y96, dimensions=["o_orderstatus"])
    names = ["o_orderstatus", "current_share", "baseline_share", "current_value", "baseline_value", "contribution", "value_effect", "mix_effect"]
    return attribute.mix(compare.compare(a, b)).df.select(*names)


@query(
    f"""with a as (select distinct o_orderpriority p, o_custkey k from orders where {IN97}), b as (select distinct o_orderpriority p, o_custkey k from orders where {IN96}),
    x as (select p, count(*) o, sum(1.0 / n) w from (select *, count(*) over (partition by k) n from a) group by p), y as (select p, count(*) o, sum(1.0 / n) w from (select *, count(*) over (partition by k) n from b) group by p)
    select coalesce(x.p, y.p) as o_orderpriority, coalesce(x.o, 0) as current_observed_distinct, coalesce(y.o, 0) as baseline_observed_distinct, round(coalesce(x.w, 0), 4)::double as current_allocated_distinct, round(coalesce(y.w, 0), 4)::double as baseline_allocated_distinct,
    round(coalesce(x.w, 0)::double - coalesce(y.w, 0)::double, 4) as contribution from x full join y on x.p = y.p"""
)
def attribute_distinct(c):
    o = c.frame("orders")
    sides = [o.where(T.inside(F.col("o_orderdate"), "timestamp_ntz", s)) for s in (Y97, Y96)]
    out = attribute.distinct_allocation(*sides, ["o_orderpriority"], "o_custkey").df
    return out.drop("share_of_total_delta", "share_of_positive_pool", "share_of_negative_pool", "rank")


@query(f"with x as (select 'order_count' as component, (count(*) filter (where {IN97}) - count(*) filter (where {IN96}))::double d from orders union all select 'urgent_count', -(count(*) filter (where {IN97} and o_orderpriority = '1-URGENT') - count(*) filter (where {IN96} and o_orderpriority = '1-URGENT'))::double from orders) select component, {SHARES}, row_number() over (order by abs(d) desc, component) as rank from x")
def attribute_linear(c):
    terms = [(s, m, compare.compare(observe(c, m, time_scope=Y97), observe(c, m, time_scope=Y96))) for s, m in ((1, "order_count"), (-1, "urgent_count"))]
    return attribute.linear(terms).df.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"with a as (select {MONTH} t, sum(o_totalprice) v from orders where o_orderdate >= '1996-03-01' and o_orderdate < '1997-03-01' group by all), b as (select {MONTH} t, sum(o_totalprice) v from orders where {IN96} group by all) select case when b.t is null then 'entering' when a.t is null then 'leaving' else 'retained_change' end as contribution_kind, round(sum(coalesce(a.v, 0) - coalesce(b.v, 0)), 2) as contribution from a full join b on a.t = b.t group by all")
def attribute_time_bridge(c):
    a = observe(c, "revenue", time_scope=T.time_scope(start="1996-03-01", end="1997-03-01"), grain="month").df
    out = attribute.time_bridge(a, observe(c, "revenue", time_scope=Y96, grain="month").df, "bucket_start", "value")
    return out.withColumn("contribution", F.round("contribution", 2) + 0.0)


# --- discovery -------------------------------------------------------------------------------------

DAILY = "select cast(ts as date) d, event_type e, count(*) v from events group by all"
WHOLE = T.time_scope(start="2024-01-01", end="2024-02-01")


def _daily(c):
    return observe(c, "event_count", time_scope=WHOLE, grain="day", dimensions=["event_type"])


@query(f"with x as (select * from ({DAILY}) where d >= '2024-01-01' and d < '2024-02-01'), y as (select *, avg(v) over (partition by e) m, stddev_pop(v) over (partition by e) s from x), z as (select *, case when s = 0 then 0 else (v - m) / s end q from y) select d as bucket_start, e as event_type, round(q, 4) as score, v::double as observed_value, round(m, 4) as baseline_value, round(v - m, 4) as delta, case when q > 0 then 'high' else 'low' end as direction from z where abs(q) >= 1.5")
def discover_point_anomalies(c):
    return discover.point_anomalies(_daily(c), threshold=1.5, limit=None).df.drop("item_id")


@query(f"with x as (select d, e, v, isodow(d) w from ({DAILY}) where d >= '2024-01-01' and d < '2024-02-01'), m as (select e, w, median(v) med from x group by all), y as (select x.*, med, abs(v - med) dev from x join m using (e, w)), k as (select e, w, median(dev) mad, avg(dev) aad from y group by all), z as (select y.*, case when mad > 0 then mad when aad > 0 then aad end sc from y join k using (e, w)) select d as bucket_start, e as event_type, round((v - med) / (1.4826 * sc), 4) as score from z where abs((v - med) / (1.4826 * sc)) >= 2")
def discover_seasonal_anomalies(c):
    return discover.point_anomalies(_daily(c), threshold=2.0, limit=None, strategy="seasonal_robust_zscore").df.select("bucket_start", "event_type", "score")


@query(f"with x as (select * from ({DAILY}) where d >= '2024-01-01' and d < '2024-02-01'), m as (select d, median(v) med from x group by all), y as (select x.*, med, abs(v - med) dev from x join m using (d)), k as (select d, median(dev) mad, avg(dev) aad from y group by all), z as (select y.*, case when mad > 0 then mad when aad > 0 then aad end sc from y join k using (d)) select d as bucket_start, e as event_type, round((v - med) / (1.4826 * sc), 4) as score from z where abs((v - med) / (1.4826 * sc)) >= 2")
def discover_cross_sectional_outliers(c):
    return discover.cross_sectional_outliers(_daily(c), threshold=2.0, limit=None).df.drop("item_id")


@query(f"with x as (select * from ({DAILY}) where d >= '2024-01-01' and d < '2024-02-01'), r as (select *, avg(v) over (partition by e order by d rows between 6 preceding and current row) m, row_number() over (partition by e order by d) i, count(*) over (partition by e) n from x), y as (select *, case when n < 4 then 0 else coalesce((m - avg(m) over (partition by e)) / nullif(stddev_pop(m) over (partition by e), 0), 0) end q from r), z as (select *, sum(case when abs(q) >= 1 then 0 else 1 end) over (partition by e order by d) run from y) select e as event_type, min(d) as window_start, max(d) as window_end, round(arg_max(q, abs(q)), 4) as score from z where abs(q) >= 1 group by e, run having min(i) > 1")
def discover_period_shifts(c):
    return discover.period_shifts(_daily(c), threshold=1.0, limit=None).df.drop("item_id")


@query(f"with x as (select * from ({DAILY}) where d >= '2024-01-01' and d < '2024-02-01'), y as (select *, (v - avg(v) over (partition by e)) / nullif(stddev_pop(v) over (partition by e), 0) q, count(*) over (partition by e) n from x), z as (select *, sum(case when abs(coalesce(q, 0)) >= 1 and n >= 4 then 0 else 1 end) over (partition by e order by d) run from y) select e as event_type, min(d) as window_start, max(d) as window_end, round(max(abs(q)), 4) as score from z where abs(q) >= 1 and n >= 4 group by e, run")
def discover_interesting_windows(c):
    return discover.interesting_windows(_daily(c), threshold=1.0, limit=None).df.drop("item_id")


@query(f"with a as (select 'n_name' axis, n_name k, d from ({_change('n_name')}) union all select 'o_orderpriority', o_orderpriority, d from ({_change('o_orderpriority')})), r as (select *, row_number() over (partition by axis order by abs(d) desc, k) i, sum(abs(d)) over (partition by axis order by abs(d) desc, k rows unbounded preceding) / sum(abs(d)) over (partition by axis) s, count(*) over (partition by axis) n from a) select axis, round(1 / (min(i) + any_value(n) / 1000), 4) as score from r where s >= 0.5 group by axis")
def discover_driver_axes(c):
    parts = [compare.compare(*_two(c, dimensions=[a])) for a in ("n_name", "o_orderpriority")]
    out = [discover.driver_axes(p, search_space=[p.keys[0]], limit=None).df.drop("item_id") for p in parts]
    return out[0].union(out[1])


@query("with x as (select o_orderstatus a, o_orderpriority b, sum(o_totalprice) v from orders group by all), g as (select a, b, grouping(a) ga, grouping(b) gb, avg(v) m from x group by grouping sets ((a), (b), (a, b))), w as (select avg(v) mu, stddev_pop(v) sd from x) select concat_ws(', ', case when ga = 0 then 'o_orderstatus=' || a end, case when gb = 0 then 'o_orderpriority=' || b end) as selector, round(abs(m - mu) / sd, 4) as score from g, w where abs(m - mu) / sd >= 0.5")
def discover_interesting_slices(c):
    f = observe(c, "revenue", dimensions=["o_orderstatus", "o_orderpriority"])
    return discover.interesting_slices(f, threshold=0.5, limit=None).df.drop("item_id")


# --- statistics --------------------------------------------------------------------------------------

BOTH96 = f"select {MONTH} t, sum(o_totalprice) x, count(*)::double y from orders where {IN96} group by all"


def _series(c):
    return observe(c, "revenue", time_scope=Y96, grain="month"), observe(c, "order_count", time_scope=Y96, grain="month")


@query(f"with s as ({BOTH96}), l as (select 0 as lag_offset, x, y from s union all select 1, x, lead(y) over (order by t) from s) select lag_offset, round(corr(x, y) filter (where y is not null), 4) as correlation, count(y) as aligned_row_count, count(*) - count(y) as dropped_row_count from l group by lag_offset")
def correlate_pearson_lags(c):
    return stats.correlate(*_series(c), lag_range=[0, 1]).df.drop("method", "is_best")


@query(f"with s as ({BOTH96}), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 a, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 b from s) select round(corr(a, b), 4) as correlation from r")
def correlate_spearman(c):
    return stats.correlate(*_series(c), method="spearman").df.select("correlation")


@query(f"with s as (select row_number() over (order by t) i, x, y from ({BOTH96})), p as (select sign(a.x - b.x) * sign(a.y - b.y) s, abs(sign(a.x - b.x)) p, abs(sign(a.y - b.y)) q from s a join s b on a.i < b.i) select round(sum(s) / sqrt(sum(p) * sum(q)), 4) as correlation from p")
def correlate_kendall(c):
    return stats.correlate(*_series(c), method="kendall").df.select("correlation")


@query(
    f"""with a as (select month(o_orderdate) m, sum(o_totalprice) v from orders where {IN97} group by all), b as (select month(o_orderdate) m, sum(o_totalprice) v from orders where {IN96} group by all),
    d as (select a.v - b.v d, a.v x, b.v y from a join b on a.m = b.m) select round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) as test_statistic, count(*) as sample_size, round(avg(x), 2) as mean_a, round(avg(y), 2) as mean_b from d"""
)
def hypothesis_paired_t(c):
    sides = []
    for s in (Y97, Y96):
        f = observe(c, "revenue", time_scope=s, grain="month")
        sides.append(f.having(f.df.withColumn("bucket_start", F.month("bucket_start"))))
    out = stats.hypothesis_test(*sides).df
    return out.select("test_statistic", "sample_size", F.round("mean_a", 2).alias("mean_a"), F.round("mean_b", 2).alias("mean_b"))


def _history(c):
    return observe(c, "revenue", time_scope=T.time_scope(start="1995-01-01", end="1998-01-01"), grain="month")


HISTORY = f"select {MONTH} t, sum(o_totalprice) y from orders where o_orderdate >= '1995-01-01' and o_orderdate < '1998-01-01' group by all"


@query(f"with h as ({HISTORY}), r as (select stddev_samp(y - l) sd from (select y, lag(y) over (order by t) l from h)), z as (select arg_max(y, t) y, max(t) t from h) select cast(t + to_months(h::int) as date) as time, round(y, 2) as predicted, round(y - 1.959963984540054 * sd * sqrt(h), 2) as lower, round(y + 1.959963984540054 * sd * sqrt(h), 2) as upper, h as horizon_index from z, r, generate_series(1, 3) g(h)")
def forecast_naive(c):
    out = stats.forecast(_history(c), horizon=3, model="naive").df
    return out.select("time", *(F.round(x, 2).alias(x) for x in ("predicted", "lower", "upper")), "horizon_index")


@query(f"with h as ({HISTORY}), r as (select stddev_samp(y - l) sd from (select y, lag(y, 12) over (order by t) l from h)), z as (select max(t) t from h) select cast(z.t + to_months(g.h::int) as date) as time, round(h.y, 2) as predicted, round(h.y - 1.959963984540054 * sd * sqrt(g.h), 2) as lower, round(h.y + 1.959963984540054 * sd * sqrt(g.h), 2) as upper, g.h as horizon_index from z, r, generate_series(1, 6) g(h) join h on h.t = cast(z.t + to_months(g.h::int - 12) as date)")
def forecast_seasonal_naive(c):
    out = stats.forecast(_history(c), horizon=6).df
    return out.select("time", *(F.round(x, 2).alias(x) for x in ("predicted", "lower", "upper")), "horizon_index")


@query(f"with h as (select *, row_number() over (order by t) - 1 i from ({HISTORY})), z as (select arg_max(y, t) y, arg_min(y, t) a, count(*) n from h), r as (select stddev_samp(h.y - (a + (z.y - a) * i / (n - 1))) sd from h, z) select round(y + h * (y - a) / (n - 1), 2) as predicted, round(y + h * (y - a) / (n - 1) - 1.959963984540054 * sd * sqrt(h), 2) as lower, round(y + h * (y - a) / (n - 1) + 1.959963984540054 * sd * sqrt(h), 2) as upper, h as horizon_index from z, r, generate_series(1, 4) g(h)")
def forecast_drift(c):
    out = stats.forecast(_history(c), horizon=4, model="drift").df
    return out.select(*(F.round(x, 2).alias(x) for x in ("predicted", "lower", "upper")), "horizon_index")


# --- events and lifecycles ----------------------------------------------------------------------------

COHORT = T.time_scope(start="2024-01-01", end="2024-01-20")
STARTS = """with s as (select user_id u, min(ts) t0 from events where event_type = 'signup' and ts >= '2024-01-01' and ts < '2024-01-20' group by all),
v as (select u, t0, (select min(ts) from events where user_id = u and event_type = 'view' and ts > t0 and ts < '2024-01-31') t1 from s),
p as (select u, t0, t1, (select min(ts) from events where user_id = u and event_type = 'purchase' and ts > t1 and ts < '2024-01-31') t2 from v)"""


def _journeys(c):
    pattern = events.sequence(events.step(event="signup", key="signup"), events.step(event="view", key="view"), events.step(event="purchase", key="purchase"))
    return events.match(c, pattern=pattern, cohort_window=COHORT, completion_through="2024-01-31", covered_through="2024-01-31")


@query(f"{STARTS}, j as (select u, t0, t1, case when t1 is not null then t2 end t2 from p) select cast(u as varchar) as subject, 'signup' as step_key, t0 as occurred_at from j union all select cast(u as varchar), 'view', t1 from j union all select cast(u as varchar), 'purchase', t2 from j")
def events_match_first_per_subject(c):
    return _journeys(c).df.select(F.col("subject_identity.k0").alias("subject"), "step_key", "occurred_at")


@query(f"{STARTS} select 'signup' as step_key, count(*) as cohort_count, count(*) as entry_count, count(t0) as reached_count, count(*) - count(t0) as lost_count from p union all select 'view', count(*), count(t0), count(t1), count(t0) - count(t1) from p union all select 'purchase', count(*), count(t1), count(t2), count(t1) - count(t2) from p")
def events_funnel(c):
    return events.funnel(_journeys(c)).df.select("step_key", "cohort_count", "entry_count", "reached_count", "lost_count")


@query(f"{STARTS} select cast(u as varchar) as subject, t0 as start_time, t2 as end_time, round(epoch(t2) - epoch(t0), 0)::double as seconds from p")
def events_time_to_event(c):
    out = events.time_to_event(_journeys(c), start_step="signup", end_step="purchase").df
    return out.select(F.col("subject_identity.k0").alias("subject"), "start_time", "end_time", F.round(F.unix_micros(F.col("end_time").cast("timestamp")) / 1e6 - F.unix_micros(F.col("start_time").cast("timestamp")) / 1e6, 0).alias("seconds"))


@query("select min(ts) as first_at, max(ts) as last_at, count(*) as n from events where event_type = 'purchase'")
def events_occurrence_bounds(c):
    return events.occurrence_bounds(c, "purchase")


@query(f"{STARTS} select cast(u as varchar) as subject from p where t1 is not null and t2 is null")
def subjects_dropped_before(c):
    return events.dropped_before(_journeys(c), "purchase").select(F.col("subject_identity.k0").alias("subject"))


@query("with s as (select distinct user_id u from events where event_type = 'purchase' and value > 50) select event_type, count(*) as value from events where user_id in (select u from s) group by all")
def subjects_cohort_observe(c):
    cohort = c.frame("events").where("event_type = 'purchase' and value > 50").select(F.col("user_id").alias("member")).distinct()
    return observe(c, "event_count", dimensions=["event_type"], cohort=("user_id", cohort))


HISTORY_SQL = """with b as (select user_id u, min(ts) t0 from events where event_type = 'signup' and ts < '2024-02-01' group by all),
e as (select u, t0, (select min(ts) from events where user_id = u and event_type = 'error' and ts > t0 and ts < '2024-02-01') t2 from b),
p as (select u, t0, t2, (select min(ts) from events where user_id = u and event_type = 'purchase' and ts > t0 and ts < coalesce(t2, timestamp '2024-02-01')) t1 from e),
h as (select u, 'active' s, t0 a, coalesce(t1, t2) z from p union all select u, 'customer', t1, t2 from p where t1 is not null union all select u, 'failed', t2, null from p where t2 is not null)"""


def _replay(c):
    return lifecycle.replay(c, "visitor", window=WHOLE)


@query(f"{HISTORY_SQL} select cast(u as varchar) as subject, s as model_state, a as valid_from, coalesce(z, timestamp '2024-02-01') as valid_to, case when z is null then 'right_censored' else 'completed' end as interval_status from h")
def lifecycle_replay(c):
    return _replay(c).df.select(F.col("subject_identity.k0").alias("subject"), "model_state", "valid_from", "valid_to", "interval_status")


@query(f"{HISTORY_SQL}, k as (select unnest(['active', 'customer', 'failed']) s) select timestamp '2024-01-10' as as_of, k.s as model_state, count(h.u) as subject_count from k left join h on h.s = k.s and a <= '2024-01-10' and coalesce(z, timestamp '2024-02-01') > '2024-01-10' group by all")
def lifecycle_distribution(c):
    return lifecycle.distribution(_replay(c), at=["2024-01-10 00:00:00"]).drop("share")


@query(f"{HISTORY_SQL} select 'active' as from_model_state, 'customer' as to_model_state, count(*) filter (where t1 is not null) as transition_count from p union all select 'active', 'failed', count(*) filter (where t1 is null and t2 is not null) from p union all select 'customer', 'failed', count(*) filter (where t1 is not null and t2 is not null) from p")
def lifecycle_transitions(c):
    return lifecycle.transitions(_replay(c)).drop("share_of_modeled_transitions")


@query(f"{HISTORY_SQL} select s as model_state, count(*) as interval_count, count(z) as completed_count, count(*) - count(z) as right_censored_count from h group by all")
def lifecycle_dwell(c):
    return lifecycle.dwell(_replay(c)).select("model_state", "interval_count", "completed_count", "right_censored_count")


@query(f"{HISTORY_SQL} select cast(u as varchar) as subject from h where s = 'customer' and a <= '2024-01-15' and coalesce(z, timestamp '2024-02-01') > '2024-01-15'")
def subjects_in_state(c):
    return lifecycle.in_state(_replay(c), "customer", "2024-01-15 00:00:00").select(F.col("subject_identity.k0").alias("subject"))


# --- quality, sources -----------------------------------------------------------------------------------


@query("select 'duplicate_keys' as check_id, 'ok' as severity union all select 'metric_row_contract', 'ok' union all select 'null_ratio:value', 'ok' union all select 'row_count', 'ok' union all select 'time_coverage', 'ok' union all select 'value_density:value', 'ok'")
def quality_metric(c):
    return quality.assess_quality(observe(c, "revenue", time_scope=Y96, grain="month")).df.select("check_id", "severity")


@query("select 'delta_row_contract' as check_id, 'ok' as severity union all select 'delta_math', 'ok'")
def quality_delta(c):
    return quality.assess_quality(compare.compare(*_two(c, dimensions=["n_name"]))).df.select("check_id", "severity")


@query("select 'event_ordering' as check_id, 'ok' as severity union all select 'event_participant', 'ok' union all select 'event_censoring', 'ok' union all select 'event_identity', 'ok'")
def quality_events(c):
    return quality.assess_quality(_journeys(c)).df.select("check_id", "severity")


@query("select 'o_orderstatus' as column, count(*) as rows, count(*) - count(o_orderstatus) as nulls, count(distinct o_orderstatus) as distinct, min(o_orderstatus) as least, max(o_orderstatus) as most from orders union all select 'o_custkey', count(*), count(*) - count(o_custkey), count(distinct o_custkey), min(o_custkey)::varchar, max(o_custkey)::varchar from orders")
def source_profile(c):
    return inspect.profile(c.frame("orders").select("o_orderstatus", "o_custkey")).select("column", "rows", "nulls", "distinct", "least", "most")


@query("select count(*) as rows, 0::bigint as null_keys, (select count(*) from (select o_custkey from orders group by 1 having count(*) > 1)) as repeated_keys from orders")
def source_key_evidence(c):
    return inspect.key_evidence(c.frame("orders"), ["o_custkey"])


@query("select (select count(*) from customer where c_custkey in (select o_custkey from orders)) as matched, (select count(*) from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)) as orphans")
def source_relationship_evidence(c):
    return inspect.relationship_evidence(c.frame("customer"), c.frame("orders"), [("c_custkey", "o_custkey")])


@query("select o_orderpriority as value, count(*) as n from orders group by all order by n desc, value limit 3")
def source_top_values(c):
    return inspect.top_values(c.frame("orders"), "o_orderpriority", 3)


@query("select o_orderstatus, count(*) as n from orders group by all")
def source_raw_sql(c):
    c.frame("orders").createOrReplaceTempView("metrolith_orders")
    return inspect.raw_sql(c.spark, "select o_orderstatus, count(*) as n from metrolith_orders group by o_orderstatus", reason="status counts")[0]


@query("select event_type, round(sum(cast(json_extract(props, '$.k') as bigint)), 4)::bigint as k from events group by all")
def source_json_paths(c):
    from metrolith.sources.readers import from_payload

    raw = c.frame("events").select(F.to_json(F.struct("event_type", F.col("props").alias("p"))).alias("value"), "props", "event_type")
    parsed = from_payload(raw.select(F.concat(F.lit('{"t":"'), "event_type", F.lit('","props":'), "props", F.lit("}")).alias("value")), schema={"event_type": "string", "k": "int64"}, field_paths={"event_type": "t", "k": "props.k"})
    return parsed.groupBy("event_type").agg(F.sum("k").alias("k"))
