"""Literal cases: fixtures with known results, and plans that must be refused."""

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from metrolith.functions import stats as S
from metrolith.functions import time as T
from metrolith.functions.errors import PlanError
from metrolith.operators import attribute, compare, events, lifecycle, quality, stats
from metrolith.plans.frames import Frame
from metrolith.plans.model import Catalog, Participant, SemiAdditive, Snapshot, Validity
from metrolith.plans.planner import observe
from metrolith.plans.session import Session
from metrolith.sources import inspect, readers


@pytest.fixture
def sales(spark):
    c = Catalog(spark)
    rows = [(1, "2026-07-01", 10.0, "north", 100), (2, "2026-07-02", 20.0, "north", 100), (3, "2026-08-01", 30.0, "south", 200), (4, "2026-09-15", 40.0, "north", 300)]
    df = spark.createDataFrame(rows, "order_id int, d string, amount double, region string, user_id int").withColumn("created_at", F.to_date("d"))
    c.entity("orders", df, primary_key=["order_id"])
    c.time_dimension("created_at", "orders")
    c.dimension("region", "orders")
    c.measure("amount", "orders")
    c.measure("user_id", "orders", additivity="non_additive")
    c.aggregate("revenue", "amount", "sum")
    c.aggregate("users", "user_id", "count_distinct")
    return c


Q3 = T.time_scope(start="2026-07-01", end="2026-10-01")


def values(f):
    return {tuple(r[a] for a in f.axes): r["value"] for r in f.df.collect()}


def test_observe_shapes(sales):
    assert observe(sales, "revenue").df.first()[0] == 100.0
    assert values(observe(sales, "revenue", dimensions=["region"])) == {("north",): 70.0, ("south",): 30.0}
    monthly = observe(sales, "revenue", time_scope=Q3, grain="month")
    assert monthly.shape == "time_series" and values(monthly)[(date(2026, 7, 1),)] == 30.0
    assert observe(sales, "revenue", time_scope=Q3, grain="month", dimensions=["region"]).shape == "panel"


def test_window_end_is_exclusive(sales):
    assert observe(sales, "revenue", time_scope=T.time_scope(start="2026-07-01", end="2026-07-02")).df.first()[0] == 10.0


def test_fan_out(spark, sales):
    items = [(1, 1, "shirt"), (2, 1, "pants"), (3, 2, "shirt"), (4, 3, "pants"), (5, 2, "hat")]
    sales.entity("items", spark.createDataFrame(items, "item_id int, order_id int, category string"), primary_key=["item_id"])
    sales.relationship("order_items", "orders", "items", [("order_id", "order_id")])
    sales.dimension("category", "items")
    with pytest.raises(PlanError, match="fanout-blocked"):
        observe(sales, "revenue", dimensions=["category"])
    sales.metric("once", "orders", lambda df: F.sum(df["amount"]), fanout="aggregate_then_join")
    assert values(observe(sales, "once", dimensions=["category"])) == {("shirt",): 30.0, ("pants",): 40.0, ("hat",): 20.0, (None,): 40.0}
    assert observe(sales, "once", slice_by={"category": "shirt"}).df.first()[0] == 30.0


def test_as_of_and_validity(spark, sales):
    tiers = spark.createDataFrame([(100, "20260701", "old"), (100, "20260705", "new")], "user_id int, dt string, tier string")
    sales.entity("tiers", tiers, primary_key=["user_id", "dt"], versioning=Snapshot("dt", "%Y%m%d"))
    sales.relationship("order_tier", "orders", "tiers", [("user_id", "user_id")])
    sales.dimension("tier", "tiers")
    july = T.time_scope(start="2026-07-01", end="2026-08-01")
    assert values(observe(sales, "revenue", time_scope=july, dimensions=["tier"], versions="root_time")) == {("old",): 30.0}
    sales2 = sales
    early = spark.createDataFrame([(9, 5.0, 100, date(2026, 6, 1))], "order_id int, amount double, user_id int, created_at date")
    c = Catalog(spark)
    c.entity("orders", early, primary_key=["order_id"])
    c.time_dimension("created_at", "orders")
    c.measure("amount", "orders")
    c.aggregate("revenue", "amount", "sum")
    c.entity("tiers", tiers, primary_key=["user_id", "dt"], versioning=Snapshot("dt", "%Y%m%d"))
    c.relationship("order_tier", "orders", "tiers", [("user_id", "user_id")])
    c.dimension("tier", "tiers")
    with pytest.raises(Exception, match="as-of-partition-missing"):
        observe(c, "revenue", time_scope=T.time_scope(start="2026-06-01", end="2026-07-01"), dimensions=["tier"], versions="root_time").df.collect()
    levels = spark.createDataFrame([(100, date(2026, 1, 1), date(2026, 7, 2), "silver"), (100, date(2026, 7, 2), None, "gold")], "user_id int, a date, z date, level string")
    sales2.entity("levels", levels, primary_key=["user_id", "a"], versioning=Validity("a", "z"))
    sales2.relationship("order_level", "orders", "levels", [("user_id", "user_id")])
    sales2.dimension("level", "levels")
    assert values(observe(sales2, "revenue", time_scope=july, dimensions=["level"], versions="root_time")) == {("silver",): 10.0, ("gold",): 20.0}


def test_paths_and_names(spark, sales):
    for n in ("a", "b", "z"):
        sales.entity(n, spark.createDataFrame([(1,)], "k int"), primary_key=["k"])
    sales.dimension("k", "z")
    with pytest.raises(PlanError, match="path-missing"):
        observe(sales, "revenue", dimensions=["z.k"])
    for n in ("a", "b"):
        sales.relationship(f"o{n}", "orders", n, [("order_id", "k")])
        sales.relationship(f"{n}z", n, "z", [("k", "k")])
    with pytest.raises(PlanError, match="path-ambiguous"):
        observe(sales, "revenue", dimensions=["z.k"])
    with pytest.raises(PlanError, match="duplicate-name"):
        sales.dimension("region", "orders")
    with pytest.raises(PlanError, match="sum-of-non-additive"):
        sales.aggregate("bad", "user_id", "sum")


def test_ratio_zero_and_error(sales):
    sales.count("south", "orders", where={"region": "south"})
    sales.ratio("r", "revenue", "south")
    assert values(observe(sales, "r", dimensions=["region"])) == {("north",): None, ("south",): 30.0}
    sales.ratio("e", "revenue", "south", zero_division="error")
    with pytest.raises(Exception, match="zero-division"):
        observe(sales, "e", dimensions=["region"]).df.collect()


def test_sampled_fold(spark):
    rows = [(t, dev, p, v) for t in ("2026-07-01 00:00:00", "2026-07-01 00:05:00") for dev, p, v in ((1, "bj", 100.0), (2, "bj", 200.0), (3, "sh", 90.0))]
    c = Catalog(spark)
    df = spark.createDataFrame(rows, "t string, device int, province string, bw double").withColumn("at", F.col("t").cast("timestamp_ntz"))
    c.entity("samples", df)
    c.time_dimension("at", "samples")
    c.dimension("province", "samples")
    c.measure("bw", "samples", additivity=SemiAdditive("samples.at", "mean"))
    c.aggregate("level", "bw", "sum")
    assert values(observe(c, "level", dimensions=["province"])) == {("bj",): 300.0, ("sh",): 90.0}
    assert observe(c, "level").df.first()[0] == 390.0


def test_delta_math(spark):
    rows = [("a", 3.0, 2.0), ("b", 1.0, 0.0), ("c", -1.0, 0.0), ("d", 0.0, 0.0), ("e", None, 1.0), ("f", float("nan"), 1.0), ("g", 1.0, -2.0)]
    df = spark.createDataFrame(rows, "k string, c double, b double")
    got = {r["k"]: (r["delta"], r["pct_change"], r["pct_change_status"]) for r in df.select("k", *compare.delta_columns("c", "b")).collect()}
    assert got["a"] == (1.0, 0.5, "computed") and got["b"] == (1.0, None, "from_zero_growth") and got["c"][2] == "from_zero_decline"
    assert got["d"][2] == "zero_baseline_no_change" and got["e"] == (None, None, "not_computable") and got["f"][2] == "not_computable"
    assert got["g"] == (3.0, 1.5, "computed")


def test_transform_refusals(sales):
    f = observe(sales, "users", dimensions=["region"])
    with pytest.raises(PlanError, match="rollup-not-additive"):
        f.transform.rollup(drop_axes=["region"])
    with pytest.raises(PlanError, match="rank-method"):
        f.transform.rank(by="value", method="odd")


def test_reconcile_and_quality(sales):
    a = observe(sales, "revenue", time_scope=T.time_scope(start="2026-08-01", end="2026-10-01"), dimensions=["region"])
    b = observe(sales, "revenue", time_scope=T.time_scope(start="2026-07-01", end="2026-08-01"), dimensions=["region"])
    d = compare.compare(a, b)
    out = attribute.additive(d, ["region"])
    assert attribute.reconcile(40.0, out.df)["ok"] and not attribute.reconcile(41.0, out.df)["ok"]
    assert quality.worst(quality.assess_quality(d)) == "ok" and quality.worst(quality.assess_quality(out)) == "ok"
    broken = Frame(a.df.union(a.df), "metric", a.keys, a.time)
    assert quality.worst(quality.assess_quality(broken)) == "blocking"


def test_statistics():
    assert abs(S.t_tail(2.0, 10) - 0.036694) < 1e-6 and abs(S.t_quantile(0.975, 10) - 2.228139) < 1e-6
    assert S.kendall([1, 2, 3], [1, 3, 2]) == pytest.approx(1 / 3)
    assert S.shapley(2, lambda s: len(s) * 3.0, "x") == [3.0, 3.0]


def _people(spark, rows, names):
    c = Catalog(spark)
    df = spark.createDataFrame(rows, "id string, subject string, kind string, t string").withColumn("at", F.col("t").cast("timestamp_ntz"))
    c.entity("log", df, primary_key=["id"])
    for n in names:
        c.event(n, "log", identity=["id"], occurred_at="at", subject=["subject"], where=lambda d, n=n: d["kind"] == n)
    return c


ROWS = [
    ("e1", "o1", "created", "2026-07-02"), ("e2", "o1", "paid", "2026-07-05"), ("e3", "o2", "created", "2026-07-10"),
    ("e4", "o3", "created", "2026-07-11"), ("e5", "o3", "paid", "2026-07-12"),
]
PATTERN = events.sequence(events.step(event="created", key="created"), events.step(event="paid", key="paid"))


@pytest.mark.parametrize("how", [events.first_per_subject(), events.every_start(completion_assignment="exclusive")])
def test_funnel(spark, how):
    c = _people(spark, ROWS, ["created", "paid"])
    j = events.match(c, pattern=PATTERN, cohort_window=T.time_scope(start="2026-07-01", end="2026-08-01"), completion_through="2026-08-01", matching=how)
    rows = {r["step_key"]: r for r in events.funnel(j).df.collect()}
    assert rows["created"]["reached_count"] == 3 and rows["paid"]["reached_count"] == 2 and rows["paid"]["lost_count"] == 1
    assert rows["paid"]["conversion_from_previous"] == pytest.approx(2 / 3)
    assert [r[0]["k0"] for r in events.dropped_before(j, "paid").collect()] == ["o2"]
    delta = compare.compare_funnels(events.funnel(j), events.funnel(j)).df.collect()
    assert all(r["loss_rate_from_previous_delta"] in (0.0, None) for r in delta)
    loss = attribute.funnel_loss(events.funnel(j).df, events.funnel(j).df, [], "paid").df
    assert all(r["contribution"] == 0 for r in loss.collect())


def test_censored_and_ambiguous(spark):
    c = _people(spark, ROWS, ["created", "paid"])
    window = T.time_scope(start="2026-07-01", end="2026-08-01")
    j = events.match(c, pattern=PATTERN, cohort_window=window, completion_through="2026-08-01", covered_through="2026-07-15")
    assert {r["completion_status"] for r in j.df.collect()} == {"complete", "coverage_censored"}
    tie = _people(spark, [("a", "x", "created", "2026-07-02"), ("b", "x", "paid", "2026-07-02")], ["created", "paid"])
    with pytest.raises(Exception, match="ambiguous-event-order"):
        events.match(tie, pattern=PATTERN, cohort_window=window, completion_through="2026-08-01").df.collect()


def test_lifecycle(spark):
    rows = [
        ("1", "o1", "created", "2026-06-15"), ("2", "o1", "paid", "2026-07-05"), ("3", "o1", "paid", "2026-07-10"), ("4", "o1", "closed", "2026-07-20"),
        ("5", "o1", "paid", "2026-07-25"), ("6", "o2", "created", "2026-07-10"), ("7", "o2", "closed", "2026-07-25"), ("8", "o3", "paid", "2026-07-01"),
    ]
    c = _people(spark, rows, ["created", "paid", "closed"])
    c.state_model("order", "order", states=["open", "paid", "closed"], initial="open", terminal=["closed"], inceptions=["created"],
                  transitions=[("open", "paid", "paid"), ("open", "closed", "closed"), ("paid", "closed", "closed")])
    h = lifecycle.replay(c, "order", window=T.time_scope(start="2026-07-01", end="2026-08-01"))
    kinds = sorted((r["trigger_event_ref"], r["violation_kind"]) for r in lifecycle.violations(h).collect())
    assert kinds == [("paid", "ignored_pre_inception"), ("paid", "illegal_transition"), ("paid", "transition_from_terminal")]
    spans = sorted((r[0]["k0"], r["model_state"], r["valid_from"].day, r["interval_status"]) for r in h.df.collect())
    assert spans[:3] == [("o1", "closed", 20, "right_censored"), ("o1", "open", 1, "completed"), ("o1", "paid", 5, "completed")]
    moves = {(r[0], r[1]): r[2] for r in lifecycle.transitions(h).collect()}
    assert moves == {("open", "paid"): 1, ("open", "closed"): 1, ("paid", "closed"): 1}
    assert quality.worst(quality.assess_quality(h)) == "warning"
    with pytest.raises(PlanError, match="state-unknown"):
        c.state_model("bad", "order", states=["a"], initial="b", inceptions=[], transitions=[])


def test_short_series(spark):
    df = spark.createDataFrame([(date(2026, 1, 1), 1.0)], "bucket_start date, value double")
    f = Frame(df, "metric", (), "bucket_start", grain=T.Grain("month"))
    assert stats.forecast(f, horizon=1, model="naive").df.first()["reason_code"] == "insufficient_history"
    assert stats.hypothesis_test(f, f).df.first()["reason_code"] == "insufficient_pairs"
    assert stats.correlate(f, f).df.first()["correlation"] is None


def test_time_helpers():
    assert T.java_pattern("%Y%m%d") == "yyyyMMdd" and T.java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    assert T.sorts_by_time("%Y-%m-%d") and not T.sorts_by_time("%d/%m/%Y")
    with pytest.raises(PlanError):
        T.java_pattern("%Q")
    assert T.floor(datetime(2026, 7, 15, 13, 44), T.Grain("minute", 15)) == datetime(2026, 7, 15, 13, 30)


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;x\n2;y\n")
    assert readers.csv(str(tmp_path / "x.csv"), schema={"a": "int64", "b": "string"}, delimiter=";")(spark).count() == 2
    (tmp_path / "x.json").write_text(json.dumps({"data": {"rows": [{"id": 1, "tags": [{"n": "p"}, {"n": "q"}]}, {"id": 2, "tags": []}]}}))
    read = readers.json_source(str(tmp_path / "x.json"), schema={"id": "int64", "tag": "string"}, records_path="data.rows", field_paths={"id": "id", "tag": "tags[*].n"})
    assert sorted(tuple(r) for r in read(spark).collect()) == [(1, "p"), (1, "q")]
    bad = readers.json_source(str(tmp_path / "x.json"), schema={"id": "int64"}, records_path="data")
    with pytest.raises(Exception, match="json-records-not-array"):
        bad(spark).collect()
    reg = readers.Registry()
    reg.register("w", "sqlite", url="jdbc:sqlite::memory:", password_env="X")
    assert reg.list() == ["w"] and reg.describe("w")["password_env"] == "***" and reg.remove("w") and not reg.remove("w")
    with pytest.raises(PlanError, match="raw-sql-not-read-only"):
        inspect.raw_sql(spark, "drop table x", reason="no")
    with pytest.raises(PlanError, match="raw-sql-many"):
        inspect.raw_sql(spark, "select 1; select 2", reason="no")
    assert inspect.raw_sql(spark, "select id from range(5)", reason="few", limit=3)[1]
    assert readers.bind({"a": readers.source_param("p")}, {"p": 3}) == {"a": 3}


def test_session_keeps_frames(sales, tmp_path):
    s = Session(sales, str(tmp_path))
    f = s.observe("revenue", dimensions=["region"])
    ref = s.save(f)
    again = s.get_frame(ref)
    assert again.keys == ("region",) and again.df.count() == 2 and s.frames() == [ref]
    assert again.meta["sha256"] == inspect.content_hash(f.df)
    d = s.compare(s.observe("revenue", time_scope=T.time_scope(start="2026-08-01", end="2026-10-01")), s.observe("revenue", time_scope=T.time_scope(start="2026-07-01", end="2026-08-01")))
    assert {r["region"]: r["contribution"] for r in s.attribute(d, axes=["region"]).df.collect()} == {"north": 10.0, "south": 30.0}
    s.delete()
    assert s.frames() == []


def test_sketch_quantiles_agree_with_exact_ones(spark):
    rng = __import__("random").Random(3)
    rows = [(rng.choice("abc"), float(rng.randint(0, 60)), side) for side in (0, 1) for _ in range(90 + 20 * side)]
    df = spark.createDataFrame(rows, "axis string, v double, side int")
    now, then = df.where("side = 1"), df.where("side = 0")
    exact = {r["axis"]: r["contribution"] for r in attribute.quantile(now, then, "axis", "v", 0.5).df.collect()}
    sketch = {r["axis"]: r["contribution"] for r in attribute.quantile_by_sketch(now, then, "axis", "v", 0.5).df.collect()}
    assert set(exact) == set(sketch) and all(abs(exact[k] - sketch[k]) <= 2.0 for k in exact)


def test_quantile_refuses_an_empty_coalition(spark):
    now = spark.createDataFrame([("a", 1.0)], "axis string, v double")
    then = spark.createDataFrame([("b", 2.0)], "axis string, v double")
    for how in (attribute.quantile, attribute.quantile_by_sketch):
        with pytest.raises(PlanError, match="quantile-empty-coalition"):
            how(now, then, "axis", "v", 0.5)


def test_kendall_counts_ties_as_pairs_do():
    from metrolith.functions.stats import kendall

    rng = __import__("random").Random(1)
    for n in (2, 3, 10, 60):
        for _ in range(20):
            x, y = ([rng.randint(0, 5) for _ in range(n)] for _ in range(2))
            s = tx = ty = 0
            for i in range(n):
                for j in range(i):
                    a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
                    s, tx, ty = s + a * b, tx + (a != 0), ty + (b != 0)
            expected = s / (tx * ty) ** 0.5 if tx and ty else None
            assert kendall(x, y) == (pytest.approx(expected) if expected is not None else None)


def test_slices_beyond_the_cap_are_listed(spark, monkeypatch):
    from metrolith.operators import discover
    from metrolith.plans.frames import Frame

    monkeypatch.setattr(discover, "MAX_GROUPS", 3)
    df = spark.createDataFrame([(a, b, float(a == 0) * 9 + b) for a in range(3) for b in range(4)], "a int, b int, value double")
    found = discover.interesting_slices(Frame(df, "metric", ("a", "b")), threshold=0.1, limit=None)
    assert found.meta["skipped"] == [{"axes": ["b"], "groups": 4, "reason": "group_cap"}, {"axes": ["a", "b"], "groups": 12, "reason": "group_cap"}]
    assert {r["selector"].split("=")[0] for r in found.df.collect()} == {"a"}
    monkeypatch.setattr(discover, "MAX_GROUPS", 1)
    assert discover.interesting_slices(Frame(df, "metric", ("a", "b"))).df.count() == 0


def test_calendar_periods_and_their_errors(spark):
    from metrolith.plans.model import CalendarAnchor

    c = Catalog(spark)
    days = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-20', interval 1 day)) d").selectExpr("d", "concat('p', floor((day(d) - 1) / 10)) p")
    rows = spark.createDataFrame([(1, "2026-01-02", 5.0), (2, "2026-01-12", 7.0), (3, "2026-01-25", 1.0)], "id int, at string, x double").selectExpr("id", "cast(at as date) at", "x")
    c.entity("rows", rows, primary_key=["id"])
    c.time_dimension("at", "rows", default=True)
    c.measure("x", "rows")
    c.aggregate("total", "x", "sum")
    c.period_calendar("tens", lambda s: days, date="d", levels={"ten": "p"})
    c.cumulative("to_date", "total", anchor=CalendarAnchor("tens", "ten"))
    assert c.period_on("tens", "ten", "2026-01-15")["period_key"] == "p1"
    with pytest.raises(PlanError, match="period-missing"):
        c.period_on("tens", "ten", "2026-02-15")
    got = observe(c, "to_date", time_scope=T.time_scope(start="2026-01-10", end="2026-01-13"), grain="day").df.orderBy("bucket_start").collect()
    assert [r["value"] for r in got] == [5.0, 0.0, 7.0]
    with pytest.raises(PlanError, match="cumulative-grain"):
        observe(c, "to_date", time_scope=T.time_scope(start="2026-01-10", end="2026-01-13"), grain="week")
    with pytest.raises(Exception, match="calendar-day-missing"):
        observe(c, "to_date", time_scope=T.time_scope(start="2026-01-18", end="2026-01-27"), grain="day").df.collect()


def test_coverage_receipt_and_roles(spark):
    from datetime import datetime

    from metrolith.operators import events

    c = Catalog(spark)
    rows = [("e1", "u1", "s1", "2026-01-01 00:00:00"), ("e2", "u2", "s1", "2026-01-03 00:00:00")]
    c.entity("log", spark.createDataFrame(rows, "id string, user string, seller string, at string").selectExpr("id", "user", "seller", "cast(at as timestamp_ntz) at"), primary_key=["id"])
    for name, cond in (("buy", "true"), ("never", "false")):
        c.event(name, "log", identity=["id"], occurred_at="at", subject=["user"], roles={"seller": ["seller"]}, where=lambda df, cond=cond: F.expr(cond))
    assert events.covered_by(events.watermark(c, ["buy"])) == datetime(2026, 1, 3) and events.covered_by(events.watermark(c, ["buy", "never"])) is None
    assert [r["subject"]["k0"] for r in events.occurrences(c, ["buy"], role="seller").collect()] == ["s1", "s1"]
    with pytest.raises(PlanError, match="event-role-unknown"):
        events.occurrences(c, ["buy"], role="courier")
    c.event("broken", "log", identity=["id"], occurred_at="when", subject=["user"])
    c.dimension("absent", "log")
    assert c.verify() == ["field-column-missing: log.absent (absent)", "event-column-missing: broken (when)"]


def _tied(spark, rows):
    c = Catalog(spark)
    c.entity("log", spark.createDataFrame(rows, "id int, who string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")), primary_key=["id"])
    for e in ("born", "a", "b", "d"):
        c.event(e, "log", identity=["id"], occurred_at="ts", subject=["who"], where=lambda df, e=e: df["kind"] == e)
    c.state_model("m", "who", states=["s", "x", "y", "end"], initial="s", inceptions=["born"], terminal=["end"], transitions=[("s", "a", "x"), ("x", "b", "y"), ("s", "d", "s"), ("y", "d", "end")])
    return c


WEEK = T.time_scope(start="2026-07-01", end="2026-07-08")


def test_ties_that_only_a_third_order_shows(spark):
    """a, b, d at one instant in state s: by name (a, b, d) and backwards (d, b, a) differ already; b, d alone do not."""
    born = (1, "u", "born", "2026-07-01 00:00:00")
    c = _tied(spark, [born, (2, "u", "d", "2026-07-02"), (3, "u", "a", "2026-07-02"), (4, "u", "b", "2026-07-02")])
    with pytest.raises(Exception, match="ambiguous-event-order"):
        lifecycle.replay(c, "m", window=WEEK).df.collect()
    calm = _tied(spark, [born, (2, "u", "d", "2026-07-02"), (3, "u", "b", "2026-07-02"), (4, "u", "a", "2026-07-03")])
    assert {r["model_state"] for r in lifecycle.replay(calm, "m", window=WEEK).df.collect()} == {"s", "x"}


def test_settled_agrees_with_all_orders():
    """The search over prefixes against every permutation, for every start and multiset of up to four events."""
    from itertools import combinations_with_replacement, permutations

    from metrolith.plans.model import StateModel

    models = [
        StateModel("m", "u", ("s", "x", "y"), "s", ("y",), ("n",), (("s", "a", "x"), ("x", "a", "s"), ("x", "b", "y"), ("s", "b", "y"))),
        StateModel("m", "u", ("s", "x"), "s", (), ("n",), (("s", "a", "x"), ("x", "b", "x"), ("s", "b", "s"), ("x", "a", "x"))),
    ]
    for m in models:
        judge = lifecycle._judge(m)
        for state in (None, *m.states):
            for size in (1, 2, 3, 4):
                for events_ in combinations_with_replacement(["a", "b", "n"], size):
                    seen = set()
                    for order in set(permutations(events_)):
                        at, nth, kinds = state, {}, set()
                        for e in order:
                            at, kind = judge(at, e)
                            kinds.add((e, nth.get(e, 0), kind))
                            nth[e] = nth.get(e, 0) + 1
                        seen.add((at, frozenset(kinds)))
                    end, agreed = lifecycle._settled(judge, state, list(events_))
                    assert agreed == (len(seen) == 1), (m, state, events_)
                    assert not agreed or {end} == {x for x, _ in seen}


def test_inception_in_a_life_and_missing_inception(spark):
    c = _tied(spark, [(1, "u", "born", "2026-07-01"), (2, "u", "born", "2026-07-02"), (3, "v", "a", "2026-07-03")])
    h = lifecycle.replay(c, "m", window=WEEK)
    assert sorted(r["violation_kind"] for r in lifecycle.violations(h).collect()) == ["ignored_pre_inception", "illegal_transition"]
    who = lambda *names: spark.createDataFrame([((n,),) for n in names], "subject_identity struct<k0:string>")
    assert lifecycle.replay(c, "m", window=WEEK, population=who("u")).df.count() == 1
    for lost in ("v", "w"):  # events but no inception; no events
        with pytest.raises(Exception, match="missing-inception"):
            lifecycle.replay(c, "m", window=WEEK, population=who("u", lost)).df.collect()
    assert lifecycle.replay(c, "m", window=WEEK, covered_through="2026-07-05", population=who("u", "w")).df.count() == 1


def test_running_counts(spark):
    from metrolith.functions.ranks import by_value, running

    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 3.0, 3.0, 3.1, -2.5, None, 1e-9, 1024.0, 1023.999]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = {r["i"]: r["n"] for r in running(df, "x", F.lit(1), "n", ties=[F.col("i")]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or 0.0, i))
    assert got == {i: n for n, i in enumerate(order)}
    places = {r["_v"]: (r["_less"], r["_place"]) for r in by_value(df.where("x >= 3"), "x", descending=True).collect()}
    assert places == {1.7e308: (0, 0), 1024.0: (1, 1), 1023.999: (2, 2), 3.1: (3, 3), 3.0: (4, 4)}
    assert running(df.where("false"), "x", F.lit(1), "n").count() == 0
    edges = [float("inf"), 2.0, float("nan"), float("-inf"), -2.0]
    got = {r["i"]: r["n"] for r in running(spark.createDataFrame(list(enumerate(edges)), "i int, x double"), "x", F.lit(1), "n").collect()}
    assert got == {3: 0, 4: 1, 1: 2, 0: 3, 2: 4}


def test_sessions_are_resumed(sales, tmp_path):
    spark, root = sales.spark, str(tmp_path / "kept")
    s = Session.create(sales, root, "july", "why?")
    ref = s.save(s.observe("revenue", dimensions=["region"]))
    with pytest.raises(PlanError, match="session-exists"):
        Session.create(sales, root, "july")
    again = Session.resume(sales, root, "july", "why?")
    assert again.id == s.id and [j["operator"] for j in again.jobs] == ["observe", "save"] and again.get_frame(ref).df.count() == 2
    with pytest.raises(PlanError, match="question-mismatch"):
        Session.resume(sales, root, "july", "how?")
    Session.create(sales, root, "august")
    assert [x["name"] for x in Session.recent(spark, root)] == ["august", "july"] and len(Session.recent(spark, root, limit=1)) == 1
    assert Session.inspect(spark, root, "july")["frames"] == [ref]
    with pytest.raises(PlanError, match="session-unknown"):
        Session.inspect(spark, root, "june")
    d = again.digest(ref, most=1)
    assert d["rows"] == 2 and len(d["items"]) == 1 and {"kind": "rows_left_out", "rows": 1} in d["boundaries"] and again.digest(ref, most=1) == d
    first = again.findings()[0]
    found = again.trace(first["finding_id"])
    assert found["source"] == ref and [j["operator"] for j in found["jobs"]] == ["save"]
    with pytest.raises(PlanError, match="finding-unknown"):
        again.trace("finding-0")


def test_specs_profiles_and_limits(spark, monkeypatch):
    s = readers.spec("postgres", host="db", database="shop", user="me", password_env="SHOP_PASSWORD")
    assert s["url"] == "jdbc:postgresql://db:5432/shop" and readers.spec("duckdb", path="/x.db")["url"] == "jdbc:duckdb:/x.db"
    for bad in ({"kind": "oracle"}, {"kind": "mysql"}, {"kind": "sqlite", "host": "h"}):
        with pytest.raises(PlanError, match="datasource-"):
            readers.spec(**bad)
    reg = readers.Registry()
    reg.register("shop", **s)
    monkeypatch.delenv("SHOP_PASSWORD", raising=False)
    with pytest.raises(PlanError, match="datasource-password-missing"):
        reg.connect("shop", "orders")
    monkeypatch.setenv("SHOP_PASSWORD", "x")
    assert callable(reg.connect("shop", "orders")) and readers.engine_profile(spark)["read_only"]
    with pytest.raises(PlanError, match="scope-conflict"):
        inspect.sample(spark.range(3).toDF("p"), max_rows=2, unpruned=True, partition={"p": 1})
    assert inspect.sample(spark.range(3).toDF("p"), max_rows=5, unpruned=True, timeout=60)[1]
    slow = spark.range(5 * 10**9).where("hash(id) = 1 and hash(id + 1) = 2")
    with pytest.raises(Exception):
        inspect.sample(slow, max_rows=5, timeout=0.5)


def test_gregorian_keys(spark):
    from metrolith.functions import periods

    days = spark.sql("select explode(sequence(date'2019-12-01', date'2021-02-01', interval 1 day)) d")
    for level in periods.LEVELS:
        back = periods.first_day(periods.key(F.col("d"), level), level)
        assert days.where(~back.eqNullSafe(periods.start(F.col("d"), level))).count() == 0
        gap = periods.end(periods.before(F.col("d"), level), level)
        assert days.where(~gap.eqNullSafe(periods.start(F.col("d"), level))).count() == 0
    row = spark.sql("select '2021-W53' a, '2020-13' b, timestamp_ntz'2021-02-03 01:02:03.000004' t").select(
        periods.first_day(F.col("a"), "week").alias("a"), periods.first_day(F.col("b"), "month").alias("b"), periods.progress(F.col("t"), "week").alias("t")
    ).first()
    assert row["a"] is None and row["b"] is None and tuple(row["t"]) == (2, 3_723_000_004)
    assert periods.rolls_up_to("month", "year") and not periods.rolls_up_to("week", "year")


def test_participants_of_repeated_identities(spark):
    """Rows that are alike in identity and time are occurrences of their own; their roles do not cross."""
    c = Catalog(spark)
    rows = [("e1", "2026-01-01", 1, "s1"), ("e1", "2026-01-01", 2, "s2"), ("e2", "2026-01-01", 9, "s1")]
    c.entity("sales", spark.createDataFrame(rows, "id string, d string, buyer int, seller string").withColumn("at", F.col("d").cast("timestamp_ntz")), primary_key=["id"])
    c.entity("buyers", spark.createDataFrame([(1, 1), (2, 1)], "buyer_id int, payer int"), primary_key=["buyer_id"])
    c.relationship("sale_buyer", "sales", "buyers", [("buyer", "buyer_id")])
    by_path = Participant("buyers", ("sale_buyer",))
    c.event("sold", "sales", identity=["id"], occurred_at="at", subject=["id"], where=lambda d: d["seller"].isNotNull(), roles={"seller": ["seller"], "buyer": by_path, "again": by_path})
    found = events.participants(c, "sold", ["seller", "buyer", "again"])
    got = sorted(found.selectExpr("id.k0", "seller.k0", "buyer.k0", "again.k0").collect(), key=str)
    assert [tuple(r) for r in got] == [("e1", "s1", "1", "1"), ("e1", "s2", "2", "2"), ("e2", "s1", None, None)]
    with pytest.raises(PlanError, match="event-role-unknown"):
        events.participants(c, "sold", ["seller", "courier"])


def test_spearman_of_sums_that_vary(spark):
    """Values whose last bits differ each time they are computed, as those of sums over a shuffle, keep their ranks."""
    jitter = F.udf(lambda k: float(k) + random.random() / 8, "double").asNondeterministic()
    base = spark.range(200).select("id")
    noisy = Frame(base.select("id", jitter("id").alias("v")), "metric", ("id",), values=("v",))
    plain = Frame(base.select("id", (-F.col("id")).cast("double").alias("v")), "metric", ("id",), values=("v",))
    found = stats.correlate(noisy, plain, method="spearman").df.first()
    assert found["correlation"] == pytest.approx(-1.0) and found["aligned_row_count"] == 200
