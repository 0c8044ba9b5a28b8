from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom import model as M
from tallyloom.catalog import DECIMAL, Catalog, build_dictionary
from tallyloom.functions import buckets
from tallyloom.functions.buckets import bucket, bucket_list, micros
from tallyloom.functions.predicates import condition
from tallyloom.model import CustomEvent, EventRef, Filter, FilterGroup, TimeRange
from tallyloom.operators import metrics, shaping
from tallyloom.plans import segmentation
from tallyloom.streaming import sessions


def test_unpivot_pivot_round_trip(spark):
    df = spark.createDataFrame([("x", 1, 2.5), ("y", None, 3.0)], "k string, a int, b double")
    long = shaping.unpivot(df, ["a", "b"])
    assert long.schema["value"].dataType == DECIMAL and long.count() == 4
    back = {r["k"]: r for r in shaping.pivot(long, "agg_name", "value", ["b", "a", "c"]).collect()}
    assert back["x"]["a"] == Decimal(1) and back["y"]["a"] is None and back["x"]["c"] is None
    with pytest.raises(ValueError):
        shaping.unpivot(df, ["a", "a"])
    with pytest.raises(Exception, match="no column for b"):
        shaping.pivot(long, "agg_name", "value", ["a"], strict=True).collect()


def test_average_sort_and_cap(spark):
    df = spark.createDataFrame([("p", "x", 1, None), ("p", "y", 5, 3), ("q", "x", 10, 2), ("q", "z", 0, 0)], "g string, h string, c1 int, c2 int")
    out = shaping.average_and_sort(df, 2)
    assert out.columns == ["g", "h", "Average", "c1", "c2"]
    assert [(r["g"], r["h"], r["Average"]) for r in out.collect()] == [("q", "x", 6.0), ("p", "y", 4.0), ("p", "x", 0.5), ("q", "z", 0.0)]
    kept = shaping.limit_groups(out, ["g", "h"], [F.desc("Average")], 1)
    assert sorted((r["g"], r["h"]) for r in kept.collect()) == [("p", "y"), ("q", "x")]
    assert shaping.limit_groups(out, [], [], 1).count() == 4


def test_append_fills_and_names(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, p string"), spark.createDataFrame([(2, "y")], "n int, q string")
    out = shaping.append([("A", a), ("B", b)])
    assert out.columns == ["event", "n", "p", "q"]
    assert sorted(map(tuple, out.collect())) == [("A", 1, "x", None), ("B", 2, None, "y")]


def test_dictionary_nulls_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "w string")
    d = build_dictionary(df, "w")
    assert sorted(map(tuple, d.collect())) == [("a", 1), ("b", 2)]
    coded = shaping.encode(spark.createDataFrame([("b",), ("zz",), (None,)], "w string"), "w", d)
    assert sorted((r["w"] for r in coded.collect()), key=str) == sorted([2, None, None], key=str)
    assert sorted((r["w"] for r in shaping.decode(coded, "w", d).collect()), key=str) == sorted(["b", None, None], key=str)


@pytest.mark.parametrize(
    "f,want",
    [
        (Filter("v", "eq", (1,)), {1}), (Filter("v", "eq", (1, 2)), {1, 2}), (Filter("v", "neq", (1, 2)), {1, 2, 3}), (Filter("v", "neq", (1, 2), strict_negation=True), {3}),
        (Filter("v", "gte", (2,)), {2, 3}), (Filter("s", "regex", ("^a.c",)), {1}), (Filter("s", "not_regex", ("b",)), {3}), (Filter("s", "like", ("a%",)), {1}), (Filter("s", "not_like", ("a%",)), {2, 3}),
        (Filter("t", "true"), {1}), (Filter("t", "false"), {2}), (Filter("t", "empty"), {3, 4}), (Filter("s", "exists"), {1, 2, 3}),
        (FilterGroup("or", (Filter("v", "eq", (1,)), FilterGroup("and", (Filter("v", "gt", (1,)), Filter("s", "eq", ("xyz",)))))), {1, 3}),
    ],
)
def test_conditions(spark, f, want):
    df = spark.createDataFrame([(1, 1, "abcd", True), (2, 2, "b", False), (3, 3, "xyz", None), (4, None, None, None)], "id int, v int, s string, t boolean")
    assert {r["id"] for r in df.where(condition(f, Catalog())).collect()} == want


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS v", "id AS other").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(condition(Filter("v", "eq", (1, 2)), Catalog())).select("v")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(v, [1,2])]" in plan and "ReadSchema: struct<v:bigint>" in plan


def test_buckets():
    time = TimeRange(datetime(2024, 1, 31, 5), datetime(2024, 3, 1))
    assert bucket_list(time, "month") == [datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)]
    assert bucket_list(time, "week")[:2] == [datetime(2024, 1, 29), datetime(2024, 2, 5)]
    assert len(bucket_list(time, "day")) == 31 and len(bucket_list(TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 1, 3)), "hour")) == 4
    assert TimeRange.last(1, "month", datetime(2024, 3, 31)).start == datetime(2024, 2, 29)


def test_catalog_columns_and_validation():
    c = Catalog()
    assert c.add("Product Name", "string").column == "e_str_0"
    assert c.add("Country", "string", group=0).column == "g_0_str_1" and c.add("Country", "string", group=0).order == 1
    assert c.add("Revenue", "decimal").column == "e_dec_0" and c.add("Created At", "timestamp", system=True).column == "created_at"
    assert c.infer("Paid", True).type == "boolean" and c.infer("Price", 3).type == "decimal" and c.infer("When", datetime(2024, 1, 1)).type == "timestamp"
    with pytest.raises(ValueError):
        c.add("Revenue", "string")
    for bad in (Filter("Country", "gt", ("a",)), Filter("Revenue", "true"), Filter("Revenue", "like", ("a",)), Filter("Revenue", "eq"), Filter("Country", "exists", ("x",)), Filter("Country", "eq", (1,))):
        with pytest.raises(ValueError):
            c.validate(bad)
    c.validate(Filter("Revenue", "gt", (1.5,)))
    assert [c.add_group(g) for g in ("user", "company", "a", "b", "d")] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        c.add_group("sixth")


def test_custom_event_levels():
    c = Catalog()
    c.add_custom(CustomEvent("l1", (EventRef("e"),)))
    c.add_custom(CustomEvent("l2", (EventRef("l1", custom=True),)))
    c.add_custom(CustomEvent("l3", (EventRef("l2", custom=True),)))
    with pytest.raises(ValueError):
        c.add_custom(CustomEvent("l4", (EventRef("l3", custom=True),)))
    with pytest.raises(ValueError):
        c.add_custom(CustomEvent("self", (EventRef("self", custom=True),)))


def test_duplicate_display_names(spark):
    c = Catalog()
    a = c.add("Name", "string").column
    df = spark.createDataFrame([("x", "y")], f"{a} string, Name string")
    assert c.display(df).columns == ["Name", "Name 2"]


def test_analysis_and_compare(spark):
    days = [datetime(2024, 1, 1) + timedelta(days=i) for i in (0, 1, 2, 4)]
    df = spark.createDataFrame([(d, "s", float(v)) for d, v in zip(days, (1, 2, 4, 8))], "bucket timestamp_ntz, s string, value double")
    get = lambda how: [r["value"] for r in shaping.analyse(df, how, "value", ["s"], [datetime(2024, 1, 1) + timedelta(days=i) for i in range(5)]).orderBy("bucket").collect()]
    assert get("cumulative") == [1, 3, 7, 7, 15] and get("rolling_average") == [1, 1.5, 3, 2, 4] and get("logarithmic")[0] == 0
    earlier = df.withColumn("bucket", F.col("bucket") - F.expr("interval 2 days"))
    assert [r["compare_value"] for r in shaping.compare(df, earlier, "value", ["s"], 2, "day", "day").orderBy("bucket").collect()] == [1, 2, 4, 8]


def test_times_do_not_move_with_the_sessions_zone(spark):
    """In a zone whose clocks go forward at 02:00 of 10 March 2024, a time without a zone between 02:00 and 03:00 is a time like any."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = [datetime(2024, 3, 10, 1, 59, 59, 999_999), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 10), datetime(1969, 12, 31, 23, 59, 59, 1)]
    rows = [(1, 5, t, i, "e") for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "project_id long, group_0 long, created_at timestamp_ntz, event_id long, event string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for unit in ("hour", "day", "week", "month", "year"):
            got = [r["b"] for r in events.select("event_id", bucket(F.col("created_at"), unit).alias("b")).orderBy("event_id").collect()]
            assert got == [buckets.floor(t, unit) for t in times]
        at = events.select("event_id", micros(F.col("created_at")).alias("us")).withColumn("back", buckets.from_micros(F.col("us"))).orderBy("event_id").collect()
        assert [r["us"] for r in at] == [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times] and [r["back"] for r in at] == times
        late = events.where("event_id < 3")
        assert [(r["session_begin"], r["n_events"], r["length_ms"]) for r in sessions.sessions(late, timedelta(minutes=35)).orderBy("session_begin").collect()] == [(times[0], 2, 1_800_000), (times[2], 1, 0)]
        assert [r["session"] for r in sessions.session_ids(late, timedelta(minutes=35)).orderBy("event_id").collect()] == [0, 0, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_result_types(spark):
    """For each type of property and each aggregate the type of the result, and that the values fit it."""
    types = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "dec": "decimal(28,16)", "f": "double"}
    events = spark.range(6).select(F.lit(1).cast("long").alias("project_id"), F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz").alias("created_at"), F.lit("e").alias("event"), (F.col("id") % 2).alias("group_0"), *[F.col("id").cast(t).alias(n) for n, t in types.items()])
    decimal = "decimal(28,16)"
    for name, kind in types.items():
        want = {"count": "bigint", "avg": "double", "min": kind, "max": kind, "sum": "bigint" if kind in ("tinyint", "smallint", "int") else "double" if kind == "double" else decimal}
        request = M.Segmentation(M.TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 31)), "day", (M.EventQuery(M.EventRef("e"), tuple(M.AggregateProperty(name, a) for a in want)),))
        (_, df), = segmentation.typed(request, events, Catalog())
        got = dict(df.dtypes)
        assert {a: got[f"{a.capitalize()} {name}"] for a in want} == want
        row = df.first()
        assert [float(row[f"{a.capitalize()} {name}"]) for a in ("count", "avg", "min", "max", "sum")] == [6, 2.5, 0, 5, 15]
    assert metrics.result_type(M.AggregatePropertyPerGroup("i32", "sum", "sum"), types, Catalog()) == decimal and metrics.result_type(M.CountPerGroup("avg"), types, Catalog()) == "double"


def test_columns_of_a_chart(spark):
    request = M.Segmentation(M.TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 2)), "day", (M.EventQuery(M.EventRef("e"), (M.CountEvents(),), ("2fa",)),))
    events = spark.createDataFrame([(1, datetime(2024, 1, 1), "e", 1, "yes")], "project_id long, created_at timestamp_ntz, event string, group_0 long, `2fa` string")
    roles = segmentation.roles(segmentation.chart(request, events, Catalog()), request)
    assert roles == {"Event": "dimension", "Segment": "dimension", "2fa": "dimension", "Formula": "dimension", "Average": "metric", "2024-01-01T00:00:00": "metricValue", "2024-01-02T00:00:00": "metricValue"}


def test_requests_are_validated():
    from tallyloom.model import EventSearch, Funnel, FunnelFilter, GroupSearch, PropertyValues

    c, columns = Catalog(), ["band", "flag"]
    c.add("Plan", "string")
    c.add("Seats", "int32", nullable=False)
    time, steps = M.TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 2)), ((EventRef("a"),), (EventRef("b"),))
    c.validate_funnel(Funnel(time, steps, timedelta(1), breakdowns=("Plan", "band"), filters=(Filter("Seats", "gt", (1,)),)), columns)
    late = M.TimeRange(time.end, time.start)
    for bad in (
        Funnel(late, steps, timedelta(1)), Funnel(time, steps, timedelta(1), group="group_7"), Funnel(time, (steps[0], ()), timedelta(1)), Funnel(time, ((EventRef("x", custom=True),),), timedelta(1)),
        Funnel(time, steps, timedelta(1), breakdowns=("none",)), Funnel(time, steps, timedelta(1), constants=("none",)), Funnel(time, steps, timedelta(1), filters=(Filter("Plan", "gt", ("x",)),)),
        Funnel(time, ((EventRef("a", (Filter("Seats", "empty"),)),),), timedelta(1)), Funnel(time, steps, timedelta(1), filter=FunnelFilter("drop_off_on", 5)), Funnel(time, steps, timedelta(1), touch=4),
        Funnel(time, steps, timedelta(1), exclude=(M.Exclude(EventRef("x", (Filter("none", "exists"),))),)),
    ):
        with pytest.raises(ValueError):
            c.validate_funnel(bad, columns)
    for bad in (EventSearch(late), EventSearch(time, filters=(FilterGroup("or", (Filter("Plan", "true"),)),)), EventSearch(time, properties=("none",)), GroupSearch(sort=("none", "asc")), EventSearch(time, limit=0)):
        with pytest.raises(ValueError):
            c.validate_search(bad, columns)
    for bad in (PropertyValues("none"), PropertyValues("band", EventRef("x", custom=True)), PropertyValues("band", filter=Filter("Seats", "like", ("x",)))):
        with pytest.raises(ValueError):
            c.validate_values(bad, columns)
    query = lambda m, **more: M.Segmentation(time, "day", (M.EventQuery(EventRef("a"), (m,)),), **more)
    c.validate_segmentation(query(M.AggregateProperty("Seats", "sum"), breakdowns=("band",)), columns)
    twice = M.Segment("s", ((M.DidEventCount(EventRef("a"), "gte", 1),),))
    for bad in (query(M.AggregateProperty("none", "sum")), query(M.CountEvents(), breakdowns=("none",)), query(M.CountEvents(), segments=(twice, twice)), query(M.CountEvents(), group="user")):
        with pytest.raises(ValueError):
            c.validate_segmentation(bad, columns)
