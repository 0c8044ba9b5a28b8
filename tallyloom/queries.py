"""The registered queries of the engine, each beside the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog, build_dictionary
from .functions.buckets import bucket
from .functions.numbering import numbered
from .functions.predicates import conditions
from .model import (
    ActiveGroups, AggregateProperty, AggregatePropertyPerGroup, CountEvents, CountPerGroup, CountUniqueGroups, CustomEvent, CustomMetric, DidEventAfterFirstUse, DidEventAggregate, DidEventCount, DidEventEach,
    DidEventRelative, EventQuery, EventRef, EventSearch, Exclude, Filter, FilterGroup, Formula, Funnel, FunnelFilter, GroupSearch, HadPropertyValue, HasPropertyValue, PropertyValues, Segment,
    Segmentation, TimeRange,
)
from .operators import segments, shaping
from .operators.coded import where_coded
from .plans import records, segmentation
from .plans.funnel import funnel
from .sources.events import as_of, clickstream, customer_versions, latest, orders
from .sources.shared import new_path
from .sources.store import Table, compact_json, csv_events
from .streaming import ingest, sessions
from .streaming.executors import Ingest

Query = Callable[[SparkSession, str], DataFrame]
START, END = datetime(2024, 1, 3), datetime(2024, 1, 24, 23, 59, 59)
TIME = TimeRange(START, END)
IN_TIME = f"created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
K = "regexp_extract(props, '\"k\": *([0-9]+)', 1)::INT"
EVENTS = f"""(SELECT *, k % 2 = 0 AS even, CASE k % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS flag, CASE WHEN k < 50 THEN 'low' WHEN k < 90 THEN 'high' END AS band,
  (group_0 % 3)::VARCHAR AS plan FROM (SELECT 1::BIGINT AS project_id, user_id AS group_0, ts AS created_at, event_id, event_type AS event, value::DECIMAL(28, 16) AS value, {K} AS k FROM events))"""
VERSIONS = """(SELECT 1::BIGINT AS project_id, c_custkey AS id, v::BIGINT AS version, TIMESTAMP '2024-01-01' + to_days((c_custkey % 20 + 3 * (v - 1))::INT) AS created_at, c_name AS name, c_mktsegment AS segment_name,
  c_acctbal + v * 100 AS balance FROM customer, unnest(range(1, (c_custkey % 3 + 2)::BIGINT)) AS u(v))"""
CATALOG = Catalog(custom_events={
    "interest": CustomEvent("interest", (EventRef("click", (Filter("band", "eq", ("low",)),)), EventRef("view", (Filter("k", "gte", (20,)),)))),
    "engaged": CustomEvent("engaged", (EventRef("interest", custom=True), EventRef("purchase"))),
})

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Decimals and doubles as rounded doubles, whole numbers as bigint: equal across engines."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, T.DecimalType | T.DoubleType)
        else F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegralType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --- segmentation -------------------------------------------------------------------------------------------------


def seg(name: str, request: Segmentation, sql: str) -> None:
    add(name, lambda s, d: plain(segmentation.compact(request, clickstream(s, d), CATALOG, latest(customer_versions(s, d)))), sql)


def one(metric, event="click", unit="day", time=TIME, breakdowns=(), **more) -> Segmentation:
    return Segmentation(time, unit, (EventQuery(EventRef(event), (metric,)),), breakdowns=breakdowns, **more)


def rows_sql(label: str, value: str, event: str = "click", unit: str = "day", keys: str = "", where: str = "TRUE", source: str = EVENTS) -> str:
    keys = f"{keys}, " if keys else ""
    return f"""SELECT '{event}' AS event, 'all' AS segment, date_trunc('{unit}', created_at)::TIMESTAMP AS bucket, {keys}'{label}' AS agg_name, round(({value})::DOUBLE, 4) AS value
FROM {source} WHERE event = '{event}' AND {IN_TIME} AND ({where}) GROUP BY ALL"""


def per_group_sql(label: str, inner: str, outer: str, event: str = "click", unit: str = "day", keys: str = "") -> str:
    keys = f"{keys}, " if keys else ""
    return f"""SELECT '{event}' AS event, 'all' AS segment, bucket, {keys}'{label}' AS agg_name, round(({outer})::DOUBLE, 4) AS value FROM (
  SELECT date_trunc('{unit}', created_at)::TIMESTAMP AS bucket, {keys}group_0, {inner} AS v FROM {EVENTS} WHERE event = '{event}' AND {IN_TIME} GROUP BY ALL) GROUP BY ALL"""


def agg_sql(agg: str, c: str) -> str:
    return {"avg": f"sum({c})::DOUBLE / count({c})", "median": f"median({c}::DOUBLE)", "distinct_count": f"count(DISTINCT {c})"}.get(agg) or (
        f"quantile_cont({c}::DOUBLE, {int(agg[1:]) / 100})" if agg[0] == "p" else f"{agg}({c})"
    )


seg("seg_count_daily", one(CountEvents()), rows_sql("Count Events", "count(event)"))
seg("seg_unique_weekly", one(CountUniqueGroups(), unit="week"), rows_sql("Count Unique Groups", "count(DISTINCT group_0)", unit="week"))
seg("dau", one(CountUniqueGroups(), event="view"), rows_sql("Count Unique Groups", "count(DISTINCT group_0)", event="view"))
for _unit in ("hour", "month", "year"):
    seg(f"seg_count_by_{_unit}", one(CountEvents(), unit=_unit), rows_sql("Count Events", "count(event)", unit=_unit))
for _name, _days, _label in (("wau_trailing", 7, "Weekly"), ("mau_trailing", 30, "Monthly")):
    seg(_name, one(ActiveGroups(_days)), f"""SELECT 'click' AS event, 'all' AS segment, b::TIMESTAMP AS bucket, '{_label} Active Groups' AS agg_name, count(DISTINCT group_0)::DOUBLE AS value FROM (
  SELECT DISTINCT group_0, created_at::DATE AS d FROM {EVENTS} WHERE event = 'click' AND created_at >= TIMESTAMP '{START}' - INTERVAL {_days - 1} DAY AND created_at <= TIMESTAMP '{END}'),
  unnest(range(d::TIMESTAMP, d::TIMESTAMP + INTERVAL {_days} DAY, INTERVAL 1 DAY)) AS u(b) WHERE b BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY b""")
for _a in ("count", "sum", "min", "max", "avg"):
    seg(f"seg_count_per_user_{_a}", one(CountPerGroup(_a)), per_group_sql(f"{_a.capitalize()} Count Per Group", "count(*)", f"{_a}(v)"))
for _a in ("count", "sum", "min", "max", "avg", "median", "distinct_count", "p25", "p75", "p90", "p99"):
    seg(f"seg_{_a}_value", one(AggregateProperty("value", _a)), rows_sql(f"{_a.capitalize()} value", agg_sql(_a, "value")))
for _i in ("count", "sum", "min", "max", "avg"):
    for _o in ("count", "sum", "min", "max", "avg"):
        _inner = "(sum(value) / count(value))::DOUBLE" if _i == "avg" else f"{_i}(value)"
        seg(f"seg_per_user_{_i}_{_o}", one(AggregatePropertyPerGroup("value", _i, _o), unit="week"), per_group_sql(f"{_o.capitalize()} of {_i.capitalize()} value Per Group", _inner, agg_sql(_o, "v"), unit="week"))
seg("seg_breakdown", one(CountUniqueGroups(), breakdowns=("band", "plan")), rows_sql("Count Unique Groups", "count(DISTINCT group_0)", keys="band, plan"))
seg(
    "seg_formula",
    Segmentation(TIME, "day", (EventQuery(EventRef("click"), (CountEvents(), CountUniqueGroups(), Formula("m0 / m1"))),)),
    " UNION ALL ".join([rows_sql("Count Events", "count(event)"), rows_sql("Count Unique Groups", "count(DISTINCT group_0)"), rows_sql("m0 / m1", "count(event) / count(DISTINCT group_0)")]),
)
for _a, _p in (("median", 0.5), ("p90", 0.9)):  # sketches are held to whole numbers of a small range, where they are exact
    seg(f"seg_approximate_{_a}_k", one(AggregateProperty("k", _a, approximate=True), unit="week"), rows_sql(f"{_a.capitalize()} k", f"quantile_disc(k, {_p})", unit="week"))
_typed_metrics = (CountEvents(), CountUniqueGroups(), AggregateProperty("k", "sum"), AggregateProperty("k", "avg"), AggregatePropertyPerGroup("k", "sum", "avg"))
add("seg_typed", lambda s, d: segmentation.typed(Segmentation(TIME, "week", (EventQuery(EventRef("click"), _typed_metrics),)), clickstream(s, d), CATALOG)[0][1], f"""SELECT 'all' AS segment, date_trunc('week', created_at)::TIMESTAMP AS bucket, sum(n)::BIGINT AS "Count Events",
  count(group_0)::BIGINT AS "Count Unique Groups", sum(ks)::BIGINT AS "Sum k", sum(ks)::DOUBLE / sum(n)::DOUBLE AS "Avg k", avg(ks)::DOUBLE AS "Avg of Sum k Per Group" FROM
  (SELECT min(created_at) AS created_at, date_trunc('week', created_at) AS w, group_0, count(*) AS n, sum(k) AS ks FROM {EVENTS} WHERE event = 'click' AND {IN_TIME} GROUP BY w, group_0) GROUP BY ALL""")
add("seg_pie", lambda s, d: plain(segmentation.shown(replace(one(CountEvents(), breakdowns=("band",)), chart_type="pie"), clickstream(s, d), CATALOG)), f"""SELECT 'click' AS event, 'all' AS segment, band, 'Count Events' AS agg_name, count(*)::DOUBLE AS value,
  round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {EVENTS} WHERE event = 'click' AND {IN_TIME} GROUP BY band""")
_own = CustomMetric("Low share", "count_if(band = 'low') / count(1)")
seg("seg_custom_metric", Segmentation(TIME, "week", (EventQuery(EventRef("click"), (CountEvents(), _own, Formula("m0 * m1")), ("plan",)),)), " UNION ALL ".join([
    rows_sql("Count Events", "count(event)", unit="week", keys="plan"), rows_sql("Low share", "count(*) FILTER (band = 'low') / count(*)", unit="week", keys="plan"), rows_sql("m0 * m1", "count(*) FILTER (band = 'low')", unit="week", keys="plan")]))
MULTI = Segmentation(TIME, "week", (EventQuery(EventRef("click"), (CountEvents(), AggregateProperty("value", "sum")), ("band",)), EventQuery(EventRef("view"), (CountUniqueGroups(),), ("plan",))))
seg("seg_multi_event_merge", MULTI, " UNION ALL BY NAME ".join([
    rows_sql("Count Events", "count(event)", unit="week", keys="band"), rows_sql("Sum value", "sum(value)", unit="week", keys="band"),
    rows_sql("Count Unique Groups", "count(DISTINCT group_0)", event="view", unit="week", keys="plan")]))
seg("seg_custom_event", Segmentation(TIME, "day", (EventQuery(EventRef("engaged", custom=True), (CountEvents(),)),)), f"""SELECT 'engaged' AS event, 'all' AS segment, date_trunc('day', created_at)::TIMESTAMP AS bucket,
  'Count Events' AS agg_name, count(*)::DOUBLE AS value FROM {EVENTS} WHERE {IN_TIME} AND ((event = 'click' AND band = 'low') OR (event = 'view' AND k >= 20) OR event = 'purchase') GROUP BY ALL""")

for _name, _filter, _sql in (
    ("eq", Filter("band", "eq", ("low",)), "band = 'low'"), ("eq_many", Filter("k", "eq", (1, 2, 3)), "k IN (1, 2, 3)"), ("neq", Filter("band", "neq", ("low",)), "band <> 'low'"),
    ("neq_many", Filter("k", "neq", (1, 2)), "k <> 1 OR k <> 2"), ("neq_strict", Filter("k", "neq", (1, 2), strict_negation=True), "k <> 1 AND k <> 2"), ("gt", Filter("k", "gt", (80,)), "k > 80"),
    ("gte", Filter("k", "gte", (80,)), "k >= 80"), ("lt", Filter("k", "lt", (20,)), "k < 20"), ("lte", Filter("k", "lte", (20,)), "k <= 20"), ("regex", Filter("band", "regex", ("^l", "gh$")), "regexp_matches(band, '^l|gh$')"),
    ("not_regex", Filter("band", "not_regex", ("ow$",)), "NOT regexp_matches(band, 'ow$')"), ("like", Filter("band", "like", ("h%", "%zz%")), "band LIKE 'h%' OR band LIKE '%zz%'"),
    ("not_like", Filter("band", "not_like", ("%ow",)), "band NOT LIKE '%ow'"), ("true", Filter("flag", "true"), "flag IS TRUE"), ("false", Filter("flag", "false"), "flag IS FALSE"),
    ("empty", Filter("band", "empty"), "band IS NULL"), ("exists", Filter("band", "exists"), "band IS NOT NULL"),
    ("groups", FilterGroup("or", (FilterGroup("and", (Filter("k", "lt", (30,)), Filter("plan", "eq", ("1",)))), Filter("flag", "true"))), "(k < 30 AND plan = '1') OR flag"),
):
    seg(f"filter_{_name}", Segmentation(TIME, "week", (EventQuery(EventRef("click", (_filter,)), (CountEvents(),)),)), rows_sql("Count Events", "count(event)", unit="week", where=_sql))

_series = f"(SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, count(*) AS n FROM {EVENTS} WHERE event = 'click' AND {IN_TIME} GROUP BY ALL)"
for _name, _sql in (("cumulative", "sum(n) OVER (ORDER BY bucket)"), ("rolling_average", "avg(n) OVER (ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"), ("logarithmic", "ln(n)")):
    seg(f"analysis_{_name}", one(CountEvents(), analysis=_name, window=3), f"SELECT 'click' AS event, 'all' AS segment, bucket, 'Count Events' AS agg_name, round(({_sql})::DOUBLE, 4) AS value FROM {_series}")
seg("compare_previous", one(CountEvents(), compare=(7, "day")), f"""SELECT 'click' AS event, 'all' AS segment, a.bucket, 'Count Events' AS agg_name, a.n::DOUBLE AS value, b.n::DOUBLE AS compare_value
FROM {_series} a LEFT JOIN (SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, count(*) AS n FROM {EVENTS} WHERE event = 'click' AND created_at BETWEEN TIMESTAMP '{START}' - INTERVAL 7 DAY AND TIMESTAMP '{END}' - INTERVAL 7 DAY GROUP BY ALL) b
ON a.bucket = b.bucket + INTERVAL 7 DAY""")
seg("compare_month_of_weeks", one(CountUniqueGroups(), unit="week", compare=(1, "week"), breakdowns=("band",)), f"""WITH s AS (SELECT date_trunc('week', created_at)::TIMESTAMP AS bucket, band, count(DISTINCT group_0) FILTER ({IN_TIME}) AS n,
  count(DISTINCT group_0) FILTER (created_at BETWEEN TIMESTAMP '{START}' - INTERVAL 7 DAY AND TIMESTAMP '{END}' - INTERVAL 7 DAY) AS m FROM {EVENTS} WHERE event = 'click' GROUP BY ALL)
SELECT 'click' AS event, 'all' AS segment, a.bucket, a.band, 'Count Unique Groups' AS agg_name, a.n::DOUBLE AS value, nullif(b.m, 0)::DOUBLE AS compare_value FROM s a LEFT JOIN s b ON a.bucket = b.bucket + INTERVAL 7 DAY AND a.band IS NOT DISTINCT FROM b.band WHERE a.n > 0""")
_rare = Segmentation(TIME, "hour", (EventQuery(EventRef("click", (Filter("k", "lt", (20,)),)), (CountEvents(),), ("band",)),))
_dense = f"""(SELECT b.bucket, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', TIMESTAMP '{START}'), TIMESTAMP '{END}', INTERVAL 1 HOUR)) AS bucket) b
  LEFT JOIN (SELECT date_trunc('hour', created_at)::TIMESTAMP AS bucket, count(*) AS n FROM {EVENTS} WHERE event = 'click' AND k < 20 AND {IN_TIME} GROUP BY ALL) s USING (bucket))"""
for _name, _sql in (("cumulative", "sum(n) OVER (ORDER BY bucket)"), ("rolling_average", "avg(n) OVER (ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")):
    seg(f"analysis_{_name}_gaps", replace(_rare, analysis=_name, window=5), f"SELECT 'click' AS event, 'all' AS segment, bucket, 'low' AS band, 'Count Events' AS agg_name, round(({_sql})::DOUBLE, 4) AS value FROM {_dense}")

# --- charts and shaping -------------------------------------------------------------------------------------------

WEEKS = ["2024-01-01T00:00:00", "2024-01-08T00:00:00", "2024-01-15T00:00:00", "2024-01-22T00:00:00"]
CHART = Segmentation(TIME, "week", (EventQuery(EventRef("click"), (CountEvents(), AggregateProperty("value", "max")), ("k",)),))


def chart_sql(limit: int | None) -> str:
    weeks = ", ".join(f"""max(value) FILTER (strftime(bucket, '%Y-%m-%dT%H:%M:%S') = '{w}') AS "{w}" """ for w in WEEKS)
    total = " + ".join(f"""coalesce("{w}", 0)""" for w in WEEKS)
    long = " UNION ALL ".join([rows_sql("Count Events", "count(event)", unit="week", keys="k"), rows_sql("Max value", "max(value)", unit="week", keys="k")])
    mean = f"""SELECT *, ({total})::DECIMAL(28, 4) / 4 AS "Average" FROM (SELECT event, segment, k, agg_name, {weeks} FROM ({long}) GROUP BY ALL)"""
    kept = f"""SELECT *, row_number() OVER (PARTITION BY k ORDER BY "Average" DESC NULLS LAST, agg_name) AS r FROM ({mean})"""
    columns = ", ".join(f'round("{w}", 4) AS "{w}"' for w in WEEKS)
    return f"""SELECT event AS "Event", segment AS "Segment", k::BIGINT AS k, agg_name AS "Formula", round("Average"::DOUBLE, 4) AS "Average", {columns} FROM ({kept}) WHERE r <= {limit or 10**9}"""


def _chart(limit: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return plain(segmentation.chart(CHART, clickstream(s, d), CATALOG, limit=limit))

    return run


add("seg_pivot_weekly", _chart(50), chart_sql(50))
add("seg_avg_sorted_capped", _chart(1), chart_sql(1))
_wide = f"(SELECT date_trunc('week', created_at)::TIMESTAMP AS bucket, count(*) AS n, sum(k) AS ks FROM {EVENTS} GROUP BY ALL)"


def _weekly(s: SparkSession, d: str) -> DataFrame:
    return clickstream(s, d).groupBy(bucket(F.col("created_at"), "week").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("ks"))


add("shape_unpivot", lambda s, d: plain(shaping.unpivot(_weekly(s, d), ["n", "ks"])), f"SELECT bucket, agg_name, value::DOUBLE AS value FROM (UNPIVOT {_wide} ON n, ks INTO NAME agg_name VALUE value)".replace("UNPIVOT (", "UNPIVOT (SELECT bucket, n::DOUBLE AS n, ks::DOUBLE AS ks FROM (", 1).replace(") ON n", ")) ON n", 1))
add("shape_rename_reorder", lambda s, d: plain(shaping.reorder(shaping.rename(shaping.add_string(_weekly(s, d), "what", "all"), {"n": "rows"}), ["rows", "what"])), f"SELECT n AS rows, 'all' AS what, bucket, ks::BIGINT AS ks FROM {_wide}")
add("shape_rename_rows", lambda s, d: shaping.rename_rows(clickstream(s, d), "event", {"click": "Clicked", "view": "Viewed"}).groupBy("event").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE event WHEN 'click' THEN 'Clicked' WHEN 'view' THEN 'Viewed' ELSE event END AS event, count(*) AS n FROM {EVENTS} GROUP BY ALL")


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    e = clickstream(s, d)
    words = build_dictionary(e, "event")
    coded = shaping.encode(e.select("event", "k"), "event", words).groupBy("event").agg(F.sum("k").alias("ks"))
    return shaping.decode(coded.withColumn("key", F.col("event")), "event", words.cache())


add("dict_roundtrip", _dictionary, f"SELECT event, sum(k)::BIGINT AS ks, dense_rank() OVER (ORDER BY event) AS key FROM {EVENTS} GROUP BY event")



def _coded(*conditions_: Filter | FilterGroup) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        e = clickstream(s, d)
        words = {c: build_dictionary(e, c).persist() for c in ("band", "event")}
        rows = e.select("event_id", "band", "event", "k")
        for c, w in words.items():
            rows = shaping.encode(rows, c, w)
        return where_coded(rows, conditions_, CATALOG, words).select("event_id", F.col("band").alias("band_key"), F.col("event").alias("event_key"))

    return run


_keys = f"(SELECT event_id, k, band, event, CASE band WHEN 'high' THEN 1 WHEN 'low' THEN 2 END::BIGINT AS band_key, dense_rank() OVER (ORDER BY event) AS event_key FROM {EVENTS})"
for _name, _filters, _sql in (
    ("eq", (Filter("band", "eq", ("low", "none of them")), Filter("event", "neq", ("click",))), "band = 'low' AND event <> 'click'"), ("unknown", (Filter("event", "eq", ("none of them",)),), "FALSE"),
    ("neq_unknown", (Filter("band", "neq", ("none of them",)), Filter("k", "lt", (60,))), "band IS NOT NULL AND k < 60"), ("like", (Filter("event", "like", ("%i%",)), Filter("band", "regex", ("^h",))), "event LIKE '%i%' AND band LIKE 'h%'"),
    ("groups", (FilterGroup("or", (Filter("event", "not_like", ("%e%",)), FilterGroup("and", (Filter("band", "empty"), Filter("event", "gt", ("purchase",)))))),), "event NOT LIKE '%e%' OR (band IS NULL AND event > 'purchase')"),
):
    add(f"coded_{_name}", _coded(*_filters), f"SELECT event_id, band_key, event_key FROM {_keys} WHERE {_sql}")

# --- segments -----------------------------------------------------------------------------------------------------


def segment(name: str, condition, sql: str) -> None:
    s1 = Segment("s", ((condition,),) if not isinstance(condition, tuple) else condition)
    add(f"segment_{name}", lambda s, d: segments.members(clickstream(s, d), s1, "group_0", CATALOG, latest(customer_versions(s, d))), sql)


def having(test: str, source: str = EVENTS) -> str:
    return f"SELECT group_0 FROM {source} GROUP BY group_0 HAVING {test}"


CLICK, BUY = EventRef("click"), EventRef("purchase")
segment("did_event", DidEventCount(CLICK, "gte", 10, TIME), having(f"count(*) FILTER (event = 'click' AND {IN_TIME}) >= 10"))
segment("agg", DidEventAggregate(BUY, "value", "avg", "gt", 50, TIME), having(f"sum(value) FILTER (event = 'purchase' AND {IN_TIME})::DOUBLE / count(value) FILTER (event = 'purchase' AND {IN_TIME}) > 50"))
segment("relative", DidEventRelative(CLICK, "gt", BUY), having("count(*) FILTER (event = 'click') > count(*) FILTER (event = 'purchase')"))
_weeks_sql = " AND ".join(f"count(*) FILTER (event = 'click' AND {IN_TIME} AND date_trunc('week', created_at) = TIMESTAMP '{w.replace('T', ' ')}') >= 2" for w in WEEKS)
segment("each_week", DidEventEach(CLICK, "gte", 2, "week", TIME), having(_weeks_sql))
segment("after_first_use", DidEventAfterFirstUse(BUY, "gte", 2, timedelta(days=5)), having("count(*) FILTER (event = 'purchase' AND created_at <= f + INTERVAL 5 DAY) >= 2", f"(SELECT *, min(created_at) OVER (PARTITION BY group_0) AS f FROM {EVENTS})"))
segment("had_property", HadPropertyValue(Filter("k", "eq", (42,)), TIME), having(f"count(*) FILTER (k = 42 AND {IN_TIME}) >= 1"))
_latest = f"(SELECT * FROM {VERSIONS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"
segment("has_property", HasPropertyValue(Filter("balance", "gt", (3000.0,))), f"SELECT DISTINCT group_0 FROM {EVENTS} WHERE group_0 IN (SELECT id FROM {_latest} WHERE balance > 3000)")
segment("and_or", ((DidEventCount(CLICK, "gte", 14), DidEventCount(BUY, "lt", 12)), (HadPropertyValue(Filter("k", "eq", (7,))),)), having("(count(*) FILTER (event = 'click') >= 14 AND count(*) FILTER (event = 'purchase') < 12) OR count(*) FILTER (k = 7) > 0"))
_fans = Segment("fans", ((DidEventCount(BUY, "gte", 12),),))
_few = Segment("few", ((DidEventCount(BUY, "lt", 12),),))
seg("seg_by_segment", one(CountUniqueGroups(), unit="week", segments=(_fans, _few)), " UNION ALL ".join(
    rows_sql("Count Unique Groups", "count(DISTINCT group_0)", unit="week", where=f"group_0 IN ({having(test)})").replace("'all'", f"'{n}'")
    for n, test in (("fans", "count(*) FILTER (event = 'purchase') >= 12"), ("few", "count(*) FILTER (event = 'purchase') < 12"))))

# --- funnels ------------------------------------------------------------------------------------------------------


def attempts_sql(steps: list[str], days: float, exclude: tuple[tuple[str, tuple[int, int] | None], ...] = (), constants: str | None = None, unique: bool = False, any_order: tuple[int, int] | None = None, keys: str = "", source: str = EVENTS) -> str:
    """A recursive walk, one event of each user per round: the same rules as the fold, in SQL. Gives u, keys, st (microseconds)."""
    n, k, wk = len(steps), f"{keys}, " if keys else "", "".join(f"w.{x.strip()}, " for x in keys.split(",") if x.strip())
    flags = ", ".join(f"coalesce({x}, FALSE)" for x in steps)
    stops = ", ".join(f"coalesce({x}, FALSE)" for x, _ in exclude) or "FALSE"
    stop = " OR ".join(f"(x[{i + 1}]{'' if r is None else f' AND len(st) BETWEEN {r[0]} AND {r[1]}'})" for i, (_, r) in enumerate(exclude)) or "FALSE"
    relevant = "TRUE" if constants else " OR ".join(f"({x})" for x in (*steps, *(x for x, _ in exclude)))
    exact = "CASE WHEN f[len(st3) + 1] THEN len(st3) END"
    match = exact
    if any_order:
        free = ", ".join(f"CASE WHEN f[{j + 1}] AND NOT list_contains(used3, {j}) THEN {j} END" for j in range(any_order[0], any_order[1] + 1))
        match = f"CASE WHEN len(st3) BETWEEN {any_order[0]} AND {any_order[1]} THEN coalesce({free}) ELSE {exact} END"
    on = " AND ".join(["w.u = ev.u", "ev.rn = w.rn + 1", *(f"w.{x.strip()} IS NOT DISTINCT FROM ev.{x.strip()}" for x in keys.split(",") if x.strip())])
    return f"""WITH RECURSIVE ev AS (SELECT group_0 AS u, {k}epoch_us(created_at) AS t, [{flags}] AS f, [{stops}] AS x, {constants or "''"} AS c,
    row_number() OVER (PARTITION BY group_0{', ' + keys if keys else ''} ORDER BY created_at, event_id) AS rn FROM {source} WHERE {IN_TIME} AND ({relevant})),
w AS (SELECT DISTINCT u, {k}0::BIGINT AS rn, []::BIGINT[] AS st, []::BIGINT[] AS used, NULL::VARCHAR AS c, []::BIGINT[][] AS out, FALSE AS done FROM ev
  UNION ALL SELECT u, {k}rn, CASE WHEN whole THEN [] ELSE st4 END, CASE WHEN whole THEN [] ELSE used4 END, CASE WHEN whole THEN NULL ELSE c4 END,
    CASE WHEN whole THEN list_append(out2, st4) ELSE out2 END, done OR (whole AND {unique}) FROM (
  SELECT *, NOT done AND m IS NOT NULL AND len(st4) = {n} AS whole FROM (
  SELECT *, CASE WHEN done OR m IS NULL THEN st3 ELSE list_append(st3, t) END AS st4, CASE WHEN done OR m IS NULL THEN used3 ELSE list_append(used3, m) END AS used4,
    CASE WHEN NOT done AND m IS NOT NULL AND len(st3) = 0 THEN nc ELSE c END AS c4 FROM (
  SELECT *, ({match})::BIGINT AS m FROM (
  SELECT *, CASE WHEN {bool(constants)} AND NOT done AND len(st2) > 0 AND c IS DISTINCT FROM nc THEN [] ELSE st2 END AS st3,
    CASE WHEN {bool(constants)} AND NOT done AND len(st2) > 0 AND c IS DISTINCT FROM nc THEN [] ELSE used2 END AS used3 FROM (
  SELECT *, CASE WHEN late THEN [] ELSE st1 END AS st2, CASE WHEN late THEN [] ELSE used1 END AS used2, CASE WHEN late THEN list_append(out, st1) ELSE out END AS out2 FROM (
  SELECT *, NOT done AND len(st1) > 0 AND t - st1[1] > {int(days * 86_400_000_000)} AS late FROM (
  SELECT *, CASE WHEN NOT done AND len(st) > 0 AND ({stop}) THEN [] ELSE st END AS st1, CASE WHEN NOT done AND len(st) > 0 AND ({stop}) THEN [] ELSE used END AS used1 FROM (
  SELECT w.u, {wk}ev.rn, w.st, w.used, w.c, w.out, w.done, ev.t, ev.f, ev.x, ev.c AS nc FROM w JOIN ev ON {on}))))))))),
ended AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY u{', ' + keys if keys else ''} ORDER BY rn DESC) = 1),
found AS (SELECT u, {k}unnest(CASE WHEN len(st) > 0 THEN list_append(out, st) ELSE out END) AS st FROM ended)"""


def report_sql(attempts: str, n: int, bucket_sql: str = f"TIMESTAMP '{START}'", keys: str = "", where: str = "TRUE") -> str:
    k = f"{keys}, " if keys else ""
    sums = ", ".join(f"count(*) FILTER (len(st) > {i}) AS n{i}, coalesce(sum(st[{i + 1}] - st[{max(i, 1)}]) FILTER (len(st) > {i}), 0)::BIGINT AS p{i}, coalesce(sum(st[{i + 1}] - st[1]) FILTER (len(st) > {i}), 0)::BIGINT AS s{i}" for i in range(n))
    parts = " UNION ALL ".join(f"""SELECT bucket, {k}{i}::BIGINT AS step, n{i} AS total, round(n{i} / n0 * 100, 4) AS conversion_ratio, n{max(i - 1, 0)} - n{i} AS dropped_off, round(100 - n{i} / n0 * 100, 4) AS drop_off_ratio,
  p{i} // 1000 AS time_to_convert, s{i} // 1000 AS time_to_convert_from_start, CASE WHEN n{i} > 0 THEN round(p{i} / 1000 / n{i}, 4) END AS avg_time_to_convert,
  CASE WHEN n{i} > 0 THEN round(s{i} / 1000 / n{i}, 4) END AS avg_time_to_convert_from_start FROM totals""" for i in range(n))
    return f"{attempts}, totals AS (SELECT {bucket_sql} AS bucket, {k}{sums} FROM found WHERE {where} GROUP BY ALL) {parts}"


def funnel_query(name: str, f: Funnel, sql: str) -> None:
    add(f"funnel_{name}", lambda s, d: plain(funnel(f, clickstream(s, d), CATALOG)), sql)


STEPS = ((EventRef("signup"),), (EventRef("click"),), (EventRef("purchase"),))
S = ["event = 'signup'", "event = 'click'", "event = 'purchase'"]
W3 = timedelta(days=3)
funnel_query("steps", Funnel(TIME, STEPS, W3), report_sql(attempts_sql(S, 3), 3))
for _name, _more in (("steps", {}), ("breakdown", {"breakdowns": ("band",), "window": timedelta(days=9)})):
    _days, _by = _more.get("window", W3).days, "band" if _more else ""
    funnel_query(f"{_name}_by_rows", replace(Funnel(TIME, STEPS, W3), fold="rows", **_more), report_sql(attempts_sql(S, _days, keys=_by), 3, keys=_by))
funnel_query("unique", Funnel(TIME, STEPS, W3, count="unique"), report_sql(attempts_sql(S, 3, unique=True), 3))
funnel_query("or_steps", Funnel(TIME, (STEPS[0], (EventRef("click", (Filter("k", "lt", (40,)),)), EventRef("view")), STEPS[2]), W3), report_sql(attempts_sql([S[0], "(event = 'click' AND k < 40) OR event = 'view'", S[2]], 3), 3))
funnel_query("five_steps", Funnel(TIME, (*STEPS, (EventRef("click"),), (EventRef("view"),)), timedelta(days=6)), report_sql(attempts_sql([*S, S[1], "event = 'view'"], 6), 5))
funnel_query("over_time", Funnel(TIME, STEPS, W3, chart="over_time", unit="week"), report_sql(attempts_sql(S, 3), 3, "date_trunc('week', make_timestamp(st[1]))::TIMESTAMP"))
funnel_query("breakdown", Funnel(TIME, STEPS, timedelta(days=9), breakdowns=("band",)), report_sql(attempts_sql(S, 9, keys="band"), 3, keys="band"))
funnel_query("exclude", Funnel(TIME, STEPS, W3, exclude=(Exclude(EventRef("error")),)), report_sql(attempts_sql(S, 3, (("event = 'error'", None),)), 3))
funnel_query("exclude_steps", Funnel(TIME, STEPS, W3, exclude=(Exclude(EventRef("error"), (2, 2)),)), report_sql(attempts_sql(S, 3, (("event = 'error'", (2, 2)),)), 3))
funnel_query("constants", Funnel(TIME, STEPS, timedelta(days=9), constants=("even",)), report_sql(attempts_sql(S, 9, constants="even::VARCHAR"), 3))
funnel_query("any_order", Funnel(TIME, (*STEPS, (EventRef("view"),)), W3, any_order=((1, 2),)), report_sql(attempts_sql([*S, "event = 'view'"], 3, any_order=(1, 2)), 4))
funnel_query("dropoff_any", Funnel(TIME, STEPS, W3, filter=FunnelFilter("drop_off_any")), report_sql(attempts_sql(S, 3), 3, where="len(st) < 3"))
funnel_query("dropoff_on", Funnel(TIME, STEPS, W3, filter=FunnelFilter("drop_off_on", 2)), report_sql(attempts_sql(S, 3), 3, where="len(st) = 2"))
_ttc = FunnelFilter("time_to_convert", least=timedelta(hours=12), most=timedelta(hours=48))
funnel_query("converted_within", Funnel(TIME, STEPS, W3, filter=_ttc), report_sql(attempts_sql(S, 3), 3, where="len(st) = 3 AND st[3] - st[1] BETWEEN 43200000000 AND 172800000000"))
funnel_query("ttc", Funnel(TIME, STEPS, W3, chart="time_to_convert"), f"{attempts_sql(S, 3)} SELECT ((st[3] - st[1]) // 3600000000)::BIGINT AS bin, count(*) AS total FROM found WHERE len(st) = 3 GROUP BY ALL")
funnel_query("frequency", Funnel(TIME, STEPS, W3, chart="frequency"), f"{attempts_sql(S, 3)} SELECT times, count(*) AS users FROM (SELECT u, count(*) AS times FROM found WHERE len(st) = 3 GROUP BY u) GROUP BY ALL")
_timed = Funnel(TIME, STEPS, timedelta(days=9), chart="time_to_convert", breakdowns=("band",), least=timedelta(hours=6), most=timedelta(days=4))
funnel_query("ttc_by_band", _timed, f"""{attempts_sql(S, 9, keys="band")} SELECT band, ((st[3] - st[1]) // 3600000000)::BIGINT AS bin, count(*) AS total FROM found WHERE len(st) = 3 AND st[3] - st[1] BETWEEN 21600000000 AND 345600000000 GROUP BY ALL""")
funnel_query("frequency_by_band", replace(_timed, chart="frequency"), f"{attempts_sql(S, 9, keys='band')} SELECT band, times, count(*) AS users FROM (SELECT u, band, count(*) AS times FROM found WHERE len(st) = 3 GROUP BY u, band) GROUP BY ALL")
_sessioned = f"""(SELECT *, sum(new) OVER (PARTITION BY group_0 ORDER BY created_at, event_id) AS sess FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY group_0 ORDER BY created_at, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new
  FROM {EVENTS} WHERE {IN_TIME}))"""
funnel_query("session", Funnel(TIME, STEPS, W3, count="session", session_gap=timedelta(days=1)), report_sql(attempts_sql(S, 3, keys="sess", source=_sessioned), 3))
_touched = f"{attempts_sql(S, 3)}, named AS (SELECT found.st, e.band FROM found JOIN {EVENTS} e ON e.group_0 = found.u AND epoch_us(e.created_at) = found.st[1])"
funnel_query("touch_first", Funnel(TIME, STEPS, W3, touch="first", breakdowns=("band",)), report_sql(_touched, 3, keys="band").replace("FROM found WHERE", "FROM named WHERE"))

# --- records ------------------------------------------------------------------------------------------------------

add("event_search_top100", lambda s, d: plain(records.search_events(EventSearch(TIME, (EventRef("click", (Filter("k", "lt", (50,)),)), EventRef("view")), (Filter("plan", "neq", ("2",)),), ("k", "band")), clickstream(s, d), CATALOG)),
    f"SELECT event_id, event, created_at, k::BIGINT AS k, band FROM {EVENTS} WHERE {IN_TIME} AND ((event = 'click' AND k < 50) OR event = 'view') AND plan <> '2' ORDER BY event_id DESC LIMIT 100")
add("event_by_id", lambda s, d: records.event_by_id(77, clickstream(s, d).select("project_id", "event_id", "event", "k", "band", "plan")),
    f"SELECT * FROM (SELECT unnest(['project_id', 'event_id', 'event', 'k', 'band', 'plan']) AS property, unnest([project_id::VARCHAR, event_id::VARCHAR, event, k::VARCHAR, band, plan]) AS value FROM {EVENTS} WHERE event_id = 77)")
add("group_search", lambda s, d: plain(records.search_groups(GroupSearch(time=TimeRange(datetime(2024, 1, 3), None), filters=(Filter("segment_name", "eq", ("BUILDING", "MACHINERY")),), properties=("name", "balance"), sort=("balance", "desc")), customer_versions(s, d), CATALOG), 2),
    f"SELECT id, name, round(balance, 2) AS balance FROM {_latest} WHERE created_at >= TIMESTAMP '2024-01-03' AND segment_name IN ('BUILDING', 'MACHINERY') ORDER BY balance DESC NULLS LAST, id LIMIT 100")
add("group_by_id", lambda s, d: records.group_by_id(5, customer_versions(s, d).select("project_id", "id", "version", "name", "segment_name")),
    f"SELECT unnest(['project_id', 'id', 'version', 'name', 'segment_name']) AS property, unnest([project_id::VARCHAR, id::VARCHAR, version::VARCHAR, name, segment_name]) AS value FROM {_latest} WHERE id = 5")
add("group_latest_version", lambda s, d: plain(latest(customer_versions(s, d)), 2), f"SELECT project_id, id, version, created_at, name, segment_name, round(balance, 2) AS balance FROM {_latest}")
add("property_values", lambda s, d: plain(records.property_values(PropertyValues("k", CLICK, Filter("k", "gte", (10,))), clickstream(s, d), CATALOG)), f"SELECT DISTINCT k::BIGINT AS value FROM {EVENTS} WHERE event = 'click' AND k >= 10 ORDER BY 1 LIMIT 1000")
add("property_values_nulls", lambda s, d: records.property_values(PropertyValues("band"), clickstream(s, d), CATALOG), f"SELECT DISTINCT band AS value FROM {EVENTS}")

# --- commerce events, ingestion -----------------------------------------------------------------------------------

_commerce = Segmentation(TimeRange(datetime(1995, 1, 1), datetime(1999, 1, 1)), "year", (EventQuery(EventRef("Order F"), (AggregateProperty("price", "sum"), CountUniqueGroups()), ("nation",)),))
add("orders_by_nation", lambda s, d: plain(segmentation.compact(_commerce, orders(s, d), CATALOG), 2), """WITH o AS (SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS bucket, n_name AS nation, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN '1995-01-01' AND '1999-01-01')
SELECT 'Order F' AS event, 'all' AS segment, bucket, nation, 'Sum price' AS agg_name, round(sum(o_totalprice::DECIMAL(28, 16))::DOUBLE, 2) AS value FROM o GROUP BY ALL
UNION ALL SELECT 'Order F', 'all', bucket, nation, 'Count Unique Groups', count(DISTINCT o_custkey)::DOUBLE FROM o GROUP BY ALL""")
add("profile_as_of", lambda s, d: plain(as_of(clickstream(s, d).select("group_0", "created_at", "event_id"), customer_versions(s, d)).groupBy("profile_segment_name").agg(F.count(F.lit(1)).alias("n"), F.sum("profile_version").alias("versions")), 2),
    f"""SELECT v.segment_name AS profile_segment_name, count(*) AS n, sum(v.version)::BIGINT AS versions FROM {EVENTS} e ASOF LEFT JOIN {VERSIONS} v ON v.id = e.group_0 AND v.created_at <= e.created_at GROUP BY ALL""")
GAP = timedelta(hours=12)
_gaps = f"""(SELECT *, sum(new) OVER (PARTITION BY group_0 ORDER BY created_at, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY group_0 ORDER BY created_at, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM {EVENTS}))"""
_sessions = f"(SELECT group_0, min(created_at) AS session_begin, max(created_at) AS session_end, count(*) AS n_events FROM {_gaps} GROUP BY group_0, session)"
add("sessions", lambda s, d: sessions.sessions(clickstream(s, d), GAP), f"SELECT *, (epoch_us(session_end) - epoch_us(session_begin)) // 1000 AS length_ms FROM {_sessions}")
add("session_events", lambda s, d: sessions.with_session_events(clickstream(s, d), GAP, datetime(2024, 1, 30)), f"""SELECT group_0, session_begin AS created_at, 'Session Begin' AS event, NULL::BIGINT AS length_ms FROM {_sessions}
UNION ALL SELECT group_0, session_end, 'Session End', (epoch_us(session_end) - epoch_us(session_begin)) // 1000 FROM {_sessions} WHERE session_end + INTERVAL 12 HOUR < TIMESTAMP '2024-01-30'""")
add("session_ids", lambda s, d: sessions.session_ids(clickstream(s, d), GAP).select("event_id", "session"), f"SELECT event_id, session FROM {_gaps}")


def _requests(s: SparkSession, d: str) -> DataFrame:
    e = clickstream(s, d)
    user = F.when(F.col("k") % 4 != 0, F.concat(F.lit("u"), (F.col("group_0") % 40).cast("string")))
    return e.select("event_id", F.to_json(F.struct(
        user.alias("userId"), F.concat(F.lit("a"), F.col("group_0").cast("string")).alias("anonymousId"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "event",
        F.struct(
            F.concat(F.lit("10.0."), (F.col("k") % 4).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string")).alias("ip"), F.struct(F.col("plan").alias("source"), F.col("band").alias("medium")).alias("campaign"),
            F.when(F.col("k") % 2 == 0, F.lit("Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.5 Mobile/15E148 Safari/604.1"))
            .otherwise(F.lit("Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:120.0) Gecko/20100101 Firefox/120.0")).alias("userAgent"),
        ).alias("context"), F.create_map(F.lit("Price"), F.col("value").cast("string"), F.lit("Band"), F.col("band")).alias("properties"),
    )).alias("body"))


_asked = f"(SELECT *, CASE WHEN k % 4 <> 0 THEN 'u' || (group_0 % 40) END AS uid, 'a' || group_0 AS aid FROM {EVENTS})"


def _identity(s: SparkSession, d: str) -> DataFrame:
    track = ingest.parse(_requests(s, d), fields=("userId", "anonymousId", "timestamp"))
    return ingest.resolve(track, ingest.identities(track)).groupBy("user").agg(F.count(F.lit(1)).alias("n"))


add("identity_merge", _identity, f"""WITH f AS (SELECT uid, arg_min(aid, (created_at, aid)) AS aid, min(created_at) AS t FROM {_asked} WHERE uid IS NOT NULL GROUP BY uid),
m AS (SELECT aid, arg_min(uid, (t, uid)) AS u FROM f GROUP BY aid) SELECT coalesce(r.uid, m.u, 'anonymous:' || r.aid) AS "user", count(*) AS n FROM {_asked} r LEFT JOIN m USING (aid) GROUP BY ALL""")


def _enriched(s: SparkSession, d: str) -> DataFrame:
    track = ingest.user_agent(ingest.campaign(ingest.parse(_requests(s, d))))
    ranges = s.createDataFrame([(10 * 2**24 + i * 256, 10 * 2**24 + i * 256 + (199 if i == 1 else 255), f"C{i}", f"City {i}") for i in range(3)], "first long, last long, country string, city string")
    out = ingest.locate(track.withColumn("address", F.col("context.ip")), ranges, "address")
    return out.groupBy("country", "utm_source", "utm_medium", "client", "client_version", "os", "os_version", "device").agg(F.count(F.lit(1)).alias("n"))


add("ingest_enrich", _enriched, f"""SELECT CASE WHEN k % 4 = 3 OR (k % 4 = 1 AND event_id % 250 > 199) THEN NULL ELSE 'C' || (k % 4) END AS country, plan AS utm_source, band AS utm_medium,
  CASE WHEN k % 2 = 0 THEN 'Safari' ELSE 'Firefox' END AS client, CASE WHEN k % 2 = 0 THEN '16' ELSE '120' END AS client_version, CASE WHEN k % 2 = 0 THEN 'iOS' ELSE 'Windows' END AS os,
  CASE WHEN k % 2 = 0 THEN '16' ELSE '10' END AS os_version, CASE WHEN k % 2 = 0 THEN 'iPhone' ELSE 'Desktop' END AS device, count(*) AS n FROM {EVENTS} GROUP BY ALL""")


def _typed(s: SparkSession, d: str) -> DataFrame:
    c = Catalog()
    price, band = c.add("Price", "decimal"), c.add("Band", "string")
    rows = ingest.typed_properties(ingest.parse(_requests(s, d)), c)
    return plain(c.display(rows.groupBy(band.column).agg(F.sum(price.column).alias("total"))))


add("ingest_typed", _typed, f"""SELECT band AS "Band", round(sum(value)::DOUBLE, 4) AS total FROM {EVENTS} GROUP BY band""")
add("ingest_numbered", lambda s, d: numbered(clickstream(s, d).select("created_at", F.col("event_id").alias("old")), ["created_at", "old"], 1000, "event_id").select("old", "event_id"), f"SELECT event_id AS old, 999 + row_number() OVER (ORDER BY created_at, event_id) AS event_id FROM {EVENTS}")


def _merged(v: DataFrame) -> DataFrame:
    asked = v.select(F.lit("user").alias("group"), F.col("id").cast("string").alias("id"), (F.col("created_at") + F.make_dt_interval(hours=F.col("version").cast("int"))).alias("timestamp"), F.create_map(F.concat(F.lit("p"), F.col("version").cast("string")), F.col("segment_name"), F.lit("last"), F.col("version").cast("string")).alias("properties"))
    out = ingest.merge_profiles(asked)
    return out.select("id", "version", F.size("properties").cast("bigint").alias("n"), F.element_at("properties", "last").alias("last"))


add("identify_merge", lambda s, d: _merged(customer_versions(s, d)), f"SELECT id::VARCHAR AS id, version, version + 1 AS n, version::VARCHAR AS last FROM {VERSIONS}")
add("grouped_conditions", lambda s, d: clickstream(s, d).where(conditions((FilterGroup("and", (Filter("k", "gt", (10,)), FilterGroup("or", (Filter("band", "eq", ("low",)), Filter("plan", "eq", ("0",)))))),), CATALOG)).groupBy("event").agg(F.count(F.lit(1)).alias("n")), f"SELECT event, count(*) AS n FROM {EVENTS} WHERE k > 10 AND (band = 'low' OR plan = '0') GROUP BY ALL")


def _ingested(s: SparkSession, d: str) -> Ingest:
    """All requests of the events, in two batches by time, the second of them twice; they came in in the order of event_id."""
    to = Ingest(s, new_path(s, "ingest"), s.createDataFrame([("t", 1)], "token string, project_id long"), GAP)
    asked = _requests(s, d).select(F.lit("t").alias("token"), "body", F.col("event_id").alias("position"), F.get_json_object("body", "$.timestamp").alias("at")).persist()
    for number, part in ((0, F.col("at") < "2024-01-15"), (1, F.col("at") >= "2024-01-15"), (1, F.col("at") >= "2024-01-15")):
        to.track(asked.where(part).drop("at"), number)
    asked.unpersist()
    return to


def _tracked(s: SparkSession, d: str) -> DataFrame:
    to = _ingested(s, d)
    price = to.catalog().properties["Price"].column
    rows = to.events.scan().groupBy("event", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_0").alias("users"), F.sum(price).alias("price"), F.count("utm_medium").alias("campaigns"), F.sum("event_id").alias("ids"))
    return plain(rows.withColumn("day", F.col("day").cast("timestamp_ntz")))


_who = f"""(WITH f AS (SELECT uid, arg_min(aid, (created_at, aid)) AS first_aid FROM {_asked} WHERE uid IS NOT NULL GROUP BY uid)
  SELECT r.*, CASE WHEN r.uid IS NULL THEN r.aid ELSE f.first_aid END AS who FROM {_asked} r LEFT JOIN f USING (uid))"""
_begun = f"""(SELECT *, created_at - lag(created_at) OVER (PARTITION BY who ORDER BY created_at, event_id) <= INTERVAL 12 HOUR AS goes_on FROM {_who})"""
_lines = f"""(SELECT *, row_number() OVER (ORDER BY created_at, source_id, place) AS id FROM (SELECT event, created_at, event_id AS source_id, 1 AS place, who, value, NULL AS medium FROM {_begun}
  UNION ALL SELECT 'Session Begin', created_at, event_id, 0, who, value, band FROM {_begun} WHERE goes_on IS NOT TRUE))"""
add("ingest_track", _tracked, f"""SELECT event, created_at::DATE::TIMESTAMP AS day, count(*) AS n, count(DISTINCT who) AS users, round(sum(value)::DOUBLE, 4) AS price, count(medium) AS campaigns, sum(id)::BIGINT AS ids FROM {_lines} GROUP BY ALL""")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The requests as files, taken as a stream of several batches that is stopped and goes on."""
    folder, to = new_path(s, "requests"), Ingest(s, new_path(s, "ingest"), s.createDataFrame([("t", 1)], "token string, project_id long"), GAP)
    asked = _requests(s, d).select(F.lit("t").alias("token"), "body")
    for part in (0, 1):
        asked.where(F.pmod(F.xxhash64("body"), F.lit(2)) == part).coalesce(3).write.mode("append").json(folder)
        requests = s.readStream.schema("token string, body string").option("maxFilesPerTrigger", 2).json(folder)
        to.stream(requests, f"{to.events.path}-checkpoint", once=True).awaitTermination()
    rows = to.events.scan().where(F.col("event") != sessions.BEGIN)
    price = to.catalog().properties["Price"].column
    return plain(rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("price"), F.countDistinct("event_id").alias("ids")))


add("ingest_stream", _streamed, f"SELECT event, count(*) AS n, round(sum(value)::DOUBLE, 4) AS price, count(*) AS ids FROM {EVENTS} GROUP BY event")


def _csv(s: SparkSession, d: str) -> DataFrame:
    path, e = new_path(s, "csv"), clickstream(s, d).select("event_id", "event", "created_at", "value", "band")
    e.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return plain(csv_events(s, path, e.schema))


add("csv_round_trip", _csv, f"SELECT event_id, event, created_at, round(value::DOUBLE, 4) AS value, band FROM {EVENTS}")


def _shown(s: SparkSession, d: str) -> DataFrame:
    """A result as compact JSON by column, read again."""
    rows = clickstream(s, d).groupBy("event").agg(F.avg("value").alias("mean"), F.max(F.when(F.col("event") == "click", F.col("k"))).alias("top")).orderBy("event")
    columns = json.loads(compact_json(rows))
    return s.createDataFrame(list(zip(*columns, strict=True)), "event string, mean double, top double")


add("compact_json", _shown, f"SELECT event, round((sum(value) / count(value))::DOUBLE, 3) AS mean, coalesce(max(k) FILTER (event = 'click'), 0)::DOUBLE AS top FROM {EVENTS} GROUP BY event")


def _identified(s: SparkSession, d: str) -> DataFrame:
    to = Ingest(s, new_path(s, "ingest"), s.createDataFrame([("t", 1)], "token string, project_id long"))
    v = customer_versions(s, d)
    said = F.struct(
        F.lit("user").alias("group"), F.col("name").alias("id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.struct(F.col("segment_name").alias("Segment"), F.when(F.col("version") == 1, F.lit(True)).alias("First"), F.col("balance").alias("Balance")).alias("properties"),
    )
    asked = v.select("version", F.lit("t").alias("token"), F.to_json(said).alias("body")).persist()
    for number in (0, 1, 1):
        to.identify(asked.where(F.col("version") <= 2 if number == 0 else F.col("version") > 2).drop("version"), number)
    asked.unpersist()
    kinds = {p.name: p.column for p in to.catalog().properties.values()}
    rows = to.profile_columns().select(F.col("key").alias("name"), "version", "created_at", F.col(kinds["Segment"]).alias("segment_name"), F.col(kinds["First"]).alias("first"), F.col(kinds["Balance"]).alias("balance"))
    return plain(rows, 2)


add("ingest_identify", _identified, f"SELECT name, version, created_at, segment_name, TRUE AS first, round(balance::DOUBLE, 2) AS balance FROM {VERSIONS}")


def _stored(s: SparkSession, d: str, replacing: bool) -> tuple[Table, DataFrame]:
    rows = customer_versions(s, d) if replacing else clickstream(s, d)
    table = Table(s, new_path(s, "store"), ("project_id", "id") if replacing else ("project_id", "group_0"), replacing)
    table.add_fields(rows.schema.fields)
    return table, rows


def _compacted(s: SparkSession, d: str) -> DataFrame:
    table, rows = _stored(s, d, False)
    for i in range(3):
        table.insert(rows.where(F.col("event_id") % 3 == i), ("all", i))
    table.compact()
    table.insert(rows.where("event_id % 3 = 2"), ("all", 2))
    return plain(table.scan(["event_id", "group_0", "event", "band", "value"]))


def _versions_stored(s: SparkSession, d: str) -> Table:
    table, rows = _stored(s, d, True)
    for v in (2, 1, 3):
        table.insert(rows.where(F.col("version") == v))
    table.compact()
    changed = table.get(project_id=1, id=5).withColumns({"version": F.col("version") + 1, "name": F.lit("changed")})
    if table.replace(changed, 99) or not table.replace(changed, table.get(project_id=1, id=5).first()["version"]):
        raise AssertionError("the version that is expected decides")
    return table


add("store_compact", _compacted, f"SELECT event_id, group_0, event, band, round(value::DOUBLE, 4) AS value FROM {EVENTS}")
add("store_replace", lambda s, d: plain(_versions_stored(s, d).scan(), 2), f"SELECT project_id, id, CASE id WHEN 5 THEN version + 1 ELSE version END AS version, created_at, CASE id WHEN 5 THEN 'changed' ELSE name END AS name, segment_name, round(balance, 2) AS balance FROM {_latest}")
add("store_as_of", lambda s, d: plain(as_of(clickstream(s, d).select("group_0", "created_at", "event_id"), _stored_versions(s, d)).select("event_id", "profile_version", "profile_balance"), 2),
    f"SELECT e.event_id, v.version AS profile_version, round(v.balance, 2) AS profile_balance FROM {EVENTS} e ASOF LEFT JOIN {VERSIONS} v ON v.id = e.group_0 AND v.created_at <= e.created_at")


def _stored_versions(s: SparkSession, d: str) -> DataFrame:
    table, rows = _stored(s, d, True)
    table.insert(rows)
    return table.raw()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily clicks and users by band and plan."""
    request = Segmentation(TIME, "day", (EventQuery(CLICK, (CountEvents(), CountUniqueGroups(), AggregateProperty("value", "sum")), ("band", "plan")),))
    return plain(segmentation.compact(request, clickstream(spark, sf_dir), CATALOG))
