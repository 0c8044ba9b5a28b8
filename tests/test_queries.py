"""Queries against their SQL at the smallest size, and the entry points."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind here; the whole list is compared by the driver.
NAMES = [n for n in Q.ORACLES if not n.startswith("seg_per_user_") or n.endswith("_avg")]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    def one(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.6g}" if not isinstance(v, bool | str) and hasattr(v, "__float__") else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    cursor = db.execute(Q.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == norm(cursor.fetchall())


def test_ingested_events_of_one_time_go_by_event_id(spark, tmp_path):
    """Copies of the events with shifted ids and users: each time stands three times."""
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 100")
    copies = e.crossJoin(spark.range(3)).withColumns({"event_id": F.col("event_id") + 100 * F.col("id"), "user_id": F.col("user_id") + 15 * F.col("id")}).drop("id")
    copies.write.parquet(str(tmp_path / "events.parquet"))
    got = Q.QUERIES["ingest_track"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cursor = c.execute(Q.ORACLES["ingest_track"])
    names = [d[0] for d in cursor.description]
    assert norm(tuple(r) for r in got.select(*names).collect()) == norm(cursor.fetchall())


def test_chart_caps_each_event_by_its_own_breakdowns(spark):
    rows = [("click", f"b{i}", None) for i in range(60)] + [("view", "b0", f"p{i}") for i in range(70)]
    events = spark.createDataFrame([(1, i, Q.START, e, b, p) for i, (e, b, p) in enumerate(rows)], "project_id long, group_0 long, created_at timestamp_ntz, event string, band string, plan string")
    count = lambda e, *keys: Q.EventQuery(Q.EventRef(e), (Q.CountEvents(),), keys)

    def sizes(*queries, limit=50):
        out = Q.segmentation.chart(Q.Segmentation(Q.TIME, "week", queries), events, Q.CATALOG, limit=limit).collect()
        return {e: sum(r["Event"] == e for r in out) for e in ("click", "view")}

    assert sizes(count("click", "band"), count("view", "plan")) == {"click": 60, "view": 70}
    assert sizes(count("click", "band"), count("view", "band"), limit=1) == {"click": 60, "view": 1}
    assert sizes(count("click", "band"), count("view", "band", "plan")) == {"click": 60, "view": 50}


def test_profiles_of_all_customers_are_merged(spark):
    ids = {str(r["c_custkey"]) for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert {r["id"] for r in Q.QUERIES["identify_merge"](spark, SF).collect()} == ids and any(int(i) % 10 for i in ids)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
