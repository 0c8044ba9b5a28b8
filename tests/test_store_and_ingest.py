import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import model as M
from tallyloom.catalog import DECIMAL, Catalog
from tallyloom.plans import segmentation
from tallyloom.sources.events import as_of, latest
from tallyloom.sources.store import Table, columns_json, compact_json, csv_events
from tallyloom.streaming import ingest, sessions
from tallyloom.streaming.executors import Ingest, debug

T0 = datetime(2024, 1, 1)
EVENTS = "project_id long, group_0 long, created_at timestamp_ntz, event_id long, event string"


def events(spark, rows):
    return spark.createDataFrame([(1, u, T0 + timedelta(minutes=m), i, e) for i, (u, m, e) in enumerate(rows)], EVENTS)


def test_table_grows_compacts_and_prunes(spark, tmp_path):
    table = Table(spark, str(tmp_path / "events"))
    rows = events(spark, [(1, 0, "a"), (2, 2000, "b")])
    with pytest.raises(ValueError, match="unknown column"):
        table.insert(rows)
    for f in rows.schema.fields:
        table.add_field(f.name, f.dataType)
    table.insert(rows)
    table.add_field("extra", T.StringType())
    table.add_field("extra", T.StringType())
    with pytest.raises(ValueError):
        table.add_field("extra", T.LongType())
    with pytest.raises(ValueError):
        table.insert(rows.withColumn("event", F.lit(1)))
    table.insert(events(spark, [(3, 1, "c")]).withColumn("extra", F.lit("x")))
    assert sorted((r["event"], r["extra"]) for r in table.scan().collect()) == [("a", None), ("b", None), ("c", "x")]
    table.compact()
    assert table.scan(["event"]).count() == 3 and len(table.state().folders) == 1
    table.insert(rows)
    table.compact()
    assert table.scan().count() == 5 and len(table.state().folders) == 1
    plan = table.get(project_id=1, group_0=2)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(group_0,2)" in plan
    assert [r["event"] for r in table.get(project_id=1, group_0=2).collect()] == ["b", "b"]
    table.backup(str(tmp_path / "copy"))
    assert Table(spark, str(tmp_path / "copy")).scan().count() == 5
    with pytest.raises(ValueError, match="holds a table"):
        table.backup(str(tmp_path / "copy"))
    table.insert(rows)
    assert table.scan().count() == 7
    table.restore(str(tmp_path / "copy"))
    assert table.scan().count() == 5 and table.schema() == Table(spark, str(tmp_path / "copy")).schema()
    assert len(table.vacuum(3600)) == 0 and len(table.vacuum(-60)) > 0 and table.scan().count() == 5


def grown(spark, path, rows):
    table = Table(spark, path)
    table.add_fields(rows.schema.fields)
    return table


def test_batches_are_taken_once(spark, tmp_path):
    rows = events(spark, [(1, 0, "a"), (2, 2000, "b")])
    table = grown(spark, str(tmp_path / "t"), rows)
    assert table.insert(rows, ("s", 0)) and not table.insert(rows, ("s", 0)) and table.insert(rows, ("s", 1)) and table.insert(rows, ("other", 0))
    table.compact()
    assert not table.insert(rows, ("s", 1)) and table.scan().count() == 6
    for i in range(2, 45):  # past commits that hold the whole state
        table._commit(lambda _, i=i: {"batches": {"s": i}})
    assert not Table(spark, table.path).insert(rows, ("s", 44)) and table.state().n > 40 and table.scan().count() == 6


def test_rows_that_come_in_while_compacting_stay(spark, tmp_path, monkeypatch):
    rows = events(spark, [(1, 0, "a"), (2, 2000, "b")])
    table = grown(spark, str(tmp_path / "t"), rows)
    table.insert(rows)
    table.insert(rows)
    write = Table._write

    def slow(self, df):
        folder = write(self, df)
        monkeypatch.setattr(Table, "_write", write)
        Table(spark, table.path).insert(rows)
        return folder

    monkeypatch.setattr(Table, "_write", slow)
    table.compact()
    assert table.scan().count() == 6 and len(table.state().folders) == 2

    def second(self, df):
        folder = write(self, df)
        monkeypatch.setattr(Table, "_write", write)
        Table(spark, table.path).compact()
        return folder

    monkeypatch.setattr(Table, "_write", second)
    table.compact()  # gives up
    assert table.scan().count() == 6 and len(table.state().folders) == 1


def test_of_two_that_replace_one_succeeds(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "users"), ("project_id", "id"), replacing=True)
    row = lambda i, v, name: spark.createDataFrame([(1, i, v, name)], "project_id long, id long, version long, name string")
    table.add_fields(row(1, 1, "x").schema.fields)
    assert table.replace(row(7, 1, "first"), None)
    write = Table._write

    def meanwhile(which):
        def run(self, df):
            folder = write(self, df)
            monkeypatch.setattr(Table, "_write", write)
            assert Table(spark, table.path, table.keys, True).replace(row(which, 2, "other"), 1 if which == 7 else None)
            return folder

        return run

    monkeypatch.setattr(Table, "_write", meanwhile(7))
    assert not table.replace(row(7, 2, "mine"), 1)
    monkeypatch.setattr(Table, "_write", meanwhile(8))
    assert table.replace(row(7, 3, "mine"), 2)  # another key's row is no conflict
    assert {(r["id"], r["name"]) for r in table.scan().collect()} == {(7, "mine"), (8, "other")}


def test_replacing_table(spark, tmp_path):
    table = Table(spark, str(tmp_path / "users"), ("project_id", "id"), replacing=True)
    row = lambda v, name: spark.createDataFrame([(1, 7, v, name)], "project_id long, id long, version long, name string")
    for f in row(1, "x").schema.fields:
        table.add_field(f.name, f.dataType)
    assert table.replace(row(1, "first"), None)
    assert not table.replace(row(2, "lost"), None) and not table.replace(row(9, "lost"), 5)
    assert table.replace(row(2, "second"), 1)
    assert [r["name"] for r in table.scan().collect()] == ["second"] and table.raw().count() == 2
    table.compact()
    assert table.raw().count() == 1 and table.get(project_id=1, id=7).first()["version"] == 2


def test_latest_and_as_of(spark):
    v = spark.createDataFrame([(1, 5, 1, T0, "old"), (1, 5, 2, T0 + timedelta(minutes=10), "new")], "project_id long, id long, version long, created_at timestamp_ntz, name string")
    assert latest(v).collect()[0]["name"] == "new"
    e = events(spark, [(5, -1, "a"), (5, 0, "b"), (5, 11, "c"), (6, 1, "d")])
    assert {r["event"]: r["profile_name"] for r in as_of(e, v).collect()} == {"a": None, "b": "old", "c": "new", "d": None}


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "e.csv").write_text("user,ts,v\n1,2022-08-29T00:00:00,11.3\n2,,\n")
    df = csv_events(spark, str(tmp_path / "e.csv"), T.StructType.fromDDL(f"user long, ts timestamp_ntz, v {DECIMAL.simpleString()}"))
    assert df.count() == 2
    assert json.loads(compact_json(df.orderBy("user"))) == [[1.0, 2.0], ["2022-08-29 00:00:00", None], [11.3, 0.0]]


def test_typed_properties_and_enrichment(spark):
    c = Catalog()
    price, paid = c.add("Price", "decimal"), c.add("Paid", "boolean")
    body = lambda **x: (json.dumps(x),)
    df = spark.createDataFrame([body(userId="u", event="e", timestamp="2024-01-01T00:00:00", properties={"Price": 9.5, "Paid": True}, context={"ip": "1.2.3.4", "campaign": {"source": "s"}}), body(event="f", properties={"Price": "x"}), ("no json",)], "body string")
    rows = {r["event"]: r for r in ingest.typed_properties(ingest.campaign(ingest.parse(df)), c).collect()}
    assert float(rows["e"][price.column]) == 9.5 and rows["e"][paid.column] is True and rows["e"]["utm_source"] == "s" and rows["f"][price.column] is None
    ranges = spark.createDataFrame([(16909056, 16909311, "C", "c")], "first long, last long, country string, city string")
    ips = spark.createDataFrame([("1.2.3.4",), ("1.2.4.0",), ("bad",), (None,)], "ip string")
    assert {r["ip"]: r["country"] for r in ingest.locate(ips, ranges, "ip").collect()} == {"1.2.3.4": "C", "1.2.4.0": None, "bad": None, None: None}


def test_identity_rules(spark):
    rows = [(None, "a1", 0), ("bob", "a1", 1), (None, "a1", 2), ("bob", "a2", 3), (None, "a2", 4), ("eve", "a1", 5)]
    track = spark.createDataFrame([(u, a, T0 + timedelta(minutes=m)) for u, a, m in rows], "userId string, anonymousId string, timestamp timestamp_ntz")
    known = ingest.identities(track)
    assert {tuple(r) for r in known.collect()} == {("a1", "bob")}
    assert [r["user"] for r in ingest.resolve(track, known).orderBy("timestamp").collect()] == ["bob", "bob", "bob", "bob", "anonymous:a2", "eve"]


def test_profiles_merge(spark):
    rows = [("user", "x", T0, {"a": "1", "b": "1"}), ("user", "x", T0 + timedelta(1), {"b": "2"}), ("user", "y", T0, None)]
    out = ingest.merge_profiles(spark.createDataFrame(rows, "group string, id string, timestamp timestamp_ntz, properties map<string,string>")).collect()
    assert {(r["id"], r["version"]): r["properties"] for r in out} == {("x", 1): {"a": "1", "b": "1"}, ("x", 2): {"a": "1", "b": "2"}, ("y", 1): {}}
    known = spark.createDataFrame([("user", "x", T0, {"c": "0"}, 4)], "group string, id string, timestamp timestamp_ntz, properties map<string,string>, version long")
    again = ingest.merge_profiles(spark.createDataFrame([("user", "x", T0 + timedelta(2), {"d": "9"})], "group string, id string, timestamp timestamp_ntz, properties map<string,string>"), known).collect()
    assert [(r["version"], r["properties"]) for r in again] == [(5, {"c": "0", "d": "9"})]


def test_stream_into_table(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    for n, t in (("project_id", T.LongType()), ("group_0", T.LongType()), ("created_at", T.TimestampNTZType()), ("event", T.StringType())):
        table.add_field(n, t)
    (tmp_path / "in").mkdir()

    def shape(batch):
        p = ingest.parse(batch)
        return p.select(F.lit(1).cast("long").alias("project_id"), F.col("userId").cast("long").alias("group_0"), F.col("timestamp").alias("created_at"), "event")

    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"userId": str(u), "event": "e", "timestamp": f"2024-01-0{i + 1}T00:00:00"}) for u in range(3)))
        ingest.stream_to_table(ingest.read_requests(spark, str(tmp_path / "in")), table, str(tmp_path / "cp"), shape, once=True).awaitTermination()
    assert table.scan().count() == 6  # the second run has read only the new file


def test_streamed_sessions_equal_batches(spark, tmp_path):
    gap, rows = timedelta(minutes=30), [(1, 0, "a"), (1, 29, "a"), (1, 59, "a"), (2, 5, "a"), (1, 120, "a"), (3, 500, "a")]
    batch = events(spark, rows)
    for i in range(3):
        batch.where(F.col("event_id").between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    sessions.stream_sessions(stream, gap).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r["group_0"], r["created_at"], r["event"], r["length_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["group_0"], r["created_at"], r["event"], r["length_ms"]) for r in sessions.with_session_events(batch, gap, T0 + timedelta(minutes=501)).collect()}
    assert got == want and len({g for g in got if g[2] == sessions.END}) == 3


def asked(spark, rows, received=None):
    return spark.createDataFrame([(token, x if isinstance(x, str) else json.dumps(x)) for token, x in rows], "token string, body string")


def at(minutes):
    return (T0 + timedelta(minutes=minutes)).isoformat()


@pytest.fixture
def store(spark, tmp_path):
    projects = spark.createDataFrame([("t1", 1), ("t2", 2)], "token string, project_id long")
    ranges = spark.createDataFrame([(16909056, 16909311, "C", "c")], "first long, last long, country string, city string")
    return Ingest(spark, str(tmp_path / "store"), projects, ranges=ranges)


BATCHES = [
    [
        ("t1", {"anonymousId": "a", "event": "view", "timestamp": at(0), "properties": {"Price": 1.5, "Ok": True, "When": "2024-01-01T05:00:00", "Name": "x", "None": None}, "context": {"ip": "1.2.3.4", "campaign": {"source": "s"}, "userAgent": "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0"}}),
        ("t1", {"userId": "u", "anonymousId": "a", "event": "buy", "timestamp": at(10), "groups": {"company": "acme", "team": "red"}}),
        ("t2", {"userId": "u", "event": "buy", "timestamp": at(3)}),
        ("t1", {"userId": "v", "event": "view", "timestamp": at(100), "groups": {"company": "acme"}, "properties": {"Price": "no number"}}),
        ("bad", {"userId": "v", "event": "view", "timestamp": at(100)}), ("t1", {"event": "view", "timestamp": at(1)}), ("t1", "no json"), ("t1", {"userId": "v", "timestamp": at(1)}), ("t1", {"userId": "v", "event": "e"}),
    ],
    [
        ("t1", {"userId": "u", "event": "view", "timestamp": at(30), "properties": {"Price": 2}}), ("t1", {"userId": "u", "event": "view", "timestamp": at(90), "context": {"campaign": {"source": "later"}}}),
        ("t1", {"userId": "v", "anonymousId": "b", "event": "view", "timestamp": at(101)}), ("t1", {"anonymousId": "b", "event": "view", "timestamp": at(102), "groups": {"g3": "x", "g4": "x", "g5": "x", "g6": "x"}}),
        ("t1", {"anonymousId": "c", "event": "view", "timestamp": at(103), "groups": {"g3": "x"}}), ("t1", {"userId": "w", "anonymousId": "c", "event": "view", "timestamp": at(104)}),
    ],
]


def check_tracked(store):
    catalog = store.catalog()
    rows = [r.asDict() for r in store.events.scan().orderBy("project_id", "event_id").collect()]
    mine = [r for r in rows if r["project_id"] == 1]
    assert [r["event_id"] for r in mine] == list(range(1, len(mine) + 1)) and [r["event_id"] for r in rows if r["project_id"] == 2] == [1, 2]
    ids = {(r["group"], r["kind"], r["value"]): r["id"] for r in store.ids.scan().where("project_id = 1").collect()}
    a, v, c = ids[0, "anonymous", "a"], ids[0, "real", "v"], ids[0, "anonymous", "c"]
    assert ids[0, "real", "u"] == a and ids[0, "real", "w"] == c and len({a, v, c}) == 3 and (0, "anonymous", "b") not in ids  # v is known; the request with too many groups is not taken
    seen = sorted((r["created_at"], r["event"] != sessions.BEGIN, r["event"], r["group_0"]) for r in mine)
    minute = lambda m: T0 + timedelta(minutes=m)
    begin = sessions.BEGIN
    assert [(t, e, g) for t, _, e, g in seen] == [
        (minute(0), begin, a), (minute(0), "view", a), (minute(10), "buy", a), (minute(30), "view", a), (minute(90), begin, a), (minute(90), "view", a), (minute(100), begin, v), (minute(100), "view", v),
        (minute(101), "view", v), (minute(103), begin, c), (minute(103), "view", c), (minute(104), "view", c),
    ]
    price, name, ok, when = (catalog.properties[n].column for n in ("Price", "Name", "Ok", "When"))
    by = {(r["event"], r["created_at"]): r for r in mine}
    first = by["view", minute(0)]
    assert float(first[price]) == 1.5 and first[name] == "x" and first[ok] is True and first[when] == datetime(2024, 1, 1, 5) and first["country"] == "C" and first["os"] == "Linux" and first["utm_source"] is None
    assert by[begin, minute(0)]["utm_source"] == "s" and by[begin, minute(90)]["utm_source"] == "later" and by["view", minute(100)][price] is None and float(by["view", minute(30)][price]) == 2
    groups = {r["name"]: r["number"] for r in store.names.scan().where("what = 'group' and project_id = 1").collect()}
    assert sorted(groups.values()) == list(range(1, len(groups) + 1)) and len(groups) <= 4
    buy = by["buy", minute(10)]
    assert buy[f"group_{groups['company']}"] == ids[groups["company"], "real", "acme"] == by["view", minute(100)][f"group_{groups['company']}"] and buy[f"group_{groups['team']}"] == 1
    assert sorted((r["reason"]) for r in store.rejected.scan().collect()) == ["no event", "no event", "no timestamp", "no user", "too many groups", "unknown token"]


def test_track_end_to_end_and_batches_again(spark, store):
    for i, rows in enumerate(BATCHES):
        assert store.track(asked(spark, rows), i) > 0
        assert store.track(asked(spark, rows), i) == 0
    check_tracked(store)
    request = M.Segmentation(M.TimeRange(T0, T0 + timedelta(days=1)), "day", (M.EventQuery(M.EventRef("view"), (M.CountEvents(), M.AggregateProperty("Price", "sum"))),))
    assert {(r["agg_name"], float(r["value"])) for r in segmentation.compact(request, store.events.scan(), store.catalog()).collect()} == {("Count Events", 7.0), ("Sum Price", 3.5)}
    assert store.end_sessions(T0 + timedelta(minutes=133), 0) == 3  # v has its last event at 101, u at 90 and at 3 in the other project, w at 104
    assert store.end_sessions(T0 + timedelta(minutes=133), 0) == 0
    assert store.end_sessions(T0 + timedelta(days=1), 1) == 1
    length = store.catalog().properties["Session Length"].column
    ends = [float(r[length]) for r in store.events.scan().where(F.col("event") == sessions.END).collect()]
    assert sorted(ends) == [0, 0, 60, 60]


@pytest.mark.parametrize("fails", ["ids", "events", "sessions"])
def test_a_batch_that_fails_midway_is_taken_once(spark, store, monkeypatch, fails):
    table, insert = getattr(store, fails), Table.insert

    def broken(self, *args, **more):
        if self is table:
            raise OSError("lost")
        return insert(self, *args, **more)

    store.track(asked(spark, BATCHES[0]), 0)
    monkeypatch.setattr(Table, "insert", broken)
    with pytest.raises(OSError):
        store.track(asked(spark, BATCHES[1]), 1)
    monkeypatch.setattr(Table, "insert", insert)
    store.track(asked(spark, BATCHES[1]), 1)
    check_tracked(store)


def test_requests_of_one_time_go_by_position(spark, store):
    body = lambda user, n: json.dumps({"userId": user, "event": f"e{n}", "timestamp": at(0), "context": {"campaign": {"source": f"s{n}"}}})
    rows = [("t1", body(user, n), n) for n, user in enumerate("abcabcab")]
    assert store.track(spark.createDataFrame(rows[::-1], "token string, body string, position long"), 0) == 11
    found = [(r["event"], r["utm_source"]) for r in store.events.scan().orderBy("event_id").collect()]
    begun = lambda n: [(sessions.BEGIN, f"s{n}"), (f"e{n}", None)]
    assert found == [*begun(0), *begun(1), *begun(2), *[(f"e{n}", None) for n in range(3, 8)]]


def test_identify_end_to_end(spark, store, tmp_path):
    rows = [
        [("t1", {"group": "user", "id": "u", "timestamp": at(0), "properties": {"Plan": "free", "Seats": 3}}), ("t1", {"group": "company", "id": "acme", "timestamp": at(0), "properties": {"Size": 9}}), ("t1", {"group": "user", "timestamp": at(0)})],
        [("t1", {"group": "user", "id": "u", "timestamp": at(5), "properties": {"Plan": "paid"}}), ("t1", {"group": "user", "id": "u", "timestamp": at(6)}), ("t2", {"group": "user", "id": "u", "timestamp": at(5), "properties": {"Plan": "other"}})],
    ]
    (tmp_path / "in").mkdir()
    for i, batch in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"token": t, "body": json.dumps(x)}) for t, x in batch))
        stream = spark.readStream.schema("token string, body string").json(str(tmp_path / "in"))
        store.stream(stream, str(tmp_path / "cp"), "identify", once=True).awaitTermination()
    store.identify(asked(spark, rows[1]), 1)
    found = {(r["project_id"], r["group"], r["key"], r["version"]): r["properties"] for r in store.profiles.raw().collect()}
    assert found == {
        (1, 0, "u", 1): {"Plan": "free", "Seats": "3"}, (1, 0, "u", 2): {"Plan": "paid", "Seats": "3"}, (1, 0, "u", 3): {"Plan": "paid", "Seats": "3"}, (1, 1, "acme", 1): {"Size": "9"}, (2, 0, "u", 1): {"Plan": "other"},
    }
    wide = store.profile_columns()
    plan, seats = (store.catalog().properties[n].column for n in ("Plan", "Seats"))
    last = latest(wide.where("project_id = 1")).first()
    assert last[plan] == "paid" and float(last[seats]) == 3 and last["version"] == 3
    assert [r["reason"] for r in store.rejected.scan().collect()] == ["no group or id"]


def test_results_as_json_by_column(spark):
    df = spark.createDataFrame([("a", T0, None), ("b", None, 2.5)], f"k string, t timestamp_ntz, v {DECIMAL.simpleString()}".replace("v decimal(28,16)", "v double"))
    assert json.loads(columns_json(df.orderBy("k"))) == [{"name": "k", "dataType": "string", "data": ["a", "b"]}, {"name": "t", "dataType": "timestamp_ntz", "data": [str(T0), None]}, {"name": "v", "dataType": "double", "data": [None, 2.5]}]


def test_debug_sink(spark, tmp_path, capsys):
    assert debug(spark.createDataFrame([("shown",)], "v string")) is None and "shown" in capsys.readouterr().out
    spark.createDataFrame([("shown",)], "v string").write.text(str(tmp_path / "in"))
    query = debug(spark.readStream.text(str(tmp_path / "in")))
    query.processAllAvailable()
    assert query.lastProgress["numInputRows"] == 1
    query.stop()
