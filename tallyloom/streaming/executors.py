"""Track and identify requests, end to end: from a token and JSON text to rows of the events and profiles tables.

A batch goes through tables in a fixed order (names, ids, events, sessions; names, ids, profiles), each of which takes a
stream's batch once. A batch that is repeated after a failure finds what is in and adds what is not, with the same ids, so that
each request ends up in the tables exactly once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..catalog import DECIMAL, Catalog
from ..functions.buckets import instant, micros
from ..functions.numbering import numbered_by
from ..model import MAX_GROUPS
from ..sources.events import latest
from ..sources.store import Table
from . import ingest
from .sessions import BEGIN, END

LENGTH = "Session Length"
_NAMES = "project_id long, what string, name string, type string, number long"
_IDS = "project_id long, group long, kind string, value string, id long"
_SESSIONS = "project_id long, group_0 long, version long, began timestamp_ntz, last timestamp_ntz, ended boolean"
_PROFILES = "project_id long, group long, id long, version long, created_at timestamp_ntz, key string, properties map<string,string>"
_REJECTED = "token string, body string, reason string"
_CLIENT = ("client", "client_version", "os", "os_version", "device")
_UTM = tuple(f"utm_{x}" for x in ("source", "medium", "campaign", "term", "content"))
_EVENTS = "project_id long, " + "".join(f"group_{i} long, " for i in range(MAX_GROUPS)) + "created_at timestamp_ntz, event_id long, event string, ip string, " + ", ".join(f"{c} string" for c in (*_CLIENT, "country", "city", *_UTM))


def kind_of(value: Column) -> Column:
    """The property type of a JSON value: numbers are decimals, texts like 2024-01-31T12:00:00 times, objects text; null: none."""
    seen, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = seen.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    time = (seen == "STRING") & text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d")
    return F.when(seen == "VOID", None).when(seen == "BOOLEAN", "boolean").when(number, "decimal").when(time, "timestamp").otherwise("string")


class Ingest:
    """The tables below path and what takes requests into them.

    projects: (token, project_id). ranges: (first, last, country, city) of addresses, for places. gap: the pause that ends a
    session. Property names are shared by all projects; a value that does not fit the type its name first came with is null."""

    def __init__(self, spark: SparkSession, path: str, projects: DataFrame, gap: timedelta = timedelta(minutes=30), ranges: DataFrame | None = None):
        self.spark, self.projects, self.gap, self.ranges = spark, projects, gap, ranges

        def table(name: str, schema: str, keys: tuple[str, ...], replacing: bool = False) -> Table:
            out = Table(spark, f"{path}/{name}", keys, replacing)
            out.add_fields(T.StructType.fromDDL(schema.replace("group long", "`group` long")).fields)
            return out

        self.names = table("names", _NAMES, ("project_id", "name"))
        self.ids = table("ids", _IDS, ("project_id", "value"))
        self.events = table("events", _EVENTS, ("project_id", "group_0"))
        self.sessions = table("sessions", _SESSIONS, ("project_id", "group_0"), replacing=True)
        self.profiles = table("profiles", _PROFILES, ("project_id", "group", "id"), replacing=True)
        self.rejected = table("rejected", _REJECTED, ("token",))

    # --- names

    def catalog(self) -> Catalog:
        """Properties as far as they are known; names are as many as a schema has."""
        out = Catalog()
        for r in self.names.scan().where("what <> 'group'").orderBy("number", "type", "name").collect():
            out.add(r["name"], r["type"], None if r["what"] == "event" else int(r["what"][6:]))
        return out

    def _resolve_names(self, seen: DataFrame, batch: tuple[str, int]) -> Catalog:
        """Adds the properties of seen (what, name, type) that are new; of a name that comes with several types the first by name."""
        catalog = self.catalog()
        rows, n = [], len(catalog.properties)
        for r in seen.where("type is not null").distinct().orderBy("what", "name", "type").collect():
            if r["name"] not in catalog.properties:
                catalog.add(r["name"], r["type"], None if r["what"] == "event" else int(r["what"][6:]))
                rows.append((None, r["what"], r["name"], r["type"], n + len(rows)))
        if rows:
            self.names.insert(self.spark.createDataFrame(rows, _NAMES), (f"properties {batch[0]}", batch[1]))
        return catalog

    def _groups(self, wanted: DataFrame, batch: tuple[str, int]) -> DataFrame:
        """(project_id, name, number) of groups, wanted (project_id, name) among them as far as numbers are left: 0 is user, at
        most MAX_GROUPS - 1 others a project. Small: projects times five."""
        known = self.names.scan().where("what = 'group'").select("project_id", "name", "number")
        new = wanted.where("name <> 'user'").distinct().join(known, ["project_id", "name"], "left_anti")
        used = known.groupBy("project_id").agg(F.max("number").alias("_used"))
        placed = new.join(used, "project_id", "left").withColumn("_at", F.row_number().over(Window.partitionBy("project_id").orderBy("name")))
        rows = placed.select("project_id", F.lit("group").alias("what"), "name", F.lit(None).cast("string").alias("type"), (F.coalesce("_used", F.lit(0)) + F.col("_at")).cast("long").alias("number"))
        rows = rows.where(F.col("number") < MAX_GROUPS)
        if not rows.isEmpty():
            self.names.insert(rows, (f"groups {batch[0]}", batch[1]))
        every = self.projects.select("project_id", F.lit("user").alias("name"), F.lit(0).cast("long").alias("number")).distinct()
        return self.names.scan().where("what = 'group'").select("project_id", "name", "number").unionByName(every)

    # --- ids

    def _fresh(self, new: DataFrame, batch: tuple[str, int]) -> None:
        """Numbers new (project_id, group, kind, value, at) in the order of at, after those given so far, and adds inherited ids."""
        notes = self.ids.state().notes
        own = new.where("kind <> 'inherits'")
        counted = numbered_by(own.withColumn("_seq", F.concat_ws("/", "project_id", "group")), "_seq", ["at", "kind", "value"], "_n").persist()
        sizes = {r["_seq"]: r["n"] for r in counted.groupBy("_seq").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per project and group
        if not sizes:
            counted.unpersist()
            return
        first = self.spark.createDataFrame([(k, notes.get(k, 1)) for k in sizes], "_seq string, _first long")
        rows = counted.join(first, "_seq").select("project_id", "group", "kind", "value", (F.col("_n") + F.col("_first")).alias("id"))
        self.ids.insert(rows, batch, {k: notes.get(k, 1) + n for k, n in sizes.items()})
        counted.unpersist()

    def _known(self, kind: str) -> DataFrame:
        """(project_id, group, value, id); should a value ever have several ids, the smallest."""
        return self.ids.scan().where(F.col("kind") == kind).groupBy("project_id", "group", "value").agg(F.min("id").alias("id"))

    def _resolve_ids(self, asked: DataFrame, batch: tuple[str, int]) -> None:
        """asked (project_id, group, user, anonymous, at): gives ids to users, anonymous ids and group values that have none.

        A user that is new and comes with an anonymous id inherits that one's number, so that its history joins up; a user that is
        known keeps its own."""
        users = asked.where("user is not null").groupBy("project_id", "group", F.col("user").alias("value")).agg(F.min_by("anonymous", F.struct("at", F.coalesce("anonymous", F.lit("")))).alias("from"), F.min("at").alias("at"))
        users = users.join(self._known("real"), ["project_id", "group", "value"], "left_anti")
        nameless = asked.where("user is null").select("project_id", "group", F.col("anonymous").alias("value"), "at")
        nameless = nameless.unionByName(users.where("from is not null").select("project_id", "group", F.col("from").alias("value"), "at"))
        nameless = nameless.groupBy("project_id", "group", "value").agg(F.min("at").alias("at")).join(self._known("anonymous"), ["project_id", "group", "value"], "left_anti")
        fresh = nameless.withColumn("kind", F.lit("anonymous")).unionByName(users.where("from is null").drop("from").withColumn("kind", F.lit("real")))
        users = users.where("from is not null").persist()
        users.count()  # before the numbers below are in, after which no user looks new
        self._fresh(fresh, (f"fresh {batch[0]}", batch[1]))
        given = self._known("anonymous").withColumnRenamed("value", "from")
        rows = users.join(given, ["project_id", "group", "from"]).select("project_id", "group", F.lit("real").alias("kind"), "value", "id")
        if not rows.isEmpty():
            self.ids.insert(rows, (f"inherited {batch[0]}", batch[1]))
        users.unpersist()

    # --- track

    def _requests(self, batch: DataFrame, kind: str) -> DataFrame:
        """Typed requests with project_id, properties as JSON values, and why a request can't be taken."""
        found = batch.join(self.projects.select("token", "project_id"), "token", "left")
        schema = (ingest.TRACK if kind == "track" else ingest.IDENTIFY).replace("properties map<string,string>", "properties map<string,variant>")
        once = found.withColumn("r", F.explode(F.array(F.from_json("body", schema))))
        return once.select("token", "body", "project_id", "r.*", *[c for c in ("received", "position") if c in batch.columns])

    def _reject(self, requests: DataFrame, batch: tuple[str, int]) -> DataFrame:
        bad = requests.where("reason is not null").select(*[F.col(c).cast("string") for c in ("token", "body", "reason")])
        self.rejected.insert(bad, batch)
        return requests.where("reason is null").drop("token", "body", "reason")

    def track(self, batch: DataFrame, number: int, stream: str = "track") -> int:
        """Takes batch (token, body, perhaps received: when a request without a timestamp came in, perhaps position: the place in
        the order in which requests came in) as the stream's batch of this number; how many rows events has got.

        Requests of one time go by position, those without one by a hash of their text.

        Rejected, with the reason, are requests of unknown tokens, without an event or without a user, that are no JSON, or that
        would need a sixth group. Before the first event of a session comes a Session Begin with the request's campaign."""
        name = (stream, number)
        asked = self._requests(batch, "track")
        at = F.coalesce("timestamp", F.col("received").cast("timestamp_ntz") if "received" in batch.columns else F.lit(None))
        asked = asked.withColumns({"created_at": at, "asked": F.xxhash64("body")} | ({} if "position" in batch.columns else {"position": F.lit(None).cast("long")}))
        names = asked.where("project_id is not null").select("project_id", F.explode(F.map_keys("groups")).alias("name"))
        groups = self._groups(names, name)
        numbers = groups.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "number"))).alias("numbers"))  # at most five a project
        asked = asked.join(numbers, "project_id", "left")
        many = F.exists(F.map_keys(F.coalesce("groups", F.create_map().cast("map<string,string>"))), lambda g: ~F.map_contains_key("numbers", g))
        asked = asked.withColumn("reason", F.when(F.col("event").isNull(), "no event").when(F.col("project_id").isNull(), "unknown token").when(F.col("userId").isNull() & F.col("anonymousId").isNull(), "no user")
            .when(F.col("created_at").isNull(), "no timestamp").when(many, "too many groups"))
        good = self._reject(asked, name).persist()
        values = good.select(F.explode("properties").alias("name", "value")).select(F.lit("event").alias("what"), "name", kind_of(F.col("value")).alias("type"))
        catalog = self._resolve_names(values, name)
        own = [p for p in catalog.properties.values() if p.group is None]
        length = catalog.properties.get(LENGTH)
        if length is None:
            catalog = self._resolve_names(self.spark.createDataFrame([("event", LENGTH, "decimal")], "what string, name string, type string"), (f"system {stream}", number))
            own = [p for p in catalog.properties.values() if p.group is None]
        self.events.add_fields([T.StructField(p.column, ingest.TYPES[p.type]) for p in own])

        who = good.select("project_id", F.lit(0).cast("long").alias("group"), F.col("userId").alias("user"), F.col("anonymousId").alias("anonymous"), F.col("created_at").alias("at"))
        others = good.select("project_id", "numbers", "created_at", F.explode("groups").alias("name", "user"))
        others = others.select("project_id", F.element_at("numbers", F.col("name")).alias("group"), "user", F.lit(None).cast("string").alias("anonymous"), F.col("created_at").alias("at")).where("group > 0")
        self._resolve_ids(who.unionByName(others), name)

        real, nameless = self._known("real"), self._known("anonymous").where("group = 0")
        rows = good.withColumns({"_value": F.col("userId"), "_anonymous": F.when(F.col("userId").isNull(), F.col("anonymousId"))})
        for i in range(MAX_GROUPS):
            ids = real.where(F.col("group") == i).select(F.col("project_id").alias("_p"), F.col("value").alias("_v"), F.col("id").alias(f"group_{i}"))
            if i:
                mine = F.map_filter("groups", lambda k, _: F.element_at("numbers", k) == i)  # noqa: B023
                entry = F.get(F.map_values(mine), F.lit(0))
                rows = rows.withColumn("_value", entry)
            rows = rows.join(ids, (F.col("project_id") == F.col("_p")) & (F.col("_value") == F.col("_v")), "left").drop("_p", "_v")
        guest = nameless.select(F.col("project_id").alias("_p"), F.col("value").alias("_v"), F.col("id").alias("_guest"))
        rows = rows.join(guest, (F.col("project_id") == F.col("_p")) & (F.col("_anonymous") == F.col("_v")), "left").withColumn("group_0", F.coalesce("group_0", "_guest"))
        rows = ingest.campaign(ingest.user_agent(rows)).withColumn("ip", F.col("context.ip"))
        rows = ingest.locate(rows, self.ranges, "ip") if self.ranges is not None else rows.withColumns({"country": F.lit(None).cast("string"), "city": F.lit(None).cast("string")})
        value = lambda p: F.try_element_at("properties", F.lit(p.name))
        rows = rows.withColumns({p.column: ingest.typed_variant(value(p), p.type) for p in own})

        before = latest(self.sessions.raw(), ("project_id", "group_0")).select("project_id", "group_0", F.col("last").alias("_last"), F.col("began").alias("_began"), F.col("ended").alias("_ended"), F.col("version").alias("_version"))
        rows = rows.join(before, ["project_id", "group_0"], "left")
        order = Window.partitionBy("project_id", "group_0").orderBy("created_at", "position", "asked")
        previous = F.coalesce(F.lag("created_at").over(order), F.when(F.coalesce(F.col("_ended"), F.lit(False)), None).otherwise(F.col("_last")))
        wide = int(self.gap.total_seconds() * 1_000_000)
        begins = F.coalesce(micros(F.col("created_at")) - micros(F.col("_previous")) > wide, F.lit(True))
        rows = rows.withColumn("_previous", previous).withColumn("_begins", begins).persist()
        state = rows.groupBy("project_id", "group_0").agg(
            (F.coalesce(F.first("_version"), F.lit(0)) + 1).alias("version"), F.coalesce(F.max(F.when(F.col("_begins"), F.col("created_at"))), F.first("_began")).alias("began"),
            F.greatest(F.max("created_at"), F.first("_last")).alias("last"), F.lit(False).alias("ended"),
        )
        own_names = [p.column for p in own]
        shown = ["project_id", *[f"group_{i}" for i in range(MAX_GROUPS)], "created_at", "position", "asked", "ip", *_CLIENT, "country", "city"]
        plain = rows.select(*shown, "event", F.lit(1).alias("_at"), *[F.lit(None).cast("string").alias(c) for c in _UTM], *own_names)
        begun = rows.where("_begins").select(*shown, F.lit(BEGIN).alias("event"), F.lit(0).alias("_at"), *_UTM, *own_names)
        done = self._number(plain.unionByName(begun), name)
        self.sessions.insert(state.select(*[f.name for f in self.sessions.schema().fields]), name)
        rows.unpersist()
        good.unpersist()
        return done

    def _number(self, rows: DataFrame, batch: tuple[str, int]) -> int:
        """Puts rows into events, numbered per project in the order of time, position and hash, after those given so far."""
        notes = self.events.state().notes
        counted = numbered_by(rows, "project_id", ["created_at", "position", "asked", "_at"], "_n").drop("position", "asked", "_at").persist()
        sizes = {r["project_id"]: r["n"] for r in counted.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = 0
        if sizes:
            first = self.spark.createDataFrame([(p, notes.get(str(p), 1)) for p in sizes], "project_id long, _first long")
            ready = counted.join(first, "project_id").withColumn("event_id", F.col("_n") + F.col("_first")).drop("_n", "_first")
            if self.events.insert(ready, batch, {str(p): notes.get(str(p), 1) + n for p, n in sizes.items()}):
                done = sum(sizes.values())
        counted.unpersist()
        return done

    def end_sessions(self, now: datetime, number: int, stream: str = "sweep") -> int:
        """A Session End, with its length in seconds, for each session idle for more than gap at now; how many."""
        catalog = self.catalog()
        idle = latest(self.sessions.raw(), ("project_id", "group_0")).where(~F.col("ended") & (F.col("last") + F.make_dt_interval(secs=F.lit(self.gap.total_seconds())) < instant(now))).persist()
        length = ((micros(F.col("last")) - micros(F.col("began"))) / 1_000_000).cast(DECIMAL)
        rows = idle.select("project_id", "group_0", F.col("last").alias("created_at"), F.lit(END).alias("event"), F.lit(None).cast("long").alias("position"), F.xxhash64("group_0").alias("asked"), F.lit(2).alias("_at"), *([length.alias(catalog.properties[LENGTH].column)] if LENGTH in catalog.properties else []))
        done = self._number(rows, (stream, number))
        self.sessions.insert(idle.withColumns({"version": F.col("version") + 1, "ended": F.lit(True)}), (stream, number))
        idle.unpersist()
        return done

    # --- identify

    def identify(self, batch: DataFrame, number: int, stream: str = "identify") -> None:
        """Takes batch (token, body): each request merges its properties into the profile of a group's id, as a new version."""
        name = (stream, number)
        asked = self._requests(batch, "identify")
        at = F.coalesce("timestamp", F.col("received").cast("timestamp_ntz") if "received" in batch.columns else F.lit(None))
        asked = asked.withColumn("created_at", at)
        groups = self._groups(asked.where("project_id is not null and group is not null").select("project_id", F.col("group").alias("name")), name)
        numbers = groups.select(F.col("project_id").alias("_p"), F.col("name").alias("_g"), F.col("number").alias("_number"))
        asked = asked.join(numbers, (F.col("project_id") == F.col("_p")) & (F.col("group") == F.col("_g")), "left").drop("_p", "_g")
        asked = asked.withColumn("reason", F.when(F.col("project_id").isNull(), "unknown token").when(F.col("group").isNull() | F.col("id").isNull(), "no group or id").when(F.col("created_at").isNull(), "no timestamp").when(F.col("_number").isNull(), "too many groups"))
        good = self._reject(asked, name).drop("group").withColumnRenamed("_number", "group").persist()
        values = good.select("group", F.explode("properties").alias("name", "value")).select(F.concat(F.lit("group "), F.col("group").cast("string")).alias("what"), "name", kind_of(F.col("value")).alias("type"))
        self._resolve_names(values, name)
        self._resolve_ids(good.select("project_id", "group", F.col("id").alias("user"), F.lit(None).cast("string").alias("anonymous"), F.col("created_at").alias("at")), name)
        ids = self._known("real").select(F.col("project_id").alias("_p"), F.col("group").alias("_g"), F.col("value").alias("_v"), F.col("id").alias("_id"))
        rows = good.join(ids, (F.col("project_id") == F.col("_p")) & (F.col("group") == F.col("_g")) & (F.col("id") == F.col("_v")))
        text = F.transform_values("properties", lambda _, v: F.try_variant_get(v, "$", "string"))
        joint = lambda p, g: F.concat_ws("/", p, g).alias("group")
        # The key stands in the profile itself, so that it comes through the merge.
        rows = rows.select(joint("project_id", "_g"), F.col("_id").cast("string").alias("id"), F.col("created_at").alias("timestamp"), F.map_concat(F.coalesce(text, F.create_map().cast("map<string,string>")), F.create_map(F.lit("\x00key"), F.col("id"))).alias("properties"))
        known = latest(self.profiles.raw(), ("project_id", "group", "id"))
        known = known.select(joint("project_id", "group"), F.col("id").cast("string").alias("id"), F.col("created_at").alias("timestamp"), "properties", "version").join(rows.select("group", "id").distinct(), ["group", "id"], "left_semi")
        merged = ingest.merge_profiles(rows, known)
        part = F.split("group", "/")
        self.profiles.insert(merged.select(
            part[0].cast("long").alias("project_id"), part[1].cast("long").alias("group"), F.col("id").cast("long").alias("id"), "version", F.col("timestamp").alias("created_at"),
            F.element_at("properties", "\x00key").alias("key"), F.map_filter("properties", lambda k, _: k != "\x00key").alias("properties"),
        ), name)
        good.unpersist()

    def profile_columns(self, group: int = 0) -> DataFrame:
        """All versions of a group's profiles, with properties in typed columns, as searches and segments take them."""
        return ingest.typed_properties(self.profiles.raw().where(F.col("group") == group), self.catalog(), group)

    # --- streams

    def stream(self, requests: DataFrame, checkpoint: str, kind: str = "track", once: bool = False) -> StreamingQuery:
        """Takes a stream of (token, body); the checkpoint tells where it stopped, the tables what of the last batch is in."""
        take = self.track if kind == "track" else self.identify
        writer = requests.writeStream.foreachBatch(lambda batch, number: take(batch, number, kind) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def debug(rows: DataFrame, lines: int = 20) -> StreamingQuery | None:
    """Prints rows, of a stream batch by batch."""
    if rows.isStreaming:
        return rows.writeStream.format("console").option("numRows", lines).option("truncate", False).start()
    rows.show(lines, truncate=False)
    return None
