"""Track and identify requests become event and profile rows. Every function takes and gives DataFrames, batch or stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DECIMAL, TYPES, Catalog
from ..sources.store import Table

_CONTEXT = "library struct<name:string,version:string>,page struct<path:string,referrer:string,search:string,title:string,url:string>,userAgent string,ip string,campaign struct<source:string,medium:string,campaign:string,term:string,content:string>"
TRACK = f"userId string,anonymousId string,timestamp timestamp_ntz,context struct<{_CONTEXT.replace(' struct', ': struct').replace('userAgent string', 'userAgent: string').replace('ip string', 'ip: string')}>,event string,properties map<string,string>,groups map<string,string>"
IDENTIFY = "timestamp timestamp_ntz,group string,id string,properties map<string,string>"
#: Patterns of user agents, most specific first, and what they stand for.
CLIENTS = (("Edge", r"Edg(?:e|A|iOS)?/(\d+)"), ("Opera", r"(?:OPR|Opera)/(\d+)"), ("Firefox", r"(?:Firefox|FxiOS)/(\d+)"), ("Chrome", r"(?:Chrome|CriOS)/(\d+)"), ("Safari", r"Version/(\d+)[\d.]* .*Safari/"))
SYSTEMS = (("iOS", r"iPhone OS (\d+)|CPU OS (\d+)"), ("Android", r"Android (\d+)"), ("Windows", r"Windows NT (\d+)"), ("macOS", r"Mac OS X (\d+)"), ("Linux", r"Linux"))
DEVICES = (("iPhone", r"iPhone"), ("iPad", r"iPad"), ("Android phone", r"Android.*Mobile"), ("Android tablet", r"Android"), ("Desktop", r"Windows NT|Macintosh|X11"))


def parse(requests: DataFrame, kind: str = "track", received: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """JSON text in column body as typed columns (fields: these alone); a request without a timestamp takes the column received,
    if named. Text that is no JSON object is left out."""
    schema = TRACK if kind == "track" else IDENTIFY
    if fields:
        schema = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema) if f.name in fields)
    # As an array's only element the request is parsed once; else each column and filter would parse it anew.
    once = F.array(F.from_json("body", schema))
    out = requests.select(*[c for c in requests.columns if c != "body"], F.explode(F.filter(once, lambda r: r.isNotNull())).alias("r"))
    out = out.select(*[c for c in requests.columns if c != "body"], "r.*")
    return out.withColumn("timestamp", F.coalesce("timestamp", F.col(received).cast("timestamp_ntz"))) if received else out


def typed_properties(df: DataFrame, catalog: Catalog, group: int | None = None, source: str = "properties") -> DataFrame:
    """The catalog's event (or group) properties from a map of text, as their physical columns; texts that are no number are null."""
    own = [p for p in catalog.properties.values() if p.group == group and not p.system]
    value = lambda p: F.try_element_at(source, F.lit(p.name))
    kinds = {"string": "string", "decimal": DECIMAL.simpleString(), "boolean": "boolean", "timestamp": "timestamp_ntz", "int8": "byte", "int16": "short", "int32": "int", "int64": "long"}
    return df.withColumns({p.column: value(p) if p.type == "string" else F.try_cast(value(p), kinds[p.type]) if hasattr(F, "try_cast") else value(p).try_cast(kinds[p.type]) for p in own})


def typed_variant(value: Column, kind: str) -> Column:
    """A JSON value as a property of this type; null if it does not fit."""
    if kind == "timestamp":
        return F.try_variant_get(value, "$", "string").try_cast("timestamp_ntz")
    return F.try_variant_get(value, "$", TYPES[kind].simpleString())


def identities(track: DataFrame) -> DataFrame:
    """(anonymousId, user): the user that an anonymous id first came in with.

    A user inherits only the first anonymous id that it came with, so that the history of that id joins up; later ones stay
    their own."""
    seen = track.where("userId is not null and anonymousId is not null")
    first = seen.groupBy("userId").agg(F.min_by("anonymousId", F.struct("timestamp", "anonymousId")).alias("anonymousId"), F.min("timestamp").alias("t"))
    return first.groupBy("anonymousId").agg(F.min_by("userId", F.struct("t", "userId")).alias("user"))


def resolve(track: DataFrame, known: DataFrame) -> DataFrame:
    """Adds user: the user id, or what the anonymous id has become, or the anonymous id itself."""
    renamed = known.select(F.col("anonymousId").alias("_anonymous"), F.col("user").alias("_user"))
    joined = track.join(renamed, track["anonymousId"] == renamed["_anonymous"], "left")
    return joined.withColumn("user", F.coalesce("userId", "_user", F.concat(F.lit("anonymous:"), "anonymousId"))).drop("_anonymous", "_user")


def campaign(df: DataFrame) -> DataFrame:
    """The five UTM columns from context.campaign."""
    c = "context.campaign"
    return df.withColumns({f"utm_{n}": F.col(f"{c}.{n}") for n in ("source", "medium", "campaign", "term", "content")})


def _first(cases: tuple[tuple[str, str], ...], agent) -> F.Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(cases):
        out = F.when(agent.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _version(cases: tuple[tuple[str, str], ...], agent) -> F.Column:
    out = F.lit(None).cast("string")
    for _, pattern in reversed(cases):
        group = F.regexp_extract(agent, pattern, 1) if "(" in pattern else F.lit("")
        out = F.when(agent.rlike(pattern), F.when(group != "", group)).otherwise(out)
    return out


def user_agent(df: DataFrame, column: str = "context.userAgent") -> DataFrame:
    """client, client_version, os, os_version and device, by a chain of patterns inside the JVM."""
    agent = F.col(column)
    return df.withColumns({"client": _first(CLIENTS, agent), "client_version": _version(CLIENTS, agent), "os": _first(SYSTEMS, agent), "os_version": _version(SYSTEMS, agent), "device": _first(DEVICES, agent)})


def ip_number(c) -> F.Column:
    part = F.split(c, r"\.")
    good = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(good, sum((F.get(part, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0)))


def locate(df: DataFrame, ranges: DataFrame, ip: str, shift: int = 16) -> DataFrame:
    """country and city of an address: ranges (first, last, country, city) must not overlap.

    Ranges are cut into blocks of 2^shift addresses, so that the look-up is an equi-join on the block."""
    cut = ranges.withColumn("_block", F.explode(F.sequence(F.shiftright("first", shift), F.shiftright("last", shift))))
    left = df.withColumn("_ip", ip_number(F.col(ip))).withColumn("_b", F.shiftright("_ip", shift))
    on = (F.col("_b") == F.col("_block")) & F.col("_ip").between(F.col("first"), F.col("last"))
    return left.join(cut, on, "left").drop("_ip", "_b", "_block", "first", "last")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by id; of an id only the profile so far is held."""
    who, version, profile = None, 0, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["group"], r["id"]) != who:
                who, version, profile = (r["group"], r["id"]), 0, {}
            profile = profile | dict(r["properties"] or [])
            version = r["base"] or version + 1
            if not r["base"]:
                out.append({"group": r["group"], "id": r["id"], "version": version, "timestamp": r["timestamp"], "properties": list(profile.items())})
        yield pa.RecordBatch.from_pylist(out, _PROFILE)


_PROFILE = pa.schema([("group", pa.string()), ("id", pa.string()), ("version", pa.int64()), ("timestamp", pa.timestamp("us")), ("properties", pa.map_(pa.string(), pa.string()))])


def merge_profiles(identify: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(group, id, version, timestamp, properties): each request's full profile after it, properties merged one on another.

    known: latest profiles, on which the requests are merged, whatever their times. Requests of one time go by a hash of their
    properties. Rows are sorted by id within partitions and folded as they come, so that an id may have any number of them."""
    rows = identify.select("group", "id", "timestamp", "properties", F.lit(0).cast("long").alias("base"))
    if known is not None:
        rows = rows.unionByName(known.select("group", "id", "timestamp", "properties", F.col("version").alias("base")))
    tie = F.xxhash64(F.sort_array(F.map_entries("properties")))
    placed = rows.withColumn("tie", tie).repartition("group", "id").sortWithinPartitions("group", "id", F.desc(F.col("base") > 0), "timestamp", "tie").drop("tie")
    return placed.mapInArrow(_merge, "group string, id string, version long, timestamp timestamp_ntz, properties map<string,string>")


def stream_to_table(stream: DataFrame, table: Table, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = False):
    """Writes a stream into a table, batch by batch; the checkpoint makes it resume where it stopped, and a batch that comes
    again is not taken again."""

    def write(batch: DataFrame, number: int) -> None:
        table.insert(transform(batch) if transform else batch, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_requests(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Files of one JSON request per line as a stream with the column body."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder).withColumnRenamed("value", "body")
