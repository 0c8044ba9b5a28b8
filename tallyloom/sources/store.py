"""A Parquet event store: checked appends, additive schema, merged reads, point reads, versioned replace, compaction.

Layout: <path>/log/<n>.json are commits, numbered without gaps; each adds and removes data folders, adds columns, or notes which
batches of a stream are in. <path>/data/_folder=.../project_id=.../_day=.../part files (_day for tables with created_at), sorted by
group within a file, so that project and day prune folders and Parquet statistics prune row groups.

A commit is written aside and renamed to its number, which fails if another writer was there first: that one then reads what
has come in, checks anew, and tries the next number. Readers see the commits there are when they begin; a writer that dies
leaves a folder that no commit names, which vacuum removes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .events import latest

#: A commit whose number is a multiple of this holds all that is before it, so that readers need no older ones.
WHOLE = 20
#: Seconds after which a folder that no commit names is taken for left behind.
GRACE = 24 * 3600


@dataclass
class State:
    """What the commits up to number n add up to. batches: of each stream the last batch that is in; notes: numbers that came with
    rows, such as the next free ids."""

    n: int = -1
    schema: T.StructType = field(default_factory=T.StructType)
    folders: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)

    def after(self, entry: dict) -> State:
        kept = [] if entry.get("whole") else [f for f in self.folders if f not in entry.get("remove", ())]
        known = T.StructType.fromJson(entry["schema"]) if entry.get("schema") else self.schema
        return State(self.n + 1, known, [*kept, *entry.get("add", ())], self.batches | entry.get("batches", {}), self.notes | entry.get("notes", {}))


class Table:
    """replacing: rows are versions of a key, and reads return each key's newest one."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("project_id", "group_0"), replacing: bool = False, version: str = "version"):
        self.spark, self.path, self.keys, self.replacing, self.version = spark, path.rstrip("/"), keys, replacing, version
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- files

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _get(self, name: str) -> dict:
        fs, p = self._fs(f"{self.path}/log/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(f"{self.path}/data/{folder}")
        fs.delete(p, True)

    def _claim(self, n: int, entry: dict) -> bool:
        """Makes entry commit n; False if there is one."""
        fs, aside = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{n:012d}.json")
        files = self._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 0)  # no overwriting
        try:
            files.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(aside), fs.makeQualified(target), plain)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- commits

    def state(self, since: State | None = None) -> State:
        """The newest state; since: a state from which to read on."""
        names = sorted(x for x in self._names(f"{self.path}/log") if not x.startswith("."))
        if since is None:
            whole = max((i for i, x in enumerate(names) if int(x[:-5]) % WHOLE == 0), default=0)
            names, since = names[whole:], State(n=int(names[whole][:-5]) - 1) if names else State()
        else:
            names = [x for x in names if int(x[:-5]) > since.n]
        for name in names:
            since = since.after(self._get(name))
        return since

    def _commit(self, make: Callable[[State], dict | None]) -> State | None:
        """Commits what make gives for the newest state, made anew as often as another writer is first; None if it gives none."""
        now = self.state()
        while True:
            entry = make(now)
            if entry is None:
                return None
            then = now.after(entry)
            if then.n % WHOLE == 0:
                entry = {"whole": True, "schema": json.loads(then.schema.json()), "add": then.folders, "batches": then.batches, "notes": then.notes}
            if self._claim(then.n, entry):
                return then
            now = self.state(now)

    def schema(self) -> T.StructType:
        return self.state().schema

    def add_field(self, name: str, type: T.DataType) -> None:
        """Columns are only ever added, nullable; the same name with another type is an error."""
        self.add_fields([T.StructField(name, type)])

    def add_fields(self, fields: list[T.StructField]) -> None:
        def make(now: State) -> dict | None:
            schema = now.schema
            for f in fields:
                if f.name not in schema.names:
                    schema = T.StructType([*schema.fields, T.StructField(f.name, f.dataType, True)])
                elif schema[f.name].dataType != f.dataType:
                    raise ValueError(f"{f.name} is {schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            return {"schema": json.loads(schema.json())} if schema != now.schema else None

        self._commit(make)

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None, notes: dict[str, int] | None = None) -> bool:
        """Appends rows; types must be the table's and columns known (add_field).

        batch: a stream's name and the number of its batch. A batch that is in already, or an older one, is not taken again, so
        that a stream which repeats a batch after a failure appends it once. notes go into the same commit. Returns whether rows were
        appended."""
        now = self.state()
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return False
        for f in df.schema.fields:
            if f.name not in now.schema.names:
                raise ValueError(f"unknown column {f.name}")
            if now.schema[f.name].dataType != f.dataType:
                raise ValueError(f"{f.name} is {now.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        folder = self._write(df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields]))

        def make(state: State) -> dict | None:
            if batch and state.batches.get(batch[0], -1) >= batch[1]:
                return None
            return {"add": [folder]} | ({"batches": {batch[0]: batch[1]}} if batch else {}) | ({"notes": notes} if notes else {})

        if self._commit(make) is None:
            self._drop(folder)
            return False
        return True

    def _write(self, df: DataFrame) -> str:
        folder = f"_folder={uuid.uuid4().hex}"
        dated = "created_at" in df.columns and not self.replacing
        laid = df.withColumn("_day", F.to_date("created_at")) if dated else df
        parts = [c for c in ("project_id", "_day") if c in laid.columns]
        rest = [k for k in self.keys if k not in parts]
        # Ranges of key within a day: a day's rows are spread over tasks, and no file mixes many days.
        laid = laid.repartitionByRange(*parts, *rest).sortWithinPartitions(*parts, *rest)
        laid.write.partitionBy(*parts).parquet(f"{self.path}/data/{folder}")
        return folder

    # --- reads

    def raw(self, state: State | None = None) -> DataFrame:
        """All rows, also superseded ones; files that lack a column give nulls."""
        now = state or self.state()
        if not now.folders:
            return self.spark.createDataFrame([], now.schema)
        data = f"{self.path}/data"
        schema = T.StructType([*now.schema.fields, T.StructField("_day", T.DateType()), T.StructField("_folder", T.StringType())])
        files = self.spark.read.schema(schema).option("basePath", data).parquet(*[f"{data}/{x}" for x in now.folders])
        return files.select(*[f"`{n}`" for n in now.schema.names])

    def scan(self, columns: list[str] | None = None) -> DataFrame:
        df = self.raw()
        df = latest(df, self.keys, self.version) if self.replacing else df
        return df.select(*columns) if columns else df

    def get(self, state: State | None = None, **key: object) -> DataFrame:
        """The rows of one key; partitions and row-group statistics do the pruning."""
        df = self.raw(state)
        for k, v in key.items():
            df = df.where(F.col(k) == F.lit(v))
        return latest(df, self.keys, self.version) if self.replacing else df

    def replace(self, df: DataFrame, expected: int | None = None) -> bool:
        """Writes a new version of one key's row if its newest version is the expected one (None: there is none).

        Of several that expect the same version one succeeds: whoever comes second finds another state and looks again."""
        row = df.first()
        key = {k: row[k] for k in self.keys}

        def fits(state: State) -> bool:
            found = self.get(state, **key).first() if state.folders else None
            return (found[self.version] if found else None) == expected

        now = self.state()
        if not fits(now):
            return False
        folder = self._write(df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields]))
        if self._commit(lambda state: {"add": [folder]} if state.n == now.n or fits(state) else None) is None:
            self._drop(folder)
            return False
        return True

    # --- upkeep

    def compact(self) -> None:
        """Rewrites the rows there are now: superseded versions go, small files become large, keys are sorted.

        Rows that come in meanwhile stay; if another compaction has taken the same folders, this one gives up."""
        now = self.state()
        if not now.folders:
            return
        rows = self.raw(now)
        folder = self._write(latest(rows, self.keys, self.version) if self.replacing else rows)
        if self._commit(lambda state: {"add": [folder], "remove": now.folders} if {*now.folders} <= {*state.folders} else None) is None:
            self._drop(folder)

    def vacuum(self, older: float = GRACE) -> list[str]:
        """Removes folders that the newest state does not name, and that were last changed more than older seconds ago."""
        used, fs, data = {*self.state().folders}, *self._fs(f"{self.path}/data")
        before, gone = (time.time() - older) * 1000, []
        for x in fs.listStatus(data) if fs.exists(data) else []:
            name = x.getPath().getName()
            if name not in used and x.getModificationTime() <= before:
                fs.delete(x.getPath(), True)
                gone.append(name)
        return gone

    def backup(self, to: str) -> None:
        """A copy of the newest state: its folders, and a log of one commit."""
        now, target = self.state(), Table(self.spark, to, self.keys, self.replacing, self.version)
        self._copy(now, self.path, to)
        if not target._claim(0, {"whole": True, "schema": json.loads(now.schema.json()), "add": now.folders, "batches": now.batches, "notes": now.notes}):
            raise ValueError(f"{to} holds a table")

    def restore(self, backup: str) -> None:
        """Makes this table, which may have commits, what the backup holds."""
        then = Table(self.spark, backup, self.keys, self.replacing, self.version).state()
        fs, _ = self._fs(self.path)
        have = {*self._names(f"{self.path}/data")}
        self._copy(State(folders=[f for f in then.folders if f not in have]), backup, self.path)
        self._commit(lambda _: {"whole": True, "schema": json.loads(then.schema.json()), "add": then.folders, "batches": then.batches, "notes": then.notes})

    def _copy(self, what: State, source: str, target: str) -> None:
        util = self._jvm.org.apache.hadoop.fs.FileUtil
        for f in what.folders:
            (a, x), (b, y) = self._fs(f"{source}/data/{f}"), self._fs(f"{target}/data/{f}")
            b.mkdirs(y.getParent())
            util.copy(a, x, b, y, False, True, self._conf)


def csv_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV file with a header; rows that do not fit the schema have nulls."""
    return spark.read.schema(schema).option("header", True).csv(path)


def columns_json(df: DataFrame) -> str:
    """A result as JSON: an object for each column with its name, type and values, in rows' order; decimals as numbers, times as text."""
    rows, kinds = df.collect(), dict(df.dtypes)
    shown = lambda v: v if v is None or isinstance(v, int | float | str | bool) else float(v) if isinstance(v, Decimal) else str(v)
    return json.dumps([{"name": c, "dataType": kinds[c], "data": [shown(r[c]) for r in rows]} for c in df.columns])


def compact_json(df: DataFrame) -> str:
    """A result as JSON by column: decimals with three digits, null numbers as 0. For results, not for tables."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    shown = df.select(*[F.coalesce(F.round(F.col(f"`{c}`").cast("double"), 3), F.lit(0.0)).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns])
    rows = shown.collect()
    return json.dumps([[r[c] if isinstance(r[c], int | float | str | bool) or r[c] is None else str(r[c]) for r in rows] for c in shown.columns])
