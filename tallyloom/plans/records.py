"""Event and profile records, and the values of a property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.predicates import any_of, conditions, event_column, filter_column, time_column
from ..model import EventSearch, GroupSearch, PropertyValues
from ..sources.events import latest


def _shown(df: DataFrame, names: tuple[str, ...], catalog: Catalog, always: tuple[str, ...]) -> DataFrame:
    if not names:
        return df
    wanted = [*dict.fromkeys((*always, *(catalog.column(n) for n in names)))]
    return df.select(*[f"`{c}`" for c in wanted])


def search_events(r: EventSearch, events: DataFrame, catalog: Catalog) -> DataFrame:
    """The newest events (by event_id) of those asked for; without events, of all."""
    catalog.validate_search(r, events.columns)
    own = any_of(event_column(e, catalog) for e in r.events) if r.events else F.lit(True)
    rows = events.where((F.col("project_id") == r.project_id) & time_column(r.time) & own & conditions(r.filters, catalog))
    return _shown(rows, r.properties, catalog, ("event_id", "event", "created_at")).orderBy(F.desc("event_id")).limit(r.limit)


def _as_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("p")).select("p.*")


def event_by_id(event_id: int, events: DataFrame, project_id: int = 1) -> DataFrame:
    """(property, value) of one event."""
    return _as_pairs(events.where((F.col("project_id") == project_id) & (F.col("event_id") == event_id)).limit(1))


def search_groups(r: GroupSearch, versions: DataFrame, catalog: Catalog) -> DataFrame:
    """Latest profiles that meet both time and filters; sorted by a property, nulls last, or by id."""
    catalog.validate_search(r, versions.columns)
    rows = latest(versions.where(F.col("project_id") == r.project_id)).where(time_column(r.time) & conditions(r.filters, catalog))
    rows = _shown(rows, r.properties, catalog, ("id",))
    order = [F.col("id")]
    if r.sort is not None:
        c = f"`{catalog.column(r.sort[0])}`"
        order = [F.asc_nulls_last(c) if r.sort[1] == "asc" else F.desc_nulls_last(c), *order]
    return rows.orderBy(*order).limit(r.limit)


def group_by_id(id: int, versions: DataFrame, project_id: int = 1) -> DataFrame:
    """(property, value) of one profile's latest version."""
    return _as_pairs(latest(versions.where((F.col("project_id") == project_id) & (F.col("id") == id))))


def property_values(r: PropertyValues, events: DataFrame, catalog: Catalog) -> DataFrame:
    """(value): distinct values, ascending, nulls last."""
    catalog.validate_values(r, events.columns)
    rows = events.where(F.col("project_id") == r.project_id)
    if r.event is not None:
        rows = rows.where(event_column(r.event, catalog))
    if r.filter is not None:
        rows = rows.where(filter_column(r.filter, catalog))
    return rows.select(F.col(f"`{catalog.column(r.prop)}`").alias("value")).distinct().orderBy(F.asc_nulls_last("value")).limit(r.limit)
