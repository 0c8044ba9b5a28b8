"""Filters on columns that hold dictionary keys instead of text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.predicates import NEGATED, all_of, any_of, filter_column
from ..model import VALUELESS, Condition, Filter, FilterGroup


def filters(cs: Iterable[Condition]) -> Iterable[Filter]:
    for c in cs:
        yield from filters(c.parts) if isinstance(c, FilterGroup) else (c,)


def where_coded(df: DataFrame, cs: Iterable[Condition], catalog: Catalog, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """df's rows that meet all conditions; dictionaries (value, key): of each property that is coded.

    Texts that are compared for (in)equality become keys, looked up before, as many as the conditions name; the scan then filters
    by whole numbers. A text that is in no dictionary equals nothing and differs from all. Patterns and orderings see the decoded
    text, by a join that Spark plans by the dictionary's size."""
    cs = list(cs)
    coded = [f for f in filters(cs) if f.prop in dictionaries and f.op not in VALUELESS]
    keys: dict[str, dict[object, int]] = {}
    for prop in dict.fromkeys(f.prop for f in coded if f.op in ("eq", "neq")):
        named = {v for f in coded if f.prop == prop and f.op in ("eq", "neq") for v in f.values}
        keys[prop] = {r["value"]: r["key"] for r in dictionaries[prop].where(F.col("value").isin(*named)).collect()}
    texts = dict.fromkeys(f.prop for f in coded if f.op not in ("eq", "neq"))
    out = df
    for i, prop in enumerate(texts):
        words = dictionaries[prop].select(F.col("key").alias(f"_key_{i}"), F.col("value").alias(f"_text_{prop}"))
        out = out.join(words, F.col(f"`{catalog.column(prop)}`") == F.col(f"_key_{i}"), "left")

    def column(c: Condition) -> Column:
        if isinstance(c, FilterGroup):
            return (all_of if c.how == "and" else any_of)(column(x) for x in c.parts)
        if c.prop not in dictionaries or c.op in VALUELESS:
            return filter_column(c, catalog)
        if c.prop in texts and c.op not in ("eq", "neq"):
            return filter_column(Filter(f"_text_{c.prop}", c.op, c.values, c.strict_negation), Catalog())
        own, known = F.col(f"`{catalog.column(c.prop)}`"), keys[c.prop]
        if c.op == "eq":
            return own.isin(*[known[v] for v in c.values if v in known]) if any(v in known for v in c.values) else F.lit(False)
        parts = [own != known[v] if v in known else own.isNotNull() for v in c.values]
        return all_of(parts) if c.strict_negation and c.op in NEGATED else any_of(parts)

    return out.where(all_of(column(c) for c in cs)).select(*[f"`{c}`" for c in df.columns])
