"""Lookup, override, resume and harmonised-union operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_multi
from ..functions.numeric import to_double_lenient
from .keys import join_on_keys

def _one_per_key(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df`` when no key repeats; an error otherwise (rows would multiply)."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    if again:
        raise ValueError(f"{what}: key {again[0][:-1]} repeats; give `order` so that its last row wins")
    return df


def last_wins(df: DataFrame, key, order: str) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (dict semantics)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_hl_r"))
            .select(*keys, "_hl_r.*"))


def lookup_left(df: DataFrame, lookup: DataFrame, key, order: str | None = None) -> DataFrame:
    """Left equi lookup: unmatched rows keep NULL attributes.  A repeated
    lookup key resolves to its last row by ``order``; without ``order`` it is
    an error.  The planner broadcasts by the lookup's size in bytes."""
    keys = [key] if isinstance(key, str) else list(key)
    lookup = last_wins(lookup, key, order).drop(order) if order is not None else _one_per_key(lookup, keys, "lookup_left")
    return df.join(lookup, key, "left")


def override(df: DataFrame, fixes: DataFrame, key: str, columns, order: str | None = None) -> DataFrame:
    """Upsert corrected values: ``coalesce(fix.c, df.c)`` per column; repeated
    fixes as in :func:`lookup_left`."""
    fixes = last_wins(fixes, key, order) if order is not None else _one_per_key(fixes, [key], "override")
    f = fixes.select(key, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    j = df.join(f, key, "left")
    return j.select(*[F.coalesce(F.col(f"_fix_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
                      for c in df.columns])


def resume_pending(samples: DataFrame, done: DataFrame, key) -> DataFrame:
    """Samples not yet enriched: anti join on the key (idempotent re-runs)."""
    keys = [key] if isinstance(key, str) else list(key)
    return samples.join(done.select(*keys), keys, "left_anti")


def latest_per_group(df: DataFrame, group_by, time_col: str) -> DataFrame:
    """Rows carrying the newest ``time_col`` of their group (all ties kept)."""
    group_by = list(group_by)
    newest = df.groupBy(*group_by).agg(F.max(time_col).alias("_hl_newest"))
    return (join_on_keys(df, newest, group_by).where(F.col(time_col).eqNullSafe(F.col("_hl_newest")))
            .drop("_hl_newest"))


# Column spellings of the field sources -> harmonised names.
HARMONISE_ALIASES = {
    "point": ["Sitio_cord", "Object_ID", "Ponto_de_coleta", "ponto", "sitio_cod", "point"],
    "date": ["Data", "data", "date"],
    "latitude": ["Latitude", "latitude", "lat"],
    "longitude": ["Longitude", "longitude", "long", "lon"],
    "turbidity": ["Turbidez", "turbidez", "turbidity"],
    "chlorophyll": ["Clorofila_a", "Clorofila_a_(µg_l)", "clorofila", "Clorofila", "chlorophyll"],
}
# Columns of the long source and how its parameters begin.
LONG_PARAMETER, LONG_RESULT = ("paramet", "parametro", "parameter"), ("result", "resultado")
LONG_NAMES = {"turbidity": "turbid", "chlorophyll": "clorofila|chlorophyll"}
HARMONISED_TYPES = {"point": "string", "date": "date", "latitude": "double", "longitude": "double",
                    "turbidity": "double", "chlorophyll": "double"}


def harmonise(df: DataFrame, source: str, aliases=None) -> DataFrame:
    """Rename a source's columns to the harmonised names and types: text
    dates in either layout, numbers with decimal commas, absent -> NULL.  A
    long source (parameter and result columns) keeps one row per measurement,
    its result in the column of its parameter."""
    aliases = aliases or HARMONISE_ALIASES
    parameter = next((c for c in LONG_PARAMETER if c in df.columns), None)
    result = next((c for c in LONG_RESULT if c in df.columns), None)
    if parameter and result:
        for name, begin in LONG_NAMES.items():
            if not any(a in df.columns for a in aliases[name]):
                df = df.withColumn(name, F.when(F.lower(F.trim(F.col(parameter))).rlike(f"^({begin})"), F.col(result)))
    cols = []
    for name, typ in HARMONISED_TYPES.items():
        src = next((a for a in aliases[name] if a in df.columns), None)
        if src is None:
            cols.append(F.lit(None).cast(typ).alias(name))
            continue
        c = F.col(f"`{src}`")
        if typ == "date":
            dt = dict(df.dtypes)[src]
            c = c.cast("date") if dt in ("date", "timestamp", "timestamp_ntz") else parse_date_multi(c)
        elif typ == "double":
            c = to_double_lenient(c)
        else:
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(F.lit(source).alias("source"), *cols)


def harmonise_union(sources: dict[str, DataFrame], dedupe: bool = False) -> DataFrame:
    """Row-wise union of harmonised sources (no key join, no de-duplication
    unless ``dedupe``)."""
    out = None
    for name, df in sources.items():
        h = harmonise(df, name)
        out = h if out is None else out.unionByName(h, allowMissingColumns=True)
    return out.dropDuplicates([c for c in out.columns if c != "source"]) if dedupe else out


def coalesce_by_key(df: DataFrame, keys, order: str) -> DataFrame:
    """Optional: one row per key, each value column the last non-NULL one."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
                                   for c in rest])
