"""Tables of maps: a row a key, and a map from names to values in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def collected(entries: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, m) from rows (key, name, value); of several values with a name the largest stays. A key's map is one row."""
    once = entries.groupBy(key, name).agg(F.max(value).alias("_value"))
    return once.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_value")))).alias("m"))


def fetched(maps: DataFrame, name: str, out: str = "value", column: str = "m") -> DataFrame:
    """The maps' value under a name, or null."""
    return maps.withColumn(out, F.try_element_at(column, F.lit(name)))


def keys_in_order(maps: DataFrame, column: str = "m") -> DataFrame:
    """maps with ``keys``: each map's names, sorted."""
    return maps.withColumn("keys", F.array_sort(F.map_keys(column)))


def key_after(maps: DataFrame, name: str | None, column: str = "m") -> DataFrame:
    """maps with ``next``: each map's first name after the given one (none: its first name); null at the end."""
    keys = F.map_keys(column) if name is None else F.filter(F.map_keys(column), lambda k: k > F.lit(name))
    return maps.withColumn("next", F.array_min(keys))


def has(column: str, name: str) -> Column:
    return F.map_contains_key(column, F.lit(name))


def stored(maps: DataFrame, changes: DataFrame, key: str, column: str = "m") -> DataFrame:
    """maps with those of ``changes`` (key, m) laid over them by name; keys that were not there are added."""
    new = changes.select(F.col(key).alias("_key"), F.col(column).alias("_m"))
    met = maps.join(new, F.col(key).eqNullSafe(F.col("_key")), "full")
    old, told = F.col(column), F.col("_m")
    both = F.when(told.isNull(), old).when(old.isNull(), told).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(told, k)), told))
    return met.select(F.coalesce(key, "_key").alias(key), both.alias(column))


def dropped(maps: DataFrame, names: list[str], column: str = "m") -> DataFrame:
    """maps without these names."""
    return maps.withColumn(column, F.map_filter(column, lambda k, _: ~k.isin(names)))


def cleared(maps: DataFrame, column: str = "m") -> DataFrame:
    return maps.withColumn(column, F.map_filter(column, lambda k, v: F.lit(False)))
