"""A/B experiments: buckets, assignment, bounded event log, overlays, recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import bucket_hash


def bucket(user: Column, experiment: Column) -> Column:
    """0 to 99 for a user in an experiment."""
    return (bucket_hash(F.concat(user, experiment)) % 100).cast("int")


def assign(user: Column, experiment: Column, split: Column, override: Column, stored: Column) -> Column:
    """Variant: an override, else what is stored, else B below the split and A above."""
    return F.coalesce(override, stored, F.when(bucket(user, experiment) < split, "B").otherwise("A"))


def event_tail(events: DataFrame, keys: list[str], order: list[Column], limit: int = 500) -> DataFrame:
    """The last `limit` events of each log."""
    return events.withColumn("fl_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("fl_rank") <= limit).drop("fl_rank")


def overlay(base: Column, over: Column) -> Column:
    """base with the entries of over in place of its own."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def recent(item: Column, before: Column, limit: int) -> Column:
    """The list with an item in front, once, cut to a length."""
    return F.slice(F.array_distinct(F.concat(F.array(item), before)), 1, limit)
