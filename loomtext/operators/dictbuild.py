"""Dictionaries as tables (slot, key, value, ord): changes and metadata as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(base: DataFrame, more: DataFrame) -> DataFrame:
    """Later rows win: first by table, then by ord."""
    both = base.withColumn("__t", F.lit(0)).unionByName(more.withColumn("__t", F.lit(1)))
    newest = F.struct("__t", "ord")
    return both.groupBy("slot", "key").agg(F.max_by("value", newest).alias("value"), F.max_by("ord", newest).alias("ord"))


def override(base: DataFrame, more: DataFrame) -> DataFrame:
    """Slots of the second table replace those of the first."""
    kept = base.join(F.broadcast(more.select("slot").distinct()), "slot", "left_anti")  # at most 21 slots
    return kept.unionByName(append(more.limit(0), more).select(*kept.columns))


def _mask(size):
    return F.bit_or(F.when(size <= 64, F.expr("shiftleft(1L, __len - 1)")))


def metadata(dicts: DataFrame) -> DataFrame:
    """By slot: key lengths in UTF-16 units as min, max, bit mask (up to 64) and the set of longer ones."""
    rows = dicts.withColumn("__len", (F.octet_length(F.encode("key", "UTF-16LE")) / 2).cast("int"))
    return rows.groupBy("slot").agg(
        F.min("__len").alias("min_len"),
        F.max("__len").alias("max_len"),
        F.coalesce(_mask(F.col("__len")), F.lit(0).cast("long")).alias("len_mask"),
        F.sort_array(F.collect_set(F.when(F.col("__len") > 64, F.col("__len")))).alias("long_lens"),
        F.count("*").alias("n_keys"),
    )


def starters(dicts: DataFrame, by_slot: bool = True) -> DataFrame:
    """By first character (and slot) the mask of key lengths; without slots it is their union."""
    rows = dicts.withColumn("__len", (F.octet_length(F.encode("key", "UTF-16LE")) / 2).cast("int")).withColumn("starter", F.substring("key", 1, 1))
    keys = ["slot", "starter"] if by_slot else ["starter"]
    return rows.groupBy(*keys).agg(F.coalesce(_mask(F.col("__len")), F.lit(0).cast("long")).alias("mask"), F.max("__len").alias("max_len"))


def merge(dicts: DataFrame, slots: list[str]) -> DataFrame:
    """(key, value) of a round: between equal keys the slot named first wins."""
    rank = F.array_position(F.array(*map(F.lit, slots)), F.col("slot"))
    return dicts.where(F.col("slot").isin(slots)).groupBy("key").agg(F.min_by("value", rank).alias("value"))


def to_json(dicts: DataFrame) -> DataFrame:
    """(slot, json): each slot's map in order of ord."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("ord", "key", "value"))), lambda e: F.struct(e["key"], e["value"]))
    return dicts.groupBy("slot").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select("slot", F.posexplode(F.map_entries(F.from_json("json", "map<string,string>"))).alias("ord", "e")).select("slot", F.col("e.key").alias("key"), F.col("e.value").alias("value"), F.col("ord").cast("long").alias("ord"))
