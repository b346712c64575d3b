"""Aggregating containers: maps by the last writer, counters by sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ids import container_kind, peer_number

KEY = ["doc_id", "container", "map_key"]


def map_values(ops: DataFrame) -> DataFrame:
    """(doc_id, container, map_key, val_json, peer, counter): the entries of each Map; the last by (lamport, peer,
    counter) wins, a removed key is gone. Repeated ops are harmless."""
    kept = ops.filter((container_kind(F.col("container")) == "Map") & F.col("map_key").isNotNull())
    writes = ~F.col("vkind").isin("delete", "DeleteOnce")
    order = F.struct("lamport", peer_number(F.col("peer")).alias("p"), "counter", writes.alias("w"), "val_json", "peer")
    last = kept.groupBy(*KEY).agg(F.max(order).alias("m"))
    return last.filter("m.w").select(*KEY, "m.val_json", "m.peer", "m.counter")


def counter_values(ops: DataFrame) -> DataFrame:
    """(doc_id, container, total): the sum of each Counter's increments, every op id once.

    Whole increments are added as integers, so their sum does not depend on the order; fractions are added as doubles.
    """
    kept = ops.filter(container_kind(F.col("container")) == "Counter")
    once = kept.groupBy("doc_id", "peer", "counter", "container").agg(F.min("val_json").alias("v"))
    number = F.col("v").try_cast("double")
    whole = number == F.floor(number)
    parts = once.groupBy("doc_id", "container").agg(F.sum(F.when(whole, number.cast("bigint"))).alias("i"), F.sum(F.when(~whole, number)).alias("f"))
    return parts.select("doc_id", "container", (F.coalesce("i", F.lit(0)) + F.coalesce("f", F.lit(0.0))).alias("total"))
