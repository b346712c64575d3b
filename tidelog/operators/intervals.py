"""Overlapping and gapped intervals per entity, by a sweep line.

Every boundary becomes an event (+1 where an interval starts, -1 where it ends); the prefix sum of the events is the
number of intervals open at a place. It is computed in two levels so that no task ever holds all the events of one
entity: events are added up per place before they are shuffled, places are grouped into blocks of ``BLOCK`` ids, the
sum within a block and the sum over whole blocks are windows of their own. A block holds at most ``BLOCK`` places
whatever the number of intervals, and an entity with 32-bit ids has at most 2^31 / ``BLOCK`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids per block, as a power of two.
BLOCK_BITS = 16


def block_of(pos: Column) -> Column:
    return F.shiftright(pos.cast("bigint"), BLOCK_BITS)


def _ends(keys: list[str]):
    """Windows within a block, and over the blocks before or after."""
    inside = Window.partitionBy(*keys, "_blk").orderBy("_pos")
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    return inside, blocks


def boundaries(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, _blk, _pos, _d): the places at which the number of open intervals changes, and by how much.

    Rows with a null in a key or an end, and empty or backward intervals, cover nothing.
    """
    usable = F.col(hi) > F.col(lo)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    ends = F.array(
        F.struct(F.col(lo).cast("bigint").alias("_pos"), F.lit(1).cast("bigint").alias("_d")),
        F.struct(F.col(hi).cast("bigint").alias("_pos"), F.lit(-1).cast("bigint").alias("_d")),
    )
    events = spans.filter(usable).select(*keys, F.inline(ends)).withColumn("_blk", block_of(F.col("_pos")))
    return events.groupBy(*keys, "_blk", "_pos").agg(F.sum("_d").alias("_d")).filter("_d <> 0")


def _turns(spans: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, _blk, _pos, _starts): the places where coverage begins or ends."""
    events = boundaries(spans, keys, lo, hi)
    inside, blocks = _ends(keys)
    totals = events.groupBy(*keys, "_blk").agg(F.sum("_d").alias("_t"))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_blk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = events.join(offsets, [*keys, "_blk"]).withColumn("_n", F.col("_off") + F.sum("_d").over(upto))
    return active.filter((F.col("_n") == 0) | (F.col("_n") == F.col("_d"))).select(*keys, "_blk", "_pos", (F.col("_n") > 0).alias("_starts"))


def periods_and_gaps(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, what, lo, hi): ``what = 'period'`` for each maximal covered run [lo, hi), ``'gap'`` for each [lo, hi)
    between two neighbouring periods of one entity. Intervals that touch are one period. Empty input gives no rows."""
    turns = _turns(spans, keys, lo, hi)
    inside, blocks = _ends(keys)
    firsts = turns.groupBy(*keys, "_blk").agg(F.min("_pos").alias("_first"))
    follow = firsts.select(*keys, "_blk", F.lead("_first").over(blocks).alias("_next_first"))
    joined = turns.join(follow, [*keys, "_blk"])
    until = F.coalesce(F.lead("_pos").over(inside), F.col("_next_first"))
    out = joined.select(*keys, F.when(F.col("_starts"), F.lit("period")).otherwise(F.lit("gap")).alias("what"), F.col("_pos").alias("lo"), until.alias("hi"))
    return out.filter(F.col("hi").isNotNull())


def periods(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, lo, hi): the union of the intervals of each entity as maximal runs."""
    return periods_and_gaps(spans, keys, lo, hi).filter("what = 'period'").drop("what")


def uncovered(items: DataFrame, cover: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, lo, hi) of ``items`` not inside one row of ``cover``, which must hold disjoint maximal periods (keys, lo, hi).

    Items and periods share one timeline per entity: the last period to start at or before an item is the only one
    that can hold it, and, periods being disjoint, its end is the greatest end so far. That running maximum is taken
    within blocks and carried over blocks, as above; there is no range join. Items of equal keys and start are one
    row, with the greatest end. Items with a null key or end give no row; empty items are inside anything.
    """
    items = items.groupBy(*keys, F.col(lo).cast("bigint").alias("_pos")).agg(F.max(F.col(hi).cast("bigint")).alias("_end")).filter("_end > _pos")
    for k in keys:
        items = items.filter(F.col(k).isNotNull())
    line = items.select(*keys, "_pos", F.lit(1).alias("_kind"), "_end").unionByName(
        cover.select(*keys, F.col("lo").cast("bigint").alias("_pos"), F.lit(0).alias("_kind"), F.col("hi").cast("bigint").alias("_end"))
    ).withColumn("_blk", block_of(F.col("_pos")))
    reach = F.when(F.col("_kind") == 0, F.col("_end"))
    inside = Window.partitionBy(*keys, "_blk").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = line.filter("_kind = 0").groupBy(*keys, "_blk").agg(F.max("_end").alias("_m"))
    homes = line.filter("_kind = 1").select(*keys, "_blk").distinct()
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(homes, [*keys, "_blk"], "full").select(*keys, "_blk", F.max("_m").over(before).alias("_carry"))
    seen = line.join(carried, [*keys, "_blk"]).withColumn("_reach", F.greatest(F.max(reach).over(inside), F.col("_carry")))
    out = seen.filter((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_reach") < F.col("_end"))))
    return out.select(*keys, F.col("_pos").alias(lo), F.col("_end").alias(hi))


def running_max(rows: DataFrame, keys: list[str], pos: str, order: list[str], value: Column, name: str, own: bool = False) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` of the rows before each (and of itself, if ``own``) in the order
    of (pos, order) within its keys. Taken within blocks of ``pos`` and carried over blocks, so that no task holds all
    rows of one key. Rows with a null key or place are left out."""
    kept = rows.filter(F.col(pos).isNotNull()).withColumn("_blk", block_of(F.col(pos))).withColumn("_val", value)
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    most = kept.groupBy(*keys, "_blk").agg(F.max("_val").alias("_m"))
    carry = most.select(*keys, "_blk", F.max("_m").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    return kept.join(carry, [*keys, "_blk"]).withColumn(name, F.greatest(F.max("_val").over(inside), F.col("_carry"))).drop("_blk", "_val", "_carry")
