"""Filling containers of fixed capacity with items of varying length.

Items larger than a capacity are split: all their full pieces are containers by themselves. The rest is packed by
best fit, largest first, in shards of bounded size that are packed independently, so that a shard costs one container
that is not full and no task holds more than a shard. Within a shard open containers are ordered by what is left in
them; each carries a bitmap of the sources and one of the duplicate clusters it holds. The search begins at the least
residual that fits and goes on to the next until a compatible container is found: one that holds no other copy of the
item's cluster. Where a cluster has more copies than the shard needs containers, they cannot all lie apart: the cluster
then has as many bits as an even spread needs, and if no container has one of them free, the tightest takes the copy
before a new one is opened. Of equally tight containers, one without the item's source is preferred.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.storage import cut

#: Items packed together. A shard leaves about one container unfilled.
SHARD_ITEMS = 20_000
#: The most kinds of containers; they are a parameter table.
MOST_BINS = 1_000

_PACKED = pa.schema([("bin_name", pa.string()), ("container_id", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])
_DDL = "bin_name string, container_id string, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint"


class Shelf:
    """The open containers of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []  # those at which containers are open, ascending
        self.at: dict[int, dict[int, list[int]]] = {}  # residual -> bitmap of sources -> containers
        self.clusters: list[int] = []  # container -> bitmap of the repeated clusters in it, a bit per copy allowed

    def _take(self, size: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        """The tightest compatible container as (container, residual, sources), taken off the shelf."""
        for k in range(bisect_left(self.residuals, size), len(self.residuals)):
            left = self.residuals[k]
            groups = self.at[left]
            for sources in sorted(groups, key=lambda s: (s & source != 0, s)):
                held = groups[sources]
                for i in range(len(held) - 1, -1, -1):
                    if not cluster or self.clusters[held[i]] & cluster != cluster:
                        box = held.pop(i)
                        if not held:
                            del groups[sources]
                            if not groups:
                                del self.at[left]
                                self.residuals.pop(k)
                        return box, left, sources
        return None

    def put(self, size: int, source: int, cluster: int) -> int:
        many = cluster & (cluster - 1)
        found = self._take(size, source, cluster) or many and self._take(size, source, 0)
        box, left, sources = found or (len(self.clusters), self.capacity, 0)
        if box == len(self.clusters):
            self.clusters.append(0)
        free = cluster & ~self.clusters[box]
        self.clusters[box] |= free & -free
        left -= size
        if left not in self.at:
            self.at[left] = {}
            insort(self.residuals, left)
        self.at[left].setdefault(sources | source, []).append(box)
        return box


def allowed_copies(items: list[tuple[int, str | None, int | None]], capacity: int) -> dict[int, int]:
    """How many copies of each repeated cluster one container may hold: one, or what spreading them evenly over the
    least number of containers takes."""
    containers = max(1, -(-sum(size for size, _, _ in items) // capacity))
    counts = Counter(c for _, _, c in items if c is not None)
    return {c: -(-n // containers) for c, n in counts.items() if n > 1}


def pack(items: list[tuple[int, str | None, int | None]], capacity: int) -> list[int]:
    """The container of each (size, source, cluster), sizes descending. Items of no cluster conflict with nothing."""
    repeated, used = {}, 0
    for c, n in allowed_copies(items, capacity).items():
        repeated[c] = (1 << n) - 1 << used
        used += n
    bit: dict[str | None, int] = {}
    shelf = Shelf(capacity)
    return [shelf.put(size, bit.setdefault(source, 1 << len(bit)), repeated.get(cluster, 0)) for size, source, cluster in items]


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, largest item first."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        name, shard, capacity = rows[0][:3]
        boxes = pack([(r[6], r[7], r[8]) for r in rows], capacity)
        out = [(name, f"{name}/{shard}/{b}", r[3], r[4], r[5], r[6]) for r, b in zip(rows, boxes)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PACKED)], schema=_PACKED)

    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][:2] != r[:2]:
                yield done(held)
                held = []
            held.append(r)
    if held:
        yield done(held)


def fill(items: DataFrame, bins: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(bin_name, container_id, doc_id, piece, first_token, n_tokens): where every item, or piece of one, lies.

    ``items`` holds (doc_id, source, n_tokens, copy_class), ``bins`` (bin_name, capacity_tokens). An item is split only
    if it alone exceeds the capacity, into full pieces and one rest. Every item is placed for every kind of bin; those
    without tokens (null or empty texts) take up no room but are listed. Bins with a null name or a capacity that is
    null or below 1 are none. Two items of one copy class share a container only where there are more copies than
    containers, and then as evenly as tight packing lets them (``allowed_copies``, per shard).
    """
    kinds = bins.filter("bin_name is not null and capacity_tokens > 0").select("bin_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    kinds = kinds.limit(MOST_BINS + 1).collect()  # a parameter table
    if len(kinds) > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} kinds of bins")
    items = cut(items.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "copy_class"), "sizes")
    shards = max(1, -(-items.count() // shard_items))
    if not kinds:
        return items.sparkSession.createDataFrame([], _DDL)
    each = F.array(*[F.struct(F.lit(k["bin_name"]).alias("bin_name"), F.lit(k["capacity"]).cast("bigint").alias("capacity")) for k in kinds])
    wanted = items.withColumn("b", F.explode(each)).select("*", "b.*").drop("b").withColumn("full", F.expr("n_tokens div capacity"))
    rest = F.col("n_tokens") - F.col("full") * F.col("capacity")
    whole = wanted.filter("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    whole = whole.select("bin_name", F.concat_ws("/", "bin_name", F.concat(F.lit("d"), F.col("doc_id")), "piece").alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"))
    loose = wanted.withColumn("rest", rest).filter("rest > 0 or n_tokens = 0").select("bin_name", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"), "capacity", "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), F.col("rest").alias("n_tokens"), "source", "copy_class")
    placed = loose.repartition(min(shards * len(kinds), 100_000), "bin_name", "shard").sortWithinPartitions("bin_name", "shard", F.col("n_tokens").desc(), "doc_id")
    return whole.unionByName(placed.mapInArrow(_pack_shards, _DDL))


def fill_report(packed: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_name, containers, pieces, tokens, unused, fill): how full the containers of each kind are."""
    got = packed.groupBy("bin_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k")).groupBy("bin_name").agg(F.count("*").alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return got.join(bins.distinct(), "bin_name").select("bin_name", "containers", "pieces", "tokens", (room - F.col("tokens")).cast("bigint").alias("unused"), (F.col("tokens") / room).alias("fill"))
