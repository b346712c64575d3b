"""Applying a feed of inserts, updates and deletes that came repeated and out of order.

Transactions are the changes of the writers: ``changes`` says which ids each spans and what it depends on, the ops say
which of them came. A transaction is assembled when all its ids are there; a writer's transactions are committed in the
order of their ids, up to the first that is missing or incomplete (a gap), and no further than the first that depends
on one that is not committed. What is exposed is what lies below these commit watermarks; all else is held. Keys do not
conflict with one another: each is folded on its own in commit order, (lamport, peer as a number, counter), with
partial folds before the shuffle, so a hot key or container never meets in one task. Repeats fold away, as an op is
never greater than itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ids import atoms, container_kind, id_counter, peer_number
from tidelog.operators.incremental import watermarks
from tidelog.operators.intervals import periods
from tidelog.plans.storage import cut

#: The two spellings of the ops of a Map.
WRITES = ["insert", "LoroValue"]
REMOVALS = ["delete", "DeleteOnce"]

WRITER = ["doc_id", "peer"]
KEY = ["doc_id", "container", "map_key"]


def transactions(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, end_counter, deps, whole): every change once, and whether all its ids were delivered.

    The ids of a change are those of its ops, ``ops.change_counter`` naming the change; overlapping ops of one change
    count their ids once if they begin at one id, as repeats do. Of a change delivered with different ends the longest
    counts. Rows with a null id are none.
    """
    named = [F.col(c).isNotNull() for c in (*WRITER, "counter", "change_counter")]
    came = ops.select(*WRITER, "change_counter", "counter", atoms(F.col("len")).alias("_n"))
    for n in named:
        came = came.filter(n)
    # one exchange by transaction serves both steps
    came = came.repartition(*WRITER, "change_counter").groupBy(*WRITER, "change_counter", "counter").agg(F.max("_n").alias("_n")).groupBy(*WRITER, "change_counter").agg(F.sum("_n").alias("_got"))
    told = changes.filter("doc_id is not null and peer is not null and counter is not null and end_counter > counter")
    told = told.groupBy(*WRITER, "counter").agg(F.max_by(F.struct("end_counter", "deps"), F.col("end_counter")).alias("c")).select(*WRITER, "counter", "c.*")
    both = told.join(came.withColumnRenamed("change_counter", "counter"), [*WRITER, "counter"], "left")
    return both.select(*WRITER, "counter", "end_counter", "deps", F.coalesce(F.col("_got") >= F.col("end_counter") - F.col("counter"), F.lit(False)).alias("whole"))


def commit_watermarks(txs: DataFrame) -> DataFrame:
    """(doc_id, peer, watermark) of ``transactions``: up to where each writer's history is committed.

    It begins as the end of the whole transactions that follow one another from id 0, and is lowered to the beginning
    of the first transaction that depends on an id behind another writer's watermark, until nothing moves. A round
    looks at the dependencies on writers lowered in the round before only, so there are as many rounds as a lost
    transaction has writers depending on it in a row.
    """
    txs = cut(txs, "transactions")
    whole = txs.filter("whole").select(*WRITER, F.col("counter").alias("lo"), F.col("end_counter").alias("hi"))
    first = watermarks(periods(whole, WRITER))
    at = cut(txs.select(*WRITER).distinct().join(first, WRITER, "left").fillna(0, ["watermark"]), "watermarks")
    needs = txs.select(*WRITER, "counter", F.explode("deps").alias("d")).select(*WRITER, "counter", F.split_part("d", F.lit("@"), F.lit(2)).alias("_of"), id_counter(F.col("d")).alias("_dep"))
    inside = needs.join(at, WRITER).filter("counter < watermark").drop("watermark")  # what is held cannot be held more
    inside = cut(inside.filter("_dep is not null and _of <> peer"), "needs")
    # before the first round every writer counts as lowered, one that delivered nothing to 0
    held = inside.join(at.select("doc_id", F.col("peer").alias("_of"), F.col("watermark").alias("_w")), ["doc_id", "_of"], "left").filter("_dep >= coalesce(_w, 0)")
    while True:
        lower = held.groupBy(*WRITER).agg(F.min("counter").alias("_to")).join(at, WRITER).filter("_to < watermark").select(*WRITER, F.col("_to").alias("watermark"))
        lower = cut(lower, "lowered")
        if lower.isEmpty():
            return at
        at = cut(at.join(lower.withColumnRenamed("watermark", "_to"), WRITER, "left").select(*WRITER, F.least("watermark", "_to").alias("watermark")), "watermarks")
        held = inside.join(lower.select("doc_id", F.col("peer").alias("_of"), F.col("watermark").alias("_w")), ["doc_id", "_of"]).filter("_dep >= _w")


def map_ops(ops: DataFrame) -> DataFrame:
    """The ops of Map containers. Rows with a null id, key, container or lamport, or of another op kind, are none."""
    kept = ops.filter((container_kind(F.col("container")) == "Map") & F.col("vkind").isin(WRITES + REMOVALS))
    for c in ("doc_id", "map_key", "lamport", "peer", "counter"):
        kept = kept.filter(F.col(c).isNotNull())
    return kept.select(*KEY, "peer", "counter", "lamport", "vkind", "val_json")


def _latest(where: Column) -> Column:
    order = F.struct("lamport", "_peer", "counter", "_writes", "val_json")
    return F.max(F.when(where, order))


def replay(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, container, map_key, committed, held): per key the last op below the commit watermarks, and the last of
    those held back; each struct(lamport, _peer, counter, _writes, val_json), null if there is none. Two different
    contents under one op id (which no honest writer makes) are settled in favour of the write with the greatest value
    text. Ops of changes that were not delivered are held."""
    marks = commit_watermarks(transactions(changes, ops))
    marked = map_ops(ops).join(marks, WRITER, "left")
    inside = F.coalesce(F.col("counter") < F.col("watermark"), F.lit(False))
    rows = marked.select(*KEY, "lamport", "counter", "val_json", peer_number(F.col("peer")).alias("_peer"), F.col("vkind").isin(WRITES).alias("_writes"), inside.alias("_in"))
    return rows.groupBy(*KEY).agg(_latest(F.col("_in")).alias("committed"), _latest(~F.col("_in")).alias("held"))


def map_entries(changes: DataFrame, ops: DataFrame, close: bool = False) -> DataFrame:
    """(doc_id, container, map_key, peer, counter, val_json): the entries each Map holds.

    What is exposed is the committed state. ``close=True`` ends the feed: gaps will not be filled any more, so what is
    held is applied to the committed state as well, in the same order, and the entries are those of all ops delivered.
    A removed key gives no row; a key set to JSON null is held. Empty tables give no rows.
    """
    state = replay(changes, ops)
    last = F.greatest("committed", "held") if close else F.col("committed")
    state = state.select(*KEY, last.alias("_last")).filter("_last._writes")
    last = F.col("_last")
    return state.select(*KEY, last["_peer"].cast("string").alias("peer"), last["counter"].alias("counter"), last["val_json"].alias("val_json"))
