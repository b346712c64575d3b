"""Set-valued operators of an operation log: overlaps, versions, frontiers, exports, conflicts and causality."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.ids import atoms, container_kind, id_counter, op_id, peer_number
from tidelog.operators.intervals import block_of, periods, running_max
from tidelog.plans.grouped import per_group

WRITER = ["doc_id", "peer"]


def clip_overlaps(ops: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, len) of each delivered range that is new, so that every op id is there once.

    Of overlapping ranges the one that begins first keeps the ids, of equal beginnings the longest. Ranges that bring
    nothing new are gone. Rows with a null id are no ops.
    """
    spans = ops.select(*WRITER, "counter", (F.col("counter") + atoms(F.col("len"))).alias("_end")).filter("doc_id is not null and peer is not null and counter is not null")
    spans = spans.groupBy(*WRITER, "counter").agg(F.max("_end").alias("_end"))
    start = F.greatest(F.col("counter"), F.col("_reach"))
    reached = running_max(spans, WRITER, "counter", [], F.col("_end"), "_reach")
    return reached.filter("_reach is null or _end > _reach").select(*WRITER, start.alias("counter"), (F.col("_end") - start).alias("len"))


def locate(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, change_counter, lamport): each of ``ids`` (doc_id, peer, counter) with the delivered change
    that holds it, and the op's own lamport; both null where none does. Ids asked for twice are one row.

    Ids and changes share one line per writer: the last change to begin at or before an id is the only one that can
    hold it, unless changes overlap; then the one that begins last counts.
    """
    asked = ids.select(*WRITER, "counter").distinct()
    held = _changes_once(changes)
    whole = F.struct(F.col("counter").alias("c"), F.col("end_counter").alias("e"), F.col("lamport").alias("l"))
    line = held.select(*WRITER, "counter", F.lit(0).alias("_kind"), whole.alias("_w")).unionByName(asked.select(*WRITER, "counter", F.lit(1).alias("_kind"), F.lit(None).cast("struct<c:bigint,e:bigint,l:bigint>").alias("_w")))
    found = running_max(line, WRITER, "counter", ["_kind"], F.col("_w"), "_in").filter("_kind = 1")
    inside = F.col("counter") < F.col("_in.e")
    return found.select(*WRITER, "counter", F.when(inside, F.col("_in.c")).alias("change_counter"), F.when(inside, F.col("_in.l") + F.col("counter") - F.col("_in.c")).alias("lamport"))


def lamport_faults(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, lamport, dep, dep_lamport): changes whose lamport does not exceed that of an op they
    depend on, or of their writer's op before. No document takes them in; dependencies that were not delivered are no
    fault. Empty logs have none."""
    once = _changes_once(changes)
    named = F.explode(F.array_union(F.coalesce("deps", F.array()), F.when(F.col("counter") > 0, F.array(op_id(F.col("counter") - 1, F.col("peer")))).otherwise(F.array().cast("array<string>"))))
    edges = once.select(*WRITER, "counter", "lamport", named.alias("dep"))
    edges = edges.withColumn("_dp", F.split_part("dep", F.lit("@"), F.lit(2))).withColumn("_dc", id_counter(F.col("dep")))
    known = locate(changes, edges.select("doc_id", F.col("_dp").alias("peer"), F.col("_dc").alias("counter")))
    known = known.select("doc_id", F.col("peer").alias("_dp"), F.col("counter").alias("_dc"), F.col("lamport").alias("dep_lamport"))
    return edges.join(known, ["doc_id", "_dp", "_dc"]).filter("dep_lamport >= lamport").select(*WRITER, "counter", "lamport", "dep", "dep_lamport")


def version_vector(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, end): the end of what each writer delivered."""
    return changes.groupBy(*WRITER).agg(F.max("end_counter").alias("end"))


def frontiers(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, counter): the ids no delivered change depends on. A writer's next change covers its last."""
    tips = version_vector(changes).select(*WRITER, (F.col("end") - 1).alias("counter"))
    deps = changes.select("doc_id", F.explode("deps").alias("d")).select("doc_id", F.split_part("d", F.lit("@"), F.lit(2)).alias("peer"), id_counter(F.col("d")).alias("counter"))
    return tips.join(deps, [*WRITER, "counter"], "left_anti")


def export_from(changes: DataFrame, version: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, end_counter, lamport, deps): what lies past ``version`` (doc_id, peer, end), each once.

    A change that is only partly past it is cut: the rest depends on its own previous op alone, and its lamport grows
    by what was cut off. Writers not in ``version``, and ends below 0, count from 0.
    """
    once = changes.groupBy(*WRITER, "counter").agg(F.max_by(F.struct("end_counter", "lamport", "deps"), F.col("end_counter")).alias("c")).select(*WRITER, "counter", "c.*")
    held = once.join(version.select(*WRITER, F.col("end").alias("_v")), WRITER, "left").withColumn("_v", F.greatest(F.coalesce("_v", F.lit(0)), F.lit(0)))
    return _cut(held.filter("end_counter > _v").withColumn("_from", F.greatest("counter", "_v")).withColumn("_to", F.col("end_counter")))


def _cut(rows: DataFrame, *more: str) -> DataFrame:
    off = F.col("_from") - F.col("counter")
    deps = F.when(off > 0, F.array(op_id(F.col("_from") - 1, F.col("peer")))).otherwise(F.col("deps"))
    return rows.select(*WRITER, *more, F.col("_from").alias("counter"), F.col("_to").alias("end_counter"), (F.col("lamport") + off).alias("lamport"), deps.alias("deps"))


def export_ranges(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, peer, layer, counter, end_counter, lamport, deps): the parts of changes within ``spans`` (doc_id, peer,
    start, end), a backward span reading the other way. Overlapping spans are merged; the k-th of a writer is layer k.

    The interval join goes by blocks of ids: both sides name the blocks they touch, and a pair is taken in the block
    where the later of the two begins, so it is found once.
    """
    want = spans.select(*WRITER, F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"))
    want = periods(want, WRITER).withColumn("layer", F.row_number().over(Window.partitionBy(*WRITER).orderBy("lo")))
    once = changes.groupBy(*WRITER, "counter").agg(F.max_by(F.struct("end_counter", "lamport", "deps"), F.col("end_counter")).alias("c")).select(*WRITER, "counter", "c.*").filter("end_counter > counter")
    touched = lambda lo, hi: F.explode(F.sequence(block_of(F.col(lo)), block_of(F.col(hi) - 1)))
    pairs = once.withColumn("_blk", touched("counter", "end_counter")).join(want.withColumn("_blk", touched("lo", "hi")), [*WRITER, "_blk"])
    pairs = pairs.withColumn("_from", F.greatest("counter", "lo")).withColumn("_to", F.least("end_counter", "hi"))
    return _cut(pairs.filter((F.col("_from") < F.col("_to")) & (block_of(F.col("_from")) == F.col("_blk"))), "layer")


def conflicts(ops: DataFrame, content: list[str]) -> DataFrame:
    """(doc_id, peer, counter, versions): op ids that were delivered with more than one content."""
    return ops.groupBy(*WRITER, "counter").agg(F.countDistinct(F.xxhash64(*content)).alias("versions")).filter("versions > 1")


def _changes_once(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*WRITER, "counter").agg(F.max_by(F.struct("end_counter", "lamport", "deps"), F.col("end_counter")).alias("c")).select(*WRITER, "counter", "c.*").withColumn("_p", peer_number(F.col("peer")))


def _gated(changes: DataFrame) -> DataFrame:
    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        held: dict[str, int] = {}
        for r in rows:
            ready = r["counter"] <= held.get(r["peer"], 0)
            for d in r["deps"] or ():
                c, _, p = d.partition("@")
                ready = ready and int(c) < held.get(p, 0)
            if ready:
                held[r["peer"]] = max(held.get(r["peer"], 0), r["end_counter"])
            yield r["doc_id"], r["peer"], r["counter"], r["end_counter"], r["lamport"], r["deps"], "applied" if ready else "pending"

    return per_group(_changes_once(changes), ["doc_id"], ["lamport", "_p", "counter"], work, "doc_id string, peer string, counter bigint, end_counter bigint, lamport bigint, deps array<string>, status string", stream=True)


def gate(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, status): ``applied`` if all a change depends on was delivered and applied, and its
    writer's ids before it too; ``pending`` otherwise. A change's lamport exceeds that of what it depends on, so one
    pass per document in that order decides."""
    return _gated(changes).select(*WRITER, "counter", "status")


def applied(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, end_counter, lamport, deps): the changes ``gate`` lets through, each once. Versions,
    frontiers and exports of these are those of a document; of all that was delivered they count what waits, too."""
    return _gated(changes).filter("status = 'applied'").drop("status")


def past_versions(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, change_counter, past): what the author of each change had seen, as a map peer -> end.

    One pass per document in lamport order, merging the versions of what a change depends on. Dependencies that were
    not delivered count with their own id alone.
    """

    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        byp: dict[str, list[tuple[int, int, dict]]] = {}
        for r in rows:
            seen: dict[str, int] = {}
            deps = [d.partition("@") for d in r["deps"] or ()]
            if r["counter"] > 0:
                deps.append((str(r["counter"] - 1), "@", r["peer"]))
            for c, _, p in deps:
                c = int(c)
                for lo, hi, past in reversed(byp.get(p, ())):
                    if lo <= c < hi:
                        for q, end in past.items():
                            if seen.get(q, 0) < end:
                                seen[q] = end
                        break
                if seen.get(p, 0) <= c:
                    seen[p] = c + 1
            byp.setdefault(r["peer"], []).append((r["counter"], r["end_counter"], seen))
            yield r["doc_id"], r["peer"], r["counter"], list(seen.items())

    got = per_group(_changes_once(changes), ["doc_id"], ["lamport", "_p", "counter"], work, "doc_id string, peer string, change_counter bigint, past array<struct<p:string,end:bigint>>", stream=True)
    return got.withColumn("past", F.map_from_entries("past"))


def merge_adjacent(changes: DataFrame, interval: int = 1000) -> DataFrame:
    """(doc_id, peer, counter, end_counter, lamport, ts, parts): changes as a store keeps them.

    A change joins the one before it if it follows on it in ids and lamport, depends on nothing but its last op, says
    the same message and is at most ``interval`` seconds younger. Repeated changes count once.
    """
    one = changes.groupBy(*WRITER, "counter").agg(F.max_by(F.struct("end_counter", "lamport", "ts", "deps", F.coalesce("msg", F.lit("")).alias("msg")), F.struct("end_counter", F.coalesce("msg", F.lit("")), "ts")).alias("c")).select(*WRITER, "counter", "c.*")
    w = Window.partitionBy(*WRITER).orderBy("counter")
    before = lambda c: F.lag(c).over(w)
    joins = (
        (before("end_counter") == F.col("counter"))
        & (before("lamport") + F.col("counter") - before("counter") == F.col("lamport"))
        & (F.size("deps") == 1)
        & (F.col("deps")[0] == op_id(F.col("counter") - 1, F.col("peer")))
        & (before("msg") == F.col("msg"))
        & (F.col("ts") - before("ts") <= interval)
    )
    grouped = one.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    got = grouped.groupBy(*WRITER, "_g").agg(F.min("counter").alias("counter"), F.max("end_counter").alias("end_counter"), F.min("lamport").alias("lamport"), F.min_by("ts", "counter").alias("ts"), F.count("*").alias("parts"))
    return got.drop("_g")


def violations(ops: DataFrame) -> DataFrame:
    """``ops`` that no log may hold, with ``reason``, the first rule each breaks. Rows that break none are left out."""
    kind = container_kind(F.col("container"))
    allowed = F.create_map(*[F.lit(x) for k, v in _ALLOWED.items() for x in (k, v)])
    rules = [
        ("id", F.col("doc_id").isNull() | F.col("peer").isNull() | peer_number(F.col("peer")).isNull() | F.col("counter").isNull() | (F.col("counter") < 0) | (F.col("counter") + atoms(F.col("len")) > (1 << 31) - 1)),
        ("lamport", F.col("lamport").isNull() | (F.col("lamport") < 0) | (F.col("lamport") >= 1 << 32)),
        ("container", F.col("container").isNull() | ~F.col("container").startswith("cid:") | F.try_element_at(allowed, kind).isNull()),
        ("kind", ~F.coalesce(F.array_contains(F.split(F.try_element_at(allowed, kind), " "), F.col("vkind")), F.lit(False))),
        ("length", F.coalesce(F.col("len"), F.lit(0)) < 1),
        ("key", (kind == "Map") & F.col("map_key").isNull()),
        ("position", kind.isin("Text", "List", "MovableList") & F.col("pos").isNotNull() & ((F.col("pos") < 0) | (F.col("pos") > 1073741822))),
        ("span", F.col("del_start").isNotNull() & (F.abs("del_len") != F.col("len"))),
        ("target", (kind == "Tree") & F.col("tree_target").isNull()),
        ("value", F.col("vkind").isin("insert", "set", "counter", "LoroValue", "Str", "ListSet", "F64") & F.col("val_json").isNull()),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])
    return ops.withColumn("reason", reason).filter("reason is not null")


#: The op kinds each kind of container takes, in both spellings.
_ALLOWED = {
    "Map": "insert delete LoroValue DeleteOnce",
    "List": "insert delete LoroValue DeleteSeq",
    "Text": "insert delete mark mark_end Str DeleteSeq MarkStart Null",
    "MovableList": "insert delete move set LoroValue DeleteSeq ListMove ListSet",
    "Tree": "create move delete RawTreeMove",
    "Counter": "counter I64 F64",
}
