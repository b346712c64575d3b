"""Parent-child rows of unknown depth into full hierarchies.

Trees are cut into fragments small enough for one task. Each fragment contracts its chains: a node points to the top of
its fragment and knows the steps and the ids between. Tops whose parent lies in another fragment, and tops that others
hang below, form a quotient forest with one record per fragment tree; it is solved by the same procedure, and the
fragments expand what they learn: root, depth and path from above, numbers of descendants from below. A chain that
meets itself within a fragment is a local loop; one that runs through several is a loop of the quotient, whose nodes
are the chains between the places where the fragments on the loop join.

At first a fragment is a range of op counters, so that the fragment of a parent is known from its id and nodes made
together stay together. Where more than ``FRAGMENT_MOST`` nodes of a tree fall into one range, as many peers edited it,
the tree's writers are dealt out to as many fragments as that takes; ids that are no op ids count as writers. What
children tell or ask their parents in other fragments is combined per parent before it is sent, so a parent with any
number of children is one row. Where a quotient is still too large for a task, records join the
fragment of their parent by a fair coin (random mate), so that every round contracts about a quarter of the edges
whatever the shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ids import DELETED_PARENT, id_counter, peer_number
from tidelog.plans.grouped import spread
from tidelog.plans.storage import cut

#: Counters per fragment, as a power of two, and nodes of a range from which on its writers are dealt out; records of one tree that a task may solve as a whole.
FRAGMENT_BITS, FRAGMENT_MOST = 10, 20_000
SOLO = 1_000_000
#: Rows a task collects before it works on whole fragments, and characters of paths it holds before it sends them on.
CHUNK, FLUSH = 20_000, 1 << 22

NODE, ASK, TOP, HANGS = 0, 1, 2, 3
TREE = ["doc_id", "tree"]
_IN = ["doc_id", "tree", "frag", "kind", "id", "up", "upfrag", "end", "len", "seg", "w"]
_CONTRACTED = "doc_id string, tree string, what string, id string, up string, end string, len bigint, seg string, w bigint"
_SOLVED = "doc_id string, tree string, id string, fate string, root string, dist bigint, path string, tot bigint"
_ARROW = {"string": pa.string(), "bigint": pa.int64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


class _Fragments:
    """The fragments of one chunk: rows by kind, parents as positions, tops, steps to them, an order from top to leaf."""

    def __init__(self, rows: list[tuple]):
        nodes = [r for r in rows if r[3] == NODE]
        self.rest = [r for r in rows if r[3] != NODE]
        self.nodes = nodes
        self.at = at = {(r[0], r[1], r[2], r[4]): i for i, r in enumerate(nodes)}
        n = len(nodes)
        self.par = par = [-1] * n
        self.end: list[str | None] = [r[7] for r in nodes]  # None at a top: its parent lies in another fragment
        for i, (doc, tree, frag, _, _, up, upfrag, end, *_) in enumerate(nodes):
            if end is None and upfrag == frag:
                j = at.get((doc, tree, frag, up))
                if j is None:
                    self.end[i] = "orphan"
                else:
                    par[i] = j
        self.top, self.dist, self.fate = [-1] * n, [0] * n, [None] * n
        self.order: list[int] = []
        state = bytearray(n)  # 0 new, 1 on the present walk, 2 done
        for i in range(n):
            walk, v = [], i
            while v >= 0 and not state[v]:
                state[v] = 1
                walk.append(v)
                v = par[v]
            if v >= 0 and state[v] == 1:
                loop = walk.index(v)
                for x in walk[loop:]:
                    self.fate[x], state[x] = "cycle", 2
                del walk[loop:]
            for x in reversed(walk):
                p, state[x] = par[x], 2
                if p < 0:
                    self.top[x] = x
                elif self.fate[p] is not None:
                    self.fate[x] = "under_cycle"
                    continue
                else:
                    self.top[x], self.dist[x] = self.top[p], self.dist[p] + nodes[x][8]
                self.order.append(x)

    def find(self, r: tuple) -> int | None:
        return self.at.get((r[0], r[1], r[2], r[4]))

    def totals(self, own: list[int]) -> list[int]:
        for x in reversed(self.order):
            if self.par[x] >= 0:
                own[self.par[x]] += own[x]
        return own

    def trail(self, x: int) -> str:
        """The labels below the top, down to x."""
        parts = []
        while self.par[x] >= 0:
            parts.append(self.nodes[x][9])
            x = self.par[x]
        return "/".join(reversed(parts))


def _contract(rows: list[tuple]) -> Iterator[tuple]:
    f = _Fragments(rows)
    wanted = {i for i, p in enumerate(f.par) if p < 0 and f.end[i] is None and f.fate[i] is None}
    for r in f.rest:  # what is asked of each node that has children elsewhere
        p = f.find(r)
        if p is None:
            yield r[0], r[1], "answer", r[4], None, "orphan", 0, "", 0
        elif f.fate[p] is not None:
            yield r[0], r[1], "answer", r[4], None, "under_cycle", 0, "", 0
        else:
            wanted.add(f.top[p])
            yield r[0], r[1], "answer", r[4], f.nodes[f.top[p]][4], None, f.dist[p], f.trail(p), 0
    if wanted:
        tot = f.totals([r[10] for r in f.nodes])
        for i in wanted:
            r = f.nodes[i]
            yield r[0], r[1], "top", r[4], None, f.end[i], r[8], r[9], tot[i]


def _expand(rows: list[tuple]) -> Iterator[tuple]:
    f = _Fragments(rows)
    own, known, on_loop = [r[10] for r in f.nodes], {}, set()
    for r in f.rest:
        x = f.find(r)
        if x is None:
            continue
        if r[3] == TOP:
            known[x] = r
            continue
        own[x] += r[10]
        while r[8] and x >= 0 and x not in on_loop:
            on_loop.add(x)
            x = f.par[x]
    tot = f.totals(own)
    below: dict[int, list[int]] = {}
    for x in f.order:
        if f.par[x] >= 0:
            below.setdefault(f.par[x], []).append(x)
    for i, r in enumerate(f.nodes):
        if f.fate[i] is not None:
            yield r[0], r[1], r[4], f.fate[i], "", -1, "", -1
        elif f.par[i] < 0:
            told = known.get(i)
            fate, root, base, first = (f.end[i], r[4], 0, r[9]) if told is None else (told[7], told[5], told[8], told[9])
            lost = fate in ("cycle", "under_cycle")
            labels: list[str] = []
            todo = [(i, 0)]
            while todo:
                x, depth = todo.pop()
                row = f.nodes[x]
                if lost:
                    yield row[0], row[1], row[4], "cycle" if x in on_loop else "under_cycle", "", -1, "", -1
                else:
                    del labels[depth:]
                    labels.append(first if x == i else row[9])
                    yield row[0], row[1], row[4], fate, root, base + f.dist[x], "/".join(labels), tot[x]
                todo.extend((c, depth + 1) for c in below.get(x, ()))


def _by_fragment(work: Callable[[list[tuple]], Iterator[tuple]], ddl: str):
    schema = _schema(ddl)

    def send(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*held), schema)], schema=schema)

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for r in work(rows):
            held.append(r)
            chars += sum(len(x) for x in r if isinstance(x, str))
            if len(held) >= 10_000 or chars > FLUSH:
                yield send(held)
                held, chars = [], 0
        if held:
            yield send(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows.extend(zip(*(c.to_pylist() for c in b.columns)))
            if len(rows) >= CHUNK:  # all but the last fragment are whole
                last, k = rows[-1][:3], len(rows)
                while k and rows[k - 1][:3] == last:
                    k -= 1
                if k:
                    yield from done(rows[:k])
                    rows = rows[k:]
        if rows:
            yield from done(rows)

    return run


def _pass(rows: DataFrame, work, ddl: str) -> DataFrame:
    placed = spread(rows.select(*_IN), *TREE, "frag").sortWithinPartitions(*TREE, "frag")
    return placed.mapInArrow(_by_fragment(work, ddl), ddl)


def _rows(df: DataFrame, kind: int, **columns: Column | str) -> DataFrame:
    types = {"frag": "bigint", "kind": "int", "upfrag": "bigint", "len": "bigint", "w": "bigint"}
    got = {c: F.col(c) if c in df.columns else F.lit(None) for c in _IN} | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()} | {"kind": F.lit(kind)}
    return df.select(*[got[c].cast(types.get(c, "string")).alias(c) for c in _IN])


def _mates(records: DataFrame, level: int) -> DataFrame:
    """Fragments by random mate: a record whose coin is tails joins its parent if that one's is heads."""
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
    own = lambda c: F.xxhash64(F.lit("f"), c, F.lit(level))
    placed = records.withColumn("frag", F.when(~coin(F.col("id")) & coin(F.col("up")), own(F.col("up"))).otherwise(own(F.col("id"))))
    return placed.join(placed.select(*TREE, F.col("id").alias("up"), F.col("frag").alias("upfrag")), [*TREE, "up"], "left")


def solve(records: DataFrame, solo: int = SOLO, level: int = 1) -> DataFrame:
    """Solves records (doc_id, tree, id, up, end, len, seg, w), (frag, upfrag) if already cut, into ``_SOLVED``.

    ``end`` is the fate of a record that has no parent, null where ``up`` names one; ``len`` the steps to it, ``seg``
    the label on the path, ``w`` what the record adds to the totals of all above it.
    """
    if "frag" not in records.columns:
        largest = records.groupBy(*TREE).count().agg(F.max("count")).first()[0] or 0
        if largest <= solo:
            return _pass(_rows(records, NODE, frag=F.lit(0), upfrag=F.lit(0)), _expand, _SOLVED)
        records = cut(_mates(records, level), "mates")
    nodes = _rows(records, NODE)
    apart = records.filter("end is null and not upfrag <=> frag").withColumn("upfrag", F.coalesce("upfrag", F.lit(-1)))
    parents = apart.select(*TREE, F.col("upfrag").alias("frag"), F.col("up").alias("id")).distinct()
    asks = _rows(parents, ASK, len=F.lit(0), w=F.lit(0))
    told = cut(_pass(nodes.unionByName(asks), _contract, _CONTRACTED), "contracted")
    answers = told.filter("what = 'answer'").select(*TREE, F.col("id").alias("_parent"), F.col("up").alias("_up"), F.col("end").alias("_end"), F.col("len").alias("_len"), F.col("seg").alias("_seg"))
    tops = told.filter("what = 'top'").select(*TREE, "id", "end", "len", "seg", "w")
    above = apart.select(*TREE, "id", F.col("up").alias("_parent"))
    joined = tops.join(above.join(answers, [*TREE, "_parent"]), [*TREE, "id"], "left")
    quotient = joined.select(
        *TREE, "id", F.col("_up").alias("up"), F.coalesce("_end", "end").alias("end"),
        F.when(F.col("_up").isNotNull(), F.col("len") + F.col("_len")).otherwise(F.lit(0)).cast("bigint").alias("len"),
        F.when(F.col("_seg") != "", F.concat_ws("/", "_seg", "seg")).otherwise(F.col("seg")).alias("seg"), "w",
    )
    if told.limit(1).count() == 0:
        return _pass(nodes, _expand, _SOLVED)
    above = cut(solve(cut(quotient, "quotient"), solo, level + 1), "above")
    known = apart.select(*TREE, "id", "frag", "upfrag", "up").join(above, [*TREE, "id"])
    tops = _rows(known.drop("up"), TOP, end="fate", up="root", len="dist", seg="path", w=F.lit(0), upfrag=F.lit(None))
    below = known.groupBy(*TREE, F.col("upfrag").alias("frag"), F.col("up").alias("id")).agg(F.max((F.col("fate") == "cycle").cast("int")).alias("len"), F.sum(F.greatest(F.col("tot"), F.lit(0))).alias("w"))
    hangs = _rows(below, HANGS)
    return _pass(nodes.unionByName(tops).unionByName(hangs), _expand, _SOLVED)


def latest_placements(nodes: DataFrame) -> DataFrame:
    """(doc_id, tree, node_id, parent_id): the row with the greatest (lamport, peer) of each node, peers as numbers; of
    equals the one with the greatest parent text. Rows with a null doc_id, tree or node_id name no node."""
    order = F.struct("lamport", peer_number(F.col("peer")).alias("p"), "parent_id")
    named = nodes.filter("doc_id is not null and tree is not null and node_id is not null")
    return named.groupBy(*TREE, "node_id").agg(F.max(order)["parent_id"].alias("parent_id"))


def fragments(placed: DataFrame, bits: int = FRAGMENT_BITS, most: int = FRAGMENT_MOST) -> DataFrame:
    """``placed`` (doc_id, tree, node_id, parent_id, ...) with ``frag`` and ``upfrag``, the fragments of node and parent.
    A fragment of a tree holds about ``most`` nodes at most, but for those that one writer has in one range."""
    numbered = lambda c: id_counter(F.col(c))
    span = lambda c: F.coalesce(F.shiftright(numbered(c), bits), F.lit(-1).cast("bigint"))
    writer = lambda c: F.xxhash64(F.when(numbered(c).isNotNull(), F.split_part(F.col(c), F.lit("@"), F.lit(2))).otherwise(F.col(c)))
    full = placed.groupBy(*TREE, span("node_id").alias("_span")).count().filter(F.col("count") > most).groupBy(*TREE).agg(F.ceil(F.max("count") / most).alias("_hands"))
    dealt = placed.join(full, TREE, "left").withColumn("_hands", F.coalesce("_hands", F.lit(1).cast("bigint")))
    frag = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(span(c), F.pmod(writer(c), F.col("_hands"))))
    return dealt.withColumn("frag", frag("node_id")).withColumn("upfrag", frag("parent_id")).drop("_hands")


def hierarchies(nodes: DataFrame, solo: int = SOLO, fragment_bits: int = FRAGMENT_BITS, fragment_most: int = FRAGMENT_MOST) -> DataFrame:
    """(doc_id, tree, node_id, fate, root_id, node_depth, n_below, node_path), one row per node.

    fate: ``live`` if the walk up ends at a node without parent (null or ''), ``deleted`` if at one under the parent of
    deleted nodes, ``orphan`` if at one whose parent has no row; ``cycle`` on a loop, ``under_cycle`` if it only leads
    to one, with root and path '' and depth and number of descendants -1. A node that is its own parent is a loop.
    """
    latest = cut(latest_placements(nodes), "placements")
    end = F.when(F.coalesce(F.col("parent_id"), F.lit("")) == "", "live").when(F.col("parent_id") == DELETED_PARENT, "deleted")
    one = F.lit(1).cast("bigint")
    records = cut(fragments(latest, fragment_bits, fragment_most).select(*TREE, F.col("node_id").alias("id"), F.col("parent_id").alias("up"), end.alias("end"), one.alias("len"), F.col("node_id").alias("seg"), one.alias("w"), "frag", "upfrag"), "records")
    done = solve(records, solo)
    return done.select(*TREE, F.col("id").alias("node_id"), "fate", F.col("root").alias("root_id"), F.col("dist").alias("node_depth"), F.when(F.col("tot") < 0, F.lit(-1)).otherwise(F.col("tot") - 1).cast("bigint").alias("n_below"), F.col("path").alias("node_path"))
