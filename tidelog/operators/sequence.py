"""The merge of sequences: Text, List and MovableList.

A position in an op counts what its author saw, so ops are replayed per container in the order of writers, each
against its author's past. The replay is sequential within a container and independent between containers; all that
follows from it (text, lengths, styles, movable items) is relational again.

Elements form a tree: one put between two neighbours hangs to the left of the right one if that was itself put directly
behind the same left neighbour, and to the right of the left one otherwise; elements on one side of an element stand in
the order of their writers. The sequence is the walk through that tree, left side first. It is kept in chunks that
count what is visible, for all that has been replayed and for each author who has not seen all of it; when such an
author has seen more, only what is new to it is counted anew. So a place is found in a few hundred steps, whatever the
author knows.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.ids import container_kind, peer_number
from tidelog.operators.log import past_versions
from tidelog.plans.grouped import per_group
from tidelog.plans.schema import SPELLINGS

KINDS = ["Text", "List", "MovableList"]
NODES = "doc_id string, container string, ord bigint, peer string, counter bigint, len bigint, val_json string, mark string, style string, deleted boolean, current boolean, value_peer string, value_counter bigint"
CHUNK = 128
#: Authors whose views of one container are kept; that of another is counted from the start when it is needed again.
VIEWS = 64
#: Steps after which the merge of one container gives up and says so (``failures``), as no honest one needs them.
BUDGET = 1 << 28
#: The kind of the rows that carry what the author of a change had seen.
PAST = "@past"


class TooLong(RuntimeError):
    pass


class Node:
    """An element or an anchor of a style, its place in the tree, and the ops that removed it."""

    __slots__ = ("peer", "counter", "num", "behind", "lefts", "rights", "run", "at", "value", "anchor", "gone", "elem", "chunk")

    def __init__(self, peer, num, counter, behind, value, anchor=None, elem=None):
        self.peer, self.num, self.counter, self.value = peer, num, counter, value
        self.behind = behind  # the element it was put directly behind
        self.lefts: list[Node] | None = None
        self.rights: list[Node] | None = None
        self.run: Run | None = None
        self.at = 0
        self.anchor, self.elem = anchor, elem  # anchor: None, or (is it a start, key, value, writer, place of the end, info)
        self.gone: list[tuple[str, int]] = []
        self.chunk: Chunk | None = None


class Run:
    """Elements each of which is the last on the right of the one before, but at ``forks``, where another came behind
    it. So the last element below any of them is found without a walk along them."""

    __slots__ = ("nodes", "forks")

    def __init__(self):
        self.nodes: list[Node] = []
        self.forks: list[int] = []


class Chunk:
    """A stretch of the sequence; ``seen`` counts what each view has visible in it, the view None being of all, and
    ``known`` what it knows, removed or not."""

    __slots__ = ("nodes", "seen", "known")

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.seen: dict[str | None, int] = {}
        self.known: dict[str, int] = {}
        for n in nodes:
            n.chunk = self


class View:
    """What one author had seen, by the end of the ids of each peer; ``done`` tells how much of it is counted."""

    __slots__ = ("ends", "done")

    def __init__(self):
        self.ends: dict[str, int] = {}
        self.done: dict[str, int] = {}


class Taken:
    """The ids of one writer that were replayed, as disjoint spans in order."""

    __slots__ = ("lo", "hi")

    def __init__(self):
        self.lo: list[int] = []
        self.hi: list[int] = []

    def add(self, lo: int, hi: int) -> int:
        """Adds ids and returns how many of them, in a row from the first, were there."""
        i = bisect_right(self.lo, lo) - 1
        had = max(0, min(self.hi[i], hi) - lo) if i >= 0 else 0
        if lo + had >= hi:
            return hi - lo
        first = i if i >= 0 and self.hi[i] >= lo else i + 1
        last = bisect_right(self.lo, hi)
        lo, hi = (min(lo, self.lo[first]), max(hi, self.hi[last - 1])) if first < last else (lo, hi)
        self.lo[first:last], self.hi[first:last] = [lo], [hi]
        return had


class Sequence:
    def __init__(self, movable: bool = False, budget: int = BUDGET):
        self.chunks: list[Chunk] = [Chunk([])]
        self.tops: list[Node] = []  # what stands on the right of the beginning
        self.ids: dict[tuple[str, int], Node] = {}
        self.seen: dict[str, int] = {}  # everything replayed so far
        self.taken: dict[str, Taken] = {}  # and which ids of it
        self.effects: dict[str, list[tuple[int, Node, bool]]] = {}  # per writer in order of ids: puts or removes a node
        self.views: dict[str, View] = {}
        self.last: tuple[str, int, Node] | None = None  # writer, place and node of what was put last, with all seen
        self.steps, self.budget = 0, budget
        self.movable = movable
        # element of a MovableList -> [writer of its place, its node, writer of its value, value, id of that op]
        self.elems: dict[tuple[int, str], list] = {}

    def __iter__(self) -> Iterator[Node]:
        for c in self.chunks:
            yield from c.nodes

    def _step(self, n: int) -> None:
        self.steps += n
        if self.steps > self.budget:
            raise TooLong(f"more than {self.budget} steps")

    # views

    def view(self, peer: str, past: dict[str, int], own: int) -> str | None:
        """The name of the view of an author with this past and ``own`` ids: None if that is all there is."""
        if all((own if p == peer else past.get(p, 0)) >= end for p, end in self.seen.items()):
            return None
        v = self.views.pop(peer, None)
        if v is not None and (any(past.get(p, 0) < end for p, end in v.ends.items() if p != peer) or own < v.ends.get(peer, 0)):
            self._forget(peer)  # a past that shrinks: no honest log has it
            v = None
        if v is None:
            v = View()
            if len(self.views) >= VIEWS:
                oldest = next(iter(self.views))
                del self.views[oldest]
                self._forget(oldest)
        self.views[peer] = v  # the last in use
        self.sync(peer, past, own)
        return peer

    def _forget(self, name: str) -> None:
        self._step(len(self.chunks))
        for c in self.chunks:
            c.seen.pop(name, None)
            c.known.pop(name, None)

    def _forget_all(self) -> None:
        self.views.clear()
        for c in self.chunks:
            c.seen, c.known = {None: c.seen.get(None, 0)}, {}

    def sync(self, peer: str, past: dict[str, int], own: int) -> None:
        """Counts what is new to an author since its last op, one effect after the other."""
        v = self.views.get(peer)
        if v is None:
            return
        for p in {*past, peer}:
            end = own if p == peer else past[p]
            if end <= v.ends.get(p, 0):
                continue
            told = self.effects.get(p, ())
            i = v.done.get(p, 0)
            while i < len(told) and told[i][0] < end:
                at, node, puts = told[i]
                v.ends[p] = max(v.ends.get(p, 0), at)  # as of just before it
                known = not puts and self._known(node, v)
                dead = any(c < v.ends.get(q, 0) for q, c in node.gone)
                v.ends[p] = at + 1
                if puts:
                    node.chunk.known[peer] = node.chunk.known.get(peer, 0) + 1
                    if not dead:
                        node.chunk.seen[peer] = node.chunk.seen.get(peer, 0) + 1
                elif known and not dead:
                    node.chunk.seen[peer] = node.chunk.seen.get(peer, 0) - 1
                i += 1
                self._step(1)
            v.done[p] = i
            v.ends[p] = end

    def _known(self, n: Node, v: View) -> bool:
        return n.counter < v.ends.get(n.peer, 0)

    def _visible(self, n: Node, name: str | None) -> bool:
        if name is None:
            return not n.gone
        v = self.views[name]
        return n.counter < v.ends.get(n.peer, 0) and not any(c < v.ends.get(p, 0) for p, c in n.gone)

    def at(self, pos: int, name: str | None) -> Node | None:
        """The pos-th element a view shows; the last one if there are fewer, as history may be incomplete."""
        last = None
        for c in self.chunks:
            k = c.seen.get(name, 0)
            if pos < k:
                # from the nearer end of the chunk
                near = pos <= k // 2
                return self._pick(c.nodes if near else reversed(c.nodes), pos if near else k - 1 - pos, name)
            if k:
                pos -= k
                last = c
        self._step(len(self.chunks))
        return self._pick(reversed(last.nodes), 0, name) if last else None

    def _pick(self, nodes: Iterator[Node], pos: int, name: str | None) -> Node | None:
        want = pos
        ends = self.views[name].ends if name is not None else None
        for i, n in enumerate(nodes):
            if not n.gone if ends is None else n.counter < ends.get(n.peer, 0) and not (n.gone and any(c < ends.get(p, 0) for p, c in n.gone)):
                if not want:
                    self._step(i + 1)
                    return n
                want -= 1
        return None

    # the tree

    def _after(self, n: Node | None) -> tuple[int, int]:
        """Where what follows n stands: chunk and offset."""
        if n is None:
            return 0, 0
        k = len(self.chunks) - 1 if self.chunks[-1] is n.chunk else self.chunks.index(n.chunk)
        nodes = n.chunk.nodes
        return k, len(nodes) if nodes[-1] is n else nodes.index(n) + 1

    def _next_known(self, n: Node | None, name: str | None) -> Node | None:
        """What an author knows to stand directly behind n, removed or not."""
        k, i = self._after(n)
        v = self.views.get(name) if name is not None else None
        for k in range(k, len(self.chunks)):
            c = self.chunks[k]
            if v is None or c.known.get(name, 0):
                for x in c.nodes[i:] if i else c.nodes:
                    if v is None or x.counter < v.ends.get(x.peer, 0):
                        return x
                    self._step(1)
            self._step(1)
            i = 0
        return None

    def _first(self, n: Node) -> Node:
        while n.lefts:
            n = n.lefts[0]
            self._step(1)
        return n

    def _last(self, n: Node) -> Node:
        while True:
            run = n.run
            fork = bisect_left(run.forks, n.at)
            n = run.nodes[run.forks[fork]] if fork < len(run.forks) else run.nodes[-1]
            if not n.rights:
                return n
            n = n.rights[-1]
            self._step(1)

    def _hang(self, n: Node, left: Node | None, right: Node | None) -> tuple[Node | None, bool]:
        """Puts a node into the tree; returns the node it then stands next to, and whether behind it."""
        key = lambda x: x.num
        if right is not None and right.behind is left:
            kin = right.lefts = right.lefts or []
            i = bisect_right(kin, n.num, key=key)
            kin.insert(i, n)
            self._start_run(n)
            return (self._first(kin[i + 1]), False) if i + 1 < len(kin) else (right, False)
        kin = self.tops if left is None else left.rights
        if kin is None:
            kin = left.rights = []
        i = bisect_right(kin, n.num, key=key)
        kin.insert(i, n)
        if left is not None and i == len(kin) - 1 and left.run.nodes[-1] is left and i == 0:
            n.run, n.at = left.run, left.at + 1
            n.run.nodes.append(n)
        else:
            self._start_run(n)
            if left is not None and i == len(kin) - 1 == 1:  # the first one was the next in the run
                insort(left.run.forks, left.at)
        if i + 1 < len(kin):
            return self._first(kin[i + 1]), False
        return (self._last(kin[i - 1]), True) if i else (left, True)

    @staticmethod
    def _start_run(n: Node) -> None:
        n.run, n.at = Run(), 0
        n.run.nodes.append(n)

    def insert(self, pos: int, values: list, peer: str, num: int, counter: int, name: str | None, anchor=None, elems=None) -> list[Node]:
        """Places a run of new elements where a view has its pos-th."""
        if not values:
            return []
        last, self.last = self.last, None
        if last is not None and name is None and last[:2] == (peer, pos - 1):
            left = last[2]  # it types on and sees all there is, as before
        else:
            left = self.at(pos - 1, name) if pos > 0 else None
        right = self._next_known(left, name)
        made: list[Node] = []
        behind = left
        for j, v in enumerate(values):
            node = Node(peer, num, counter + j, behind, v, anchor, elems[j] if elems else None)
            self.ids[(peer, counter + j)] = node
            if j:
                # nothing can stand behind an element that is new: the run goes on to its right
                behind.rights = [node]
                node.run, node.at = behind.run, behind.at + 1
                node.run.nodes.append(node)
            else:
                beside, after = self._hang(node, left, right)
            made.append(node)
            behind = node
        told = self.effects.setdefault(peer, [])
        if told and told[-1][0] > counter:  # late ids of a writer
            for n in made:
                insort(told, (n.counter, n, True), key=lambda e: e[0])
            self._forget_all()
        else:
            told.extend((n.counter, n, True) for n in made)
        v = self.views.get(peer)
        known = v is not None and counter < v.ends.get(peer, 0)  # a move is put with its own id seen
        if known:
            v.done[peer] = len(told)
        self._put(beside, after, made, peer if known else None)
        if name is None:
            self.last = (peer, pos + len(made) - 1, made[-1])
        return made

    def _put(self, beside: Node | None, after: bool, made: list[Node], known: str | None) -> None:
        k, i = self._after(beside)
        if beside is not None and not after:
            i -= 1
        c = self.chunks[k]
        c.nodes[i:i] = made
        for n in made:
            n.chunk = c
        c.seen[None] = c.seen.get(None, 0) + len(made)
        if known is not None:
            c.seen[known] = c.seen.get(known, 0) + len(made)
            c.known[known] = c.known.get(known, 0) + len(made)
        self._step(1)
        if len(c.nodes) > 2 * CHUNK:
            parts = [Chunk(c.nodes[x : x + CHUNK]) for x in range(0, len(c.nodes), CHUNK)]
            for name in {None, *c.known}:
                if name is None or name in self.views:
                    for part in parts:
                        part.seen[name] = sum(self._visible(n, name) for n in part.nodes)
                        if name is not None:
                            part.known[name] = sum(self._known(n, self.views[name]) for n in part.nodes)
            self.chunks[k : k + 1] = parts

    def drop(self, n: Node, peer: str, counter: int) -> None:
        self._step(1)
        self.last = None
        if not n.gone:
            n.chunk.seen[None] -= 1
        n.gone.append((peer, counter))
        told = self.effects.setdefault(peer, [])
        if told and told[-1][0] > counter:
            insort(told, (counter, n, False), key=lambda e: e[0])
            self._forget_all()
        else:
            told.append((counter, n, False))


def apply(seq: Sequence, r: dict, kind: str) -> None:
    """Replays one op; ``past`` is what its author had seen of others."""
    peer, num, counter = r["peer"], int(r["peer"]), r["counter"]
    what = SPELLINGS.get((kind, r["vkind"]), r["vkind"])
    n = max(r["len"] or 1, 1)
    taken = seq.taken.get(peer)
    if taken is None:
        taken = seq.taken[peer] = Taken()
    skip = taken.add(counter, counter + n)  # ids of this op that were delivered before, in a row from its start
    if skip >= n:
        return
    past = r["past"] or {}
    own = max(past.get(peer, 0), counter + skip)
    pos = (r["pos"] or 0) + (skip if what == "insert" else 0)
    writer = (r["lamport"], num)
    if what == "insert":
        value = json.loads(r["val_json"]) if r["val_json"] is not None else ""
        items = list(value)[skip:] if isinstance(value, (str, list)) else [value]
        elems = [(r["lamport"] + skip + j, peer) for j in range(len(items))] if seq.movable else None
        made = seq.insert(pos, items, peer, num, counter + skip, seq.view(peer, past, own), elems=elems)
        for m in made if seq.movable else ():
            place = (m.elem[0], num)
            known = seq.elems.setdefault(m.elem, [None, None, None, None, None])
            if known[0] is None or place > known[0]:
                known[0], known[1] = place, m
            if known[2] is None or place > known[2]:
                known[2], known[3], known[4] = place, m.value, (peer, m.counter)
    elif what == "delete":
        if r["del_start"]:
            c, _, p = r["del_start"].partition("@")
            span = r["del_len"] or 0
            for k in range(skip, abs(span)):  # a delete that ran backwards took the last id first
                node = seq.ids.get((p, int(c) + (k if span > 0 else -span - 1 - k)))
                if node is not None:
                    seq.drop(node, peer, counter + k)
        else:
            length = r["del_len"] if r["del_len"] is not None else n
            first = pos if length >= 0 else pos + length + 1
            for k in range(skip, abs(length)):
                node = seq.at(first, seq.view(peer, past, max(own, counter + k)))
                if node is None:
                    break
                seq.drop(node, peer, counter + k)
    elif what == "mark":
        seq.insert(pos, [None], peer, num, counter, seq.view(peer, past, own), anchor=(True, r["mark_key"], r["val_json"], writer, pos + (r["mark_len"] or 0) + 1, r.get("mark_info")))
    elif what == "mark_end":
        start = seq.ids.get((peer, counter - 1))
        if start is not None and start.anchor:
            seq.insert(start.anchor[4], [None], peer, num, counter, seq.view(peer, past, own), anchor=(False, *start.anchor[1:]))
    elif what == "set" and r["elem"]:
        lam, _, p = r["elem"].partition("@")
        known = seq.elems.setdefault((int(lam), p), [None, None, None, None, None])
        if known[2] is None or writer > known[2]:
            known[2], known[3], known[4] = writer, json.loads(r["val_json"]), (peer, counter)
    elif what == "move" and r["elem"]:
        lam, _, p = r["elem"].partition("@")
        known = seq.elems.get((int(lam), p))
        source = seq.at(r["move_from"], seq.view(peer, past, own)) if r["move_from"] is not None else known and known[1]
        if source is not None:
            seq.drop(source, peer, counter)
        made = seq.insert(pos, [None], peer, num, counter, seq.view(peer, past, counter + 1), elems=[(int(lam), p)])
        known = seq.elems.setdefault((int(lam), p), [None, None, None, None, None])
        if known[0] is None or writer > known[0]:
            known[0], known[1] = writer, made[0]
    seq.seen[peer] = max(seq.seen.get(peer, 0), counter + n)


def _replay(rows: Iterator[dict]) -> Iterator[tuple]:
    seq = first = None
    pasts: dict[tuple[str, int], dict[str, int]] = {}
    try:
        for r in rows:
            if seq is None:
                first, kind = r, r["container"].rpartition(":")[2]
                seq = Sequence(kind == "MovableList")
            if r["vkind"] == PAST:
                pasts[r["peer"], r["counter"]] = dict(r["past"])
            else:
                r["past"] = pasts.get((r["peer"], r["change_counter"]))
                apply(seq, r, kind)
    except TooLong as e:
        yield first["doc_id"], first["container"], -1, None, None, 0, None, f"failed:{e}", None, True, False, None, None
        return
    yield from _emit(first, seq)


def _emit(first: dict, seq: Sequence) -> Iterator[tuple]:
    doc, container = first["doc_id"], first["container"]
    text = container.endswith(":Text")
    ended = {(n.peer, n.counter - 1) for n in seq if n.anchor and not n.anchor[0] and not n.gone}
    open_marks: dict[str, list] = {}
    style = None
    run: list[str] = []  # characters typed in a row that are alike in all else
    head: tuple = ()

    def done() -> Iterator[tuple]:
        if run:
            at, peer, counter, gone, worn = head
            yield doc, container, at, peer, counter, len(run), json.dumps("".join(run), ensure_ascii=False), None, worn, gone, True, peer, counter
            run.clear()

    for i, n in enumerate(seq):
        if text and n.anchor is None:
            gone = bool(n.gone)
            if not run or head[1] != n.peer or head[2] + len(run) != n.counter or head[3] != gone:
                yield from done()
                head = (i, n.peer, n.counter, gone, style)
            run.append(n.value)
            continue
        yield from done()
        mark = None
        if n.anchor:
            start, key, value, writer, *_ = n.anchor
            mark = f"{'start' if start else 'end'}:{key}"
            own = (n.peer, n.counter if start else n.counter - 1)
            if not n.gone:
                marks = open_marks.setdefault(key, [])
                if start and own in ended:
                    marks.append((writer, own, value))
                elif not start:
                    marks[:] = [m for m in marks if m[1] != own]
                won = {k: max(m)[2] for k, m in open_marks.items() if m}
                style = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {won[k]}" for k in sorted(won)) + "}" if won else None
        value, wrote, current = n.value, (n.peer, n.counter), True
        if seq.movable:
            known = seq.elems.get(n.elem)
            current = known is not None and known[1] is n and known[4] is not None
            if current:
                value, wrote = known[3], known[4]
        yield doc, container, i, n.peer, n.counter, 1, None if n.anchor else json.dumps(value, ensure_ascii=False), mark, style, bool(n.gone), current, wrote[0], wrote[1]
    yield from done()


def sequence_nodes(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """One row per item or anchor of every List and MovableList, and per run of characters of every Text, in order:
    (doc_id, container, ord, peer, counter, len, val_json, mark, style, deleted, current, value_peer, value_counter).

    A run holds ``len`` characters typed in a row and alike in all else, as JSON text.
    ``mark`` names an anchor; ``style`` is the canonical JSON of the styles in force, null values included; ``current``
    tells the place an item of a MovableList really has; value_peer and value_counter name the op that wrote the value.
    Ops of one container are replayed in (lamport, peer, counter) order; repeated and overlapping deliveries count once.
    Deletes go by the ids they recorded, or by position where they recorded none; a move that recorded no position
    takes its item from where it is. Empty logs give no rows.
    """
    kept = ops.filter(container_kind(F.col("container")).isin(KINDS) & F.col("doc_id").isNotNull() & F.col("peer").isNotNull() & F.col("counter").isNotNull())
    for c in ("move_from", "mark_len"):
        kept = kept if c in kept.columns else kept.withColumn(c, F.lit(None).cast("bigint"))
    for c in ("elem", "mark_key"):
        kept = kept if c in kept.columns else kept.withColumn(c, F.lit(None).cast("string"))
    need = ["doc_id", "container", "peer", "counter", "len", "lamport", "change_counter", "vkind", "pos", "val_json", "del_start", "del_len", "move_from", "elem", "mark_len", "mark_key"]
    rows = kept.select(*need)
    # a version goes once per change and container, in front of all ops; what only its writer wrote needs none
    seen = past_versions(changes).withColumn("past", F.map_filter("past", lambda p, _: p != F.col("peer"))).filter(F.size("past") > 0)
    pasts = rows.select("doc_id", "container", "peer", "change_counter").distinct().join(seen, ["doc_id", "peer", "change_counter"])
    told = {"counter": F.col("change_counter"), "lamport": F.lit(-1), "vkind": F.lit(PAST)}
    pasts = pasts.select(*[told.get(c, F.col(c) if c in pasts.columns else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in need], "past")
    both = rows.withColumn("past", F.lit(None).cast(pasts.schema["past"].dataType)).unionByName(pasts).withColumn("_p", peer_number(F.col("peer")))
    first = F.when(F.col("vkind") == PAST, 0).otherwise(1)
    return per_group(both, ["doc_id", "container"], [first, "lamport", "_p", "counter", F.col("len").desc()], _replay, NODES, stream=True)


def failures(nodes: DataFrame) -> DataFrame:
    """(doc_id, container, reason): the containers whose merge gave up; they have no other rows in ``sequence_nodes``."""
    return nodes.filter("ord < 0").select("doc_id", "container", F.substring_index("mark", ":", -1).alias("reason"))


def live(nodes: DataFrame) -> DataFrame:
    return nodes.filter("not deleted and mark is null and current")


def texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, container, text) of every Text, from ``sequence_nodes``; '' where all was deleted."""
    kept = nodes.filter((container_kind(F.col("container")) == "Text") & (F.col("ord") >= 0))
    char = F.get_json_object("val_json", "$")
    shown = F.expr("not deleted and mark is null")
    return kept.groupBy("doc_id", "container").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("ord", char.alias("c"))))), lambda x: x["c"]), "").alias("text"))


def lengths(nodes: DataFrame) -> DataFrame:
    """(doc_id, container, length): characters or items each sequence shows; 0 where all was removed."""
    shown = F.expr("not deleted and mark is null and current")
    return nodes.filter("ord >= 0").groupBy("doc_id", "container").agg(F.coalesce(F.sum(F.when(shown, F.col("len"))), F.lit(0)).alias("length"))


def items(nodes: DataFrame) -> DataFrame:
    """(doc_id, container, place, val_json) of every List and MovableList, places from 0."""
    kept = live(nodes).filter(container_kind(F.col("container")).isin("List", "MovableList"))
    return kept.select("doc_id", "container", (F.row_number().over(Window.partitionBy("doc_id", "container").orderBy("ord")) - 1).cast("bigint").alias("place"), "val_json")


def delta_runs(nodes: DataFrame) -> DataFrame:
    """(doc_id, container, run, insert, attributes): text in runs of equal styles. A style set to null is no attribute
    but still ends a run."""
    chars = live(nodes).filter(container_kind(F.col("container")) == "Text").select("doc_id", "container", "ord", F.get_json_object("val_json", "$").alias("c"), F.coalesce("style", F.lit("")).alias("style"))
    w = Window.partitionBy("doc_id", "container").orderBy("ord")
    new = F.when(F.lag("style").over(w).eqNullSafe(F.col("style")), 0).otherwise(1)
    runs = chars.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1)
    done = runs.groupBy("doc_id", "container", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda x: x["c"]), "").alias("insert"), F.first("style").alias("_style"))
    # variants keep the types of values
    style = F.map_filter(F.from_json("_style", "map<string,variant>"), lambda _, v: ~F.is_variant_null(v))
    keep = F.map_filter(style, lambda _, v: v.isNotNull())
    return done.select("doc_id", "container", "run", "insert", F.when(F.col("_style") == "", None).otherwise(F.col("_style")).alias("style"), F.when((F.col("_style") != "") & (F.size(keep) > 0), F.to_json(keep)).alias("attributes"))
