"""Edit scripts compiled into operation logs.

A script row is one call by one writer on one container. Calls are checked against what the writer sees, positions are
those of a user (characters or items, without anchors and lost places), and what comes out are log rows: ops with ids,
lamports and positions as an author of the log records them, and the changes that hold them. One document is one group;
documents are compiled in parallel. A call that is refused makes no op and gives an error row instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tidelog.functions import fractional
from tidelog.functions.ids import DELETED_PARENT, KINDS
from tidelog.operators.sequence import Node, Sequence, apply
from tidelog.plans.grouped import per_group
from tidelog.plans.schema import CHANGES, CHILD, OPS

SCRIPT = "doc_id string, seq bigint, peer string, action string, container string, pos bigint, len bigint, key string, val_json string, other string"
#: How far styles spread to text typed at their edges (bit 1 before, bit 2 after; 0x80 marks a live one).
EXPAND = {"bold": 4, "italic": 4, "underline": 4, "link": 0, "highlight": 0, "comment": 0, "code": 0}
ALIVE, BEFORE, AFTER = 0x80, 2, 4

_OUT = "what string, error string, " + OPS + ", end_counter bigint, ts bigint, deps array<string>, msg string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


class Refused(ValueError):
    pass


def need(ok: bool, why: str) -> None:
    if not ok:
        raise Refused(why)


class Writer:
    """What one peer has seen, the containers as it sees them, and its open change."""

    def __init__(self, peer: str):
        self.peer, self.version, self.frontier, self.lamport = peer, {}, [], 0
        self.open: list[dict] = []
        self.began = (0, 0)
        self.seqs: dict[str, Sequence] = {}
        self.maps: dict[str, dict[str, tuple]] = {}
        self.trees: dict[str, dict[str, dict]] = {}

    def see(self, r: dict) -> None:
        """Takes in one op; ops come in (lamport, peer, counter) order."""
        cid, kind = r["container"], r["container"].rpartition(":")[2]
        if kind in ("Text", "List", "MovableList"):
            apply(self.seqs.setdefault(cid, Sequence(kind == "MovableList")), r, kind)
        elif kind == "Map":
            self.maps.setdefault(cid, {})[r["map_key"]] = None if r["vkind"] == "delete" else (r["val_json"],)
        elif kind == "Tree":
            nodes, x = self.trees.setdefault(cid, {}), r["tree_parent"]
            while x is not None and x != r["tree_target"]:
                x = nodes[x]["tree_parent"] if x in nodes else None
            if x is None:
                nodes[r["tree_target"]] = r

    def live(self, cid: str) -> list[Node]:
        s = self.seqs.get(cid)
        return [n for n in s if not n.gone] if s else []

    def items(self, cid: str) -> list[tuple[int, Node]]:
        """What a user sees, each with its place in the log's counting."""
        s = self.seqs.get(cid)
        return [(i, n) for i, n in enumerate(self.live(cid)) if not n.anchor and (not s.movable or s.elems[n.elem][1] is n)]

    def children(self, cid: str, parent: str | None) -> list[str]:
        nodes = self.trees.get(cid, {})
        kids = [n for n, r in nodes.items() if r["tree_parent"] == parent]
        return sorted(kids, key=lambda n: (bytes.fromhex(nodes[n]["fractional_index"] or ""), nodes[n]["lamport"], int(nodes[n]["peer"])))

    def alive(self, cid: str, node: str) -> bool:
        nodes, x = self.trees.get(cid, {}), node
        while x in nodes:
            x = nodes[x]["tree_parent"]
        return x is None and node in nodes


class Document:
    def __init__(self, doc_id: str):
        self.doc_id = doc_id
        self.writers: dict[str, Writer] = {}
        self.log: list[dict] = []  # ops of committed changes
        self.changes: list[dict] = []
        self.arrival = 0

    # the open change

    def put(self, w: Writer, container: str, vkind: str, n: int = 1, **fields) -> str:
        if not w.open:
            w.began = (w.version.get(w.peer, 0), w.lamport)
        counter, lamport = w.version.get(w.peer, 0), w.lamport
        r = dict.fromkeys(_NAMES) | {"doc_id": self.doc_id, "peer": w.peer, "counter": counter, "len": n, "lamport": lamport, "change_counter": w.began[0], "container": container, "vkind": vkind} | fields
        r["past"] = dict(w.version)
        w.open.append(r)
        w.see(r)
        w.version[w.peer], w.lamport = counter + n, lamport + n
        return f"{counter}@{w.peer}"

    def commit(self, w: Writer, msg: str | None = None) -> Iterator[dict]:
        if not w.open:
            return
        counter, lamport = w.began
        change = dict.fromkeys(_NAMES) | {"what": "change", "doc_id": self.doc_id, "peer": w.peer, "counter": counter, "end_counter": w.version[w.peer], "lamport": lamport, "ts": 0, "deps": list(w.frontier), "msg": msg}
        w.frontier = [f"{w.version[w.peer] - 1}@{w.peer}"]
        self.changes.append(change)
        self.log += w.open
        for r in (*w.open, change):
            r["what"], r["arrival"] = r["what"] or "op", self.arrival
            self.arrival += 1
            yield {k: v for k, v in r.items() if k != "past"}
        w.open = []

    def sync(self, w: Writer, other: str | None) -> Iterator[dict]:
        """Imports what others committed, by rebuilding the writer's view from all it then knows."""
        yield from self.commit(w)
        sources = [x for p, x in self.writers.items() if x is not w and (other in (None, "", p))]
        version = dict(w.version)
        tips = set(w.frontier)
        for x in sources:
            for p, end in x.version.items():
                end = min(end, x.began[0]) if p == x.peer and x.open else end
                version[p] = max(version.get(p, 0), end)
            tips |= set(x.frontier)
        known = [r for r in self.log if r["counter"] < version.get(r["peer"], 0)]
        new = Writer(w.peer)
        for r in sorted(known, key=lambda r: (r["lamport"], int(r["peer"]), r["counter"])):
            new.see(r)
            new.lamport = max(new.lamport, r["lamport"] + r["len"])
        new.version = {p: e for p, e in version.items() if e}
        held = [c for c in self.changes if c["counter"] < version.get(c["peer"], 0)]
        covered = {d for c in held for d in c["deps"]} | {f"{c['counter'] - 1}@{c['peer']}" for c in held}
        new.frontier = sorted(t for t in tips if t not in covered)
        self.writers[w.peer] = new

    # the calls

    def run(self, s: dict) -> Iterator[dict]:
        w = self.writers.setdefault(s["peer"], Writer(s["peer"]))
        if s["action"] == "commit":
            yield from self.commit(w, s["other"])
        elif s["action"] == "sync":
            yield from self.sync(w, s["other"])
        else:
            cid = s["container"] or ""
            kind = cid.rpartition(":")[2]
            call = getattr(self, f"{kind}_{s['action']}".lower(), None) if kind in KINDS else None
            need(call is not None, f"no {s['action']} on {kind or 'nothing'}")
            call(w, cid, s)

    def _typing_place(self, w: Writer, cid: str, pos: int) -> int:
        """Where text typed at a user's position goes: among the anchors that stand there, in front of the first that
        keeps text out, which are beginnings of styles that do not spread forward or are unset, and ends of styles
        that spread."""
        live = w.live(cid)
        chars = [i for i, n in enumerate(live) if not n.anchor]
        begin = chars[pos - 1] + 1 if pos else 0
        end = chars[pos] if pos < len(chars) else len(live)

        def keeps_out(n: Node) -> bool:
            start, _, value, _, _, info = n.anchor
            return bool((info or 0) & AFTER) if not start else not (info or 0) & BEFORE or value in ("null", "false")

        return next((i for i in range(begin, end) if keeps_out(live[i])), end)

    def _range(self, have: int, s: dict, n: int) -> int:
        pos = s["pos"]
        need(pos is not None and n >= 0 and 0 <= pos <= have - n, f"{pos}+{n} lies outside of {have}")
        return pos

    def text_insert(self, w, cid, s):
        text = json.loads(s["val_json"])
        need(isinstance(text, str), "a Text takes text")
        pos = self._range(len(w.items(cid)), s, 0)
        if text:
            self.put(w, cid, "insert", len(text), pos=self._typing_place(w, cid, pos), val_json=json.dumps(text, ensure_ascii=False))

    def _delete(self, w, cid, s):
        items = w.items(cid)
        n = s["len"] if s["len"] is not None else 1
        pos = self._range(len(items), s, n)
        runs: list[list[tuple[int, Node]]] = []
        for i, x in items[pos : pos + n]:  # a run ends where ids or places do not follow one another
            if runs and runs[-1][-1][0] + 1 == i and runs[-1][-1][1].peer == x.peer and runs[-1][-1][1].counter + 1 == x.counter:
                runs[-1].append((i, x))
            else:
                runs.append([(i, x)])
        for run in reversed(runs):
            self.put(w, cid, "delete", len(run), pos=run[0][0], del_start=f"{run[0][1].counter}@{run[0][1].peer}", del_len=len(run))

    text_delete = list_delete = movablelist_delete = _delete

    def text_mark(self, w, cid, s, unmark=False):
        n = s["len"] or 0
        need(n > 0, "a mark needs a range")
        pos = self._range(len(w.items(cid)), s, n)
        need(s["key"] in EXPAND, f"style {s['key']} is not configured")
        flag = EXPAND[s["key"]] if not unmark or EXPAND[s["key"]] in (BEFORE, AFTER) else EXPAND[s["key"]] ^ (BEFORE | AFTER)
        value = "null" if unmark else s["val_json"]
        first, last = self._typing_place(w, cid, pos), self._typing_place(w, cid, pos + n)
        now = self._styles(w, cid)[pos : pos + n]
        if all(x.get(s["key"]) == value for x in now) or unmark and not any(s["key"] in x for x in now):
            return
        self.put(w, cid, "mark", pos=first, mark_len=last - first, mark_key=s["key"], mark_info=ALIVE | flag, val_json=value)
        self.put(w, cid, "mark_end")

    def text_unmark(self, w, cid, s):
        self.text_mark(w, cid, s, unmark=True)

    def _styles(self, w, cid) -> list[dict]:
        open_marks, out = [], []
        for n in w.live(cid):
            if n.anchor is None:
                out.append({key: value for _, key, value, _ in sorted(open_marks)})
            elif n.anchor[0]:
                open_marks.append((n.anchor[3], n.anchor[1], n.anchor[2], (n.peer, n.counter)))
            else:
                open_marks = [m for m in open_marks if m[3] != (n.peer, n.counter - 1)]
        return out

    def map_set(self, w, cid, s):
        need(s["key"] is not None and s["val_json"] is not None, "a key and a value are needed")
        if w.maps.get(cid, {}).get(s["key"]) != (s["val_json"],):
            self.put(w, cid, "insert", map_key=s["key"], val_json=s["val_json"])

    def map_delete(self, w, cid, s):
        need(s["key"] is not None, "a key is needed")
        self.put(w, cid, "delete", map_key=s["key"])

    def map_child(self, w, cid, s):
        need(s["other"] in KINDS and s["key"] is not None, "a kind and a key are needed")
        own = f"{w.version.get(w.peer, 0)}@{w.peer}"
        self.put(w, cid, "insert", map_key=s["key"], val_json=json.dumps(f"{CHILD}cid:{own}:{s['other']}", ensure_ascii=False))

    def _insert(self, w, cid, s):
        items = w.items(cid)
        pos = self._range(len(items), s, 0)
        values = json.loads(s["val_json"])
        need(isinstance(values, list), "a list takes a list of items")
        if values:
            place = items[pos][0] if pos < len(items) else len(w.live(cid))
            self.put(w, cid, "insert", len(values), pos=place, val_json=json.dumps(values, ensure_ascii=False))

    list_insert = movablelist_insert = _insert

    def _child(self, w, cid, s):
        need(s["other"] in KINDS, "a kind is needed")
        own = f"{w.version.get(w.peer, 0)}@{w.peer}"
        self._insert(w, cid, s | {"val_json": json.dumps([f"{CHILD}cid:{own}:{s['other']}"], ensure_ascii=False)})

    list_child = movablelist_child = _child

    def movablelist_set(self, w, cid, s):
        items = w.items(cid)
        elem = items[self._range(len(items), s, 1)][1].elem
        self.put(w, cid, "set", elem=f"{elem[0]}@{elem[1]}", val_json=s["val_json"])

    def movablelist_move(self, w, cid, s):
        items = w.items(cid)
        at, to = self._range(len(items), s, 1), s["len"]
        need(to is not None and 0 <= to < len(items), f"{to} lies outside of {len(items)}")
        if at == to:
            return
        place, node = items[at]
        rest = [i - (i > place) for i, _ in items if i != place]
        end = len(w.live(cid)) - 1
        self.put(w, cid, "move", move_from=place, pos=rest[to] if to < len(rest) else end, elem=f"{node.elem[0]}@{node.elem[1]}")

    def counter_add(self, w, cid, s):
        need(isinstance(v := json.loads(s["val_json"]), (int, float)) and not isinstance(v, bool), "a number is needed")
        self.put(w, cid, "counter", val_json=s["val_json"])

    def _place(self, w, cid, node, parent, index):
        """The fractional index at a place among siblings; equal neighbours are spread anew from there on."""
        kids = [k for k in w.children(cid, parent) if k != node]
        index = len(kids) if index is None else index
        need(0 <= index <= len(kids), f"{index} lies outside of {len(kids)}")
        of = [bytes.fromhex(w.trees[cid][k]["fractional_index"]) for k in kids]
        left, right = (of[index - 1] if index else None), (of[index] if index < len(kids) else None)
        try:
            if left is None or left != right:
                return fractional.between(left, right), []
            same = next((j for j in range(index, len(kids)) if of[j] != left), len(kids))
            fresh = fractional.evenly(left, of[same] if same < len(kids) else None, 1 + same - index)
        except ValueError as e:
            raise Refused(str(e)) from None
        return fresh[0], list(zip(kids[index:same], fresh[1:]))

    def _stand(self, w, cid, vkind, node, parent, index):
        fi, others = self._place(w, cid, node, parent, index)
        self.put(w, cid, vkind, tree_target=node, tree_parent=parent, fractional_index=fi.hex().upper())
        for k, f in others:
            self.put(w, cid, "move", tree_target=k, tree_parent=parent, fractional_index=f.hex().upper())

    def tree_create(self, w, cid, s):
        need(s["other"] is None or w.alive(cid, s["other"]), f"no node {s['other']}")
        self._stand(w, cid, "create", f"{w.version.get(w.peer, 0)}@{w.peer}", s["other"], s["pos"])

    def tree_move(self, w, cid, s):
        node, parent = s["key"], s["other"]
        need(node is not None and w.alive(cid, node) and (parent is None or w.alive(cid, parent)), f"no node {node} or {parent}")
        x = parent
        while x is not None:
            need(x != node, f"{node} would lie below itself")
            x = w.trees[cid][x]["tree_parent"]
        if w.trees[cid][node]["tree_parent"] == parent and s["pos"] in (None, w.children(cid, parent).index(node)):
            return
        self._stand(w, cid, "move", node, parent, s["pos"])

    def tree_delete(self, w, cid, s):
        need(s["key"] is not None and w.alive(cid, s["key"]), f"no node {s['key']}")
        self.put(w, cid, "delete", tree_target=s["key"], tree_parent=DELETED_PARENT)


def _compile(rows: list[dict]) -> Iterator[tuple]:
    doc = Document(rows[0]["doc_id"])
    for s in rows:
        try:
            for r in doc.run(s):
                yield tuple(r[n] for n in _NAMES)
        except (Refused, json.JSONDecodeError, TypeError) as e:
            yield tuple((dict.fromkeys(_NAMES) | {"what": "error", "doc_id": s["doc_id"], "peer": s["peer"], "counter": s["seq"], "error": str(e)})[n] for n in _NAMES)
    for w in list(doc.writers.values()):
        for r in doc.commit(w):
            yield tuple(r[n] for n in _NAMES)


def compile_scripts(script: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, ops, errors) of scripts of ``SCRIPT`` rows; errors are (doc_id, seq, peer, error).

    Actions, by kind of container: Text insert, delete, mark, unmark; List and MovableList insert, delete, child, and
    set and move (from pos to len); Map set, delete, child; Tree create (below ``other``, at pos), move (``key`` below
    ``other``), delete (``key``); Counter add; and, without a container, commit (``other`` is the message) and sync
    (from ``other``, or all). Open changes are committed at the end. Setting an equal value, moving to the same place and
    marking what is so marked make no op. Give the result a stored cut if it is read more than once.
    """
    out = per_group(script.select(*[x.split()[0] for x in SCRIPT.split(", ")]), ["doc_id"], ["seq"], _compile, _OUT)
    pick = lambda what, ddl: out.filter(f"what = '{what}'").select(*[x.split()[0] for x in ddl.split(", ")])
    return pick("change", CHANGES), pick("op", OPS), out.filter("what = 'error'").selectExpr("doc_id", "counter as seq", "peer", "error")
