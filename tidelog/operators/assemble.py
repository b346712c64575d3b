"""Containers nested in containers into documents."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ids import DELETED_PARENT, KINDS, container_is_root
from tidelog.operators import sequence, tree
from tidelog.operators.lww import counter_values, map_values
from tidelog.plans.grouped import per_group
from tidelog.plans.schema import CHILD, MERGEABLE

PARTS = "doc_id string, container string, slot string, place bigint, val_json string, wrote string, more string"


def container_parts(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """Every container's own content as rows (doc_id, container, slot, place, val_json, wrote, more): map entries by
    ``slot``, list items and tree nodes by ``place``, texts and counters whole. ``wrote`` names the op of a value."""
    none = lambda kind="string": F.lit(None).cast(kind)
    maps = map_values(ops).select("doc_id", "container", F.col("map_key").alias("slot"), none("bigint").alias("place"), "val_json", F.concat_ws("@", "counter", "peer").alias("wrote"), none().alias("more"))
    sums = counter_values(ops).select("doc_id", "container", none().alias("slot"), none("bigint").alias("place"), F.col("total").cast("string").alias("val_json"), none().alias("wrote"), none().alias("more"))
    nodes = sequence.sequence_nodes(changes, ops)
    seqs = sequence.live(nodes).select("doc_id", "container", none().alias("slot"), F.col("ord").alias("place"), "val_json", F.concat_ws("@", "value_counter", "value_peer").alias("wrote"), none().alias("more"))
    placed = tree.ranked(tree.tree_placements(ops))
    trees = placed.select("doc_id", "container", F.col("node_id").alias("slot"), F.col("index").alias("place"), F.to_json(F.struct("fractional_index")).alias("val_json"), none().alias("wrote"), F.col("parent_id").alias("more"))
    return maps.unionByName(sums).unionByName(seqs).unionByName(trees)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace(">", "\\>").replace("/", "\\s").replace("\0", "\\0")


def _base36(n: int) -> str:
    digits, sign, n = "", "-" if n < 0 else "", abs(n)
    while True:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        if not n:
            return sign + digits


#: The name of a shared child: the path of its parent, a root's name or the peer and counter of what made it in base 36,
#: and the key in it. Separators within names are escaped.
_SHARED = re.compile(rf"{MERGEABLE}(?:\$(?!{MERGEABLE})(?P<root>(?:[^\\/>\0]|\\[\\>])+)|@(?P<peer>0|[1-9a-z][0-9a-z]*):(?P<counter>0|-?[1-9a-z][0-9a-z]*))>(?P<key>(?:[^\\/\0]|\\[\\>s0])*)", re.S)


def is_shared_name(name: str) -> bool:
    """Whether a root's name is that of a shared child. One that only begins like it is an ordinary root."""
    m = _SHARED.fullmatch(name)
    return m is not None and (m["root"] is not None or int(m["peer"], 36) < 1 << 64 and -(1 << 31) <= int(m["counter"], 36) < 1 << 31)


def shared_parent(name: str) -> tuple[str, str] | None:
    """(id of the parent map, key) of a shared child by its name; None if it is no such name. Where keys are nested in
    one another the parent is itself a shared child."""
    if not is_shared_name(name):
        return None
    ends = [i for i, c in enumerate(name) if c == ">" and (len(name[:i]) - len(name[:i].rstrip("\\"))) % 2 == 0]
    above, key = name[: ends[-1]], _unescape(name[ends[-1] + 1 :])
    if len(ends) > 1:
        return f"cid:root-{above}:Map", key
    m = _SHARED.fullmatch(name)
    return (f"cid:root-{_unescape(m['root'])}:Map" if m["root"] is not None else f"cid:{int(m['counter'], 36)}@{int(m['peer'], 36)}:Map"), key


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"s": "/", "0": "\0"}.get(m[1], m[1]), s, flags=re.S)


def mergeable_child(parent: str, key: str, marker: list, domain: str | None = None) -> str | None:
    """The shared child container that a map's 8-byte value stands for, if it is such a marker.

    A marker is 0, 76, 77, 1, the kind and a 24-bit checksum over ``domain``, the parent's id, the key and the kind
    (CRC-32, low bits); the child is a root named by the path to it.
    """
    if domain is None or len(marker) != 8 or marker[:4] != [0, 76, 77, 1] or not all(isinstance(x, int) and 0 <= x < 256 for x in marker) or marker[4] >= len(KINDS):
        return None
    body, _, _ = parent.rpartition(":")
    if body.startswith("cid:root-"):
        name = body[len("cid:root-") :]
        raw = bytes([0x80]) + _varint(len(name.encode())) + name.encode()
        path = name[len(MERGEABLE) :] if name.startswith(MERGEABLE) else "$" + _escape(name)
    else:
        counter, _, peer = body[4:].partition("@")
        raw = bytes([0]) + int(peer).to_bytes(8, "little") + int(counter).to_bytes(4, "little", signed=True)
        path = f"@{_base36(int(peer))}:{_base36(int(counter))}"
    data = domain.encode() + _varint(len(raw)) + raw + _varint(len(key.encode())) + key.encode() + bytes([marker[4]])
    if zlib.crc32(data) & 0xFFFFFF != int.from_bytes(bytes(marker[5:]), "big"):
        return None
    return f"cid:root-{MERGEABLE}{path}>{_escape(key)}:{KINDS[marker[4]]}"


class _Document:
    """The parts of one document; values are built bottom up with a stack, so depth is no limit."""

    def __init__(self, rows: list[dict], domain: str | None):
        self.parts: dict[str, list[dict]] = {}
        for r in rows:
            self.parts.setdefault(r["container"], []).append(r)
        self.domain = domain

    def _own(self, cid: str) -> tuple[object, list[tuple]]:
        """A container's value with holes, and (holder, key, child) for every hole."""
        rows, kind, holes = self.parts.get(cid, []), cid.rpartition(":")[2], []
        if kind == "Text":
            return "".join(json.loads(r["val_json"]) for r in sorted(rows, key=lambda r: r["place"])), holes
        if kind == "Counter":
            total = float(rows[0]["val_json"]) if rows else 0.0
            return int(total) if total == int(total) and abs(total) <= 1 << 53 else total, holes
        if kind == "Tree":
            return self._tree(rows, holes), holes
        if kind == "Map":
            value: object = {}
            entries = [(r["slot"], r) for r in rows]
        else:
            value = [None] * len(rows)
            entries = list(enumerate(sorted(rows, key=lambda r: r["place"])))
        for key, r in entries:
            v = json.loads(r["val_json"])
            child = None
            if isinstance(v, str) and v.startswith(CHILD + "cid:"):
                child = f"cid:{r['wrote']}:{v.rpartition(':')[2]}"
            elif kind == "Map" and isinstance(v, list):
                child = mergeable_child(cid, key, v, self.domain)
            value[key] = v
            if child is not None:
                holes.append((value, key, child))
        return value, holes

    def _tree(self, rows: list[dict], holes: list[tuple]) -> list:
        nodes = {r["slot"]: {"parent": r["more"], "index": r["place"], "meta": {}, "id": r["slot"], "fractional_index": json.loads(r["val_json"]).get("fractional_index"), "children": []} for r in rows}
        top: list[dict] = []
        for r in sorted(rows, key=lambda r: r["place"]):
            node = nodes[r["slot"]]
            holes.append((node, "meta", f"cid:{r['slot']}:Map"))
            if r["more"] is None:
                top.append(node)
            elif r["more"] in nodes and r["more"] != DELETED_PARENT:
                nodes[r["more"]]["children"].append(node)
        return top

    def value(self, root: str) -> object:
        out: dict = {}
        todo = [(out, "", root, frozenset())]
        while todo:
            holder, key, cid, above = todo.pop()
            if cid in above:
                raise ValueError(f"{cid} lies within itself")
            value, holes = self._own(cid)
            holder[key] = value
            within = above | {cid} if holes else above
            todo += [(h, k, c, within) for h, k, c in holes]
        return out[""]


def documents(changes: DataFrame, ops: DataFrame, domain: str | None = None) -> DataFrame:
    """(doc_id, root_name, kind, value): the state of each document, a row per root with its value as JSON.

    Of roots with one name the one whose ops arrived first shows. Shared children show under their parents only. A map's
    value stands for a shared child if it is a marker whose checksum over ``domain`` (a constant of the log's format)
    is right; without a domain no marker can be told from a value of eight bytes, and none is followed.
    """
    arrived = ops.filter(container_is_root(F.col("container"))).groupBy("doc_id", "container").agg(F.min("arrival").alias("first"))
    roots = arrived.select("doc_id", "container", F.lit("@root").alias("slot"), F.col("first").alias("place"), F.lit(None).cast("string").alias("val_json"), F.lit(None).cast("string").alias("wrote"), F.lit(None).cast("string").alias("more"))
    rows = container_parts(changes, ops).withColumn("_r", F.lit(0)).unionByName(roots.withColumn("_r", F.lit(1)))

    def work(group: list[dict]) -> Iterator[tuple]:
        doc = _Document([r for r in group if not r["_r"]], domain)
        named: set[str] = set()
        for r in sorted((r for r in group if r["_r"]), key=lambda r: r["place"]):
            name, _, kind = r["container"][len("cid:root-") :].rpartition(":")
            if name not in named and not is_shared_name(name):
                named.add(name)
                yield r["doc_id"], name, kind, json.dumps(doc.value(r["container"]), ensure_ascii=False)

    return per_group(rows, ["doc_id"], ["container"], work, "doc_id string, root_name string, kind string, value string")
