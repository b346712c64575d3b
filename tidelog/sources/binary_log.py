"""The binary op log: blobs of changes to rows of the log tables, and back.

A blob has a header (magic, checksum, mode) and blocks, each a run of changes of one writer with its own tables of
peers, keys, containers and positions. A snapshot holds its blocks in a small key-value store, whose parts may be
compressed. Blobs are independent of one another, so both directions are one pass: a row per blob in, its changes or
ops out, or a document's log in, its blob out. A blob that cannot be read gives one row that says why.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions.ids import DELETED_PARENT, KINDS
from tidelog.plans.grouped import per_group
from tidelog.plans.schema import CHANGES, CHILD, OPS, SPELLINGS
from tidelog.sources import columns as col
from tidelog.sources.columns import Cursor

#: Fixed values of the format.
MAGIC, STORE_MAGIC, FRAME_MAGIC = bytes([108, 111, 114, 111]), bytes([76, 79, 82, 79]), 0x184D2204
SEED = 0x4F524F4C
SNAPSHOT, UPDATES = 3, 4
#: The numbers of op kinds.
NULL, TRUE, FALSE, INT, FLOAT, STR, BYTES, CONTAINER, DELETE_ONCE, DELETE_SEQ, DELTA_INT, VALUE, MARK, TREE_MOVE, LIST_MOVE, LIST_SET, RAW_TREE_MOVE = range(17)
#: The numbers of value kinds within a value.
V_NULL, V_TRUE, V_FALSE, V_INT, V_FLOAT, V_STR, V_BYTES, V_LIST, V_MAP, V_CHILD = range(10)
#: Nesting of values, and bytes a compressed part may grow to.
DEEPEST, LARGEST = 128, 64 << 20
#: Estimated bytes of a block that is written.
BLOCK_BYTES = 4096


class Child:
    """A child container within a value; it is named by the id of what holds it."""

    def __init__(self, kind: int):
        self.kind = kind


def _json(v, holder: str) -> str:
    """JSON text; a child as its printed id, bytes as a list of numbers, a whole float with its fraction."""

    def plain(x):
        if isinstance(x, Child):
            return f"{CHILD}cid:{holder}:{KINDS[x.kind] if x.kind < len(KINDS) else 'Unknown'}"
        if isinstance(x, bytes):
            return list(x)
        if isinstance(x, list):
            return [plain(y) for y in x]
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        return x

    return json.dumps(plain(v), ensure_ascii=False)


class _Values(Cursor):
    def __init__(self, data: bytes, keys: list[str]):
        super().__init__(data)
        self.keys = keys

    def float(self) -> float:
        return struct.unpack(">d", self.bytes(8))[0]

    def value(self, depth: int = 0):
        if depth > DEEPEST:
            raise ValueError("a value nested too deep")
        kind = self.byte()
        if kind in (V_NULL, V_TRUE, V_FALSE):
            return (None, True, False)[kind]
        if kind == V_INT:
            return self.leb()
        if kind == V_FLOAT:
            return self.float()
        if kind == V_STR:
            return self.text()
        if kind == V_BYTES:
            return self.block()
        if kind == V_CHILD:
            return Child(self.byte())
        n = self.unsigned()
        if kind not in (V_LIST, V_MAP) or n > self.left():
            raise ValueError("an impossible value")
        if kind == V_LIST:
            return [self.value(depth + 1) for _ in range(n)]
        return {self.keys[self.unsigned()]: self.value(depth + 1) for _ in range(n)}

    def op(self, kind: int):
        """What an op of this kind carries."""
        if kind in (NULL, TRUE, FALSE):
            return (None, True, False)[kind]
        if kind in (INT, DELTA_INT):
            return self.leb()
        if kind == FLOAT:
            return self.float()
        if kind == STR:
            return self.text()
        if kind == BYTES:
            return self.block()
        if kind in (CONTAINER,):
            return self.unsigned()
        if kind in (DELETE_ONCE, DELETE_SEQ):
            return None
        if kind == VALUE:
            return self.value()
        if kind == MARK:
            return {"info": self.byte(), "len": self.unsigned(), "key": self.unsigned(), "value": self.value()}
        if kind == LIST_MOVE:
            return {"from": self.unsigned(), "peer": self.unsigned(), "lamport": self.unsigned()}
        if kind == LIST_SET:
            return {"peer": self.unsigned(32), "lamport": self.unsigned(32), "value": self.value()}
        if kind == RAW_TREE_MOVE:
            got = {"peer": self.unsigned(), "counter": self.unsigned(), "position": self.unsigned(), "parent": None}
            if not self.byte():
                got["parent"] = (self.unsigned(), self.unsigned())
            return got
        raise ValueError(f"op kind {kind}")


def _positions(blob: bytes) -> list[bytes]:
    if not blob:
        return []
    shared, rests = Cursor(blob).columns(2)
    prefixes = shared.runs(shared.unsigned)
    out: list[bytes] = []
    for k in range(rests.unsigned()):
        before = out[-1] if out else b""
        n = prefixes[k] if k < len(prefixes) else 0
        if n > len(before):
            raise ValueError("a position longer than the one it continues")
        out.append(before[:n] + rests.block())
    return out


def _block(raw: bytes) -> Iterator[tuple[dict, list[dict]]]:
    """The changes of a block, each with its ops."""
    c = Cursor(raw)
    counter_start, counter_len, lamport_start, lamport_len, n = (c.unsigned() for _ in range(5))
    header, meta, cids, keys_blob, positions_blob, ops_blob, deletes_blob, values_blob = (c.block() for _ in range(8))
    c.done()
    if not 1 <= n <= len(raw) + 1:
        raise ValueError("an impossible number of changes")
    h = Cursor(header)
    peers = [str(int.from_bytes(h.bytes(8), "little")) for _ in range(h.unsigned())]
    if not peers:
        raise ValueError("no peers")
    lens = [h.unsigned() for _ in range(n - 1)]
    lens.append(counter_len - sum(lens))
    on_self, dep_lens = h.flags(n), h.runs(h.unsigned, n)
    total = sum(dep_lens)
    if total > len(header):
        raise ValueError("more dependencies than bytes")
    dep_peers, dep_counters = h.runs(h.unsigned, total), h.second_differences(total)
    lamports = [*h.second_differences(n - 1), lamport_start + lamport_len - lens[-1]]
    h.done()
    if lens[-1] < 0 or lamports[-1] < 0:
        raise ValueError("lengths that do not add up")
    m = Cursor(meta)
    times, message_lens = m.second_differences(n), m.runs(m.unsigned, n)
    messages = [m.bytes(k).decode() for k in message_lens]
    m.done()
    keys, k = [], Cursor(keys_blob)
    while k.left():
        keys.append(k.text())
    containers, k = [], Cursor(cids)
    for _ in range(k.unsigned() if cids else 0):
        k.unsigned()
        root, kind, peer, at = k.byte(), k.byte(), k.unsigned(), k.signed()
        if root > 1:
            raise ValueError("neither a root nor a child")
        name = f"root-{keys[at]}" if root else f"{at}@{peers[peer]}"
        containers.append((f"cid:{name}:{KINDS[kind] if kind < len(KINDS) else 'Unknown'}", KINDS[kind] if kind < len(KINDS) else "Unknown"))
    positions = _positions(positions_blob)
    deletes = []
    if deletes_blob:
        deletes = list(zip(*(x.differences() for x in Cursor(deletes_blob).columns(3))))
    a, b, d, e = Cursor(ops_blob).columns(4)
    table = list(zip(a.differences(), b.differences(), d.runs(d.byte), e.runs(e.unsigned)))

    changes: list[dict] = []
    at, dep = counter_start, 0
    for i in range(n):
        deps = [f"{at - 1}@{peers[0]}"] if on_self[i] else []
        for _ in range(dep_lens[i]):
            deps.append(f"{dep_counters[dep]}@{peers[dep_peers[dep]]}")
            dep += 1
        changes.append({"peer": peers[0], "counter": at, "end_counter": at + lens[i], "lamport": lamports[i], "ts": times[i], "deps": deps, "msg": messages[i] or None, "ops": []})
        at += lens[i]
    values, at, now = _Values(values_blob, keys), counter_start, 0
    deletes.reverse()
    for container, prop, kind, length in table:
        while now + 1 < n and at >= changes[now + 1]["counter"]:
            now += 1
        cid, kind_name = containers[container]
        if container < 0 or prop < 0 and kind_name == "Map":
            raise ValueError("an index below 0")
        own = f"{at}@{peers[0]}"
        row = {"peer": peers[0], "counter": at, "len": length, "lamport": changes[now]["lamport"] + at - changes[now]["counter"], "change_counter": changes[now]["counter"], "container": cid, "vkind": _spelled(kind)}
        row["map_key" if kind_name == "Map" else "pos"] = keys[prop] if kind_name == "Map" else prop
        v = values.op(kind)
        if kind == DELETE_SEQ:
            p, start, span = deletes.pop()
            if abs(span) != length:
                raise ValueError("a delete of another length")
            row |= {"del_start": f"{start}@{peers[p]}", "del_len": span}
        elif kind == MARK:
            row |= {"mark_len": v["len"], "mark_key": keys[v["key"]], "mark_info": v["info"], "val_json": _json(v["value"], own)}
        elif kind == LIST_MOVE:
            row |= {"move_from": v["from"], "elem": f"{v['lamport']}@{peers[v['peer']]}"}
        elif kind == LIST_SET:
            row |= {"elem": f"{v['lamport']}@{peers[v['peer']]}", "val_json": _json(v["value"], own)}
        elif kind == RAW_TREE_MOVE:
            row |= {"tree_target": f"{v['counter']}@{peers[v['peer']]}", "tree_parent": v["parent"] and f"{v['parent'][1]}@{peers[v['parent'][0]]}"}
            if row["tree_parent"] != DELETED_PARENT:
                row["fractional_index"] = positions[v["position"]].hex().upper()
        elif kind not in (DELETE_ONCE, NULL):
            if kind == VALUE and kind_name in ("List", "MovableList"):
                if not isinstance(v, list) or len(v) != length:
                    raise ValueError("an insert of another length")
                v = [json.loads(_json(x, f"{at + j}@{peers[0]}")) if isinstance(x, (Child, list, dict, bytes)) else x for j, x in enumerate(v)]
            elif kind == STR and len(v) != length:
                raise ValueError("an insert of another length")
            row["val_json"] = _json(v, own)
        changes[now]["ops"].append(row)
        at += length
    yield from ((x, x.pop("ops")) for x in changes)


def _spelled(kind: int) -> str:
    """The op log's word for an op kind."""
    words = {VALUE: "insert", STR: "insert", DELETE_ONCE: "delete", DELETE_SEQ: "delete", LIST_MOVE: "move", LIST_SET: "set", MARK: "mark", NULL: "mark_end", RAW_TREE_MOVE: "move", FLOAT: "counter", INT: "counter"}
    return words.get(kind, f"kind{kind}")


def _body(blob: bytes) -> tuple[int, bytes]:
    if len(blob) < 22 or blob[:4] != MAGIC:
        raise ValueError("no header")
    mode = int.from_bytes(blob[20:22], "big")
    if mode not in (SNAPSHOT, UPDATES):
        raise ValueError(f"mode {mode}")
    if xxhash.xxh32_intdigest(blob[20:], SEED) != int.from_bytes(blob[16:20], "little"):
        raise ValueError("a wrong checksum")
    return mode, blob[22:]


def _store(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a key-value store."""
    if len(data) < 17 or data[:4] != STORE_MAGIC or data[4]:
        raise ValueError("no store")
    meta_at = int.from_bytes(data[-4:], "little")
    meta = data[meta_at:-4]
    body = meta[4:-4]
    if xxhash.xxh32_intdigest(body, SEED) != int.from_bytes(meta[-4:], "little"):
        raise ValueError("a wrong checksum")
    c, parts = Cursor(body), []
    number = lambda n: int.from_bytes(c.bytes(n), "little")
    for _ in range(int.from_bytes(meta[:4], "little")):
        begin, first, flags = number(4), c.bytes(number(2)), c.byte()
        if flags < 128:
            c.bytes(number(2))
        parts.append((begin, first, flags))
    for (begin, first, flags), end in zip(parts, [p[0] for p in parts[1:]] + [meta_at]):
        part = data[begin : end - 4]
        if xxhash.xxh32_intdigest(part, SEED) != int.from_bytes(data[end - 4 : end], "little"):
            raise ValueError("a wrong checksum")
        if flags & 127 == 1:
            part = unpack(part)
        elif flags & 127:
            raise ValueError(f"compression {flags & 127}")
        if flags >= 128:
            yield first, part
            continue
        n = int.from_bytes(part[-2:], "little")
        stop = len(part) - 2 * (n + 1)
        at = [int.from_bytes(part[stop + 2 * i : stop + 2 * i + 2], "little") for i in range(n)] + [stop]
        for i in range(n):
            entry = Cursor(part[at[i] : at[i + 1]])
            key = first
            if i:
                shared = entry.byte()
                key = first[:shared] + entry.bytes(int.from_bytes(entry.bytes(2), "little"))
            yield key, entry.bytes(entry.left())


def unpack(frame: bytes) -> bytes:
    """A frame of LZ4: literals and back references, with optional checksums."""
    c = Cursor(frame)
    if int.from_bytes(c.bytes(4), "little") != FRAME_MAGIC:
        raise ValueError("no frame")
    flags = c.byte()
    c.byte()
    if flags >> 6 != 1:
        raise ValueError("another version")
    c.bytes(8 * (flags >> 3 & 1) + 4 * (flags & 1))
    if xxhash.xxh32_intdigest(frame[4 : c.at], 0) >> 8 & 255 != c.byte():
        raise ValueError("a wrong checksum")
    out = bytearray()
    while size := int.from_bytes(c.bytes(4), "little"):
        part = c.bytes(size & 0x7FFFFFFF)
        if flags & 16 and xxhash.xxh32_intdigest(part, 0) != int.from_bytes(c.bytes(4), "little"):
            raise ValueError("a wrong checksum")
        if size >> 31:
            out += part
        else:
            _unpack_block(Cursor(part), out)
        if len(out) > LARGEST:
            raise ValueError("too large")
    if flags & 4 and xxhash.xxh32_intdigest(bytes(out), 0) != int.from_bytes(c.bytes(4), "little"):
        raise ValueError("a wrong checksum")
    return bytes(out)


def _unpack_block(c: Cursor, out: bytearray) -> None:
    def length(n: int) -> int:
        if n == 15:
            while (b := c.byte()) == 255:
                n += 255
            n += b
        return n

    while c.left():
        token = c.byte()
        out += c.bytes(length(token >> 4))
        if not c.left():
            return
        back = int.from_bytes(c.bytes(2), "little")
        n = length(token & 15) + 4
        if not 0 < back <= len(out) or len(out) + n > LARGEST:
            raise ValueError("an impossible reference")
        for _ in range(n):
            out.append(out[-back])


def decode(blob: bytes) -> list[tuple[dict, list[dict]]]:
    """(change, ops) of every change of a blob."""
    mode, body = _body(blob)
    c, raw = Cursor(body), []
    if mode == UPDATES:
        while c.left():
            raw.append(c.block())
    else:
        raw = [v for k, v in _store(c.bytes(int.from_bytes(c.bytes(4), "little"))) if len(k) == 12]
    try:
        return [x for r in raw for x in _block(r)]
    except (IndexError, UnicodeDecodeError, RecursionError) as e:
        raise ValueError(f"malformed block: {e}") from None


class _Table(dict):
    """Things in order of first use, with their numbers."""

    def number(self, x) -> int:
        return self.setdefault(x, len(self))


class _Writer:
    """One block."""

    def __init__(self, peer: str):
        self.peers, self.keys, self.containers, self.places = _Table({peer: 0}), _Table(), _Table(), _Table()
        self.values, self.deletes, self.rows = bytearray(), [], []

    def peer_of(self, printed: str) -> tuple[int, int]:
        counter, _, peer = printed.partition("@")
        return self.peers.number(peer), int(counter)

    def value(self, v) -> None:
        out = self.values
        if v is None or isinstance(v, bool):
            out.append({None: V_NULL, True: V_TRUE, False: V_FALSE}[v])
        elif isinstance(v, int):
            out.append(V_INT)
            col.leb(out, v)
        elif isinstance(v, float):
            out.append(V_FLOAT)
            out += struct.pack(">d", v)
        elif isinstance(v, str) and v.startswith(CHILD + "cid:"):
            out += bytes([V_CHILD, KINDS.index(v.rpartition(":")[2])])
        elif isinstance(v, str):
            out.append(V_STR)
            col.block(out, v.encode())
        elif isinstance(v, list) and len(v) == 8 and v[:4] == [0, 76, 77, 1]:
            out.append(V_BYTES)  # JSON cannot tell bytes from a list; only markers of shared children are bytes
            col.block(out, bytes(v))
        elif isinstance(v, list):
            out.append(V_LIST)
            col.unsigned(out, len(v))
            for x in v:
                self.value(x)
        else:
            out.append(V_MAP)
            col.unsigned(out, len(v))
            for k in sorted(v):
                col.unsigned(out, self.keys.number(k))
                self.value(v[k])

    def op(self, r: dict) -> None:
        cid, kind = r["container"], r["container"].rpartition(":")[2]
        what = SPELLINGS.get((kind, r["vkind"]), r["vkind"])
        body = cid[4 : -len(kind) - 1]
        if body.startswith("root-"):
            entry = (1, KINDS.index(kind), 0, self.keys.number(body[5:]))
        else:
            peer, counter = self.peer_of(body)
            entry = (0, KINDS.index(kind), peer, counter)
        prop = self.keys.number(r["map_key"]) if kind == "Map" else r["pos"] or 0
        v = json.loads(r["val_json"]) if r["val_json"] is not None else None
        out = self.values
        if kind == "Counter":
            number = INT if isinstance(v, int) and abs(v) < 1 << 27 else FLOAT
            col.leb(out, v) if number == INT else out.extend(struct.pack(">d", v))
        elif kind == "Tree":
            number = RAW_TREE_MOVE
            peer, counter = self.peer_of(r["tree_target"])
            parent = DELETED_PARENT if what == "delete" else r["tree_parent"]
            place = 0 if parent == DELETED_PARENT else self.places.number(bytes.fromhex(r["fractional_index"] or ""))
            for x in (peer, counter, place):
                col.unsigned(out, x)
            out.append(parent is None)
            if parent is not None:
                for x in self.peer_of(parent):
                    col.unsigned(out, x)
        elif what == "delete":
            number = DELETE_ONCE if kind == "Map" else DELETE_SEQ
            if kind != "Map":
                self.deletes.append((*self.peer_of(r["del_start"]), r["del_len"]))
        elif what == "mark":
            number = MARK
            out.append(r["mark_info"] or 0)
            col.unsigned(out, r["mark_len"])
            col.unsigned(out, self.keys.number(r["mark_key"]))
            self.value(v)
        elif what == "mark_end":
            number = NULL
        elif what in ("move", "set"):
            number = LIST_MOVE if what == "move" else LIST_SET
            peer, lamport = self.peer_of(r["elem"])
            for x in (r["move_from"], peer, lamport) if what == "move" else (peer, lamport):
                col.unsigned(out, x)
            if what == "set":
                self.value(v)
        elif kind == "Text":
            number = STR
            col.block(out, v.encode())
        else:
            number = VALUE
            if kind == "Map":
                self.value(v)
            else:
                out.append(V_LIST)
                col.unsigned(out, len(v))
                for x in v:
                    self.value(x)
        self.rows.append((self.containers.number(entry), prop, number, r["len"]))

    def block(self, changes: list[dict]) -> bytes:
        own, n = changes[0]["peer"], len(changes)
        on_self, dep_lens, dep_peers, dep_counters = [], [], [], []
        for c in changes:
            before = f"{c['counter'] - 1}@{own}"
            on_self.append(before in c["deps"])
            rest = [self.peer_of(d) for d in c["deps"] if d != before]
            dep_lens.append(len(rest))
            dep_peers += [p for p, _ in rest]
            dep_counters += [x for _, x in rest]
        header = bytearray()
        col.unsigned(header, len(self.peers))
        for p in self.peers:
            header += int(p).to_bytes(8, "little")
        lens = [c["end_counter"] - c["counter"] for c in changes]
        for x in lens[:-1]:
            col.unsigned(header, x)
        lamports = [c["lamport"] for c in changes]
        header += col.flags(on_self) + col.runs(dep_lens, col.unsigned) + col.runs(dep_peers, col.unsigned) + col.second_differences(dep_counters) + col.second_differences(lamports[:-1])
        messages = [(c["msg"] or "").encode() for c in changes]
        meta = col.second_differences([c["ts"] or 0 for c in changes]) + col.runs([len(x) for x in messages], col.unsigned) + b"".join(messages)
        cids, keys = bytearray(), bytearray()
        if self.containers:
            col.unsigned(cids, len(self.containers))
        for root, kind, peer, at in self.containers:
            cids += bytes([4, root, kind])
            col.unsigned(cids, peer)
            col.signed(cids, at)
        for k in self.keys:
            col.block(keys, k.encode())
        places = b""
        if self.places:
            prefixes, rests, before = [], bytearray(), b""
            col.unsigned(rests, len(self.places))
            for p in self.places:
                k = next((i for i, (x, y) in enumerate(zip(before, p)) if x != y), min(len(before), len(p)))
                prefixes.append(k)
                col.block(rests, p[k:])
                before = p
            places = col.framed([col.runs(prefixes, col.unsigned), bytes(rests)])
        a, b, d, e = ([r[i] for r in self.rows] for i in range(4))
        ops = col.framed([col.differences(a), col.differences(b), col.runs(d, col.byte), col.runs(e, col.unsigned)])
        deletes = col.framed([col.differences([x[i] for x in self.deletes]) for i in range(3)]) if self.deletes else b""
        out = bytearray()
        for x in (changes[0]["counter"], sum(lens), lamports[0], lamports[-1] + lens[-1] - lamports[0], n):
            col.unsigned(out, x)
        for x in (header, meta, cids, keys, places, ops, deletes, self.values):
            col.block(out, bytes(x))
        return bytes(out)


def encode(changes: list[tuple[dict, list[dict]]]) -> bytes:
    """A blob of updates. Changes of a writer that follow one another share a block up to ``BLOCK_BYTES``."""
    body = bytearray()
    ordered = sorted(changes, key=lambda x: (int(x[0]["peer"]), x[0]["counter"]))
    i = 0
    while i < len(ordered):
        j, size = i, 0
        while j < len(ordered) and (j == i or ordered[j][0]["peer"] == ordered[i][0]["peer"] and ordered[j][0]["counter"] == ordered[j - 1][0]["end_counter"] and size <= BLOCK_BYTES):
            size += sum(16 + len(r["val_json"] or "") + len(r["map_key"] or "") for r in ordered[j][1])
            j += 1
        w = _Writer(ordered[i][0]["peer"])
        for _, ops in ordered[i:j]:
            for r in ops:
                w.op(r)
        col.block(body, w.block([c for c, _ in ordered[i:j]]))
        i = j
    tail = UPDATES.to_bytes(2, "big") + bytes(body)
    return MAGIC + bytes(12) + xxhash.xxh32_intdigest(tail, SEED).to_bytes(4, "little") + tail


def read(blobs: DataFrame, doc_id: str = "doc_id", blob: str = "blob") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, ops, errors) of the blobs of many documents; errors are (doc_id, error), one per unreadable blob.

    A null blob is an unreadable one. ``arrival`` counts within a blob.
    """
    only = blobs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(blob).alias("blob"))

    def part(want: str, ddl: str) -> DataFrame:
        schema = to_arrow_schema(StructType.fromDDL(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, data in zip(b.column("doc_id").to_pylist(), b.column("blob").to_pylist()):
                    rows: list[dict] = []
                    try:
                        if data is None:
                            raise ValueError("null")
                        for i, (change, ops) in enumerate(decode(data)):
                            rows += [change | {"doc_id": doc, "arrival": i}] if want == "changes" else [r | {"doc_id": doc, "arrival": i} for r in ops] if want == "ops" else []
                    except ValueError as e:
                        rows = [{"doc_id": doc, "error": str(e)}] if want == "errors" else []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return only.mapInArrow(run, ddl)

    return part("changes", CHANGES), part("ops", OPS), part("errors", "doc_id string, error string")


def write(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, blob): the whole log of each document as one blob of updates. Repeated rows are written once."""
    own = F.struct(*[F.col(c) for c in ops.columns])
    ops = ops.dropDuplicates(["doc_id", "peer", "counter"]).groupBy("doc_id", "peer", "change_counter").agg(F.array_sort(F.collect_list(F.struct("counter", own.alias("r")))).alias("rows"))
    once = changes.dropDuplicates(["doc_id", "peer", "counter"]).join(ops.withColumnRenamed("change_counter", "counter"), ["doc_id", "peer", "counter"], "left")

    def work(group: list[dict]) -> Iterator[tuple]:
        yield group[0]["doc_id"], encode([(c, [x["r"] for x in c["rows"] or ()]) for c in group])

    return per_group(once, ["doc_id"], ["counter"], work, "doc_id string, blob binary")
