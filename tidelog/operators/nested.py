"""Deeply nested semi-structured records into flat tables.

Each record is parsed as a stream: an object is taken apart as soon as it closes, into a (path, ordinal, value) triple
per scalar, and only its number goes on to what holds it. Paths are grouped by repeated ancestor: objects whose path is
alike are rows of one table, and a key that repeats within itself (``children`` below ``children``) is one table
whatever the depth; an array of scalars is a table of its own. Each group is then pivoted into one table, a row per object and a
column per path asked for, with links to the row above. All triples of a record come from one input row, so grouping
and pivoting need no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One JSON token with the blanks before it. Strings may not hold bare control characters.
_TOKEN = re.compile(r'[ \t\n\r]*(?:("[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|([{}\[\],:])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_BLANK = re.compile(r"[ \t\n\r]*\Z")


class Unreadable(ValueError):
    pass


class NeedsText(Exception):
    """The quick parser does not know where a container stands in the text."""


class Obj:
    """An object of a record: its number, its owner, the key that holds it, its place in an array there, its text."""

    __slots__ = ("no", "owner", "key", "pos", "begin", "end", "fields", "singles", "gone", "group")

    def __init__(self, no: int = 0, owner: "Obj | None" = None, key: str | None = None, pos: int | None = None, begin: int = -1):
        self.no, self.owner, self.key, self.pos, self.begin, self.end, self.gone = no, owner, key, pos, begin, begin, False
        self.singles: dict[str, Obj] = {}  # objects it holds outside of arrays
        #: key -> (ordinal in the array or None, value, kind); kind is w(ord), n(umber), b(oolean), 0 for JSON null,
        #: a for an array within an array, with its place in the text. Objects are not listed: they know their owner.
        self.fields: dict[str, list[tuple]]


def _text(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    try:
        s = json.loads(token)
    except ValueError as e:
        raise Unreadable(str(e)) from None
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Number(str):
    """A number as it was written."""

    __slots__ = ()


def _constant(name: str):
    raise Unreadable(name)


def _sound(s: str) -> str:
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Quick:
    """Parses by the library's tokenizer, which calls back at the end of each object. Depth is bounded by its recursion;
    beyond it, and where the text of a container is asked for, ``parse_deep`` reads the record with a stack of its own."""

    def __init__(self):
        self.objects: list[Obj] = []
        self.decode = json.JSONDecoder(object_pairs_hook=self._closed, parse_int=Number, parse_float=Number, parse_constant=_constant).decode

    def _closed(self, pairs: list[tuple]) -> Obj:
        o = Obj()
        o.fields = fields = {}
        for k, v in pairs:
            k = _sound(k)
            if k in fields:  # of a key given twice the last holds
                for x in self.objects:
                    x.gone = x.gone or x.owner is o and x.key == k
                o.singles.pop(k, None)
            kind = type(v)
            if kind is Obj:
                v.owner, v.key = o, k
                o.singles[k] = v
                fields[k] = []
            elif kind is list:
                fields[k] = held = []
                for i, x in enumerate(v):
                    kind = type(x)
                    if kind is Obj:
                        x.owner, x.key, x.pos = o, k, i
                    elif kind is list:
                        held.append((i, None, "a"))
                        self._within(o, k, x)
                    else:
                        held.append(_scalar(i, x, kind))
            else:
                fields[k] = [_scalar(None, v, kind)]
        self.objects.append(o)
        return o

    def _within(self, o: Obj | None, k: str | None, array: list) -> None:
        """Objects in arrays within arrays belong to the key as well."""
        todo = [array]
        while todo:
            for i, x in enumerate(todo.pop()):
                if type(x) is Obj:
                    x.owner, x.key, x.pos = o, k, i
                elif type(x) is list:
                    todo.append(x)

    def __call__(self, text: str) -> list[Obj]:
        self.objects = []
        try:
            whole = self.decode(text)
        except ValueError as e:
            raise Unreadable(str(e)) from None
        if type(whole) is list:
            self._within(None, None, whole)
        objects, gone = self.objects, False
        for o in reversed(objects):  # owners close after what they own
            o.gone = o.gone or o.owner is not None and o.owner.gone
            gone = gone or o.gone
        return [o for o in objects if not o.gone] if gone else objects


def _scalar(at: int | None, v, kind: type) -> tuple:
    if kind is str:
        return at, _sound(v), "w"
    if kind is Number:
        return at, str(v), "n"
    return (at, None, "0") if v is None else (at, "true" if v else "false", "b")


_quick = Quick()


def parse(text: str | None, spans: bool = False) -> list[Obj]:
    """All objects of a record, in the order they end. Of a key given twice the last holds, with all below it.

    With ``spans`` they know where in the text they stand. Raises ``Unreadable`` if the text as a whole is no JSON
    value. A record that is a scalar has no objects.
    """
    if text is None:
        raise Unreadable("null")
    objects = None
    if not spans:
        try:
            objects = _quick(text)
        except RecursionError:
            pass
    if objects is None:
        objects = sorted(parse_deep(text), key=lambda o: o.end)
    outermost = Group("$", {})
    no = len(objects)
    for o in reversed(objects):  # owners end after what they own
        no -= 1
        o.no, up = no, o.owner
        o.group = outermost if up is None else up.group.step(f".{o.key}" if o.pos is None else f".{o.key}[]")
    return objects


class Group:
    """Paths with one repeated ancestor: a step that occurs on the way already leads back to where it did, so that a
    record has no more groups than its keys can be arranged without repeating one."""

    __slots__ = ("table", "above", "below")

    def __init__(self, table: str, above: dict[str, "Group"]):
        self.table, self.above = table, above
        self.below: dict[str, Group] = {}

    def step(self, name: str) -> "Group":
        g = self.below.get(name)
        if g is None:
            g = self.above.get(name)
            if g is None:
                g = Group(self.table + name, {})
                g.above = self.above | {name: g}
            self.below[name] = g
        return g


def parse_deep(text: str) -> list[Obj]:
    """The objects of a record in the order they begin, with the places where they begin and end."""
    objects: list[Obj] = []
    stack: list[tuple] = []  # (object or None for an array, where it began, owner, key, pos, level) of what is open
    owner = key = pos = None
    level = 0  # arrays between the owner's key and here
    state, at, match, twice = "value", 0, _TOKEN.match, False
    while True:
        m = match(text, at)
        if m is None:
            if state == "end" and _BLANK.match(text, at):
                break
            raise Unreadable(f"at {at}")
        kind = m.lastindex
        start, at, token = m.start(kind), m.end(), m[kind]
        if state == "value" or state == "value or ]":
            if kind != 2:
                if owner is None or level > 1:
                    if kind == 1:
                        _text(token)
                elif kind == 1:
                    owner.fields[key].append((pos, _text(token), "w"))
                elif kind == 3:
                    owner.fields[key].append((pos, token, "n"))
                else:
                    owner.fields[key].append((pos, None, "0") if token == "null" else (pos, token, "b"))
                state = "next" if stack else "end"
                continue
            if token == "{":
                o = Obj(len(objects), owner, key, pos, start)
                o.fields = {}
                objects.append(o)
                if owner is not None and pos is None:
                    owner.singles[key] = o
                stack.append((o, start, owner, key, pos, level))
                state = "key or }"
                continue
            if token == "[":
                stack.append((None, start, owner, key, pos, level))
                pos, level, state = 0, level + 1, "value or ]"
                continue
            if token != "]" or state == "value":
                raise Unreadable(f"at {start}")
        elif state == "key or }" or state == "key":
            if kind == 1:
                owner, key, pos, level = stack[-1][0], _text(token), None, 0
                if key in owner.fields:
                    twice = True
                    owner.singles.pop(key, None)
                    for o in objects[owner.no + 1 :]:
                        o.gone = o.gone or o.owner is owner and o.key == key
                owner.fields[key] = []
                m = match(text, at)
                if m is None or m[2] != ":":
                    raise Unreadable(f"at {at}")
                at, state = m.end(), "value"
                continue
            if token != "}" or state == "key":
                raise Unreadable(f"at {start}")
        elif state == "end":
            raise Unreadable(f"at {start}")
        elif token == "," and kind == 2:
            if stack[-1][0] is None:
                pos, state = pos + 1, "value"
            else:
                state = "key"
            continue
        if kind != 2 or not stack or token != ("]" if stack[-1][0] is None else "}"):
            raise Unreadable(f"at {start}")
        shut, began, owner, key, pos, level = stack.pop()
        if shut is not None:
            shut.end = at
        elif owner is not None and level == 1:
            owner.fields[key].append((pos, (began, at), "a"))
        state = "next" if stack else "end"
    if twice:
        for o in objects:  # owners come before what they own
            o.gone = o.gone or o.owner is not None and o.owner.gone
        objects = [o for o in objects if not o.gone]
    return objects


def triples(text: str | None) -> Iterator[tuple[int, int, int, str, int, str | None]]:
    """(object, owner or -1, place or -1, path, ordinal, value) of each scalar of a record; nothing if unreadable. The
    path is the object's table and the key."""
    try:
        objects = parse(text)
    except Unreadable:
        return
    for o in objects:
        up, place = -1 if o.owner is None else o.owner.no, -1 if o.pos is None else o.pos
        for k, values in o.fields.items():
            for ordinal, value, kind in values:
                if kind != "a":
                    yield o.no, up, place, f"{o.group.table}.{k}", -1 if ordinal is None else ordinal, value


def _holder(o: Obj | None, path: list[str]) -> Obj | None:
    """The object that holds the last key of a path, objects outside of arrays being followed on the way."""
    for k in path[:-1]:
        o = o.singles.get(k) if o is not None else None
    return o if o is not None and path[-1] in o.fields else None


class Pivot:
    """Turns the triples of a record into rows of its tables, see ``tables``."""

    def __init__(self, columns: list[str], arrays: list[str]):
        self.columns, self.arrays = columns, [(a, a.split(".")) for a in arrays]

    def full(self, o: Obj | None) -> bool:
        return o is not None and all(c in o.fields for c in self.columns)

    def values(self, o: Obj) -> list[str | None]:
        """A column's value; null where it is a container or JSON null."""
        return [next((v for at, v, kind in o.fields[c] if at is None and kind != "0"), None) for c in self.columns]

    def rows(self, text: str, spans: bool = False) -> Iterator[tuple]:
        objects = parse(text, spans)
        elements: dict[tuple[int, str], list[Obj]] = {}  # objects in the arrays asked for
        last = {path[-1] for _, path in self.arrays}
        for o in objects:
            if o.pos is not None and o.key in last:
                elements.setdefault((o.owner.no, o.key), []).append(o)
        for o in objects:
            if not self.full(o):
                continue
            own, up = self.values(o), o.owner
            above = self.values(up) if self.full(up) else [None] * len(own)
            at = -1 if o.pos is None else o.pos
            link = (self.full(up), o.key, at, *own, *above)
            yield o.group.table, o.no, -1 if up is None else up.no, *link, None, None, None
            for name, path in self.arrays:
                holder = _holder(o, path)
                if holder is None:
                    continue
                for ordinal, v, kind in holder.fields[path[-1]]:
                    if kind == "a":
                        if v is None:
                            raise NeedsText
                        kind, v = "a", text[v[0] : v[1]]
                    yield f"{o.group.table}.{name}[]", o.no, -1 if up is None else up.no, *link, -1 if ordinal is None else ordinal, kind, v
                for x in elements.get((holder.no, path[-1]), ()):
                    if x.begin < 0:
                        raise NeedsText
                    yield f"{o.group.table}.{name}[]", o.no, -1 if up is None else up.no, *link, x.pos, "o", text[x.begin : x.end]

    def __call__(self, text: str | None) -> list[tuple]:
        try:
            try:
                return list(self.rows(text))
            except NeedsText:
                return list(self.rows(text, spans=True))
        except Unreadable:
            return []


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(states: DataFrame, record_id: str, document: str, rows, fields: list[tuple]) -> DataFrame:
    schema = pa.schema([pa.field("rec", pa.int64()), *[pa.field(n, {"bigint": pa.int64(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for rec, text in zip(b.column(0).to_pylist(), b.column(1)):
                    for r in rows(text.as_py()):
                        yield rec, *r

        return _batches(each(), schema)

    only = states.select(states[record_id].cast("bigint").alias("rec"), states[document].alias("doc"))
    out = only.mapInArrow(run, "rec bigint, " + ", ".join(f"{n} {t}" for n, t in fields))
    return out.withColumnRenamed("rec", record_id)


def record_triples(states: DataFrame, record_id: str = "state_id", document: str = "state_json") -> DataFrame:
    """Path-value-ordinal triples of every record, for any shape of JSON."""
    return _mapped(states, record_id, document, triples, [("obj", "bigint"), ("owner", "bigint"), ("place", "bigint"), ("path", "string"), ("ordinal", "bigint"), ("val", "string")])


def tables(states: DataFrame, columns: list[str], arrays: list[str], record_id: str = "state_id", document: str = "state_json") -> DataFrame:
    """The tables of a set of records whose rows have all of ``columns``, for any shape of JSON.

    (record id, tab, row, up, linked, held, place, columns..., up_<columns>..., ordinal, kind, val). A row of table
    ``tab`` is an object; ``up`` is the object that owns it (-1 for the outermost) under the key ``held`` and at
    ``place`` in an array there (-1 outside of one); ``linked`` tells that the owner has all of the columns too, and
    ``up_<column>`` are its values, so that links by key need no join. Columns are null where the value is JSON null or a
    container. Each entry of an array among ``arrays`` (paths such as ``meta.tags`` from the object on) is a row of the
    table ``tab.path[]``, with ``ordinal`` (-1 for a value that is no array), ``kind`` (w, n, b, 0 for null, a, o) and
    ``val``, containers as their text. Unreadable, empty and null records give no rows.
    """
    pivot = Pivot(columns, arrays)
    fields = [("tab", "string"), ("row", "bigint"), ("up", "bigint"), ("linked", "boolean"), ("held", "string"), ("place", "bigint"), *[(c, "string") for c in columns], *[(f"up_{c}", "string") for c in columns], ("ordinal", "bigint"), ("kind", "string"), ("val", "string")]
    return _mapped(states, record_id, document, pivot, fields)


def flatten_trees(states: DataFrame, record_id: str = "state_id", document: str = "state_json") -> DataFrame:
    """(record id, kind, node_id, parent_id, pos, val): the nodes and tags of the trees in every record.

    A node is a row of any table with both ``id`` and ``fractional_index``; its parent is the node whose ``children``
    holds it, '' if none; pos is its place in its array, 0 outside of one. A tag is an entry of the node's own
    meta.tags: nulls give no row but are counted, a single word or number is one tag at 0, a container within the array
    is its own JSON text. An id that is null or a container reads ''. Unreadable, empty and null records give no rows;
    a record saved twice gives its rows once.
    """
    rows = tables(states, ["id", "fractional_index"], ["meta.tags"], record_id, document)
    parent = F.when(F.col("linked") & (F.col("held") == "children"), F.coalesce("up_id", F.lit(""))).otherwise(F.lit(""))
    node = rows.filter("kind is null or kind <> '0' and (ordinal >= 0 or kind in ('w', 'n'))")
    is_tag = F.col("kind").isNotNull()
    return node.select(
        record_id, F.when(is_tag, "tag").otherwise("node").alias("kind"), F.coalesce("id", F.lit("")).alias("node_id"), parent.alias("parent_id"),
        F.greatest(F.when(is_tag, F.col("ordinal")).otherwise(F.col("place")), F.lit(0)).cast("bigint").alias("pos"), F.coalesce("val", F.lit("")).alias("val"),
    ).distinct()
