"""The binary log: column encodings, round trips, snapshots, and bytes that are none."""

import json
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from test_log import LOGS, numbers, states

from tidelog.operators import assemble
from tidelog.sources import binary_log, json_log
from tidelog.sources import columns as col
from tidelog.sources.columns import Cursor

INTS = st.one_of(st.integers(-3, 3), st.integers(-(2**40), 2**40))


@given(st.lists(INTS, max_size=60), st.lists(st.booleans(), max_size=60))
@settings(max_examples=300, deadline=None)
def test_columns_round_trip(values, bits):
    c = Cursor(col.runs(values, col.signed))
    assert c.runs(c.signed) == values
    assert Cursor(col.differences(values)).differences() == values
    c = Cursor(col.second_differences(values) + b"\x07")
    assert c.second_differences(len(values)) == values and c.byte() == 7
    c = Cursor(col.flags(bits) + b"\x07")
    assert c.flags(len(bits)) == bits and c.byte() == 7


def test_columns_known_bytes():
    assert col.flags([True, True, False, False, False]).hex() == "000203"
    assert col.runs([7, 8, 9], col.unsigned).hex() == "05070809"
    assert col.differences([1, 2, 3, 4, 5, 6]).hex() == "0c02"
    assert col.second_differences([1, 2, 3, 4, 5, 6]).hex() == "010205a000"
    assert col.second_differences([]).hex() == "0000"


@given(st.integers(-(2**63), 2**63 - 1))
def test_signed_numbers(n):
    out = bytearray()
    col.leb(out, n)
    assert Cursor(bytes(out)).leb() == n


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, (peers, changes, _) in LOGS.items():
        (folder / f"{name}.ops.json").write_text(json.dumps({"schema_version": 1, "start_version": {}, "peers": peers, "changes": changes}))
    return [df.cache() for df in json_log.read(spark, str(folder))]


@pytest.fixture(scope="module")
def blobs(log):
    return binary_log.write(*log).cache()


def test_state_survives(blobs):
    changes, ops, errors = binary_log.read(blobs)
    assert errors.count() == 0
    want = {n: numbers(s) for n, (_, _, s) in LOGS.items()}
    assert states(assemble.documents(changes, ops)) == want


def test_changes_and_ops_survive(log, blobs, rows):
    changes, ops, _ = binary_log.read(blobs)
    keep = [c for c in changes.columns if c not in ("arrival", "deps")]
    assert rows(changes, *keep) == rows(log[0], *keep)
    sets = lambda df: {(r.doc_id, r.peer, r.counter): set(r.deps) for r in df.collect()}
    assert sets(changes) == sets(log[0])
    same = ["doc_id", "peer", "counter", "len", "lamport", "container", "map_key", "del_start", "del_len", "move_from", "elem", "mark_key", "mark_len", "tree_target", "tree_parent", "fractional_index"]
    assert rows(ops, *same) == rows(log[1], *same)
    value = lambda df: {(r.doc_id, r.peer, r.counter): numbers(json.loads(r.val_json)) for r in df.filter("val_json is not null").collect()}
    assert value(ops) == value(log[1])


def packed(data):
    """A frame with one compressed block: the first 20 bytes as literals, a run of the last of them, the rest."""
    head = bytes([0x40 | 16 | 4, 0x40])
    part = bytearray()
    lit, run = data[:20], 0
    while 20 + run < len(data) and data[20 + run] == data[19]:
        run += 1
    if run < 4:
        run, lit = 0, data
    n = len(lit)
    part.append(min(n, 15) << 4 | (min(run - 4, 15) if run else 0))
    if n >= 15:
        part += bytes([255] * ((n - 15) // 255) + [(n - 15) % 255])
    part += lit
    if run:
        part += b"\x01\x00"
        if run - 4 >= 15:
            part += bytes([255] * ((run - 19) // 255) + [(run - 19) % 255])
        tail = data[20 + run :]
        part.append(min(len(tail), 15) << 4)
        if len(tail) >= 15:
            part += bytes([255] * ((len(tail) - 15) // 255) + [(len(tail) - 15) % 255])
        part += tail
    check = lambda b: xxhash.xxh32_intdigest(b, 0).to_bytes(4, "little")
    return binary_log.FRAME_MAGIC.to_bytes(4, "little") + head + bytes([xxhash.xxh32_intdigest(head, 0) >> 8 & 255]) + len(part).to_bytes(4, "little") + bytes(part) + check(bytes(part)) + bytes(4) + check(data)


@pytest.mark.parametrize("data", [b"", b"abc", b"x" * 500, bytes(range(200)), b"a" * 19 + b"b" * 300 + bytes(range(99))])
def test_unpack(data):
    assert binary_log.unpack(packed(data)) == data


def snapshot(updates, large):
    mode, body = binary_log._body(updates)
    c, raw = Cursor(body), []
    while c.left():
        raw.append(c.block())
    check = lambda b: xxhash.xxh32_intdigest(b, binary_log.SEED).to_bytes(4, "little")
    store, meta = bytearray(binary_log.STORE_MAGIC + b"\0"), bytearray()
    if large:
        for i, r in enumerate(raw):
            part = packed(r)
            meta += len(store).to_bytes(4, "little") + (12).to_bytes(2, "little") + i.to_bytes(12, "big") + bytes([128 | 1])
            store += part + check(part)
        count = len(raw)
    else:
        entries = [(b"fr", b"?"), *((i.to_bytes(12, "big"), r) for i, r in enumerate(raw))]
        part, offsets = bytearray(), []
        for i, (k, v) in enumerate(entries):
            offsets.append(len(part))
            part += (b"" if not i else bytes([0]) + len(k).to_bytes(2, "little") + k) + v
        part += b"".join(o.to_bytes(2, "little") for o in offsets) + len(entries).to_bytes(2, "little")
        meta += len(store).to_bytes(4, "little") + (2).to_bytes(2, "little") + b"fr" + bytes([0]) + (12).to_bytes(2, "little") + bytes(12)
        store += part + check(bytes(part))
        count = 1
    at = len(store)
    store += count.to_bytes(4, "little") + meta + check(bytes(meta)) + at.to_bytes(4, "little")
    tail = binary_log.SNAPSHOT.to_bytes(2, "big") + len(store).to_bytes(4, "little") + bytes(store)
    return binary_log.MAGIC + bytes(12) + check(tail) + tail


@pytest.mark.parametrize("large", [False, True])
def test_snapshots(blobs, large):
    for r in blobs.collect():
        assert binary_log.decode(snapshot(bytes(r.blob), large)) == binary_log.decode(bytes(r.blob))


def test_bytes_that_are_none(spark, blobs, rows):
    good = bytes(blobs.first().blob)
    bad = {"null": None, "empty": b"", "short": good[:10], "magic": b"x" + good[1:], "sum": good[:-1] + bytes([good[-1] ^ 1]), "mode": good[:21] + b"\x01" + good[22:]}
    df = spark.createDataFrame([*bad.items(), ("good", good)], "doc_id string, blob binary")
    changes, ops, errors = binary_log.read(df)
    assert {r.doc_id for r in errors.collect()} == set(bad)
    assert {r.doc_id for r in changes.collect()} == {r.doc_id for r in ops.collect()} == {"good"}


def test_any_damage_is_an_error_or_a_log(blobs):
    rnd = random.Random(1)
    for r in blobs.collect():
        body = bytes(r.blob)[20:]
        for _ in range(150):
            at = rnd.randrange(2, len(body)) if len(body) > 2 else 0
            hurt = body[:at] + bytes([rnd.randrange(256)]) + body[at + 1 :]
            try:
                binary_log.decode(binary_log.MAGIC + bytes(12) + xxhash.xxh32_intdigest(hurt, binary_log.SEED).to_bytes(4, "little") + hurt)
            except ValueError:
                pass
