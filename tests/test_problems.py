"""Problems 1 to 6: brute force, and the cases each operator's docstring defines."""

import json
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelog.functions.ids import DELETED_PARENT
from tidelog.operators import changefeed, dedup, hierarchy, incremental, intervals, nested
from tidelog.plans.problems import covered_ids

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
SPANS = "doc_id string, peer string, lo bigint, hi bigint, _pos int, what string"


def brute_periods(spans):
    ids = defaultdict(set)
    for d, p, lo, hi, *_ in spans:
        if None not in (d, p, lo, hi):
            ids[d, p] |= set(range(lo, hi))
    out = []
    for key, held in ids.items():
        ends = []
        for x in sorted(held):
            if ends and ends[-1][1] == x:
                ends[-1][1] = x + 1
            else:
                ends.append([x, x + 1])
        out += [(*key, "period", *e) for e in ends]
        out += [(*key, "gap", a[1], b[0]) for a, b in zip(ends, ends[1:])]
    return sorted(out, key=repr)


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["1", "2"]), st.one_of(st.none(), st.integers(-5, 40)), st.one_of(st.none(), st.integers(-5, 40))), max_size=30), st.integers(1, 4))
def test_periods_and_gaps(spark, rows, spans, bits):
    kept, intervals.BLOCK_BITS = intervals.BLOCK_BITS, bits  # small blocks, so that carrying is exercised
    try:
        df = spark.createDataFrame([(*s, 1, "x") for s in spans], SPANS)
        assert rows(intervals.periods_and_gaps(df, ["doc_id", "peer"])) == brute_periods(spans)
    finally:
        intervals.BLOCK_BITS = kept


def test_covered_ids(spark, rows):
    spans = [("d", "1", k, s, e, n) for k, s, e, n in [("range", 5, 9, None), ("range", 9, 5, None), ("range", 3, 3, None), ("range", -4, 2, None), ("range", 4, None, None), ("delete", 7, None, -3), ("delete", 7, None, 3), ("delete", None, None, 3), ("range", None, 3, None), ("delete", -2, None, 3)]]
    df = spark.createDataFrame(spans, "doc_id string, peer string, span_kind string, span_start bigint, span_end bigint, del_len bigint")
    got = [(lo, hi) for _, _, lo, hi in (tuple(r) for r in covered_ids(df).collect())]
    assert [g if g[1] is not None and g[1] > g[0] else None for g in got] == [(5, 9), (6, 10), None, (0, 2), None, (7, 10), (7, 10), None, None, (0, 1)]


CHANGES = "arrival bigint, doc_id string, peer string, counter bigint, end_counter bigint, _reach int"


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["1", "2", None]), st.integers(0, 30), st.integers(1, 9)), max_size=25), st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["1", "2"]), st.integers(0, 30), st.integers(0, 15)), max_size=20), st.integers(1, 4))
def test_pending(spark, rows, changes, spans, bits):
    kept, intervals.BLOCK_BITS = intervals.BLOCK_BITS, bits
    try:
        runs = spark.createDataFrame([(1, 1, "started"), (1, 2, " Committed "), (2, 1, "committed"), (2, 2, "revoked"), (3, 5, "COMMITTED"), (3, 4, "failed"), (4, 1, None), (None, 1, "committed")], "run_id bigint, seq int, status string")
        work = spark.createDataFrame([(r, "d", p, a, a + n) for r, p, a, n in spans], "run_id bigint, doc_id string, peer string, start_counter bigint, end_counter bigint")
        feed = spark.createDataFrame([(i, "d", p, c, c + n, 0) for i, (p, c, n) in enumerate(changes)], CHANGES)
        done = {(p, x) for r, p, a, n in spans if r in (1, 3) for x in range(a, a + n)}
        want = {("d", p, c) for p, c, n in changes if p is not None and any((p, x) not in done for x in range(c, c + n))}
        assert rows(incremental.pending(feed, runs, work)) == sorted(want, key=repr)
    finally:
        intervals.BLOCK_BITS = kept


def test_pending_upper_limit_and_empty(spark, rows):
    runs = spark.createDataFrame([], "run_id bigint, seq int, status string")
    work = spark.createDataFrame([], "run_id bigint, doc_id string, peer string, start_counter bigint, end_counter bigint")
    feed = spark.createDataFrame([(1, "d", "1", 0, 2, 0), (2, "d", "1", 2, 4, 0)], CHANGES)
    assert rows(incremental.pending(feed, runs, work, upper=1)) == [("d", "1", 0)]
    assert rows(incremental.pending(feed.limit(0), runs, work)) == []


def test_ledger(spark, tmp_path):
    source = lambda n: spark.range(n).selectExpr("id as seq", "id * 2 as v")
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.output() is None and ledger.run(source(0), "seq", lambda x: x) is None
    for crash in ("output", "commit"):
        with pytest.raises(RuntimeError):
            ledger.run(source(5), "seq", lambda x: x, crash=crash)
        assert ledger.watermark() is None
    assert ledger.run(source(5), "seq", lambda x: x) == 4
    assert ledger.run(source(5), "seq", lambda x: x) is None
    with pytest.raises(RuntimeError):
        ledger.run(source(9), "seq", lambda x: x, crash="commit")
    other = incremental.Ledger(spark, f"file://{tmp_path}/ledger")
    assert other.run(source(12), "seq", lambda x: x) == 11
    assert sorted(r.seq for r in ledger.output().collect()) == list(range(12))
    with pytest.raises(RuntimeError):  # the loser of a race
        ledger.commit(1, {"output": "x", "from": 4, "watermark": 11})


OPS = "doc_id string, peer string, counter bigint, len bigint, lamport bigint, container string, vkind string, map_key string, val_json string, change_counter bigint, watermark string"
TXS = "doc_id string, peer string, counter bigint, end_counter bigint, deps array<string>, watermark string"


def op(peer, counter, lamport, vkind, key, val=None, container="cid:root-a:b:Map", doc="d", n=1, of=None):
    return (doc, peer, counter, n, lamport, container, vkind, key, val, counter if of is None else of, "clash")


def tx(peer, counter, end, *deps):
    return ("d", peer, counter, end, list(deps), "clash")


def test_map_entries(spark, rows):
    ops = [
        op("9", 0, 5, "insert", "k", "1"), op("10", 0, 5, "LoroValue", "k", "2"),  # a lamport tie: 10 is the greater peer
        op("18446744073709551615", 0, 5, "insert", "K", "3"), op("2", 0, 6, "DeleteOnce", "K"),
        op("3", 0, 1, "insert", "n", "null"), op("3", 0, 1, "insert", "n", "null"),  # a repeat, and a key set to null
        op("3", 1, 2, "delete", "gone"), op("3", 2, 3, "insert", None, "1"), op("3", 3, 4, "Str", "t", '"x"'),
        op("3", 9, 9, "insert", "late", "1"),  # behind a gap
        op("3", 4, 5, "insert", "k", "5", container="cid:root-a:b:Text"), op("3", 5, 5, "insert", "k ", "6"), op(None, 5, 5, "insert", "z", "6"),
        op("4", 0, 9, "insert", "unknown", "1"),  # of a change that was not delivered
    ]
    df = spark.createDataFrame(ops, OPS)
    changes = spark.createDataFrame([tx(o[1], o[2], o[2] + 1) for o in ops[:-1]] + [tx("3", 0, 1), ("d", "1", 0, 3, None, ""), (None, "1", 0, 3, [], "")], TXS)
    held = [("d", "cid:root-a:b:Map", "k ", "3", 5, "6"), ("d", "cid:root-a:b:Map", "k", "10", 0, "2"), ("d", "cid:root-a:b:Map", "n", "3", 0, "null")]
    assert rows(changefeed.map_entries(changes, df)) == sorted(held, key=repr)
    late = [("d", "cid:root-a:b:Map", "late", "3", 9, "1"), ("d", "cid:root-a:b:Map", "unknown", "4", 0, "1")]
    assert rows(changefeed.map_entries(changes, df, close=True)) == sorted([*held, *late], key=repr)
    assert rows(changefeed.map_entries(changes.limit(0), df)) == rows(changefeed.map_entries(changes, df.limit(0), close=True)) == []
    assert rows(changefeed.map_entries(changes.limit(0), df, close=True)) == rows(changefeed.map_entries(changes, df, close=True))


def test_only_whole_transactions_are_exposed(spark, rows):
    ops = [op("1", 0, 0, "insert", "a", "1"), op("1", 1, 1, "insert", "b", "2", of=0), op("1", 2, 2, "insert", "a", "3"), op("1", 3, 3, "insert", "b", "4", of=2), op("2", 0, 0, "insert", "c", "5"), op("3", 0, 0, "insert", "d", "6")]
    changes = spark.createDataFrame([tx("1", 0, 2), tx("1", 2, 5), tx("1", 2, 5), tx("2", 0, 2), tx("3", 0, 1)], TXS)
    df = spark.createDataFrame(ops, OPS)
    assert rows(changefeed.map_entries(changes, df), "map_key", "val_json") == [("a", "1"), ("b", "2"), ("d", "6")]
    assert rows(changefeed.map_entries(changes, df, close=True), "map_key", "val_json") == [("a", "3"), ("b", "4"), ("c", "5"), ("d", "6")]


def test_transactions_wait_for_what_they_depend_on(spark, rows):
    ops = [op("1", 0, 0, "insert", "a", "1"), op("1", 2, 9, "insert", "a", "gap")]
    ops += [op("2", 0, 1, "insert", "b", "1"), op("2", 1, 10, "insert", "b", "2"), op("2", 2, 11, "insert", "b", "3")]
    ops += [op("3", 0, 12, "insert", "c", "1"), op("4", 0, 1, "insert", "d", "1"), op("4", 1, 9, "insert", "d", "2"), op("5", 0, 1, "insert", "e", "1")]
    changes = [tx("1", 0, 1), tx("1", 2, 3), tx("2", 0, 1, "0@1"), tx("2", 1, 2, "0@2", "2@1"), tx("2", 2, 3), tx("3", 0, 1, "2@2"), tx("4", 0, 1, "0@2"), tx("4", 1, 2, "0@3"), tx("5", 0, 1, "0@77")]
    got = rows(changefeed.map_entries(spark.createDataFrame(changes, TXS), spark.createDataFrame(ops, OPS)), "map_key", "val_json")
    # 2@1 lies behind a gap, so 1@2 waits, so 2@2 does, so 0@3, so 1@4; 0@77 never came
    assert got == [("a", "1"), ("b", "1"), ("d", "1")]


@SLOW
@given(st.randoms(use_true_random=False))
def test_commit_against_brute_force(spark, rows, rnd):
    changes, ops = [], []
    for p in "123":
        at = 0
        for _ in range(6):
            n = rnd.randint(1, 3)
            deps = [f"{rnd.randint(0, 8)}@{q}" for q in "123" if q != p and rnd.random() < 0.3]
            if rnd.random() < 0.95:
                changes.append(tx(p, at, at + n, *deps))
            ops += [op(p, at + k, 10 * at + k, "insert", f"{at + k}@{p}", "1", of=at) for k in range(n) if rnd.random() < 0.97]
            at += n
    came = {(o[1], o[2]) for o in ops}
    held = {"1": 0, "2": 0, "3": 0}
    done = False
    while not done:  # commits what can be committed, one transaction at a time
        done = True
        for _, p, lo, hi, deps, _ in changes:
            if held[p] == lo and all((p, x) in came for x in range(lo, hi)):
                if all(int(d[0]) < held[d[-1]] for d in deps):
                    held[p], done = hi, False
    # cyclic dependencies cannot arise in a log; where the drawn ones are, the watermarks may differ
    got = {(r.peer, r.counter) for r in changefeed.map_entries(spark.createDataFrame(changes, TXS), spark.createDataFrame(ops, OPS)).collect()}
    want = {(p, c) for p, c in came if c < held[p]}
    assert want <= got
    marks = {r.peer: r.watermark for r in changefeed.commit_watermarks(changefeed.transactions(spark.createDataFrame(changes, TXS), spark.createDataFrame(ops, OPS))).collect()}
    for _, p, lo, hi, deps, _ in changes:  # and nothing below them is incomplete or depends on what is held
        if lo < marks.get(p, 0):
            assert all((p, x) in came for x in range(lo, hi)) and all(int(d[0]) < marks.get(d[-1], 0) for d in deps)


@SLOW
@given(st.randoms(use_true_random=False))
def test_map_entries_any_order(spark, rows, rnd):
    ops = [op(str(rnd.randint(1, 3)), c, rnd.randint(0, 6), rnd.choice(["insert", "delete"]), rnd.choice("abc"), str(c)) for c in range(40)]
    want = {}
    for o in ops:
        key, order = o[7], (o[4], int(o[1]), o[2])
        if key not in want or order > want[key][0]:
            want[key] = (order, o)
    rnd.shuffle(ops)
    changes = spark.createDataFrame([tx(o[1], o[2], o[2] + 1) for o in ops], TXS)
    got = rows(changefeed.map_entries(changes, spark.createDataFrame(ops + ops[:20], OPS), close=True), "map_key", "peer", "counter")
    assert got == sorted((k, o[1], o[2]) for k, (_, o) in want.items() if o[6] == "insert")


def brute_surplus(messages):
    least = {}
    for s, r, i in messages:
        if s is not None and r is not None and i:
            least[s, i] = min(r, least.get((s, i), r))
    return sorted(((s, r) for s, r, i in messages if s is not None and r is not None and i and r > least[s, i]), key=repr)


def test_surplus_copies(spark, rows):
    rnd = random.Random(5)
    messages = [("a" if rnd.random() < 0.5 else "b", r, rnd.choice(["hot"] * 10 + [f"id{rnd.randint(0, 900)}" for _ in range(20)] + ["", None])) for r in range(3000)]
    rnd.shuffle(messages)
    messages += [(None, 1, "x"), ("a", None, "x")]
    df = spark.createDataFrame([(*m, "clash") for m in messages], "src string, row_id bigint, ident string, h string").repartition(3)
    for shard in (100, 10**6):
        assert rows(dedup.surplus_copies(df, shard)) == brute_surplus(messages)
    assert rows(dedup.surplus_copies(df.limit(0))) == []


def test_inbox_keeps_what_came_in_earlier_batches(spark, rows, tmp_path):
    """Batch after batch, over a row range that grows beyond the first one's; what came first stays."""
    rnd = random.Random(6)
    inbox, schema = dedup.Inbox(spark, f"file://{tmp_path}/inbox", 200), "src string, row_id bigint, ident string"
    seen, at = set(), 0
    for n in (300, 0, 900, 500):
        batch = [(rnd.choice("ab"), at + i, f"id{rnd.randint(0, 900)}" if rnd.random() < 0.9 else None) for i in range(n)]
        at += n
        want = []
        for s, r, i in batch:
            if i and (s, i) in seen:
                want.append((s, r))
            elif i:
                seen.add((s, i))
        rnd.shuffle(batch)
        assert rows(inbox.take(spark.createDataFrame(batch, schema))) == sorted(want, key=repr)
        inbox = dedup.Inbox(spark, f"file://{tmp_path}/inbox", 5)  # another process; the first batch fixed the shards
    stored = inbox.stored(inbox.ledger.manifests())
    assert {(r.src, r.ident) for r in stored.filter("what = 'n'").collect()} == seen


def test_filters_know_no_false_negatives():
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    bloom = dedup.Bloom.read(dedup.Bloom.of(h[:10_000]).bytes())
    assert bloom.knows(h[:10_000]).all() and bloom.knows(h[10_000:]).mean() < 0.02


def test_identifiers_of_one_hash():
    import numpy as np
    import pyarrow as pa

    names = ["a", "b", "a", "c", "b", "a"]
    t = pa.table({"src": ["s"] * 6, "row_id": [1, 2, 3, 4, 5, 6], "ident": names, "h": np.full(6, 7), "bucket": [0, 0, 0, 1, 1, 1], "bits": pa.nulls(6, pa.binary())}).cast(dedup._SENT_ARROW)
    got = [(w, r) for b in dedup._settle_shard(t, {}) for w, r in zip(b.column("what").to_pylist(), b.column("row_id").to_pylist()) if w != "f"]
    assert sorted(got) == [("n", 1), ("n", 2), ("n", 4), ("s", 3), ("s", 5), ("s", 6)]


def test_exactly_once_and_identity(spark, rows):
    df = spark.createDataFrame([(3, "a", "1"), (1, "a", "1"), (2, "a1", ""), (4, None, "1"), (5, None, "1")], "id bigint, x string, y string")
    assert rows(dedup.exactly_once(df, "id", "x", "y"), "id") == [(1,), (2,), (4,), (5,)]


def test_trees_from_json(spark, rows):
    node = lambda i, **k: {"id": i, "fractional_index": "80", **k}
    states = [
        (1, json.dumps({"t": [None, node("a", meta={"tags": ["x", None, 7, 2.5, True, ["q"], {"z": 1}]}, children=[node("b", parent="wrong", index=9, meta={"tags": "solo"}), None, node("c", meta={"tags": 3, "children": ["no"]})])]})),
        (2, '{"t": [{"id": "a", "fractional_index": "80"'), (3, ""), (4, None), (5, "null"), (6, '{"id": "a"}'), (7, "[1, 2"), (8, '{"a": 01}'), (9, '"\x01"'),
        (10, '{"n": {"id": 5, "fractional_index": null, "meta": null, "children": {"id": "k", "fractional_index": ""}}}'),
        (11, '{"t": [{"id": "old", "fractional_index": "1"}], "t": [{"id": "new", "fractional_index": "1", "id": "newer"}]}'),
        (12, json.dumps({"t": [node("é \"\\", meta={"tags": ["\ud800"]})]})),
        (1, json.dumps({"x": [node("again")]})),
    ]
    df = spark.createDataFrame([(*s, "clash") for s in states], "state_id bigint, state_json string, kind string")
    want = [
        (1, "node", "a", "", 1, ""), (1, "node", "b", "a", 0, ""), (1, "node", "c", "a", 2, ""),
        (1, "tag", "a", "", 0, "x"), (1, "tag", "a", "", 2, "7"), (1, "tag", "a", "", 3, "2.5"), (1, "tag", "a", "", 4, "true"), (1, "tag", "a", "", 5, '["q"]'), (1, "tag", "a", "", 6, '{"z": 1}'),
        (1, "tag", "b", "a", 0, "solo"), (1, "tag", "c", "a", 0, "3"), (1, "node", "again", "", 0, ""),
        (10, "node", "5", "", 0, ""), (10, "node", "k", "5", 0, ""), (11, "node", "newer", "", 0, ""),
        (12, "node", 'é "\\', "", 0, ""), (12, "tag", 'é "\\', "", 0, "�"),
    ]
    assert rows(nested.flatten_trees(df)) == sorted(want, key=repr)
    assert rows(nested.flatten_trees(df.limit(0))) == []


def test_json_as_deep_as_it_comes():
    depth = 50_000
    assert len(nested.Pivot(["id", "fractional_index"], ["meta.tags"])('{"id":"a","fractional_index":"1","children":[' * depth + "]}" * depth)) == depth
    alternating = '{"a":{"b":[' * depth + "1" + "]}}" * depth
    assert len(nested.parse(alternating)) == 2 * depth and len({o.group.table for o in nested.parse(alternating)}) == 3


@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=5)), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.sampled_from(["id", "a", "b"]), x, max_size=3)), max_leaves=20), st.sampled_from([None, 2]))
@settings(max_examples=150, deadline=None)
def test_parser_reads_what_json_reads(value, indent):
    def scalars(v):
        if isinstance(v, dict):
            for x in v.values():
                if isinstance(x, list):
                    yield from (y for y in x if not isinstance(y, (list, dict)))
                elif not isinstance(x, dict):
                    yield x
            for x in v.values():
                yield from inner(x)

    def inner(x):
        if isinstance(x, dict):
            yield from scalars(x)
        elif isinstance(x, list):
            for y in x:
                yield from inner(y)

    told = lambda x: None if x is None else json.dumps(x) if isinstance(x, (bool, int)) else x
    text = json.dumps(value, indent=indent)
    assert sorted((t[5] for t in nested.triples(text)), key=repr) == sorted((told(x) for x in inner(value)), key=repr)
    if text[-1] in "]}":
        assert list(nested.triples(text[:-1])) == []


@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=5)), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.sampled_from(["id", "meta", "tags", "fractional_index"]), x, max_size=4)), max_leaves=30), st.booleans())
@settings(max_examples=150, deadline=None)
def test_both_parsers_agree(value, twice):
    text = json.dumps(value)
    text = text.replace('"meta"', '"id"') if twice else text  # keys given twice
    told = lambda objects: [(o.no, o.owner and o.owner.no, o.key, o.pos, o.group.table, {k: [x for x in v if x[2] != "a"] for k, v in o.fields.items()}, {k: x.no for k, x in o.singles.items()}) for o in objects]
    assert told(nested.parse(text)) == told(nested.parse(text, spans=True))


def test_tables_of_any_shape(spark, rows):
    record = {"sku": "x", "parts": [{"no": 1, "made": {"by": "A", "tags": ["p", None, True]}, "parts": [{"no": 2, "made": {"tags": "q"}}]}, {"no": None, "made": 5}, "loose"]}
    df = spark.createDataFrame([(7, json.dumps(record), "clash")], "state_id bigint, state_json string, tab string")
    got = rows(nested.tables(df, ["no"], ["made.tags"]), "tab", "linked", "held", "place", "no", "up_no", "ordinal", "kind", "val")
    at = "$.parts[]"
    assert got == sorted([
        (at, False, "parts", 0, "1", None, None, None, None), (f"{at}.made.tags[]", False, "parts", 0, "1", None, 0, "w", "p"), (f"{at}.made.tags[]", False, "parts", 0, "1", None, 1, "0", None), (f"{at}.made.tags[]", False, "parts", 0, "1", None, 2, "b", "true"),
        (at, True, "parts", 0, "2", "1", None, None, None), (f"{at}.made.tags[]", True, "parts", 0, "2", "1", -1, "w", "q"), (at, False, "parts", 1, None, None, None, None, None),
    ], key=repr)


def brute_hierarchy(parents):
    out = {}
    for n in parents:
        walk, x = [n], n
        while True:
            p = parents[x]
            if p in (None, ""):
                fate = "live"
            elif p == DELETED_PARENT:
                fate = "deleted"
            elif p not in parents:
                fate = "orphan"
            elif p in walk:
                fate = "cycle" if p == n else "lost"
            else:
                walk.append(p)
                x = p
                continue
            break
        out[n] = (fate, walk)
    below = defaultdict(int)
    for n, (fate, walk) in out.items():
        for x in walk[1:]:
            below[x] += fate in ("live", "deleted", "orphan")
    loops = set()
    for n, (fate, _) in out.items():
        if fate in ("cycle", "lost"):
            seen, x = set(), n
            while x not in seen:
                seen.add(x)
                x = parents[x]
            y = x
            while True:
                loops.add(y)
                y = parents[y]
                if y == x:
                    break
    rows = []
    for n, (fate, walk) in out.items():
        if fate in ("cycle", "lost"):
            rows.append(("d", "t", n, "cycle" if n in loops else "under_cycle", "", -1, -1, ""))
        else:
            rows.append(("d", "t", n, fate, walk[-1], len(walk) - 1, below[n], "/".join(reversed(walk))))
    return sorted(rows, key=repr)


NODES = "doc_id string, tree string, node_id string, parent_id string, lamport bigint, peer string, id string, frag string"


@pytest.mark.parametrize("seed,solo,bits", [(1, 10**6, 10), (2, 10**6, 1), (3, 4, 2), (4, 3, 0)])
def test_hierarchies(spark, rows, seed, solo, bits):
    rnd = random.Random(seed)
    n = 60
    names = [f"{i}@1" for i in range(n)]
    near = lambda i: names[max(0, i - rnd.randint(1, 4))]
    parents = {x: rnd.choice([None, "", DELETED_PARENT, "999@9", rnd.choice(names)]) if rnd.random() < 0.3 else near(i) for i, x in enumerate(names)}
    placed = [("d", "t", x, p, 5, "10", "x", "y") for x, p in parents.items()] + [("d", "t", x, rnd.choice(names), 5, "9", "x", "y") for x in names[::3]] + [("d", "t", names[0], parents[names[0]], 5, "10", "x", "y"), ("d", "t", None, "1@1", 1, "1", "", "")]
    rnd.shuffle(placed)
    df = spark.createDataFrame(placed, NODES)
    assert rows(hierarchy.hierarchies(df, solo, bits, seed * 7)) == brute_hierarchy(parents)


def test_deep_chain_and_empty(spark, rows):
    n = 3000
    chain = [("d", "t", f"{i}@1", f"{i - 1}@1" if i else None, 1, "1", "", "") for i in range(n)]
    got = {r.node_id: r for r in hierarchy.hierarchies(spark.createDataFrame(chain, NODES), fragment_bits=6).collect()}
    assert len(got) == n and got[f"{n - 1}@1"].node_depth == n - 1 and got["0@1"].n_below == n - 1
    assert got["2@1"].node_path == "0@1/1@1/2@1"
    assert rows(hierarchy.hierarchies(spark.createDataFrame([], NODES))) == []


def test_many_peers_and_a_hot_parent(spark):
    """A tree that ten thousand peers edit is many fragments, and a node with a hundred thousand children asks once."""
    top = [("d", "t", "0@1", None, 1, "1", "", "")]
    peers = [("d", "t", f"0@{p}", "0@1", 1, "1", "", "") for p in range(2, 10_002)]
    sizes = []
    kept = hierarchy._Fragments.__init__
    wide = spark.createDataFrame(top + peers, NODES)
    assert hierarchy.hierarchies(wide, solo=100, fragment_most=500).filter("node_depth = 1 and n_below = 0").count() == 10_000
    cut = hierarchy.fragments(wide, most=500).groupBy("frag").count().collect()
    assert len(cut) > 10 and max(r["count"] for r in cut) < 1000

    def counted(self, rows):
        sizes.append(len(rows))
        kept(self, rows)

    many = spark.range(100_000).selectExpr("'d' doc_id", "'t' tree", "concat(id, '@', id % 500 + 7) node_id", "'0@1' parent_id", "1L lamport", "'1' peer")
    root = spark.createDataFrame([("d", "t", "0@1", None, 1, "1")], "doc_id string, tree string, node_id string, parent_id string, lamport bigint, peer string")
    got = hierarchy.hierarchies(many.unionByName(root)).filter("node_id = '0@1'").first()
    assert (got.n_below, got.fate) == (100_000, "live")
    nodes = hierarchy._Fragments.__init__ = counted
    try:  # what one fragment gets is bounded by its own nodes, whatever hangs below them
        rows = [("d", "t", 1, hierarchy.NODE, "0@1", None, None, "live", 0, "0@1", 1), ("d", "t", 1, hierarchy.ASK, "0@1", None, None, None, 0, None, 0)]
        assert [r[2] for r in hierarchy._contract(rows)] == ["answer", "top"] and sizes == [2] and nodes
    finally:
        hierarchy._Fragments.__init__ = kept
