"""Edit scripts: what they do to documents, what is refused, and that all peers agree afterwards."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_log import numbers, states

from tidelog import edit
from tidelog.functions import fractional
from tidelog.operators import assemble, sequence

T, L, ML, M, TR, C = "cid:root-t:Text", "cid:root-l:List", "cid:root-b:MovableList", "cid:root-m:Map", "cid:root-tr:Tree", "cid:root-c:Counter"


def script(spark, calls, doc="d"):
    rows = []
    for i, (peer, action, container, *more) in enumerate(calls):
        x = more[0] if more else {}
        rows.append((doc, i, str(peer), action, container, x.get("pos"), x.get("len"), x.get("key"), json.dumps(x["val"]) if "val" in x else None, x.get("other")))
    return spark.createDataFrame(rows, edit.SCRIPT)


def run(spark, calls):
    changes, ops, errors = (df.cache() for df in edit.compile_scripts(script(spark, calls)))
    return states(assemble.documents(changes, ops)).get("d", {}), sorted((r.seq, r.error) for r in errors.collect()), changes, ops


def test_one_writer(spark):
    state, errors, changes, ops = run(spark, [
        (1, "insert", T, {"pos": 0, "val": "hello"}), (1, "insert", T, {"pos": 5, "val": " wörld🙂"}), (1, "delete", T, {"pos": 1, "len": 3}),
        (1, "insert", L, {"pos": 0, "val": [1, 2, 3]}), (1, "delete", L, {"pos": 1}), (1, "insert", L, {"pos": 2, "val": ["x"]}),
        (1, "set", M, {"key": "a", "val": 1}), (1, "set", M, {"key": "a", "val": 1}), (1, "set", M, {"key": "n", "val": None}), (1, "delete", M, {"key": "gone"}),
        (1, "child", M, {"key": "kid", "other": "List"}), (1, "commit", None, {"other": "first"}),
        (1, "insert", ML, {"pos": 0, "val": ["a", "b", "c"]}), (1, "move", ML, {"pos": 0, "len": 2}), (1, "set", ML, {"pos": 0, "val": "B"}), (1, "move", ML, {"pos": 1, "len": 1}), (1, "delete", ML, {"pos": 1}),
        (1, "add", C, {"val": 2}), (1, "add", C, {"val": 0.5}),
    ])
    assert not errors
    assert state == numbers({"t": "ho wörld🙂", "l": [1, 3, "x"], "m": {"a": 1, "n": None, "kid": []}, "b": ["B", "a"], "c": 2.5})
    assert [(r.counter, r.msg) for r in changes.orderBy("counter").collect()][0] == (0, "first") and changes.count() == 2
    assert ops.filter("map_key = 'a'").count() == 1


def test_refused(spark):
    calls = [(1, "insert", T, {"pos": 1, "val": "x"}), (1, "delete", T, {"pos": 0}), (1, "insert", T, {"pos": 0, "val": 5}), (1, "set", T, {"pos": 0}), (1, "mark", T, {"pos": 0, "len": 0, "key": "bold", "val": True}), (1, "move", TR, {"key": "0@1"}), (1, "nothing", None), (1, "set", M, {"key": "a"})]
    state, errors, changes, _ = run(spark, calls)
    assert state == {} and [s for s, _ in errors] == list(range(len(calls))) and changes.count() == 0


def test_tree(spark):
    state, errors, *_ = run(spark, [
        (1, "create", TR), (1, "create", TR), (1, "create", TR, {"pos": 0}), (1, "create", TR, {"other": "0@1"}),
        (1, "move", TR, {"key": "1@1", "other": "3@1"}), (1, "move", TR, {"key": "0@1", "other": "1@1"}), (1, "set", "cid:3@1:Map", {"key": "k", "val": 1}), (1, "create", TR, {"other": "1@1"}), (1, "delete", TR, {"key": "2@1"}),
    ])
    assert [s for s, _ in errors] == [5]
    show = lambda nodes: [(n["id"], n["meta"], show(n["children"])) for n in nodes]
    assert show(state["tr"]) == [("0@1", {}, [("3@1", {"k": 1.0}, [("1@1", {}, [("6@1", {}, [])])])])]


def delta(changes, ops):
    runs = sequence.delta_runs(sequence.sequence_nodes(changes, ops)).orderBy("run").collect()
    return [(r.insert, json.loads(r.attributes) if r.attributes else {}) for r in runs]


def test_styles_spread(spark):
    _, errors, changes, ops = run(spark, [
        (1, "insert", T, {"pos": 0, "val": "abcd"}), (1, "mark", T, {"pos": 1, "len": 2, "key": "bold", "val": True}), (1, "mark", T, {"pos": 1, "len": 1, "key": "bold", "val": True}),
        (1, "insert", T, {"pos": 3, "val": "X"}), (1, "insert", T, {"pos": 1, "val": "Y"}),
        (1, "mark", T, {"pos": 0, "len": 1, "key": "link", "val": "u"}), (1, "insert", T, {"pos": 1, "val": "Z"}),
        (1, "unmark", T, {"pos": 0, "len": 1, "key": "italic"}), (1, "unmark", T, {"pos": 3, "len": 1, "key": "bold"}),
    ])
    assert not errors
    assert delta(changes, ops) == [("a", {"link": "u"}), ("ZY", {}), ("b", {}), ("cX", {"bold": True}), ("d", {})]


@pytest.mark.parametrize("seed", range(3))
def test_peers_agree(spark, seed):
    """After everybody synced with everybody, what each then types on its own view makes the log's state."""
    rnd = random.Random(seed)
    calls = []
    for _ in range(120):
        p = rnd.choice([1, 2, 3])
        act = rnd.random()
        if act < 0.15:
            calls.append((p, rnd.choice(["sync", "commit"]), None))
        elif act < 0.5:
            calls.append((p, "insert", T, {"pos": rnd.randint(0, 6), "val": rnd.choice(["a", "bc", "d e"])}))
        elif act < 0.6:
            calls.append((p, "delete", T, {"pos": rnd.randint(0, 4), "len": rnd.randint(1, 3)}))
        elif act < 0.65:
            calls.append((p, "mark", T, {"pos": rnd.randint(0, 3), "len": rnd.randint(1, 3), "key": "bold", "val": True}))
        elif act < 0.75:
            calls.append((p, "insert", ML, {"pos": rnd.randint(0, 3), "val": [rnd.randint(0, 9)]}))
        elif act < 0.85:
            calls.append((p, rnd.choice(["move", "delete"]), ML, {"pos": rnd.randint(0, 3), "len": rnd.randint(0, 1)}))
        else:
            calls.append((p, "set", M, {"key": rnd.choice("xyz"), "val": rnd.randint(0, 3)}))
    calls += [(p, "sync", None) for p in (1, 2, 3)] * 2
    doc = edit.Document("d")
    for i, (peer, action, container, *more) in enumerate(calls):
        x = more[0] if more else {}
        s = {"doc_id": "d", "seq": i, "peer": str(peer), "action": action, "container": container, "pos": x.get("pos"), "len": x.get("len"), "key": x.get("key"), "val_json": json.dumps(x["val"]) if "val" in x else None, "other": None}
        try:
            list(doc.run(s))
        except edit.Refused:
            pass
    views = []
    for w in doc.writers.values():
        text = "".join(n.value for _, n in w.items(T))
        items = [w.seqs[ML].elems[n.elem][3] for _, n in w.items(ML)]
        views.append((text, items, {k: v for k, v in w.maps[M].items() if v}))
    assert views[0] == views[1] == views[2]
    state, *_ = run(spark, calls)
    assert (state["t"], state["b"]) == (views[0][0], numbers(views[0][1]))


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_fractional_indexes_stay_in_order(places):
    order: list[bytes] = []
    for p in places:
        i = p % (len(order) + 1)
        x = fractional.between(order[i - 1] if i else None, order[i] if i < len(order) else None)
        order.insert(i, x)
        assert x[-1] == fractional.END
    assert order == sorted(order) and len(set(order)) == len(order)
    assert fractional.evenly(None, None, 9) == sorted(set(fractional.evenly(None, None, 9)))
    with pytest.raises(ValueError):
        fractional.between(b"\x80", b"\x80")
