"""The log's own operators: hand-written op logs, a brute-force merge of random histories, and the streams."""

import glob
import json
import os
import random
from collections import defaultdict

import pytest

from tidelog.functions import versions
from tidelog.operators import assemble, log, lww, sequence, tree
from tidelog.plans import logqueries, schema
from tidelog.sources import json_log, rooms
from tidelog.streaming import replay


def change(counter, peer, lamport, ops, deps=()):
    return {"id": f"{counter}@{peer}", "timestamp": 0, "deps": list(deps), "lamport": lamport, "msg": None, "ops": [{"container": c, "content": x, "counter": n} for n, c, x in ops]}


def put(pos, text):
    return {"type": "insert", "pos": pos, "text": text}


T, L, M, ML, TR, C = "cid:root-t:Text", "cid:root-l:List", "cid:root-m:Map", "cid:root-ml:MovableList", "cid:root-tr:Tree", "cid:root-c:Counter"

#: name -> (peers, changes, state); @n is an index into the peers.
LOGS = {
    "offline": (["9", "1"], [change(0, 0, 0, [(0, T, put(0, "CD"))]), change(0, 1, 0, [(0, T, put(0, "AB"))])], {"t": "ABCD"}),
    "numbers": (["18446744073709551614", "9"], [change(0, 0, 0, [(0, T, put(0, "CD"))]), change(0, 1, 0, [(0, T, put(0, "AB"))])], {"t": "ABCD"}),
    "in_front": (["1", "2"], [change(0, 0, 0, [(0, T, put(0, "BBB"))]), change(0, 1, 3, [(0, T, put(0, "Z"))], ["2@0"])], {"t": "ZBBB"}),
    "between": (["1", "2", "3"], [change(0, 0, 0, [(0, T, put(0, "ABC"))]), change(0, 1, 3, [(0, T, put(1, "X"))], ["2@0"]), change(0, 2, 4, [(0, T, put(1, "Y"))], ["0@1"])], {"t": "AYXBC"}),
    # 3 saw what 2 typed and types in front of it, 4 did not: what 2 and 4 put hangs on the bracket, what 3 put on that of 2
    "two_right_neighbours": (["1", "2", "3", "4"], [change(0, 0, 0, [(0, T, put(0, "[]"))]), change(0, 1, 2, [(0, T, put(1, "x"))], ["1@0"]), change(0, 3, 2, [(0, T, put(1, "zz"))], ["1@0"]), change(0, 2, 3, [(0, T, put(1, "y"))], ["0@1"])], {"t": "[yxzz]"}),
    # two who type on at one place are not interleaved
    "runs_stay_whole": (["2", "1"], [change(0, 0, 0, [(0, T, put(0, "a")), (1, T, put(1, "b")), (2, T, put(2, "c"))]), change(0, 1, 0, [(0, T, put(0, "x")), (1, T, put(1, "y")), (2, T, put(0, "w"))])], {"t": "wxyabc"}),
    "by_turns": (["1"], [change(0, 0, 0, [(0, T, put(0, "ab")), (2, "cid:root-u:Text", put(0, "xy")), (4, T, put(1, "c")), (5, "cid:root-u:Text", put(2, "z")), (6, T, put(3, "d"))])], {"t": "acbd", "u": "xyz"}),
    "removed_neighbour": (["1", "2"], [change(0, 0, 0, [(0, T, put(0, "abc")), (3, T, {"type": "delete", "pos": 1, "len": 1, "start_id": "1@0"})]), change(0, 1, 3, [(0, T, put(2, "x"))], ["2@0"]), change(4, 0, 4, [(4, T, put(1, "y"))])], {"t": "ayxc"}),
    "looks_like_a_shared_child": (["1"], [change(0, 0, 0, [(0, "cid:root-🤝:notes:Map", {"type": "insert", "key": "k", "value": [0, 76, 77, 1, 0, 1, 2, 3]})])], {"🤝:notes": {"k": [0, 76, 77, 1, 0, 1, 2, 3]}}),
    "backwards": (["1"], [change(0, 0, 0, [(0, T, put(0, "abcd")), (4, T, {"type": "delete", "pos": 2, "len": -2, "start_id": "1@0"})])], {"t": "ad"}),
    "astral": (["1"], [change(0, 0, 0, [(0, T, put(0, "a🙂字")), (3, T, {"type": "delete", "pos": 1, "len": 1, "start_id": "1@0"}), (4, T, put(2, "!"))])], {"t": "a字!"}),
    "same_place": (["1", "2"], [change(0, 0, 0, [(0, T, put(0, "ab"))]), change(2, 0, 2, [(2, T, {"type": "delete", "pos": 0, "len": 2, "start_id": "0@0"})]), change(0, 1, 2, [(0, T, put(1, "x"))], ["1@0"])], {"t": "x"}),
    "list": (["1"], [change(0, 0, 0, [(0, L, {"type": "insert", "pos": 0, "value": [1, 2.5, None, "x", {"k": [True]}]}), (5, L, {"type": "delete", "pos": 0, "len": 1, "start_id": "0@0"})])], {"l": [2.5, None, "x", {"k": [True]}]}),
    "map": (["1", "2"], [change(0, 0, 0, [(0, M, {"type": "insert", "key": "a", "value": 1}), (1, M, {"type": "insert", "key": "b", "value": None}), (2, M, {"type": "insert", "key": "c", "value": 5.0}), (3, M, {"type": "delete", "key": "c"})]), change(0, 1, 0, [(0, M, {"type": "insert", "key": "a", "value": 2})])], {"m": {"a": 2, "b": None}}),
    "counter": (["1"], [change(0, 0, 0, [(i, C, {"type": "counter", "value_type": "f64", "value": v, "prop": 0}) for i, v in enumerate((5, 0.5, -2))])], {"c": 3.5}),
    "movable": (["1", "2"], [
        change(0, 0, 0, [(0, ML, {"type": "insert", "pos": 0, "value": ["a", "b", "c"]})]),
        change(3, 0, 3, [(3, ML, {"type": "move", "from": 0, "to": 2, "elem_id": "L0@0"})]),
        change(0, 1, 3, [(0, ML, {"type": "move", "from": 0, "to": 1, "elem_id": "L0@0"}), (1, ML, {"type": "set", "elem_id": "L1@0", "value": "B"})], ["2@0"]),
    ], {"ml": ["B", "a", "c"]}),
    "tree": (["1", "2"], [
        change(0, 0, 0, [(0, TR, {"type": "create", "target": "0@0", "parent": None, "fractional_index": "80"}), (1, TR, {"type": "create", "target": "1@0", "parent": None, "fractional_index": "8180"}), (2, "cid:1@0:Map", {"type": "insert", "key": "k", "value": "v"})]),
        change(3, 0, 3, [(3, TR, {"type": "move", "target": "0@0", "parent": "1@0", "fractional_index": "80"})]),
        change(0, 1, 3, [(0, TR, {"type": "move", "target": "1@0", "parent": "0@0", "fractional_index": "80"})], ["2@0"]),
    ], {"tr": [{"parent": None, "index": 0, "meta": {"k": "v"}, "id": "1@1", "fractional_index": "8180", "children": [{"parent": "1@1", "index": 0, "meta": {}, "id": "0@1", "fractional_index": "80", "children": []}]}]}),
    "tree_gone": (["1"], [change(0, 0, 0, [(0, TR, {"type": "create", "target": "0@0", "parent": None, "fractional_index": "80"}), (1, TR, {"type": "create", "target": "1@0", "parent": "0@0", "fractional_index": "80"}), (2, TR, {"type": "delete", "target": "0@0"})])], {"tr": []}),
    "nested": (["1"], [change(0, 0, 0, [(0, M, {"type": "insert", "key": "x", "value": "🦜:cid:0@0:List"}), (1, "cid:0@0:List", {"type": "insert", "pos": 0, "value": ["🦜:cid:1@0:Text", 7]}), (3, "cid:1@0:Text", put(0, "deep"))])], {"m": {"x": ["deep", 7]}}),
    "colons": (["1"], [change(0, 0, 0, [(0, "cid:root-a:b:Map", {"type": "insert", "key": "k", "value": 1})])], {"a:b": {"k": 1}}),
    "styles": (["1"], [change(0, 0, 0, [(0, T, put(0, "hello")), (5, T, {"type": "mark", "start": 0, "end": 3, "style_key": "bold", "style_value": True, "info": 132}), (6, T, {"type": "mark_end"}), (7, T, {"type": "mark", "start": 3, "end": 6, "style_key": "bold", "style_value": None, "info": 132}), (8, T, {"type": "mark_end"})])], {"t": "hello"}),
}


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, (peers, changes, _) in LOGS.items():
        (folder / f"{name}.ops.json").write_text(json.dumps({"schema_version": 1, "start_version": {}, "peers": peers, "changes": changes}))
    return [df.cache() for df in json_log.read(spark, str(folder))]


def numbers(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return [numbers(x) for x in v] if isinstance(v, list) else {k: numbers(x) for k, x in v.items()}


def states(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.doc_id][r.root_name] = numbers(json.loads(r.value))
    return dict(out)


def test_documents(logs):
    assert states(assemble.documents(*logs)) == {n: numbers(s) for n, (_, _, s) in LOGS.items()}


def test_repeats_and_order_change_nothing(spark, logs):
    changes, ops = logs
    twice = ops.unionByName(ops.sample(0.5, seed=1)).repartition(5)
    assert states(assemble.documents(changes.unionByName(changes), twice)) == {n: numbers(s) for n, (_, _, s) in LOGS.items()}


def test_ints_stay_ints(logs):
    value = {r.doc_id: r.value for r in assemble.documents(*logs).collect()}
    assert json.loads(value["list"])[0] == 2.5 and value["nested"] == '{"x": ["deep", 7]}'


def test_delta_runs(logs):
    runs = [(r.run, r.insert, r.attributes) for r in sequence.delta_runs(sequence.sequence_nodes(*logs)).filter("doc_id = 'styles'").orderBy("run").collect()]
    # places count anchors: S h e l E l o, then the second mark from 3 to 6: S h e S' l E l E' o
    # a null style is no attribute but ends a run
    assert runs == [(0, "he", '{"bold":true}'), (1, "ll", None), (2, "o", None)]


def test_style_values_keep_their_types(spark, rows):
    nodes = [("d", "cid:root-t:Text", i, "1", i, 1, f'"{c}"', None, style, False, True, "1", i) for i, (c, style) in enumerate([("a", '{"n": 5, "on": true, "s": "true", "z": null}'), ("b", '{"o": {"k": [1.5, null]}}'), ("c", None)])]
    got = rows(sequence.delta_runs(spark.createDataFrame(nodes, sequence.NODES)), "insert", "attributes")
    assert got == [("a", '{"n":5,"on":true,"s":"true"}'), ("b", '{"o":{"k":[1.5,null]}}'), ("c", None)]


def test_conformance(spark):
    """Op logs and the states they must give, from the folder $OPLOG_FIXTURES names (``x.ops.json`` beside ``x.json``)."""
    folder = os.environ.get("OPLOG_FIXTURES")
    if not folder:
        pytest.skip("no folder named")
    got = states(assemble.documents(*json_log.read(spark, f"{folder}/*.ops.json"), os.environ.get("OPLOG_MARKER_DOMAIN")))
    for path in glob.glob(f"{folder}/*.ops.json"):
        name = os.path.basename(path).split(".")[0]
        with open(f"{folder}/{name}.json") as f:
            assert got.get(name, {}) == numbers(json.load(f)), name


def walk(kids, of=None):
    """The sequence: what hangs to the left of an element, the element, what hangs to its right, in order of writers."""
    for n in sorted(kids.get((of, "left"), []), key=lambda n: n["id"][0]):
        yield from walk(kids, n["id"])
    if of is not None:
        yield of
    for n in sorted(kids.get((of, "right"), []), key=lambda n: n["id"][0]):
        yield from walk(kids, n["id"])


def brute_text(ops):
    """Replays by the definition: the whole tree is walked anew for every element, views by looking at everything."""
    nodes, kids = {}, defaultdict(list)

    def seen(past, order):
        return [i for i in order if i[1] < past.get(i[0], 0) and not any(c < past.get(p, 0) for p, c in nodes[i]["gone"])]

    for o in sorted(ops, key=lambda o: (o["lamport"], o["peer"], o["counter"])):
        for k in range(o["n"]):
            past, order = dict(o["past"]) | {o["peer"]: o["counter"] + k}, list(walk(kids))
            view = seen(past, order)
            if o["what"] == "delete":
                nodes[view[o["pos"]]]["gone"].append((o["peer"], o["counter"] + k))
                continue
            left = view[o["pos"] + k - 1] if o["pos"] + k else None
            right = next((i for i in (order[order.index(left) + 1 :] if left else order) if i[1] < past.get(i[0], 0)), None)
            n = nodes[o["peer"], o["counter"] + k] = {"id": (o["peer"], o["counter"] + k), "behind": left, "c": o["text"][k] if o["what"] == "insert" else "", "gone": []}
            kids[(right, "left") if right and nodes[right]["behind"] == left else (left, "right")].append(n)
    order = list(walk(kids))
    return "".join(nodes[i]["c"] for i in order if not nodes[i]["gone"]), lambda past: seen(past, order)


def history(seed):
    rnd = random.Random(seed)
    peers = {i: {"counter": 0, "seen": {}, "lamport": 0} for i in (1, 2, 3)}
    ops, changes = [], []
    for _ in range(25):
        p = rnd.choice(list(peers))
        me = peers[p]
        if rnd.random() < 0.4:
            q = rnd.choice([x for x in peers if x != p])
            for k, v in peers[q]["seen"].items():
                me["seen"][k] = max(me["seen"].get(k, 0), v)
            me["lamport"] = max(me["lamport"], peers[q]["lamport"])
        past = dict(me["seen"])
        size = len(brute_text([o for o in ops if o["counter"] < past.get(o["peer"], 0)])[1](past))
        o = {"peer": p, "counter": me["counter"], "lamport": me["lamport"], "past": past}
        if size and rnd.random() < 0.3:
            pos = rnd.randrange(size)
            o |= {"what": "delete", "pos": pos, "n": min(size - pos, rnd.randint(1, 3))}
        else:
            o |= {"what": "insert", "pos": rnd.randint(0, size), "text": "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3)))}
            o["n"] = len(o["text"])
        ops.append(o)
        deps = [f"{end - 1}@{q}" for q, end in past.items() if q != p]
        changes.append((f"h{seed}", str(p), o["counter"], o["counter"] + o["n"], o["lamport"], 0, deps, None, len(changes)))
        me["counter"] += o["n"]
        me["lamport"] += o["n"]
        me["seen"][p] = me["counter"]
    return ops, changes


def test_random_histories(spark):
    rows, changes, want = [], [], {}
    names = [f.split()[0] for f in schema.OPS.split(", ")]
    for seed in range(40):
        ops, made = history(seed)
        changes += made
        want[f"h{seed}"] = brute_text(ops)[0]
        for i, o in enumerate(ops):
            r = dict.fromkeys(names) | {"doc_id": f"h{seed}", "peer": str(o["peer"]), "counter": o["counter"], "len": o["n"], "lamport": o["lamport"], "change_counter": o["counter"], "arrival": i, "container": T, "vkind": o["what"], "pos": o["pos"]}
            r |= {"val_json": json.dumps(o["text"])} if o["what"] == "insert" else {"del_len": o["n"]}
            rows.append(tuple(r[n] for n in names))
    random.Random(0).shuffle(rows)
    nodes = sequence.sequence_nodes(spark.createDataFrame(changes, schema.CHANGES), spark.createDataFrame(rows, schema.OPS))
    assert {r.doc_id: r.text for r in sequence.texts(nodes).collect()} == want


def ch(doc, peer, counter, end, lamport, deps=(), msg=None):
    return (doc, peer, counter, end, lamport, 0, list(deps), msg, 0)


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame(
        [ch("d", "1", 0, 4, 0), ch("d", "1", 0, 4, 0, (), "again"), ch("d", "1", 4, 6, 9, ["3@1", "2@2"]), ch("d", "2", 0, 3, 4, ["3@1"]), ch("d", "3", 5, 7, 20, ["1@9"]), ch("e", "1", 0, 1, 0)],
        schema.CHANGES,
    )


def test_versions_and_frontiers(changes, rows):
    assert rows(log.version_vector(changes)) == [("d", "1", 6), ("d", "2", 3), ("d", "3", 7), ("e", "1", 1)]
    assert rows(log.frontiers(changes)) == [("d", "1", 5), ("d", "3", 6), ("e", "1", 0)]


def test_export_from(spark, changes, rows):
    version = spark.createDataFrame([("d", "1", 2), ("d", "2", 9), ("d", "3", -4)], "doc_id string, peer string, end bigint")
    assert rows(log.export_from(changes, version)) == [("d", "1", 2, 4, 2, ["1@1"]), ("d", "1", 4, 6, 9, ["3@1", "2@2"]), ("d", "3", 5, 7, 20, ["1@9"]), ("e", "1", 0, 1, 0, [])]


def test_export_ranges(spark, changes, rows):
    spans = spark.createDataFrame([("d", "1", 3, 1), ("d", "1", 2, 5), ("d", "1", 5, 5), ("d", "2", 8, 99)], "doc_id string, peer string, start bigint, end bigint")
    assert rows(log.export_ranges(changes, spans)) == [("d", "1", 1, 1, 4, 1, ["0@1"]), ("d", "1", 1, 4, 5, 9, ["3@1", "2@2"])]


def test_applied_history_leaves_out_what_waits(spark, changes, rows):
    more = changes.unionByName(spark.createDataFrame([ch("d", "4", 0, 2, 27, ["6@3"]), ch("d", "1", 6, 8, 30, ["1@4"]), ch("e", "1", 2, 3, 9)], schema.CHANGES))
    done = log.applied(more)
    assert rows(log.version_vector(done)) == [("d", "1", 6), ("d", "2", 3), ("e", "1", 1)]
    assert rows(log.frontiers(done)) == [("d", "1", 5), ("e", "1", 0)]
    version = spark.createDataFrame([("d", "1", 2)], "doc_id string, peer string, end bigint")
    assert rows(log.export_from(done, version)) == [("d", "1", 2, 4, 2, ["1@1"]), ("d", "1", 4, 6, 9, ["3@1", "2@2"]), ("d", "2", 0, 3, 4, ["3@1"]), ("e", "1", 0, 1, 0, [])]
    spans = spark.createDataFrame([("d", "1", 5, 8), ("d", "3", 5, 7)], "doc_id string, peer string, start bigint, end bigint")
    assert rows(log.export_ranges(done, spans)) == [("d", "1", 1, 5, 6, 10, ["4@1"])]


def test_gate_and_past(changes, rows):
    assert [r[1:] for r in rows(log.gate(changes)) if r[0] == "d"] == [("1", 0, "applied"), ("1", 4, "applied"), ("2", 0, "applied"), ("3", 5, "pending")]
    past = {(r.doc_id, r.peer, r.change_counter): r.past for r in log.past_versions(changes).collect()}
    assert past["d", "1", 4] == {"1": 4, "2": 3} and past["d", "2", 0] == {"1": 4} and past["d", "3", 5] == {"9": 2, "3": 5} and past["e", "1", 0] == {}


def test_clip_and_conflicts(spark, changes, rows):
    ops = spark.createDataFrame([("d", "1", 0, 4, "a"), ("d", "1", 2, 5, "b"), ("d", "1", 3, 1, "c"), ("d", "1", 9, None, "d"), ("d", None, 9, 1, "d")], "doc_id string, peer string, counter bigint, len bigint, x string")
    assert rows(log.clip_overlaps(ops)) == [("d", "1", 0, 4), ("d", "1", 4, 3), ("d", "1", 9, 1)]
    assert rows(log.conflicts(changes, ["msg"])) == [("d", "1", 0, 2)]


def test_leaf_placements_equal_replay(logs, rows):
    ops = logs[1].filter("doc_id = 'tree_gone'")
    assert rows(tree.leaf_placements(ops)) == rows(tree.tree_placements(ops))


def test_leaf_placements_replay_where_loops_could_arise(logs, rows):
    """Two crossing moves of nodes that have children: only the replay knows that the second is void."""
    assert rows(tree.leaf_placements(logs[1])) == rows(tree.tree_placements(logs[1]))


def test_names_of_shared_children():
    good = ["$a>k", "$a\\>b>k", "@1y2p0ij32e8e7:0>k", "@0:-5>k>l", "$a>", "$a>k\\s\\0"]
    bad = ["notes", "$>k", "$a", "@1>k", "@01:0>k", "@A:0>k", "@zzzzzzzzzzzzzz:0>k", "@1:zzzzzzzz>k", "$a/b>k", "$a>k/", "$a>k\\x", f"${schema.MERGEABLE}x>k"]
    assert [assemble.is_shared_name(schema.MERGEABLE + x) for x in good + bad] == [True] * len(good) + [False] * len(bad)
    assert assemble.shared_parent(schema.MERGEABLE + "$a\\>b>k\\s") == ("cid:root-a>b:Map", "k/") and assemble.shared_parent("x") is None
    assert assemble.shared_parent(schema.MERGEABLE + "@0:-5>k>l") == (f"cid:root-{schema.MERGEABLE}@0:-5>k:Map", "l")
    assert assemble.shared_parent(schema.MERGEABLE + "@a:b>k") == ("cid:11@10:Map", "k")


def test_locate_and_lamport_faults(spark, changes, rows):
    ids = spark.createDataFrame([("d", "1", 3), ("d", "1", 3), ("d", "1", 5), ("d", "1", 6), ("d", "3", 4), ("x", "1", 0), (None, "1", 0)], "doc_id string, peer string, counter bigint")
    assert rows(log.locate(changes, ids)) == [("d", "1", 3, 0, 3), ("d", "1", 5, 4, 10), ("d", "1", 6, None, None), ("d", "3", 4, None, None), ("x", "1", 0, None, None)]
    bad = changes.unionByName(spark.createDataFrame([ch("d", "5", 0, 1, 3, ["3@1"]), ch("d", "2", 3, 4, 6)], schema.CHANGES))
    assert rows(log.lamport_faults(bad)) == [("d", "2", 3, 6, "2@2", 6), ("d", "5", 0, 3, "3@1", 3)]


def test_a_merge_that_takes_too_long_says_so(spark, logs, monkeypatch, rows):
    few = lambda movable: sequence.__dict__["_Sequence"](movable, 3)
    monkeypatch.setattr(sequence, "_Sequence", sequence.Sequence, raising=False)
    monkeypatch.setattr(sequence, "Sequence", few)
    out = list(sequence._replay([dict.fromkeys(["past", "mark_len", "move_from", "elem", "mark_key", "del_start", "del_len"]) | {"doc_id": "d", "container": T, "peer": "1", "counter": i, "len": 1, "lamport": i, "change_counter": i, "vkind": "insert", "pos": 0, "val_json": '"x"'} for i in range(9)]))
    nodes = spark.createDataFrame(out, sequence.NODES)
    assert rows(sequence.failures(nodes)) == [("d", T, "more than 3 steps")] and rows(sequence.texts(nodes)) == []


def test_empty_log(spark, rows):
    none = [spark.createDataFrame([], x) for x in (schema.CHANGES, schema.OPS)]
    assert rows(assemble.documents(*none)) == [] and rows(log.frontiers(none[0])) == [] and rows(lww.counter_values(none[1])) == []


def test_version_codec():
    vector = {"18446744073709551615": 5, "1": 2**31 - 1, "7": 0}
    assert versions.bytes_version(versions.version_bytes(vector)) == {"1": 2**31 - 1, "18446744073709551615": 5}
    assert versions.bytes_frontier(versions.frontier_bytes(["3@2", "9@2", "0@10"])) == ["9@2", "0@10"]
    for bad in (b"", b"\x01", b"\x00\x00", b"\x01" + b"\xff" * 11):
        with pytest.raises(ValueError):
            versions.bytes_version(bad)


NAMES = ("dev.x.update", "x-fast-updates-v1")


def test_rooms(spark, rows):
    good = json.dumps({"format": "x-fast-updates-v1", "payload": "aGk="})
    events = [("e1", "dev.x.update", good), ("e2", "m.text", good), ("e3", "dev.x.update", good[:-3]), ("e4", "dev.x.update", '{"format": "other", "payload": "aGk="}'), ("e5", "dev.x.update", '{"format": "x-fast-updates-v1", "payload": "?"}'), ("e6", None, good), ("e7", "dev.x.update", None), ("e8", "dev.x.update", '"text"'), ("e9", "dev.x.update", '{"format": "x-fast-updates-v1"}'), ("f1", "dev.x.updates", good)]
    df = spark.createDataFrame(events, "event_id string, event_type string, content_json string")
    assert rooms.most_used(df) == NAMES and rooms.most_used(df.limit(0)) == (None, None)
    got = rooms.classified(df, *NAMES)
    assert [r[1] for r in rows(got, "event_id", "status")] == ["ok", "foreign_type", "broken", "foreign_format", "broken", "foreign_type", "broken", "broken", "broken", "foreign_type"]
    assert bytes(got.filter("status = 'ok'").first().payload) == b"hi"


def test_replay_stream(spark, tmp_path):
    good = json.dumps({"format": "x-fast-updates-v1", "payload": "aGk="})
    batches = [[("a", good), ("b", "{")], [("a", good), ("c", good), (None, good)]]
    at = {x: f"{tmp_path}/{x}" for x in ("in", "good", "bad", "state")}
    for i, batch in enumerate(batches):
        rows = [(i * 10 + k, i, "r", e, "dev.x.update", c, "1", 0, None) for k, (e, c) in enumerate(batch)]
        spark.createDataFrame(rows, rooms.EVENTS).coalesce(1).write.mode("append").parquet(at["in"])
        replay.replay(rooms.stream(spark, at["in"]), *NAMES, at["good"], at["bad"], at["state"]).awaitTermination()
    assert sorted(r.event_id for r in spark.read.schema(rooms.EVENTS).parquet(at["good"]).collect()) == ["a", "c"]
    assert [r.event_id for r in spark.read.schema(rooms.EVENTS).parquet(at["bad"]).collect()] == ["b"]


def test_replay_stream_keeps_events_without_id(spark, tmp_path, rows):
    good = json.dumps({"format": "x-fast-updates-v1", "payload": "aGk="})
    batches = [[("a", good), (None, good), ("", "{"), ("", good)], [("a", good), ("", good), (None, "{"), (None, good)]]
    os.mkdir(f"{tmp_path}/room_events.parquet")
    for i, batch in enumerate(batches):
        events = [(i * 10 + k, i, "r", e, "dev.x.update", c, "1", 0, None) for k, (e, c) in enumerate(batch)]
        spark.createDataFrame(events, rooms.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/room_events.parquet")
    got = rows(logqueries.q19_replay_stream(spark, str(tmp_path)))
    assert got == sorted([("a", "good"), (None, "good"), (None, "good"), ("", "good"), ("", "good"), ("", "bad"), (None, "bad")], key=repr)


def test_gate_stream(spark, tmp_path):
    path = f"{tmp_path}/in"
    made = [ch("d", "1", 2, 3, 2), ch("d", "2", 0, 1, 3, ["2@1"]), ch("d", "1", 0, 2, 0), ch("d", "1", 0, 2, 0)]
    got = []
    for c in made:
        spark.createDataFrame([c], schema.CHANGES).coalesce(1).write.mode("append").parquet(path)
        q = replay.gate_stream(spark.readStream.schema(schema.CHANGES).parquet(path)).writeStream.foreachBatch(lambda df, n: got.append([(r.peer, r.counter) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [x for b in got for x in b] == [("1", 0), ("1", 2), ("2", 0)]
