"""The queries of the log's own operators, over the log tables and over logs derived from the star schema."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import edit
from tidelog.operators import assemble, hierarchy, log, lww, sequence, tree
from tidelog.plans import derive
from tidelog.plans.storage import cut, session_dir
from tidelog.plans.tables import table
from tidelog.sources import binary_log, rooms
from tidelog.streaming import replay


def q01_map_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return lww.map_values(derive.event_map(spark, d)).select("doc_id", "map_key", F.col("val_json").cast("bigint").alias("cents"))


def q02_counter(spark: SparkSession, d: str) -> DataFrame:
    return lww.counter_values(derive.event_map(spark, d, "Counter")).select("doc_id", F.col("total").cast("bigint").alias("total"))


def q02_counter_ops(spark: SparkSession, d: str) -> DataFrame:
    return lww.counter_values(table(spark, d, "ops")).select("doc_id", "container", F.round("total", 4).alias("total"))


def q03_version_vector(spark: SparkSession, d: str) -> DataFrame:
    return log.version_vector(table(spark, d, "changes"))


def q03_version_applied(spark: SparkSession, d: str) -> DataFrame:
    """As a document has it: changes that wait for others are not in it."""
    return log.version_vector(log.applied(table(spark, d, "changes")))


def q04_frontiers(spark: SparkSession, d: str) -> DataFrame:
    return log.frontiers(table(spark, d, "changes"))


def q04_frontiers_applied(spark: SparkSession, d: str) -> DataFrame:
    return log.frontiers(cut(log.applied(table(spark, d, "changes")), "applied"))


def q05_export_from(spark: SparkSession, d: str) -> DataFrame:
    return _export_half(table(spark, d, "changes"))


def q05_export_applied(spark: SparkSession, d: str) -> DataFrame:
    return _export_half(cut(log.applied(table(spark, d, "changes")), "applied"))


def _export_half(changes: DataFrame) -> DataFrame:
    half = log.version_vector(changes).select("doc_id", "peer", F.expr("end div 2").alias("end"))
    return log.export_from(changes, half).withColumn("deps", F.array_join("deps", " "))


def q06_export_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _export_spans(spark, d, table(spark, d, "changes"))


def q06_export_ranges_applied(spark: SparkSession, d: str) -> DataFrame:
    return _export_spans(spark, d, log.applied(table(spark, d, "changes")))


def _export_spans(spark: SparkSession, d: str, changes: DataFrame) -> DataFrame:
    spans = table(spark, d, "run_spans").select("doc_id", "peer", F.col("end_counter").alias("start"), F.col("start_counter").alias("end"))
    return log.export_ranges(changes, spans).withColumn("deps", F.array_join("deps", " ")).withColumn("layer", F.col("layer").cast("bigint"))


def q07_clip_overlaps(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "changes").select("doc_id", "peer", "counter", (F.col("end_counter") - F.col("counter")).alias("len"))
    late = changes.select("doc_id", "peer", F.expr("counter + len div 2").alias("counter"), "len")
    return log.clip_overlaps(changes.unionByName(late))


def q08_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return log.conflicts(table(spark, d, "changes"), ["end_counter", "lamport", "msg"])


def q09_text_one_author(spark: SparkSession, d: str) -> DataFrame:
    return sequence.texts(sequence.sequence_nodes(*derive.order_text(spark, d))).select("doc_id", "text")


def q10_text_offline_authors(spark: SparkSession, d: str) -> DataFrame:
    return sequence.texts(sequence.sequence_nodes(*derive.order_text(spark, d, offline=True))).select("doc_id", "text")


def q11_list_prepend(spark: SparkSession, d: str) -> DataFrame:
    return sequence.items(sequence.sequence_nodes(*derive.order_list(spark, d))).select("doc_id", "place", F.col("val_json").cast("bigint").alias("item"))


def q12_text_deletes(spark: SparkSession, d: str) -> DataFrame:
    return sequence.texts(sequence.sequence_nodes(*derive.cut_text(spark, d, 5))).select("doc_id", "text")


def q13_movable_list(spark: SparkSession, d: str) -> DataFrame:
    return sequence.items(sequence.sequence_nodes(*derive.nation_board(spark, d))).select("doc_id", "place", F.get_json_object("val_json", "$").alias("item"))


def _tree_state(placed: DataFrame) -> DataFrame:
    rows = placed.select("doc_id", F.col("container").alias("tree"), "node_id", "parent_id", "lamport", "peer")
    return hierarchy.hierarchies(rows).select("node_id", "fate", "node_depth", "n_below", "node_path")


def q14_tree_leaf_moves(spark: SparkSession, d: str) -> DataFrame:
    return _tree_state(tree.leaf_placements(derive.sales_tree(spark, d)))


def q14_tree_replay(spark: SparkSession, d: str) -> DataFrame:
    return _tree_state(tree.tree_placements(derive.sales_tree(spark, d)))


def q14_tree_siblings(spark: SparkSession, d: str) -> DataFrame:
    return tree.ranked(tree.tree_placements(derive.sales_tree(spark, d))).select("node_id", "parent_id", "index")


def q15_tree_delete_subtree(spark: SparkSession, d: str) -> DataFrame:
    return _tree_state(tree.tree_placements(derive.sales_tree(spark, d, delete_nation=3)))


def q15_tree_ops(spark: SparkSession, d: str) -> DataFrame:
    return tree.ranked(tree.tree_placements(table(spark, d, "ops"))).select("doc_id", "container", "node_id", "parent_id", "index")


def q16_delta_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = sequence.delta_runs(sequence.sequence_nodes(*derive.styled_text(spark, d)))
    return runs.select("doc_id", F.col("run").cast("bigint").alias("run"), F.col("insert").alias("piece"), "style")


def q17_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = assemble.documents(*derive.nested_orders(spark, d))
    entries = docs.select("doc_id", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("order_key", "fields"))
    return entries.select("doc_id", "order_key", F.explode("fields").alias("field", "val"))


def q18_causal_gate(spark: SparkSession, d: str) -> DataFrame:
    return log.gate(derive.event_chain(spark, d)).select("doc_id", F.col("peer").cast("bigint").alias("place"), "status")


def q18_gate_changes(spark: SparkSession, d: str) -> DataFrame:
    return log.gate(table(spark, d, "changes"))


def q18_past_versions(spark: SparkSession, d: str) -> DataFrame:
    past = log.past_versions(table(spark, d, "changes"))
    return past.select("doc_id", "peer", "change_counter", F.explode("past").alias("seen_peer", "seen_end"))


def q19_replay_status(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "room_events")
    return rooms.classified(events, *rooms.most_used(events)).groupBy("status").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


def q19_replay_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same room as a stream, run to its end: one row per event that was kept, good or quarantined."""
    at = f"{session_dir(spark)}/replay-{uuid.uuid4().hex}"
    names = rooms.most_used(table(spark, d, "room_events"))
    replay.replay(rooms.stream(spark, f"{d}/room_events.parquet"), *names, f"{at}/good", f"{at}/bad", f"{at}/state").awaitTermination()
    tables = [(path, x) for x in ("good", "bad") for path in (f"{at}/{x}", replay.unnamed(f"{at}/{x}"))]
    return reduce(DataFrame.unionByName, [spark.read.schema(rooms.EVENTS).parquet(path).select("event_id", F.lit(x).alias("kept")) for path, x in tables])


def q20_text_of_ops(spark: SparkSession, d: str) -> DataFrame:
    return sequence.texts(sequence.sequence_nodes(table(spark, d, "changes"), table(spark, d, "ops").filter("container like '%:Text'")))


def q21_version_codec(spark: SparkSession, d: str) -> DataFrame:
    """Version vectors through their binary form and back."""
    return _through_bytes(q03_version_vector(spark, d))


def q21_version_codec_applied(spark: SparkSession, d: str) -> DataFrame:
    return _through_bytes(q03_version_applied(spark, d))


def _through_bytes(version: DataFrame) -> DataFrame:
    from tidelog.functions.versions import decode_version, encode_version

    vectors = version.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("peer", "end"))).alias("vv"))
    back = vectors.select("doc_id", decode_version(encode_version(F.col("vv"))).alias("vv"))
    return back.select("doc_id", F.explode("vv").alias("peer", "end"))


def q22_binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A log written as a blob per document and read again."""
    blobs = cut(binary_log.write(*derive.nested_orders(spark, d)), "blobs")
    _, ops, _ = binary_log.read(blobs)
    return ops.select("doc_id", "counter", "lamport", "container", "map_key", "val_json")


def q23_edit_scripts(spark: SparkSession, d: str) -> DataFrame:
    changes, ops, _ = edit.compile_scripts(derive.order_script(spark, d))
    return sequence.texts(sequence.sequence_nodes(changes, ops)).select("doc_id", "text")


def q24_merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return log.merge_adjacent(table(spark, d, "changes"))


def q26_locate(spark: SparkSession, d: str) -> DataFrame:
    """Which change holds the first id of each span a run worked through, and the lamport of that op."""
    ids = table(spark, d, "run_spans").select("doc_id", "peer", F.col("start_counter").alias("counter"))
    return log.locate(table(spark, d, "changes"), ids)


def q27_lamport_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth lamport is set back to half of what it was."""
    changes = table(spark, d, "changes")
    hurt = changes.withColumn("lamport", F.when(F.col("counter") % 20 == 7, F.expr("lamport div 2")).otherwise(F.col("lamport")))
    return log.lamport_faults(hurt)


def q28_lengths(spark: SparkSession, d: str) -> DataFrame:
    return sequence.lengths(sequence.sequence_nodes(*derive.cut_text(spark, d, 5))).select("doc_id", "length")


def q29_two_containers(spark: SparkSession, d: str) -> DataFrame:
    """One writer that edits two texts by turns, so that its ids in each have gaps."""
    return sequence.texts(sequence.sequence_nodes(*derive.turns(spark, d))).select("doc_id", "container", "text")


def q30_right_origins(spark: SparkSession, d: str) -> DataFrame:
    """Authors who type at one place, some of whom had seen others' text there and some not."""
    return sequence.texts(sequence.sequence_nodes(*derive.same_place(spark, d))).select("doc_id", "text")


def q25_violations(spark: SparkSession, d: str) -> DataFrame:
    ops = table(spark, d, "ops")
    hurt = ops.withColumn("len", F.when(F.col("arrival") % 50 == 3, 0).otherwise(F.col("len"))).withColumn("lamport", F.when(F.col("arrival") % 50 == 4, -1).otherwise(F.col("lamport"))).withColumn("vkind", F.when(F.col("arrival") % 50 == 5, F.lit("other")).otherwise(F.col("vkind")))
    return log.violations(hurt).select("arrival", "reason")


QUERIES = {n: f for n, f in sorted(globals().items()) if n[0] == "q" and n[1:3].isdigit()}

_EV = "select *, user_id % 16 as doc, row_number() over (partition by user_id % 16 order by ts, event_id) - 1 as n from events"
_ONCE = "select doc_id, peer, counter, max(end_counter) as end_counter, max(lamport) as lamport, any_value(deps) as deps from changes group by doc_id, peer, counter"
#: ``a``: the changes that wait for nothing. What waits for an id that no change has, or for a change that waits, waits.
_APPLIED = f"""recursive o as ({_ONCE}),
  need as (select doc_id, peer, counter, cast(split_part(d, '@', 1) as bigint) as c, split_part(d, '@', 2) as p from (select doc_id, peer, counter, unnest(deps) as d from o) union select doc_id, peer, counter, counter - 1, peer from o where counter > 0),
  edge as (select n.doc_id, n.peer, n.counter, t.peer as tp, t.counter as tc from need n left join o t on t.doc_id = n.doc_id and t.peer = n.p and n.c >= t.counter and n.c < t.end_counter),
  waits as (select doc_id, peer, counter from edge where tc is null union select e.doc_id, e.peer, e.counter from waits w join edge e on e.doc_id = w.doc_id and e.tp = w.peer and e.tc = w.counter),
  a as (select * from o anti join waits using (doc_id, peer, counter))"""
_SALES = """
  last as (select o_custkey, max_by(o_orderkey, o_orderkey) % 25 as nk from orders group by o_custkey),
  nat as (select n_nationkey as nk, n_nationkey || '@2' as id, n_regionkey || '@1' as up from nation),
  cust as (select c_custkey || '@3' as id, coalesce(nk, c_nationkey) || '@2' as up from customer left join last on o_custkey = c_custkey)"""


def _sales_sql(deleted: int | None) -> str:
    gone = f"nk = {deleted}" if deleted is not None else "false"
    return f"""with {_SALES},
  kids as (select up, count(*) as k from cust group by up)
select node_id, fate, cast(node_depth as bigint) as node_depth, cast(n_below as bigint) as n_below, node_path from (select r_regionkey || '@1' as node_id, 'live' as fate, 0 as node_depth, (select count(*) + coalesce(sum(k), 0) from nat left join kids on kids.up = nat.id where nat.up = r_regionkey || '@1' and not ({gone})) as n_below, r_regionkey || '@1' as node_path from region
union all select id, case when {gone} then 'deleted' else 'live' end, case when {gone} then 0 else 1 end, coalesce(k, 0), case when {gone} then id else nat.up || '/' || id end from nat left join kids on kids.up = nat.id
union all select cust.id, case when {gone} then 'deleted' else 'live' end, case when {gone} then 1 else 2 end, 0, case when {gone} then nat.id else nat.up || '/' || nat.id end || '/' || cust.id from cust join nat on nat.id = cust.up)"""


ORACLES = {
    "q01_map_last_writer": f"select cast(doc as varchar) as doc_id, event_type as map_key, max_by(cast(round(value * 100) as bigint), n) as cents from ({_EV}) group by doc, event_type",
    "q02_counter": f"select cast(doc as varchar) as doc_id, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from ({_EV}) group by doc",
    "q02_counter_ops": "select doc_id, container, round(sum(cast(v as double)), 4) as total from (select doc_id, container, peer, counter, min(val_json) as v from ops where container like '%:Counter' group by all) group by doc_id, container",
    "q03_version_vector": 'select doc_id, peer, max(end_counter) as "end" from changes group by doc_id, peer',
    "q03_version_applied": f'with {_APPLIED} select doc_id, peer, max(end_counter) as "end" from a group by doc_id, peer',
    "q21_version_codec_applied": f'with {_APPLIED} select doc_id, peer, max(end_counter) as "end" from a group by doc_id, peer',
    "q04_frontiers_applied": f"with {_APPLIED}, t as (select doc_id, peer, max(end_counter) - 1 as counter from a group by doc_id, peer) select doc_id, peer, counter from t where (doc_id, counter || '@' || peer) not in (select (doc_id, d) from (select doc_id, unnest(deps) as d from a))",
    "q05_export_applied": f"""with {_APPLIED}, v as (select doc_id, peer, max(end_counter) // 2 as v from a group by doc_id, peer)
select doc_id, peer, greatest(counter, v) as counter, end_counter, lamport + greatest(v - counter, 0) as lamport, case when v > counter then (v - 1) || '@' || peer else array_to_string(deps, ' ') end as deps from a join v using (doc_id, peer) where end_counter > v""",
    "q04_frontiers": "select doc_id, peer, max(end_counter) - 1 as counter from changes c group by doc_id, peer having (doc_id, (max(end_counter) - 1) || '@' || peer) not in (select (doc_id, d) from (select doc_id, unnest(deps) as d from changes))",
    "q05_export_from": f"""with o as ({_ONCE}), v as (select doc_id, peer, max(end_counter) // 2 as v from changes group by doc_id, peer)
select doc_id, peer, greatest(counter, v) as counter, end_counter, lamport + greatest(v - counter, 0) as lamport, case when v > counter then (v - 1) || '@' || peer else array_to_string(deps, ' ') end as deps from o join v using (doc_id, peer) where end_counter > v""",
    "q06_export_ranges": f"""with o as ({_ONCE}),
  b as (select doc_id, peer, start_counter as lo, end_counter as hi, max(end_counter) over (partition by doc_id, peer order by start_counter, end_counter rows between unbounded preceding and 1 preceding) as reach from (select distinct doc_id, peer, start_counter, end_counter from run_spans where end_counter > start_counter)),
  g as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by doc_id, peer order by lo, hi rows unbounded preceding) as layer from b),
  s as (select doc_id, peer, cast(layer as bigint) as layer, min(lo) as lo, max(hi) as hi from g group by all)
select doc_id, peer, layer, greatest(counter, lo) as counter, least(end_counter, hi) as end_counter, lamport + greatest(lo - counter, 0) as lamport, case when lo > counter then (lo - 1) || '@' || peer else array_to_string(deps, ' ') end as deps
from o join s using (doc_id, peer) where greatest(counter, lo) < least(end_counter, hi)""",
    "q07_clip_overlaps": """with a as (select doc_id, peer, counter, end_counter - counter as n from changes), u as (select doc_id, peer, counter, max(hi) as hi from (select doc_id, peer, counter, counter + n as hi from a union all select doc_id, peer, counter + n // 2, counter + n // 2 + n from a) group by all),
  r as (select *, max(hi) over (partition by doc_id, peer order by counter rows between unbounded preceding and 1 preceding) as reach from u)
select doc_id, peer, greatest(counter, coalesce(reach, counter)) as counter, hi - greatest(counter, coalesce(reach, counter)) as len from r where reach is null or hi > reach""",
    "q08_conflicts": "select doc_id, peer, counter, count(distinct end_counter || '/' || lamport || '/' || coalesce('m' || msg, '')) as versions from changes group by all having versions > 1",
    "q09_text_one_author": "select cast(o_custkey as varchar) as doc_id, string_agg(o_orderpriority, '' order by o_orderkey) as text from orders group by o_custkey",
    "q10_text_offline_authors": "select cast(o_custkey as varchar) as doc_id, string_agg(o_orderpriority, '' order by o_orderkey % 3, o_orderkey) as text from orders group by o_custkey",
    "q11_list_prepend": "select cast(o_custkey as varchar) as doc_id, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as place, o_orderkey as item from orders",
    "q12_text_deletes": "select cast(o_custkey as varchar) as doc_id, substring(string_agg(o_orderpriority, '' order by o_orderkey), 6) as text from orders group by o_custkey",
    "q13_movable_list": "select cast(n_regionkey as varchar) as doc_id, row_number() over (partition by n_regionkey order by last desc nulls last, n_nationkey) - 1 as place, coalesce(seg, n_name) as item from nation left join (select c_nationkey, max(c_custkey) as last, max_by(c_mktsegment, c_custkey) as seg from customer group by c_nationkey) on c_nationkey = n_nationkey",
    "q14_tree_leaf_moves": _sales_sql(None),
    "q14_tree_replay": _sales_sql(None),
    "q14_tree_siblings": f"""with {_SALES}, l as (select o_custkey || '@3' as id, max(o_orderkey) + 3 as lam from orders group by o_custkey)
select id as node_id, up as parent_id, row_number() over (partition by up order by lam, p, k) - 1 as index from (
  select r_regionkey || '@1' as id, null as up, 0 as lam, 1 as p, r_regionkey || '@1' as k from region union all select id, up, 1, 2, id from nat
  union all select cust.id, up, coalesce(lam, 2), case when lam is null then 3 else 4 end, cust.id from cust left join l using (id))""",
    "q15_tree_delete_subtree": _sales_sql(3),
    "q16_delta_runs": """with m as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders),
  chars as (select o_custkey, unnest(range(40)) as i from (select distinct o_custkey from orders)),
  won as (select c.o_custkey, i, o_orderstatus as k, max_by(o_orderpriority, rn) as v from chars c join m on m.o_custkey = c.o_custkey and i >= o_orderkey % 30 and i < o_orderkey % 30 + o_orderkey % 9 + 1 group by all),
  styled as (select o_custkey, i, '{' || string_agg('"' || k || '": "' || v || '"', ', ' order by k) || '}' as style from won group by all),
  every as (select c.o_custkey, c.i, style, case when c.i > 0 and lag(style) over w is not distinct from style then 0 else 1 end as new from chars c left join styled s on s.o_custkey = c.o_custkey and s.i = c.i window w as (partition by c.o_custkey order by c.i)),
  runs as (select *, sum(new) over (partition by o_custkey order by i rows unbounded preceding) - 1 as run from every)
select cast(o_custkey as varchar) as doc_id, cast(run as bigint) as run, string_agg(chr(cast(97 + i % 26 as int)), '' order by i) as piece, any_value(style) as style from runs group by o_custkey, run""",
    "q17_nested": "select cast(o_custkey as varchar) as doc_id, cast(o_orderkey as varchar) as order_key, 'priority' as field, o_orderpriority as val from orders union all select cast(o_custkey as varchar), cast(o_orderkey as varchar), 'status', o_orderstatus from orders",
    "q18_causal_gate": f"select cast(doc as varchar) as doc_id, n as place, case when n < 7 then 'applied' else 'pending' end as status from ({_EV}) where n % 50 <> 7",
    "q18_gate_changes": f"with {_APPLIED} select doc_id, peer, counter, case when exists (select 1 from a where a.doc_id = o.doc_id and a.peer = o.peer and a.counter = o.counter) then 'applied' else 'pending' end as status from o",
    "q18_past_versions": f"""with recursive o as ({_ONCE}),
  need as (select doc_id, peer, counter, cast(split_part(d, '@', 1) as bigint) as c, split_part(d, '@', 2) as p from (select doc_id, peer, counter, unnest(deps) as d from o) union select doc_id, peer, counter, counter - 1, peer from o where counter > 0),
  edge as (select n.doc_id, n.peer, n.counter, t.peer as tp, t.counter as tc from need n join o t on t.doc_id = n.doc_id and t.peer = n.p and n.c >= t.counter and n.c < t.end_counter),
  reach as (select doc_id, peer, counter, peer as tp, counter as tc from o union select r.doc_id, r.peer, r.counter, e.tp, e.tc from reach r join edge e on e.doc_id = r.doc_id and e.peer = r.tp and e.counter = r.tc)
select r.doc_id, r.peer, r.counter as change_counter, n.p as seen_peer, max(n.c) + 1 as seen_end from reach r join need n on n.doc_id = r.doc_id and n.peer = r.tp and n.counter = r.tc group by r.doc_id, r.peer, r.counter, n.p""",
    "q19_replay_status": """with e as (select event_id, event_type, case when json_valid(content_json) then json_extract_string(content_json, '$.format') end as f, case when json_valid(content_json) then json_extract_string(content_json, '$.payload') end as p from room_events),
  t as (select event_type as t from e where event_type is not null group by event_type order by count(*) desc, event_type desc limit 1), g as (select f as g from e where f is not null group by f order by count(*) desc, f desc limit 1)
select case when not coalesce(event_type = (select t from t), false) then 'foreign_type' when f is null then 'broken' when f <> (select g from g) then 'foreign_format' when not coalesce(regexp_full_match(p, '[A-Za-z0-9+/]*={0,2}') and length(p) % 4 = 0, false) then 'broken' else 'ok' end as status, count(*) as events, count(distinct event_id) as ids from e group by status""",
    "q22_binary_round_trip": """with o as (select *, (row_number() over (partition by o_custkey order by o_orderkey) - 1) * 3 as n from orders)
select cast(o_custkey as varchar) as doc_id, n as counter, n as lamport, 'cid:root-m:Map' as container, cast(o_orderkey as varchar) as map_key, '"🦜:cid:' || n || '@1:Map"' as val_json from o
union all select cast(o_custkey as varchar), n + 1, n + 1, 'cid:' || n || '@1:Map', 'priority', '"' || o_orderpriority || '"' from o
union all select cast(o_custkey as varchar), n + 2, n + 2, 'cid:' || n || '@1:Map', 'status', '"' || o_orderstatus || '"' from o""",
    "q23_edit_scripts": "select cast(o_custkey as varchar) as doc_id, left(string_agg(o_orderpriority, '' order by o_orderkey desc), cast(sum(length(o_orderpriority)) - 4 as bigint)) as text from orders group by o_custkey",
    "q24_merge_adjacent": """with o as (select doc_id, peer, counter, unnest(max_by({'end_counter': end_counter, 'lamport': lamport, 'ts': ts, 'deps': deps, 'm': coalesce(msg, '')}, {'e': end_counter, 'm': coalesce(msg, ''), 't': ts})) from changes group by doc_id, peer, counter),
  n as (select *, case when lag(end_counter) over w = counter and lag(lamport) over w + counter - lag(counter) over w = lamport and len(deps) = 1 and deps[1] = (counter - 1) || '@' || peer and lag(m) over w = m and ts - lag(ts) over w <= 1000 then 0 else 1 end as new from o window w as (partition by doc_id, peer order by counter)),
  g as (select *, sum(new) over (partition by doc_id, peer order by counter rows unbounded preceding) as g from n)
select doc_id, peer, min(counter) as counter, max(end_counter) as end_counter, min(lamport) as lamport, min_by(ts, counter) as ts, count(*) as parts from g group by doc_id, peer, g""",
    "q25_violations": "select arrival, case arrival % 50 when 3 then 'length' when 4 then 'lamport' else 'kind' end as reason from ops where arrival % 50 in (3, 4, 5)",
    "q26_locate": f"""with o as ({_ONCE}), i as (select distinct doc_id, peer, start_counter as counter from run_spans)
select i.doc_id, i.peer, i.counter, o.counter as change_counter, o.lamport + i.counter - o.counter as lamport from i left join o on o.doc_id = i.doc_id and o.peer = i.peer and i.counter >= o.counter and i.counter < o.end_counter""",
    "q27_lamport_faults": f"""with o as (select doc_id, peer, counter, end_counter, deps, case when counter % 20 = 7 then lamport // 2 else lamport end as lamport from ({_ONCE})),
  e as (select doc_id, peer, counter, lamport, unnest(deps) as dep from o union select doc_id, peer, counter, lamport, (counter - 1) || '@' || peer from o where counter > 0)
select e.*, t.lamport + cast(split_part(dep, '@', 1) as bigint) - t.counter as dep_lamport from e join o t on t.doc_id = e.doc_id and t.peer = split_part(dep, '@', 2) and cast(split_part(dep, '@', 1) as bigint) >= t.counter and cast(split_part(dep, '@', 1) as bigint) < t.end_counter
where t.lamport + cast(split_part(dep, '@', 1) as bigint) - t.counter >= e.lamport""",
    "q28_lengths": "select cast(o_custkey as varchar) as doc_id, greatest(cast(sum(length(o_orderpriority)) as bigint) - 5, 0) as length from orders group by o_custkey",
    "q29_two_containers": "select cast(o_custkey as varchar) as doc_id, case when n % 2 = 0 then 'cid:root-a:Text' else 'cid:root-b:Text' end as container, string_agg(o_orderpriority, '' order by o_orderkey) as text from (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders) group by all",
    "q30_right_origins": """with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select cast(o_custkey as varchar) as doc_id, '[' || string_agg('<' || o_orderstatus || '>', '' order by (n + 1) // 2, n desc) || ']' as text from o group by o_custkey""",
    "q21_version_codec": 'select doc_id, peer, max(end_counter) as "end" from changes group by doc_id, peer',
}
ORACLES["q06_export_ranges_applied"] = ORACLES["q06_export_ranges"].replace(f"with o as ({_ONCE})", f"with {_APPLIED}").replace("from o join s", "from a join s")
