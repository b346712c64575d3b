"""The queries of the data-processing problems 1 to 6 over the test tables, and what SQL says of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import changefeed, dedup, hierarchy, incremental, intervals, nested
from tidelog.plans.storage import session_dir
from tidelog.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One run of a new import over all that has arrived: its output is committed together with its watermark."""
    ledger = incremental.Ledger(spark, f"{session_dir(spark)}/import-{uuid.uuid4().hex}")
    incremental.take_pending(ledger, *_imports(spark, d))
    out = ledger.output()
    return spark.createDataFrame([], "doc_id string, peer string, counter bigint") if out is None else out


def p1_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same in two runs, half of the changes having arrived before the first, with failed runs before and after it."""
    ledger = incremental.Ledger(spark, f"{session_dir(spark)}/import-{uuid.uuid4().hex}")
    changes, runs, spans = _imports(spark, d)
    half = changes.agg(F.percentile_approx("arrival", 0.5)).first()[0]
    for arrived, crash in ((changes.filter(F.col("arrival") <= half), "output"), (changes.filter(F.col("arrival") <= half), None), (changes, "commit"), (changes, None)):
        try:
            incremental.take_pending(ledger, arrived, runs, spans, crash)
        except incremental.Crash:
            pass
    return ledger.output()


def _imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "changes"), table(spark, d, "import_runs"), table(spark, d, "run_spans")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.map_entries(table(spark, d, "changes"), table(spark, d, "ops"), close=True).drop("val_json")


def p2_committed(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.map_entries(table(spark, d, "changes"), table(spark, d, "ops"))


def covered_ids(spans: DataFrame) -> DataFrame:
    """(doc_id, peer, lo, hi): the ids each row of ``id_spans`` covers; empty where it covers none. Ids below 0 do not
    exist. A range that ran backwards holds its start and not its end; the sign of del_len is a direction only."""
    back = F.col("span_end") < F.col("span_start")
    deletes = F.col("span_kind") == "delete"
    lo = F.when(deletes, F.col("span_start")).when(back, F.col("span_end") + 1).otherwise(F.col("span_start"))
    hi = F.when(deletes, F.col("span_start") + F.abs("del_len")).when(back, F.col("span_start") + 1).otherwise(F.col("span_end"))
    return spans.select("doc_id", "peer", F.greatest(lo, F.lit(0)).alias("lo"), F.when(lo.isNotNull(), hi).alias("hi"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(covered_ids(table(spark, d, "id_spans")), ["doc_id", "peer"])


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Changes and room events as messages (src, row_id, ident)."""
    changes, events = table(spark, d, "changes"), table(spark, d, "room_events")
    c = changes.select(F.lit("changes").alias("src"), F.col("arrival").alias("row_id"), dedup.exact_ident(F.col("doc_id"), F.col("peer"), F.col("counter")).alias("ident"))
    e = events.select(F.lit("room_events").alias("src"), F.col("delivery_id").alias("row_id"), F.col("event_id").alias("ident"))
    return c.unionByName(e)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.surplus_copies(deliveries(spark, d))


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same in two batches, the second meeting the filters and identifiers the first has stored."""
    messages = deliveries(spark, d)
    half = messages.groupBy("src").agg(F.percentile_approx("row_id", 0.5).alias("half"))  # a row per source
    parted = messages.join(F.broadcast(half), "src")
    inbox = dedup.Inbox(spark, f"{session_dir(spark)}/inbox-{uuid.uuid4().hex}")
    early = inbox.take(parted.filter("row_id <= half"))
    return early.unionByName(inbox.take(parted.filter("row_id > half")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_trees(table(spark, d, "tree_states"))


def p5_triples(spark: SparkSession, d: str) -> DataFrame:
    return nested.record_triples(table(spark, d, "tree_states"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, d, "tree_nodes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_resumed, p2_found, p2_committed, p3_found, p4_found, p4_batches, p5_found, p5_triples, p6_found)}

_UNION = """
  {name}_b as (select *, max(hi) over (partition by doc_id, peer order by lo, hi rows between unbounded preceding and 1 preceding) as reach from (select distinct doc_id, peer, lo, hi from {src} where hi > lo)),
  {name}_g as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by doc_id, peer order by lo, hi rows unbounded preceding) as grp from {name}_b),
  {name} as (select doc_id, peer, min(lo) as lo, max(hi) as hi from {name}_g group by doc_id, peer, grp)"""

_WALK = """
with recursive n as (
    select doc_id, tree, node_id, nullif(parent_id, '') as parent_id from (
      select *, row_number() over (partition by doc_id, tree, node_id order by lamport desc, cast(peer as uhugeint) desc, parent_id desc nulls last) as rn from tree_nodes) where rn = 1),
  e as (select c.doc_id, c.tree, c.node_id, c.parent_id, p.node_id is not null as held,
      case when c.parent_id is null then 'live' when c.parent_id = '2147483647@18446744073709551615' then 'deleted' when p.node_id is null then 'orphan' end as fin
    from n c left join n p on c.doc_id = p.doc_id and c.tree = p.tree and c.parent_id = p.node_id),
  down as (select doc_id, tree, node_id, fin as fate, node_id as root_id, cast(0 as bigint) as node_depth, node_id as node_path from e where fin is not null
    union all select e.doc_id, e.tree, e.node_id, d.fate, d.root_id, d.node_depth + 1, d.node_path || '/' || e.node_id from down d join e on e.doc_id = d.doc_id and e.tree = d.tree and e.parent_id = d.node_id and e.fin is null),
  up as (select doc_id, tree, node_id, node_id as anc from e union select u.doc_id, u.tree, u.node_id, e.parent_id from up u join e on e.doc_id = u.doc_id and e.tree = u.tree and e.node_id = u.anc and e.fin is null),
  below as (select doc_id, tree, anc as node_id, count(*) - 1 as n_below from up group by all),
  lost as (select e.* from e left join down d using (doc_id, tree, node_id) where d.node_id is null),
  reach as (select doc_id, tree, node_id, parent_id as anc from lost union select r.doc_id, r.tree, r.node_id, l.parent_id from reach r join lost l on l.doc_id = r.doc_id and l.tree = r.tree and l.node_id = r.anc)
select doc_id, tree, node_id, fate, root_id, node_depth, cast(n_below as bigint) as n_below, node_path from down join below using (doc_id, tree, node_id)
union all select doc_id, tree, node_id, case when bool_or(anc = node_id) then 'cycle' else 'under_cycle' end, '', -1, -1, '' from reach group by doc_id, tree, node_id"""

_LAST_OP = """select *, row_number() over (partition by doc_id, container, map_key order by lamport desc, cast(peer as uhugeint) desc, counter desc) as rn from {src}
    where container like '%:Map' and vkind in ('insert', 'LoroValue', 'delete', 'DeleteOnce')"""

_P1 = f"""
with last as (select run_id, max_by(status, seq) as status from import_runs group by run_id),
  kept as (select doc_id, peer, start_counter as lo, end_counter as hi from run_spans join last using (run_id) where lower(trim(status)) = 'committed'),{_UNION.format(name="cover", src="kept")}
select distinct c.doc_id, c.peer, c.counter from changes c left join cover v on c.doc_id = v.doc_id and c.peer = v.peer and v.lo <= c.counter and v.hi >= c.end_counter where v.lo is null"""

_P4 = """
select 'changes' as src, arrival as row_id from (select arrival, row_number() over (partition by doc_id, peer, counter order by arrival) as rn from changes) where rn > 1
union all select 'room_events', delivery_id from (select delivery_id, row_number() over (partition by event_id order by delivery_id) as rn from room_events where event_id <> '') where rn > 1"""

ORACLES = {
    "p1_found": _P1,
    "p1_resumed": _P1,
    "p2_found": f"select doc_id, container, map_key, peer, counter from ({_LAST_OP.format(src='ops')}) where rn = 1 and vkind in ('insert', 'LoroValue')",
    "p2_committed": f"""
with recursive o as (select doc_id, peer, counter, max(end_counter) as end_counter, any_value(deps) as deps from changes group by doc_id, peer, counter),
  got as (select doc_id, peer, counter, sum(n) as n from (select doc_id, peer, change_counter as counter, counter as c, max(greatest(coalesce(len, 1), 1)) as n from ops group by all) group by doc_id, peer, counter),
  need as (select doc_id, peer, counter, cast(split_part(d, '@', 1) as bigint) as c, split_part(d, '@', 2) as p from (select doc_id, peer, counter, unnest(deps) as d from o) union select doc_id, peer, counter, counter - 1, peer from o where counter > 0),
  edge as (select n.doc_id, n.peer, n.counter, t.peer as tp, t.counter as tc from need n left join o t on t.doc_id = n.doc_id and t.peer = n.p and n.c >= t.counter and n.c < t.end_counter),
  open as (select doc_id, peer, counter from edge where tc is null union select o.doc_id, o.peer, o.counter from o left join got using (doc_id, peer, counter) where got.n is null or got.n < o.end_counter - o.counter),
  waits as (select * from open union select e.doc_id, e.peer, e.counter from waits w join edge e on e.doc_id = w.doc_id and e.tp = w.peer and e.tc = w.counter),
  below as (select ops.* from ops join (select * from o anti join waits using (doc_id, peer, counter)) a on ops.doc_id = a.doc_id and ops.peer = a.peer and ops.counter >= a.counter and ops.counter < a.end_counter)
select doc_id, container, map_key, peer, counter, val_json from ({_LAST_OP.format(src="below")}) where rn = 1 and vkind in ('insert', 'LoroValue')""",
    "p3_found": f"""
with ids as (select doc_id, peer, greatest(case when span_kind = 'delete' then span_start when span_end < span_start then span_end + 1 else span_start end, 0) as lo,
    case when span_kind = 'delete' then span_start + abs(del_len) when span_end < span_start then span_start + 1 else span_end end as hi from id_spans),{_UNION.format(name="cover", src="ids")}
select doc_id, peer, 'period' as what, lo, hi from cover
union all select doc_id, peer, 'gap', hi, nxt from (select *, lead(lo) over (partition by doc_id, peer order by lo) as nxt from cover) where nxt is not null""",
    "p4_found": _P4,
    "p4_batches": _P4,
    "p5_found": """
with j as (select distinct state_id, json(state_json) as doc from tree_states where json_valid(state_json)),
  e as (select state_id, doc, t.key as key, t.type as type, t.id as id, t.parent as up, t.value as v, t.fullkey as at from j, json_tree(j.doc) as t),
  node as (select state_id, id, key, up, v from e where type = 'OBJECT' and json_exists(v, '$.id') and json_exists(v, '$.fractional_index')),
  held as (select n.*, a.key as akey, a.type as atype, a.up as aup from node n left join e a on a.state_id = n.state_id and a.id = n.up),
  linked as (select h.*, case when atype = 'ARRAY' then aup else up end as owner, case when atype = 'ARRAY' then akey else key end as how, case when atype = 'ARRAY' then cast(key as bigint) else 0 end as pos from held h),
  named as (select l.state_id, l.v, l.pos, coalesce(l.v->>'$.id', '') as node_id, case when p.id is not null and l.how = 'children' then coalesce(p.v->>'$.id', '') else '' end as parent_id from linked l left join node p on p.state_id = l.state_id and p.id = l.owner),
  tags as (select *, json_extract(v, '$.meta.tags') as t from named)
select distinct state_id, 'node' as kind, node_id, parent_id, pos, '' as val from named
union select state_id, 'tag', node_id, parent_id, i - 1, json_extract(t, '$[' || (i - 1) || ']')->>'$' from (select *, unnest(range(1, cast(json_array_length(t) as bigint) + 1)) as i from tags where json_type(t) = 'ARRAY') where json_type(t, '$[' || (i - 1) || ']') <> 'NULL'
union select state_id, 'tag', node_id, parent_id, 0, t->>'$' from tags where json_type(t) in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')""",
    "p6_found": _WALK,
}
