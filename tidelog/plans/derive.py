"""Operation logs derived from the star-schema tables, in the log's own layout, with known results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.plans.schema import CHANGES, CHILD, OPS
from tidelog.plans.tables import table


def _as(df: DataFrame, ddl: str, **columns: Column) -> DataFrame:
    """``df`` in the layout of ``ddl``; columns that are not given are null."""
    out = []
    for f in StructType.fromDDL(ddl):
        out.append(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def _text(c: Column) -> Column:
    """A string without quotes or escapes as JSON."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def order_text(spark: SparkSession, d: str, offline: bool = False) -> tuple[DataFrame, DataFrame]:
    """A Text per customer, typed from the priorities of the orders: by one author, one order after the other, or by
    three authors (order key modulo 3) who never saw each other and each type at their own end."""
    orders = table(spark, d, "orders").withColumn("peer", (F.col("o_orderkey") % 3 + 1) if offline else F.lit(1))
    w = Window.partitionBy("o_custkey", "peer").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    typed = orders.withColumn("at", F.coalesce(F.sum(F.length("o_orderpriority")).over(w), F.lit(0)))
    n = F.length("o_orderpriority")
    common = {"doc_id": F.col("o_custkey").cast("string"), "peer": F.col("peer"), "counter": F.col("at"), "lamport": F.col("at"), "arrival": F.col("o_orderkey")}
    ops = _as(typed, OPS, **common, len=n, change_counter=F.col("at"), container=F.lit("cid:root-t:Text"), vkind=F.lit("insert"), pos=F.col("at"), val_json=_text(F.col("o_orderpriority")))
    return _as(typed, CHANGES, **common, end_counter=F.col("at") + n, deps=F.array()), ops


def cut_text(spark: SparkSession, d: str, first: int) -> tuple[DataFrame, DataFrame]:
    """``order_text``, and then a second author who saw all of it deletes the first characters, by position."""
    changes, ops = order_text(spark, d)
    ends = changes.groupBy("doc_id").agg(F.max("end_counter").alias("end"))
    common = {"doc_id": F.col("doc_id"), "peer": F.lit(2), "counter": F.lit(0), "lamport": F.col("end"), "arrival": F.lit(0)}
    more = _as(ends, OPS, **common, len=F.lit(first), change_counter=F.lit(0), container=F.lit("cid:root-t:Text"), vkind=F.lit("delete"), pos=F.lit(0), del_len=F.lit(first))
    change = _as(ends, CHANGES, **common, end_counter=F.lit(first), deps=F.array(F.concat((F.col("end") - 1).cast("string"), F.lit("@1"))))
    return changes.unionByName(change), ops.unionByName(more)


def styled_text(spark: SparkSession, d: str, width: int = 40) -> tuple[DataFrame, DataFrame]:
    """Forty letters per customer, and a style per order, set by an author of its own who saw nothing but the text."""
    orders = table(spark, d, "orders")
    customers = orders.select("o_custkey").distinct()
    letters = "".join(chr(97 + i % 26) for i in range(width))
    text = {"doc_id": F.col("o_custkey").cast("string"), "peer": F.lit(1), "counter": F.lit(0), "lamport": F.lit(0), "arrival": F.lit(0)}
    typed = _as(customers, OPS, **text, len=F.lit(width), change_counter=F.lit(0), container=F.lit("cid:root-t:Text"), vkind=F.lit("insert"), pos=F.lit(0), val_json=F.lit(f'"{letters}"'))
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1
    marks = orders.withColumn("peer", rn)
    own = {"doc_id": F.col("o_custkey").cast("string"), "peer": F.col("peer"), "arrival": F.col("o_orderkey"), "change_counter": F.lit(0), "container": F.lit("cid:root-t:Text"), "len": F.lit(1)}
    begin = _as(marks, OPS, **own, counter=F.lit(0), lamport=F.lit(width), vkind=F.lit("mark"), pos=F.col("o_orderkey") % 30, mark_len=F.col("o_orderkey") % 9 + 1, mark_key=F.col("o_orderstatus"), val_json=_text(F.col("o_orderpriority")), mark_info=F.lit(132))
    end = _as(marks, OPS, **own, counter=F.lit(1), lamport=F.lit(width + 1), vkind=F.lit("mark_end"))
    change = _as(marks, CHANGES, doc_id=own["doc_id"], peer=F.col("peer"), counter=F.lit(0), end_counter=F.lit(2), lamport=F.lit(width), deps=F.array(F.lit(f"{width - 1}@1")), arrival=F.col("o_orderkey"))
    return _as(customers, CHANGES, **text, end_counter=F.lit(width), deps=F.array()).unionByName(change), typed.unionByName(begin).unionByName(end)


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two Texts per customer; one author types the priorities of its orders at their ends by turns, in one change
    each."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("o_orderpriority")
    orders = table(spark, d, "orders").withColumn("turn", (F.row_number().over(w) - 1) % 2).withColumn("at", F.coalesce(F.sum(n).over(before), F.lit(0)))
    own = Window.partitionBy("o_custkey", "turn").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    typed = orders.withColumn("place", F.coalesce(F.sum(n).over(own), F.lit(0)))
    common = {"doc_id": F.col("o_custkey").cast("string"), "peer": F.lit(1), "counter": F.col("at"), "lamport": F.col("at"), "arrival": F.col("o_orderkey")}
    cid = F.when(F.col("turn") == 0, "cid:root-a:Text").otherwise("cid:root-b:Text")
    ops = _as(typed, OPS, **common, len=n, change_counter=F.col("at"), container=cid, vkind=F.lit("insert"), pos=F.col("place"), val_json=_text(F.col("o_orderpriority")))
    return _as(typed, CHANGES, **common, end_counter=F.col("at") + n, deps=F.array()), ops


def same_place(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A Text ``[]`` per customer. The first, third, ... order's author has seen no more and types the order's status
    behind the bracket; the second, fourth, ... author has seen the text of the one before as well, and types in front
    of it. So authors who never saw each other have different neighbours to their right."""
    orders = table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    doc, late = F.col("o_custkey").cast("string"), F.col("n") % 2 == 0
    base = {"doc_id": doc, "peer": F.lit(1), "counter": F.lit(0), "lamport": F.lit(0), "arrival": F.lit(0)}
    text = {"container": F.lit("cid:root-t:Text"), "vkind": F.lit("insert"), "change_counter": F.lit(0)}
    customers = orders.select("o_custkey").distinct()
    put = {"doc_id": doc, "peer": F.col("n") + 1, "counter": F.lit(0), "lamport": F.when(late, 5).otherwise(2), "arrival": F.col("n")}
    ops = _as(customers, OPS, **base, **text, len=F.lit(2), pos=F.lit(0), val_json=F.lit('"[]"'))
    more = _as(orders, OPS, **put, **text, len=F.lit(3), pos=F.lit(1), val_json=F.concat(F.lit('"<'), F.col("o_orderstatus"), F.lit('>"')))
    seen = F.when(late, F.concat(F.lit("2@"), F.col("n").cast("string"))).otherwise(F.lit("1@1"))
    changes = _as(customers, CHANGES, **base, end_counter=F.lit(2), deps=F.array())
    return changes.unionByName(_as(orders, CHANGES, **put, end_counter=F.lit(3), deps=F.array(seen))), ops.unionByName(more)


def order_list(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A List per customer into which every order is put at the front."""
    orders = table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    common = {"doc_id": F.col("o_custkey").cast("string"), "peer": F.lit(1), "counter": F.col("n"), "lamport": F.col("n"), "arrival": F.col("o_orderkey")}
    ops = _as(orders, OPS, **common, len=F.lit(1), change_counter=F.col("n"), container=F.lit("cid:root-l:List"), vkind=F.lit("insert"), pos=F.lit(0), val_json=F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit("]")))
    return _as(orders, CHANGES, **common, end_counter=F.col("n") + 1, deps=F.array()), ops


def nation_board(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A MovableList per region of its nations; each customer, in turn, moves its nation to the front and sets its
    value to the customer's segment."""
    nations = table(spark, d, "nation").withColumn("n", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    per = nations.groupBy("n_regionkey").agg(F.count("*").alias("k"))
    put = {"doc_id": F.col("n_regionkey").cast("string"), "peer": F.lit(1), "counter": F.col("n"), "lamport": F.col("n"), "arrival": F.col("n")}
    made = _as(nations, OPS, **put, len=F.lit(1), change_counter=F.col("n"), container=F.lit("cid:root-b:MovableList"), vkind=F.lit("insert"), pos=F.col("n"), val_json=F.concat(F.lit('["'), F.col("n_name"), F.lit('"]')))
    turn = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(per, "n_regionkey")
    turn = turn.withColumn("at", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("c_custkey")) - 1) * 2 + F.col("k"))
    own = {"doc_id": F.col("n_regionkey").cast("string"), "peer": F.lit(1), "arrival": F.col("at"), "change_counter": F.col("at"), "container": F.lit("cid:root-b:MovableList"), "len": F.lit(1), "elem": F.concat(F.col("n").cast("string"), F.lit("@1"))}
    move = _as(turn, OPS, **own, counter=F.col("at"), lamport=F.col("at"), vkind=F.lit("move"), pos=F.lit(0))
    name = _as(turn, OPS, **own, counter=F.col("at") + 1, lamport=F.col("at") + 1, vkind=F.lit("set"), val_json=_text(F.col("c_mktsegment")))
    changes = _as(nations, CHANGES, **put, end_counter=F.col("n") + 1, deps=F.array()).unionByName(
        _as(turn, CHANGES, doc_id=own["doc_id"], peer=F.lit(1), counter=F.col("at"), end_counter=F.col("at") + 2, lamport=F.col("at"), deps=F.array(), arrival=F.col("at"))
    )
    return changes, made.unionByName(move).unionByName(name)


def sales_tree(spark: SparkSession, d: str, delete_nation: int | None = None) -> DataFrame:
    """Ops of one Tree: regions, nations below them, customers below those; each order, in turn, moves its customer to
    the nation of the order key modulo 25. Node ids are ``key@peer`` with peers 1, 2 and 3 for the three levels."""
    tree = {"doc_id": F.lit("sales"), "container": F.lit("cid:root-s:Tree"), "fractional_index": F.lit("80"), "len": F.lit(1)}
    made = lambda key, p: F.concat(F.col(key).cast("string"), F.lit(f"@{p}"))
    regions = _as(table(spark, d, "region"), OPS, **tree, peer=F.lit(1), counter=F.col("r_regionkey"), lamport=F.lit(0), vkind=F.lit("create"), tree_target=made("r_regionkey", 1))
    nations = _as(table(spark, d, "nation"), OPS, **tree, peer=F.lit(2), counter=F.col("n_nationkey"), lamport=F.lit(1), vkind=F.lit("create"), tree_target=made("n_nationkey", 2), tree_parent=made("n_regionkey", 1))
    customers = _as(table(spark, d, "customer"), OPS, **tree, peer=F.lit(3), counter=F.col("c_custkey"), lamport=F.lit(2), vkind=F.lit("create"), tree_target=made("c_custkey", 3), tree_parent=made("c_nationkey", 2))
    moves = _as(table(spark, d, "orders"), OPS, **tree, peer=F.lit(4), counter=F.col("o_orderkey"), lamport=F.col("o_orderkey") + 3, vkind=F.lit("move"), tree_target=made("o_custkey", 3), tree_parent=F.concat((F.col("o_orderkey") % 25).cast("string"), F.lit("@2")))
    ops = regions.unionByName(nations).unionByName(customers).unionByName(moves)
    if delete_nation is not None:
        gone = table(spark, d, "nation").filter(F.col("n_nationkey") == delete_nation)
        ops = ops.unionByName(_as(gone, OPS, **tree, peer=F.lit(5), counter=F.lit(0), lamport=F.lit(1 << 31), vkind=F.lit("delete"), tree_target=made("n_nationkey", 2)))
    return ops


def nested_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A Map per customer that holds a Map per order, with its priority and status."""
    orders = table(spark, d, "orders").withColumn("n", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) * 3)
    child = F.concat(F.lit("cid:"), F.col("n").cast("string"), F.lit("@1:Map"))
    rows = []
    for k, (cid, key, value) in enumerate(((F.lit("cid:root-m:Map"), F.col("o_orderkey").cast("string"), F.concat(F.lit(f'"{CHILD}'), child, F.lit('"'))), (child, F.lit("priority"), _text(F.col("o_orderpriority"))), (child, F.lit("status"), _text(F.col("o_orderstatus"))))):
        at = F.col("n") + k
        rows.append(_as(orders, OPS, doc_id=F.col("o_custkey").cast("string"), peer=F.lit(1), counter=at, lamport=at, arrival=at, len=F.lit(1), change_counter=F.col("n"), container=cid, vkind=F.lit("insert"), map_key=key, val_json=value))
    changes = _as(orders, CHANGES, doc_id=F.col("o_custkey").cast("string"), peer=F.lit(1), counter=F.col("n"), end_counter=F.col("n") + 3, lamport=F.col("n"), deps=F.array(), arrival=F.col("n"))
    return changes, rows[0].unionByName(rows[1]).unionByName(rows[2])


def event_map(spark: SparkSession, d: str, kind: str = "Map") -> DataFrame:
    """Ops of a Map (or Counter) per 16 groups of users: the last value of each event type, in cents."""
    w = Window.partitionBy("doc").orderBy("ts", "event_id")
    events = table(spark, d, "events").withColumn("doc", F.col("user_id") % 16).withColumn("n", F.row_number().over(w) - 1)
    key = {"map_key": F.col("event_type"), "vkind": F.lit("insert")} if kind == "Map" else {"vkind": F.lit("counter")}
    return _as(events, OPS, doc_id=F.col("doc").cast("string"), peer=F.col("user_id") % 4 + 1, counter=F.col("n"), lamport=F.col("n"), arrival=F.col("event_id"), len=F.lit(1), change_counter=F.col("n"), container=F.lit(f"cid:root-e:{kind}"), val_json=F.round(F.col("value") * 100).cast("bigint").cast("string"), **key)


def event_chain(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the event log, each after the one before it in its document, of which every 50th went missing."""
    w = Window.partitionBy("doc").orderBy("ts", "event_id")
    events = table(spark, d, "events").withColumn("doc", F.col("user_id") % 16).withColumn("n", F.row_number().over(w) - 1)
    deps = F.when(F.col("n") > 0, F.array(F.concat((F.col("n") - 1).cast("string"), F.lit("@"), (F.col("n") - 1).cast("string")))).otherwise(F.array())
    # a writer of its own per change, so that only the dependency holds a change back
    chain = _as(events, CHANGES, doc_id=F.col("doc").cast("string"), peer=F.col("n"), counter=F.lit(0), end_counter=F.lit(1), lamport=F.col("n"), deps=F.transform(deps, lambda x: F.concat(F.lit("0@"), F.split_part(x, F.lit("@"), F.lit(2)))), arrival=F.col("event_id"))
    return chain.filter("lamport % 50 <> 7")


def order_script(spark: SparkSession, d: str) -> DataFrame:
    """An edit script per customer: the priority of each order is typed at the front, the last four characters go."""
    from tidelog.edit import SCRIPT

    orders = table(spark, d, "orders")
    doc = F.col("o_custkey").cast("string")
    typed = _as(orders, SCRIPT, doc_id=doc, seq=F.col("o_orderkey"), peer=F.lit(1), action=F.lit("insert"), container=F.lit("cid:root-t:Text"), pos=F.lit(0), val_json=_text(F.col("o_orderpriority")))
    ends = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.sum(F.length("o_orderpriority")).alias("n"))
    cut_off = _as(ends, SCRIPT, doc_id=doc, seq=F.col("last") + 1, peer=F.lit(1), action=F.lit("delete"), container=F.lit("cid:root-t:Text"), pos=F.col("n") - 4, len=F.lit(4))
    return typed.unionByName(cut_off)
