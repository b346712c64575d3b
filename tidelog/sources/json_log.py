"""Op logs in JSON, one document a file."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions.ids import DELETED_PARENT
from tidelog.plans.schema import CHANGES, CHILD, OPS


class _Log:
    """One file. ``@n`` is an index into the file's peers wherever an id stands; it is resolved here."""

    def __init__(self, doc_id: str, text: str):
        self.doc_id = doc_id
        # floats stay text, so that 5.0 is still told from 5 and no digit is lost
        self.log = json.loads(text, parse_float=lambda s: _Number(s))
        self.peers = self.log["peers"]

    def id(self, printed: str | None) -> str | None:
        if printed is None:
            return None
        counter, _, index = printed.rpartition("@")
        return f"{counter}@{self.peers[int(index)]}"

    def container(self, cid: str) -> str:
        if cid.startswith("cid:root-"):
            return cid
        body, _, kind = cid[4:].rpartition(":")
        return f"cid:{self.id(body)}:{kind}"

    def value(self, v) -> str:
        def resolve(x):
            if isinstance(x, str) and x.startswith(CHILD + "cid:"):
                return CHILD + self.container(x[len(CHILD) :])
            if isinstance(x, list):
                return [resolve(y) for y in x]
            if isinstance(x, dict):
                return {k: resolve(y) for k, y in x.items()}
            return x

        return json.dumps(resolve(v), ensure_ascii=False)

    def rows(self) -> Iterator[tuple[tuple, list[dict]]]:
        arrival = 0
        for c in self.log["changes"]:
            counter, peer = self.id(c["id"]).split("@")
            ops = []
            for op in c["ops"]:
                x, kind = op["content"], op["container"].rpartition(":")[2]
                n, row = 1, {"vkind": x["type"], "container": self.container(op["container"])}
                row["pos"] = x.get("pos")
                if kind == "Map":
                    row["map_key"] = x["key"]
                    if x["type"] == "insert":
                        row["val_json"] = self.value(x["value"])
                elif x["type"] == "insert":
                    row["val_json"] = self.value(x["text"] if kind == "Text" else x["value"])
                    n = len(x["text"] if kind == "Text" else x["value"])
                elif x["type"] == "delete" and kind != "Tree":
                    row["del_len"], row["del_start"], n = x["len"], self.id(x["start_id"]), abs(x["len"])
                elif x["type"] == "mark":
                    row |= {"pos": x["start"], "mark_len": x["end"] - x["start"], "mark_key": x["style_key"], "mark_info": x["info"], "val_json": self.value(x["style_value"])}
                elif x["type"] == "move" and kind == "MovableList":
                    row |= {"move_from": x["from"], "pos": x["to"], "elem": self.id(x["elem_id"])[1:]}
                elif x["type"] == "set":
                    row |= {"elem": self.id(x["elem_id"])[1:], "val_json": self.value(x["value"])}
                elif kind == "Tree":
                    row |= {"tree_target": self.id(x["target"]), "tree_parent": DELETED_PARENT if x["type"] == "delete" else self.id(x.get("parent")), "fractional_index": x.get("fractional_index")}
                elif kind == "Counter":
                    row["val_json"] = self.value(x["value"])
                at = op["counter"]
                ops.append(row | {"doc_id": self.doc_id, "peer": peer, "counter": at, "len": n, "lamport": c["lamport"] + at - int(counter), "change_counter": int(counter), "arrival": arrival})
                arrival += 1
            end = ops[-1]["counter"] + ops[-1]["len"] if ops else int(counter)
            yield (self.doc_id, peer, int(counter), end, c["lamport"], c["timestamp"], [self.id(d) for d in c["deps"]], c.get("msg"), arrival), ops


class _Number(float):
    def __new__(cls, s: str):
        return super().__new__(cls, s)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) of the op logs at ``path`` (a file, folder or glob); a document is named by its file.

    Files are parsed where they are read; one that is no op log fails the query.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(want: str, ddl: str):
        schema = to_arrow_schema(StructType.fromDDL(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[dict] = []
                for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    for change, ops in _Log(os.path.basename(p).split(".")[0], content.decode()).rows():
                        rows += ops if want == "ops" else [dict(zip(schema.names, change))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return files.mapInArrow(run, ddl)

    return parse("changes", CHANGES), parse("ops", OPS)


def write(changes: DataFrame, ops: DataFrame, folder: str) -> None:
    """The log as two Parquet tables, spread by document."""
    for name, df in (("changes", changes), ("ops", ops)):
        df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).write.partitionBy("doc_bucket").parquet(f"{folder}/{name}")
