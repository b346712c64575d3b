"""Replaying a room as a stream: isolate bad events, drop repeats, hold back changes until what they need is there."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.sources.rooms import classified


def unnamed(path: str) -> str:
    """The table of the events without an id, beside the table ``path``."""
    return f"{path}-unnamed"


def replay(events: DataFrame, event_type: str, payload_format: str, good: str, quarantine: str, checkpoint: str):
    """Starts the query and returns it: ok events go to the table ``good``, broken ones to ``quarantine``.

    Event ids are kept for ever: a repeat may come at any time, and no watermark could tell that it will not. Events
    with a null or empty id are copies of nothing: every one is kept, in the ``unnamed`` tables beside the two. Each
    batch is written to a folder of its own number, so a batch that is run again after a failure replaces itself.
    """
    ours = classified(events, event_type, payload_format).filter("status in ('ok', 'broken')")
    has_id = F.coalesce(F.col("event_id") != "", F.lit(False))
    kept = ours.filter(has_id).dropDuplicates(["event_id"]).unionByName(ours.filter(~has_id))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, status in ((good, "ok"), (quarantine, "broken")):
            for to, which in ((path, has_id), (unnamed(path), ~has_id)):
                batch.filter((F.col("status") == status) & which).write.mode("overwrite").parquet(f"{to}/batch={number}")
        batch.unpersist()

    return kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held, waiting = (json.loads(x) for x in state.get) if state.exists else ({}, [])
    for frame in frames:
        waiting += [[p, int(c), int(e), int(lam), list(d) if d is not None else []] for p, c, e, lam, d in zip(frame["peer"], frame["counter"], frame["end_counter"], frame["lamport"], frame["deps"])]
    waiting.sort(key=lambda x: (x[3], int(x[0]), x[1]))
    applied, moved = [], True
    while moved:
        moved, rest = False, []
        for x in waiting:
            peer, counter, end, lamport, deps = x
            if end <= held.get(peer, 0):
                continue  # a repeat
            ready = counter <= held.get(peer, 0)
            for d in deps:
                c, _, p = d.partition("@")
                ready = ready and int(c) < held.get(p, 0)
            if not ready:
                rest.append(x)
                continue
            applied.append((key[0], peer, max(counter, held.get(peer, 0)), end, lamport))  # a known beginning is cut off
            held[peer], moved = end, True
        waiting = rest
    state.update((json.dumps(held), json.dumps(waiting)))
    yield pd.DataFrame(applied, columns=["doc_id", "peer", "counter", "end_counter", "lamport"])


def gate_stream(changes: DataFrame) -> DataFrame:
    """(doc_id, peer, counter, end_counter, lamport): changes of a stream, once all they depend on has been applied.

    The state of a document is its version and the changes that wait; it grows until what they wait for arrives, and
    nothing may be evicted without changing the result.
    """
    return changes.groupBy("doc_id").applyInPandasWithState(_gate, "doc_id string, peer string, counter bigint, end_counter bigint, lamport bigint", "held string, waiting string", "append", "NoTimeout")
