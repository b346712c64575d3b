"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a hash and get a virtual finish time: the tokens of the source up to and
including the document, over the weight of the source. At virtual time v every source has sent weight x v tokens, so
the order of finish times is the mixture. A small source goes round again, each time in another order, as often as it
may; then its queue is empty and the others share the line in their proportions. To stop at the budget is to keep the
finish times up to the virtual time at which the queues have sent that much together, which follows from the sizes of
the sources alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.tokens import source_name
from tidelog.plans.storage import cut

#: The shuffle is by the hash's leading bits first: so many blocks a source, each summed by a task of its own.
BLOCK_BITS = 12
#: The most sources that may be mixed; they are a parameter table.
MOST_SOURCES = 10_000


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats) in one spelling of sources; two spellings of one source add up."""
    named = targets.filter("source is not null and target_share > 0").select(source_name(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r"))
    return named.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("r").alias("max_repeats"))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, weight, max_repeats, have), a row per target.

    ``weight`` is the target share among the sources that can send anything, null for the others: nobody can send what
    does not exist, and the rest keep their proportions.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    rows = targets_of(targets).join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    able = (F.col("have") > 0) & (F.col("max_repeats") > 0)
    everything = Window.partitionBy()  # a parameter table, see MOST_SOURCES
    return rows.withColumn("weight", F.when(able, F.col("target_share") / F.sum(F.when(able, F.col("target_share"))).over(everything)))


def closing_time(queues: list[tuple[float, int]], budget: float) -> float:
    """The virtual time at which queues of (weight, tokens they may send) have sent ``budget`` together. A queue that
    has sent all it may falls out and the others go on in their proportions; past the last one no time is left."""
    v = sent = 0.0
    rate = sum(w for w, _ in queues)
    for ends, weight in sorted((most / weight, weight) for weight, most in queues):
        if sent + rate * (ends - v) >= budget:
            return v + (budget - sent) / rate
        sent, v, rate = sent + rate * (ends - v), ends, rate - weight
    return v


def mixture(sized: DataFrame, targets: DataFrame, seed: int = 0, budget: float | None = None) -> DataFrame:
    """(finish, source, doc_id, copy, n_tokens) in order of finish: the mixture; ``copy`` counts a document's uses from 0.

    ``sized`` holds (doc_id, source, n_tokens) with sources in one spelling; give it as a stored table, it is read
    three times. ``budget`` is in tokens; by default it is what the target sources hold, so that the mixture is as
    large as the data it is made from. A source that has been used as often as it may falls short of its share and the
    others go on in their proportions until the budget is met; only if all are used up the mixture is smaller. The
    total falls short of the budget by less than a document per source. ``shares`` tells what was reached. Documents
    without tokens, and those of sources without a target, are left out.
    """
    if targets_of(targets).limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = [w for w in cut(plan(sized, targets), "mixplan").collect() if w["weight"]]
    spark = sized.sparkSession
    if not weights:
        return spark.createDataFrame([], "finish double, source string, doc_id bigint, copy bigint, n_tokens bigint")
    total = sum(w["have"] for w in weights) if budget is None else float(budget)
    closes = closing_time([(w["weight"], w["have"] * w["max_repeats"]) for w in weights], total) * (1 + 1e-12)
    rounds = [(w["source"], w["weight"], w["have"], min(w["max_repeats"], int(closes * w["weight"] // w["have"]) + 1)) for w in weights]
    shares = spark.createDataFrame(rounds, "source string, weight double, have bigint, rounds int")
    rows = sized.filter("n_tokens > 0").join(F.broadcast(shares), "source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rounds").cast("bigint") - 1)))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "copy", F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 64 - BLOCK_BITS))
    key = ["source", "copy", "_b"]
    blocks = rows.groupBy(*key).agg(F.sum("n_tokens").alias("_t"))
    before = Window.partitionBy("source", "copy").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*key, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*key).orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = F.col("copy") * F.col("have") + F.col("_off") + F.sum("n_tokens").over(inside)
    timed = rows.join(offsets, key).withColumn("finish", sent.cast("double") / F.col("weight"))
    return timed.filter(F.col("finish") <= F.lit(closes)).select("finish", "source", "doc_id", "copy", "n_tokens").orderBy("finish", "source", "doc_id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, records, documents, most_uses, tokens, reached_share): what each source really gave."""
    per = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("u"), F.sum("n_tokens").alias("t"))
    got = per.groupBy("source").agg(F.sum("u").alias("records"), F.count("*").alias("documents"), F.max("u").alias("most_uses"), F.sum("t").alias("tokens"))
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # a row per target
    joined = targets_of(targets).join(got, "source", "left").fillna(0, ["records", "documents", "most_uses", "tokens"])
    return joined.select("source", "target_share", "records", "documents", "most_uses", "tokens", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)).alias("reached_share"))
