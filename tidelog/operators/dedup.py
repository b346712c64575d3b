"""Messages delivered more than once.

Identifiers are stored by time bucket (a range of delivery numbers of one source) and hash shard, and every bucket of a
shard has a Bloom filter. A message whose identifier no filter of an earlier bucket knows is new for certain, without
any comparison; a possible repeat is looked up, exactly, in the stored identifiers of only those buckets whose filters
answered. ``Inbox`` keeps filters and identifiers between batches: a batch is hashed to the shards, where it meets the
filters of earlier batches, and of what is stored it reads the matching buckets alone.

An identifier that fills a third of a batch is thinned out before the shuffle: each input task reports at once what it
can prove to be a later copy, and sends on one copy of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.incremental import Ledger
from tidelog.plans.storage import cut, session_dir

#: Time buckets that the first batch of a source is divided into, and rows a shard is sized for.
BUCKETS = 16
SHARD_ROWS = 400_000
#: Bits of a filter per identifier, and positions set for each: about one false answer in a hundred.
BITS, PROBES = 10, 5
#: Identifiers that an input task remembers because it met them twice in one Arrow batch. Others only cost shuffle. One
#: that fills a third of the rows occurs twice in the first batch of every task, long before so many are remembered.
HOT_IDS = 100_000

_OUT = "src string, row_id bigint"
_SENT = "src string, row_id bigint, ident string, h bigint, bucket bigint, bits binary"
_SENT_ARROW = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("ident", pa.string()), ("h", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
#: what: s(urplus), n(ew), m(aybe a repeat of something in ``bucket``, if so a surplus), f(ilter of ``bucket``).
_SETTLED = "what string, src string, row_id bigint, ident string, h bigint, bucket bigint, own bigint, bits binary"
_SETTLED_ARROW = pa.schema([("what", pa.string()), ("src", pa.string()), ("row_id", pa.int64()), ("ident", pa.string()), ("h", pa.int64()), ("bucket", pa.int64()), ("own", pa.int64()), ("bits", pa.binary())])
_STORED = "src string, row_id bigint, ident string, h bigint, own bigint, bits binary, shard int, what string, bucket bigint"


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks what is a later copy within this task by taking its identifier away; such rows spread by row number."""
    hot: dict[int, tuple] = {}
    known = np.zeros(0, np.int64)
    for b in batches:
        h, row = b.column("h").to_numpy(), b.column("row_id").to_numpy()
        src, ident = b.column("src"), b.column("ident")
        surplus = np.zeros(len(h), bool)
        for i in np.flatnonzero(np.isin(h, known)):
            of, name, least = hot[h[i]]
            if row[i] > least and ident[i].as_py() == name and src[i].as_py() == of:
                surplus[i] = True
        order = np.lexsort((row, h))
        for at in np.flatnonzero(h[order[1:]] == h[order[:-1]]):
            x, y = order[at], order[at + 1]
            if ident[x].as_py() == ident[y].as_py() and src[x].as_py() == src[y].as_py():
                surplus[y] = True
                if len(hot) < HOT_IDS or h[x] in hot:
                    hot.setdefault(h[x], (src[x].as_py(), ident[x].as_py(), row[x]))
        if len(known) != len(hot):
            known = np.fromiter(hot, np.int64, len(hot))
        kept = pc.if_else(pa.array(surplus), pa.scalar(None, pa.string()), ident)
        yield pa.record_batch([src, b.column("row_id"), kept, pa.array(np.where(surplus, row, h)), b.column("bucket"), b.column("bits")], schema=_SENT_ARROW)


class Bloom:
    """A filter over 64-bit hashes; positions are taken from two halves of the hash."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, h: np.ndarray) -> "Bloom":
        made = cls(np.zeros(1 << max(6, int(np.ceil(np.log2(max(1, len(h)) * BITS)))), bool))
        for at in made._places(h):
            made.bits[at] = True
        return made

    @classmethod
    def read(cls, data: bytes) -> "Bloom":
        return cls(np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool))

    def bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mixed = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        low, high = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        mask = np.uint64(len(self.bits) - 1)
        for k in range(PROBES):
            yield ((low + np.uint64(k) * high) & mask).astype(np.int64)

    def knows(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self._places(h):
            found &= self.bits[at]
        return found


class Names:
    """The identifiers of one bucket in order of their hashes."""

    def __init__(self, h: np.ndarray, ident: pa.Array):
        order = np.argsort(h, kind="stable")
        self.h, self.ident = h[order], ident.take(pa.array(order))

    def has(self, h: np.ndarray, ident: pa.Array) -> np.ndarray:
        lo, hi = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        found = np.zeros(len(h), bool)
        there = np.flatnonzero(hi > lo)
        found[there] = pc.equal(self.ident.take(pa.array(lo[there])), ident.take(pa.array(there))).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero((hi > lo + 1) & ~found):  # several identifiers of one hash
            found[i] = ident[i].as_py() in self.ident[lo[i] : hi[i]].to_pylist()
        return found


def _settle_shard(rows: pa.Table, stored: dict[tuple[str, int], Bloom]) -> Iterator[pa.RecordBatch]:
    """One source's rows of one shard, bucket after bucket: copies within a bucket are settled by sorting, then the
    bucket's identifiers are screened by the filters before it, and possible repeats are compared with the identifiers
    of this batch in those buckets that answered; for stored buckets that answered, the question is passed on."""
    src = rows.column("src")[0].as_py()
    h, row, bucket = (rows.column(c).to_numpy() for c in ("h", "row_id", "bucket"))
    ident = rows.column("ident").combine_chunks()
    order = np.lexsort((row, h, bucket))
    h, row, bucket, ident = h[order], row[order], bucket[order], ident.take(pa.array(order))
    same = np.zeros(len(h), bool)  # a later copy within its bucket; rows of one hash stand together
    like = np.flatnonzero((h[1:] == h[:-1]) & (bucket[1:] == bucket[:-1])) + 1
    if len(like):
        apart = like[pc.not_equal(ident.take(pa.array(like)), ident.take(pa.array(like - 1))).to_numpy(zero_copy_only=False)]
        same[like] = True
        for i in apart:  # two identifiers of one hash: compared one by one
            lo = hi = i
            while lo and h[lo - 1] == h[i] and bucket[lo - 1] == bucket[i]:
                lo -= 1
            while hi < len(h) and h[hi] == h[i] and bucket[hi] == bucket[i]:
                hi += 1
            names: set[str] = set()
            for j in range(lo, hi):
                name = ident[j].as_py()
                same[j] = name in names
                names.add(name)
    first = np.flatnonzero(~same)
    known = sorted(b for s, b in stored if s == src)
    filters: list[tuple[int, Bloom]] = []
    names_of: dict[int, Names] = {}
    surplus = [row[same]]
    new, maybe = [], []
    for b in np.unique(bucket[first]).tolist():
        mine = first[bucket[first] == b]
        hb = h[mine]
        repeat = np.zeros(len(mine), bool)
        for earlier, bloom in filters:
            hit = np.flatnonzero(bloom.knows(hb) & ~repeat)
            repeat[hit[names_of[earlier].has(hb[hit], ident.take(pa.array(mine[hit])))]] = True
        surplus.append(row[mine[repeat]])
        mine = mine[~repeat]
        hb = h[mine]
        asked = np.zeros(len(mine), bool)
        for earlier in known:
            for k in np.flatnonzero(stored[src, earlier].knows(hb)):
                asked[k] = True
                maybe.append((mine[k], earlier, b))
        new.append(mine[~asked])
        filters.append((b, Bloom.of(hb)))
        names_of[b] = Names(hb, ident.take(pa.array(mine)))
    yield _settled("s", src, np.concatenate(surplus))
    fresh = np.concatenate(new) if new else np.zeros(0, np.int64)
    yield _settled("n", src, row[fresh], ident.take(pa.array(fresh)), h[fresh], bucket[fresh], bucket[fresh])
    if maybe:
        i = np.array([m[0] for m in maybe])
        yield _settled("m", src, row[i], ident.take(pa.array(i)), h[i], np.array([m[1] for m in maybe]), np.array([m[2] for m in maybe]))
    for b, bloom in filters:
        yield _settled("f", src, np.zeros(1, np.int64), None, np.zeros(1, np.int64), np.array([b]), np.array([b]), [bloom.bytes()])


def _settled(what: str, src: str, row: np.ndarray, ident=None, h=None, bucket=None, own=None, bits=None) -> pa.RecordBatch:
    n = len(row)
    none = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.record_batch([pa.array([what] * n, pa.string()), pa.array([src] * n, pa.string()), pa.array(row, pa.int64()), none(ident, pa.string()), none(h, pa.int64()), none(bucket, pa.int64()), none(own, pa.int64()), none(bits, pa.binary())], schema=_SETTLED_ARROW)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: passes on what is known to be surplus, reads the filters, and settles each source."""
    parts: list[pa.RecordBatch] = []
    stored: dict[tuple[str, int], Bloom] = {}
    for b in batches:
        is_filter = pc.is_valid(b.column("bits"))
        if pc.any(is_filter).as_py():
            for r in b.filter(is_filter).to_pylist():
                old = stored.get((r["src"], r["bucket"]))
                bloom = Bloom.read(r["bits"])
                stored[r["src"], r["bucket"]] = bloom if old is None else _either(old, bloom)
            b = b.filter(pc.invert(is_filter))
        sure = pc.is_null(b.column("ident"))
        if pc.any(sure).as_py():
            gone = b.filter(sure)
            for s in pc.unique(gone.column("src")).to_pylist():
                yield _settled("s", s, gone.filter(pc.equal(gone.column("src"), s)).column("row_id").to_numpy())
            b = b.filter(pc.invert(sure))
        if b.num_rows:
            parts.append(b)
    if parts:
        t = pa.Table.from_batches(parts)
        for s in pc.unique(t.column("src")).to_pylist():
            yield from _settle_shard(t.filter(pc.equal(t.column("src"), s)), stored)


class _either:
    """Two filters of one bucket, filled by different batches."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def knows(self, h: np.ndarray) -> np.ndarray:
        return self.a.knows(h) | self.b.knows(h)


def exact_ident(*columns: Column) -> Column:
    """One string per combination of values, no two alike: each value behind its length. Null if any is null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    return F.concat(*parts)


class Inbox:
    """The messages seen so far, in a folder of any file system Spark can write.

    ``take`` settles one batch. A batch, its identifiers and its filters become visible together, by one manifest of a
    ``Ledger``; a batch that fails is taken again. The number of shards and each source's scale of buckets are fixed by
    the first batch that has it; buckets of one source are as wide ever after, so history grows in buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, shard_rows: int = SHARD_ROWS):
        self.spark, self.folder, self.shard_rows = spark, folder, shard_rows
        self.ledger = Ledger(spark, folder)

    def _scales(self, named: DataFrame, done: list[dict]) -> tuple[int, dict[str, list[int]]]:
        """(shards, source -> [least row number, bucket width]). There is a row per source on the driver, no more."""
        meta = json.loads(done[-1]["note"]) if done else {"shards": 0, "scales": {}}
        seen = named.groupBy("src").agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).collect()
        shards = meta["shards"] or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in seen) // self.shard_rows))
        return shards, meta["scales"] | {r["src"]: [r["lo"], max(1, -(-(r["hi"] - r["lo"] + 1) // BUCKETS))] for r in seen if r["src"] not in meta["scales"]}

    def take(self, messages: DataFrame) -> DataFrame:
        """(src, row_id): the rows of this batch that are surplus copies of earlier rows of it, or of a batch before.

        Within a batch the row with the lowest ``row_id`` is kept; what an earlier batch brought stays. Rows with a null
        or empty ident, or a null row_id or src, are copies of nothing. Identifiers are compared exactly.
        """
        named = messages.filter("src is not null and row_id is not null and ident <> ''").select("src", "row_id", "ident")
        done = self.ledger.manifests()
        shards, scales = self._scales(named, done)
        if not scales:
            return self.spark.createDataFrame([], _OUT)
        scale = F.create_map(*[x for s, (lo, w) in scales.items() for x in (F.lit(s), F.struct(F.lit(lo).cast("bigint").alias("lo"), F.lit(w).cast("bigint").alias("w")))])
        bucket = F.floor((F.col("row_id") - scale[F.col("src")]["lo"]) / scale[F.col("src")]["w"]).cast("bigint")
        sent = named.select("src", "row_id", "ident", F.xxhash64("src", "ident").alias("h"), bucket.alias("bucket"), F.lit(None).cast("binary").alias("bits")).mapInArrow(_thin, _SENT)
        sent = sent.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        stored = self.stored(done) if done else None
        if stored is not None:
            filters = stored.filter("what = 'f'").select("src", "row_id", "ident", F.lit(0).cast("bigint").alias("h"), "bucket", "bits", "shard")
            sent = sent.unionByName(filters)
        settled = sent.repartitionById(shards, F.col("shard")).mapInArrow(_with_shard(_settle), _SETTLED + ", shard int")
        settled = cut(settled, "settled") if stored is not None else settled
        if stored is not None:
            settled = self._look_up(settled, stored)
        out = f"{self.folder}/data/run={len(done):010d}-{uuid.uuid4().hex}"
        settled.filter("what <> 'm'").write.partitionBy("what", "bucket").parquet(out)
        self.ledger.commit(len(done), {"output": out, "from": None, "watermark": len(done), "note": json.dumps({"shards": shards, "scales": scales})})
        return self.stored([{"output": out}]).filter("what = 's'").select("src", "row_id")

    def stored(self, done: list[dict]) -> DataFrame:
        """What the named batches left: identifiers (``what = 'n'``), filters ('f') and surplus rows ('s')."""
        return self.spark.read.schema(_STORED).option("basePath", f"{self.folder}/data").parquet(*[m["output"] for m in done]).drop("run")

    def _look_up(self, settled: DataFrame, stored: DataFrame) -> DataFrame:
        """Turns maybes into surplus or new rows by the stored identifiers of the buckets they name, and no others."""
        asked = settled.filter("what = 'm'")
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets
        there = stored.filter((F.col("what") == "n") & F.col("bucket").isin(buckets)).select("src", "bucket", "h", "ident").distinct()
        hit = asked.join(there, ["src", "bucket", "h", "ident"], "left_semi").select("src", "row_id").distinct()
        rows = asked.select("src", "row_id", "ident", "h", F.col("own").alias("bucket"), "own", "bits", "shard").distinct()
        repeated = rows.join(hit.withColumn("_hit", F.lit(True)), ["src", "row_id"], "left")
        settled_rows = repeated.select(F.when(F.col("_hit"), "s").otherwise("n").alias("what"), "src", "row_id", "ident", "h", "bucket", "own", "bits", "shard")
        return settled.filter("what <> 'm'").unionByName(settled_rows)


def _with_shard(work):
    """``work`` over one shard's rows without their shard number, which its results get back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[int] = []

        def bare() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not shard and b.num_rows:
                    shard.append(b.column("shard")[0].as_py())
                yield b.select(_SENT_ARROW.names)

        for b in work(bare()):
            yield b.append_column("shard", pa.array([shard[0]] * b.num_rows, pa.int32()))

    return run


def surplus_copies(messages: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(src, row_id): every row but the one with the lowest ``row_id`` among those of equal (src, ident), as one batch
    of an ``Inbox`` of its own.

    ``messages`` has src string, row_id bigint (unique within src, in order of delivery) and ident string.
    """
    spark = messages.sparkSession
    return Inbox(spark, f"{session_dir(spark)}/inbox-{uuid.uuid4().hex}", shard_rows).take(messages)


def exactly_once(messages: DataFrame, row_id: str, *ident: str) -> DataFrame:
    """``messages`` without the surplus copies; rows without an identifier are all kept."""
    named = messages.select(F.lit("m").alias("src"), F.col(row_id).cast("bigint").alias("row_id"), exact_ident(*[F.col(c) for c in ident]).alias("ident"))
    extra = surplus_copies(named).select(F.col("row_id").alias(row_id))
    return messages.join(extra, row_id, "left_anti")
