"""Ordered work within groups, streamed: many groups to a task, one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of output held before they are sent on.
SEND = 10_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` for Python work. A number of parts is named because adaptive execution would
    otherwise merge them by bytes, and few bytes may be much work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def per_group(df: DataFrame, keys: list[str], order: list, work: Callable[[list[dict] | Iterator[dict]], Iterator[tuple]], ddl: str, stream: bool = False) -> DataFrame:
    """``work`` gets the rows of one group, in order, and yields rows of ``ddl``. With ``stream`` it gets them one after
    the other and only what it keeps must fit a task's memory; else the group must."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby((r for b in batches for r in b.to_pylist()), itemgetter(*keys)):
            for row in work(group if stream else list(group)):
                out.append(row)
                if len(out) >= SEND:
                    yield send(out)
                    out = []
        if out:
            yield send(out)

    return spread(df, *keys).sortWithinPartitions(*[F.col(k) for k in keys], *order).mapInArrow(run, ddl)
