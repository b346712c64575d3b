"""Binary forms of version vectors and frontiers, as Arrow batches of values.

Fixed formats: numbers are LEB128 varints, signed ones in zigzag; a version vector is its length and then peer and end
of each writer; frontiers are their length and then peer and counter of each id, in order of (peer, counter).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def put_unsigned(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def put_signed(out: bytearray, n: int) -> None:
    put_unsigned(out, n << 1 if n >= 0 else (-n << 1) - 1)


class Cursor:
    """Reads from bytes, never past their end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unsigned(self, bits: int = 64) -> int:
        n = shift = 0
        while True:
            if self.at >= len(self.data):
                raise ValueError("the bytes end within a number")
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            if n >> bits:
                raise ValueError(f"a number of more than {bits} bits")
            if b < 128:
                return n
            shift += 7

    def signed(self, bits: int = 64) -> int:
        n = self.unsigned(bits)
        return n >> 1 if not n & 1 else -(n + 1 >> 1)

    def done(self) -> None:
        if self.at != len(self.data):
            raise ValueError("bytes behind the end")


def version_bytes(vector: dict[str, int]) -> bytes:
    """Ends at or below 0 are no entries. Peers come in numeric order, so equal vectors give equal bytes."""
    held = sorted((int(p), int(e)) for p, e in vector.items() if e > 0)
    out = bytearray()
    put_unsigned(out, len(held))
    for p, e in held:
        put_unsigned(out, p)
        put_signed(out, e)
    return bytes(out)


def bytes_version(data: bytes) -> dict[str, int]:
    c, vector = Cursor(data), {}
    for _ in range(c.unsigned()):
        p = c.unsigned()
        vector[str(p)] = c.signed(32)
    c.done()
    return vector


def frontier_bytes(ids: list[str]) -> bytes:
    """One id per peer is kept, the one with the greatest counter."""
    best: dict[int, int] = {}
    for i in ids:
        c, _, p = i.partition("@")
        best[int(p)] = max(best.get(int(p), int(c)), int(c))
    out = bytearray()
    put_unsigned(out, len(best))
    for p, c in sorted(best.items()):
        put_unsigned(out, p)
        put_signed(out, c)
    return bytes(out)


def bytes_frontier(data: bytes) -> list[str]:
    c, ids = Cursor(data), []
    for _ in range(c.unsigned()):
        p = c.unsigned()
        ids.append(f"{c.signed(32)}@{p}")
    c.done()
    return ids


@F.pandas_udf(T.BinaryType())
def encode_version(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else version_bytes(dict(v)))


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def decode_version(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else bytes_version(bytes(b)))


@F.pandas_udf(T.BinaryType())
def encode_frontiers(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else frontier_bytes(list(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_frontiers(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else bytes_frontier(bytes(b)))
