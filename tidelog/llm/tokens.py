"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies (a parameter of all that counts tokens), and the pattern that splits text before merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Chunks whose counts a process remembers, and the longest of them in characters.
MEMO, MEMO_LENGTH = 400_000, 32

# The pattern never joins what stands before white space to what follows, so a text may be cut in front of each run of
# white space and the parts counted alone. Python's \s holds four control characters more than the tokenizer's.
_CHUNKS = re.compile(r"\s*\S+|\s+").findall
_ODD = re.compile("[\x1c-\x1f]").search


class Counter(dict):
    """Counts tokens; as a dict, it remembers the counts of short chunks."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> int:
        n = len(self._encode(chunk))
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _ODD(text):
            return len(self._encode(text))
        return sum(map(self.__getitem__, _CHUNKS(text)))


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def copy_class(text: str | None) -> int | None:
    """The same number for texts that differ in letter case and white space only; None for blank ones."""
    words = (text or "").lower().split()
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63) if words else None


def source_name(source: Column) -> Column:
    """One spelling of each source: letter case and outer blanks aside, ``-`` for ``_``; '' for null."""
    return F.coalesce(F.lower(F.trim(F.translate(source, "_\t\r\n", "-   "))), F.lit(""))


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY, copies: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens), with ``copies`` also (copy_class): the size of every whole text.

    A null or empty text has no tokens. Texts are read once and do not leave the task.
    """
    fields = [("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())] + [("copy_class", pa.int64())] * copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n, c = [], []
            for x in b.column("text"):
                text = x.as_py()
                n.append(count(text))
                if copies:
                    c.append(copy_class(text))
            columns = [b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())] + [pa.array(c, pa.int64())] * copies
            yield pa.RecordBatch.from_arrays(columns, names=[f for f, _ in fields])

    ddl = "doc_id bigint, source string, n_tokens bigint" + ", copy_class bigint" * copies
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").mapInArrow(run, ddl)
