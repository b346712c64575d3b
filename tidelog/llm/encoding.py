"""Garbled text from wrong character encodings: which texts are affected, and what stood there.

A text that was decoded with the wrong code page is a substitution cipher. Where it was written in a code page of one
byte a character, each letter stands for another letter; where it was written in a code of several bytes, each letter
stands for a byte, and the bytes for letters by the rules of that code. Both tables are unknown and learned for each
source by expectation maximisation against the bigrams of sound text, which are learned along with them:

* In the expectation step every word is weighed as sound or as enciphered. Its decipherments are scored by the bigrams
  and by the tables of its source, which tell how likely a character stands for a letter or byte.
* In the maximisation step the tables are counted anew from the decipherments, each with its weight, and the bigrams
  from words as read or as deciphered, so that garbled bigrams fade from the model of sound text. Sources lean on the
  counts of all sources where their own are few.

Code pages are the prior: every page the library knows, read as any other, proposes tables, and at the start a
character stands for what any two pages make of it, all alike. No pair of pages is preferred or listed.

What is learned is bounded by the alphabet and the largest sources, never by the corpus. It is then applied in one pass
over the texts, word by word and with ``translate`` over letters, without a join or a shuffle. Words are runs of
letters of ASCII and of anything beyond it, since garbled letters turn into signs as well; only words with a character
beyond ASCII matter.
"""

from __future__ import annotations

import encodings.aliases
import importlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokens import source_name
from tidelog.plans.storage import cut

#: Codes with more than one byte a character.
MANY_BYTES = ["utf-8", "gbk", "big5", "shift_jis", "euc-jp", "euc-kr"]
ROUNDS = 4
#: At the start one word in a hundred is enciphered. Enciphered words a source needs to weigh as much as all sources
#: together, and characters of which all sources together need as many to outweigh the code pages.
PRIOR, BACKED, PAGED = 0.01, 20.0, 2.0
#: Log odds from which on a word counts as enciphered: where several characters are deciphered, and for a single letter
#: under another, where context is all there is. Bytes that fit together as UTF-8 need only be likelier than not.
SURE, SURE_ONE = 3.0, 6.0
#: Log likelihood ratio at which a decipherment weighs less than a millionth, and none.
HOPELESS = -14.0
#: Sources with at least this share of all words have tables of their own; the others, of which there may be any
#: number, share one. So there are at most 1 / OWN_TABLE + 1 tables.
OWN_TABLE = 0.001

_RUNS = re.compile("[A-Za-z\x80-\U0010ffff]+")
#: What no sound text holds: control characters of the second set (NEL, a line end, apart) and the sign for undecodable
#: bytes; and what no decipherment may hold.
_MARKS = re.compile("[\x80-\x84\x86-\x9f�]")
_NEVER = re.compile("[\x00-\x1f\x7f-\x9f-�]")


@lru_cache(maxsize=1)
def pages() -> dict[str, str]:
    """Every one-byte page of the library that holds ASCII: name -> its characters by byte, of equal ones the first by
    name. Bytes that a page leaves undefined are U+FFFE; those of cp125x are read as control characters."""
    out: dict[str, str] = {}
    for name in sorted({"latin_1", *encodings.aliases.aliases.values()}):
        try:
            table = getattr(importlib.import_module(f"encodings.{name}"), "decoding_table", None)
        except ImportError:  # of another operating system
            continue
        if name == "latin_1":
            table = "".join(map(chr, range(256)))
        if isinstance(table, str) and len(table) == 256 and table[:128] == "".join(map(chr, range(128))):
            if name.startswith("cp125"):
                table = "".join(chr(i) if c == "￾" else c for i, c in enumerate(table))
            if table not in out.values():
                out[name] = table
    return out


def different(rows: np.ndarray) -> np.ndarray:
    """The different rows, compared as bytes."""
    if not rows.size:
        return rows[:0]
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()
    return rows[np.unique(whole, return_index=True)[1]]


class Alphabet:
    """The characters of all one-byte pages have numbers of their own; of all others only the block of 256 counts in
    bigrams, and the character within its block. ``maps`` holds every table two pages make: a row per pair, a column per
    character, -1 where it stands for nothing."""

    def __init__(self):
        known = pages()
        chars = sorted({c for t in known.values() for c in t if c != "￾"} | set(map(chr, range(32, 0x250))))
        self.chars, self.number = chars, {c: i for i, c in enumerate(chars)}
        self.own = len(chars)
        self.size = self.own + 256 + 2
        self.begin, self.end = self.size - 2, self.size - 1
        self.symbol = self.own + (np.arange(1 << 16) >> 8)
        for c, i in self.number.items():
            self.symbol[ord(c)] = i
        decode = np.array([[self.number.get(c, -1) if not _NEVER.match(c) or c < "\x80" else -1 for c in t] for t in known.values()])
        encode = np.full((len(known), self.own), -1)
        for r, t in enumerate(known.values()):
            for b in range(255, 127, -1):
                if t[b] in self.number:
                    encode[r, self.number[t[b]]] = b
            if "cp1252" == list(known)[r]:  # may have been plain Latin-1, which reads all bytes
                for b in range(128, 160):
                    if encode[r, self.number[chr(b)]] < 0:
                        encode[r, self.number[chr(b)]] = b
        self.encode = encode
        maps = np.where(encode[:, None, :] >= 0, decode[np.arange(len(known))[None, :, None], np.maximum(encode, 0)[:, None, :]], -1).reshape(-1, self.own)
        self.maps = different(maps.astype(np.int16))
        self.plain = np.array([c < "\x80" for c in chars])
        self.names = list(known)
        #: How many letters, and bytes, a character may stand for.
        self.letters = np.array([max(1, len(np.unique(self.maps[:, i])) - 1) for i in range(self.own)])
        self.bytes_ = np.array([max(1, len(np.unique(encode[:, i])) - 1) for i in range(self.own)])
        self.to_byte = [{ord(c): chr(b) for b, c in reversed(list(enumerate(t))) if c != "￾"} | ({b: chr(b) for b in range(128, 160)} if n == "cp1252" else {}) for n, t in known.items()]
        self._masks = {c: sum(1 << r for r in range(len(known)) if c < "\x80" or encode[r, i] >= 0) for c, i in self.number.items()}

    def symbols(self, word: str) -> np.ndarray:
        """Numbers of the word's characters, in UTF-16 units, between those of its begin and end."""
        units = np.frombuffer(word.encode("utf-16-le", "surrogatepass"), np.uint16)
        out = np.empty(len(units) + 2, np.int64)
        out[0], out[-1], out[1:-1] = self.begin, self.end, self.symbol[units]
        return out

    def raw(self, word: str) -> set[bytes]:
        """The bytes the word may have been, under every page and code that can write it."""
        out: set[bytes] = set()
        mask = -1
        for c in set(word):
            mask &= self._masks.get(c, 0)
            if not mask:
                break
        while mask > 0:
            low = mask & -mask
            out.add(word.translate(self.to_byte[low.bit_length() - 1]).encode("latin-1"))
            mask ^= low
        for code in MANY_BYTES[1:]:
            try:
                out.add(word.encode(code))
            except UnicodeError:
                pass
        out.discard(word.encode("utf-8", "replace"))
        return out


@lru_cache(maxsize=1)
def alphabet() -> Alphabet:
    return Alphabet()


@lru_cache(maxsize=4096)
def tables_of(chars: tuple[int, ...]) -> np.ndarray:
    """The different things the pages make of these characters together: a row per table, a column per character."""
    got = alphabet().maps[:, chars]
    got = got[(got >= 0).all(1) & (got != np.array(chars)).any(1)]
    return different(got)


#: (deciphered, (character's number, -1 - byte) for what characters stand for, whether the code was UTF-8).
Reading = tuple[str, list[tuple[int, int]], bool]


@lru_cache(maxsize=50_000)
def byte_readings(word: str) -> tuple[list[Reading], float]:
    """What the word says if its characters stand for bytes of a code with several of them a character, and the log of
    how many ways there are to read it. Text in UTF-8 may have been misread twice."""
    out: dict[str, tuple] = {}
    a = alphabet()
    raws = a.raw(word)
    for raw in raws:
        pairs = [(a.number[c], -1 - b) for c, b in zip(word, raw) if c > "\x7f"] if len(raw) == len(word) else []
        for code in MANY_BYTES:
            try:
                o = raw.decode(code)
            except UnicodeError:
                continue
            utf8 = code == "utf-8"
            if o == word or not utf8 and o.isascii():
                continue
            if not _NEVER.search(o) and (o not in out or utf8 and not out[o][2]):
                out[o] = (o, pairs, utf8)
            if utf8 and not o.isascii():
                for again in a.raw(o):
                    try:
                        oo = again.decode("utf-8")
                    except UnicodeError:
                        continue
                    if oo != o and not _NEVER.search(oo):
                        out.setdefault(oo, (oo, pairs, True))
    return list(out.values()), math.log(max(1, len(raws)))


def words_of(text: str) -> set[str]:
    """The distinct words with a character beyond ASCII. Lines of ASCII only, such as embedded images, are skipped."""
    found: set[str] = set()
    if not text.isascii():
        for line in text.split("\n"):
            if not line.isascii():
                found.update(w for w in _RUNS.findall(line) if not w.isascii())
    return found


def pieces(word: str) -> list[str]:
    """Where only some of a run is garbled: its parts between undecodable signs, and within them those of characters
    that one-byte pages hold and those of others, as scripts without blanks are."""
    known, out, held = alphabet().number, [], ""
    for c in word:
        if c == "�" or held and (c in known) != (held[-1] in known):
            out.append(held)
            held = ""
        held += c if c != "�" else ""
    out.append(held)
    return [p for p in out if p and not p.isascii() and p != word]


class Model:
    """Bigrams of sound text, and per group of sources the tables and the share of enciphered words.

    ``pairs`` counts (symbol, symbol), ``singles`` the characters without numbers of their own by code, ``stands`` (group,
    character, target) where a target is a letter's number, or -1 - byte; ``garbled`` and ``seen`` the words by group.
    """

    def __init__(self, groups: set[str], pairs: dict, singles: dict, stands: dict, garbled: dict, seen: dict):
        self.groups, self.pairs, self.singles, self.stands, self.garbled, self.seen = groups, pairs, singles, stands, garbled, seen
        self._built: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "_built": {}}

    def group(self, source: str) -> str:
        return source if source in self.groups else ""

    @property
    def bigrams(self) -> np.ndarray:
        if "bigrams" not in self._built:
            a = alphabet()
            n = np.zeros((a.size, a.size))
            if self.pairs:
                at = np.array(list(self.pairs))
                n[at[:, 0], at[:, 1]] = np.fromiter(self.pairs.values(), float, len(self.pairs))
            back = (n.sum(0) + 0.02) / (n.sum() + 120.0)
            self._built["bigrams"] = np.log((n + 2 * back) / (n.sum(1, keepdims=True) + 2))
            held = np.zeros(1 << 16)
            held[list(self.singles)] = list(self.singles.values())
            blocks = held.reshape(256, 256).sum(1)
            self._built["within"] = np.where(a.symbol >= a.own, np.log((held + 0.1) / (np.repeat(blocks, 256) + 25.6)), 0.0)
        return self._built["bigrams"]

    def score(self, word: str) -> float:
        a, b = alphabet(), self.bigrams
        s = a.symbols(word)
        total = b.ravel()[s[:-1] * a.size + s[1:]].sum()
        if s[1:-1].max() >= a.own:
            total += self._built["within"][np.frombuffer(word.encode("utf-16-le", "surrogatepass"), np.uint16)].sum()
        return float(total)

    def _counts(self, group: str) -> dict[int, dict[int, float]]:
        if group not in self._built:
            got: dict[int, dict[int, float]] = defaultdict(dict)
            for (g, c, t), n in self.stands.items():
                if g == group:
                    got[c][t] = n
            self._built[group] = got
        return self._built[group]

    def emits(self, group: str, c: int, byte: bool) -> tuple[dict[int, float], float]:
        """(log probability by target, that of any other) of what a character stands for in a group."""
        key = (group, c, byte)
        if key not in self._built:
            a = alphabet()
            if "all" not in self._built:
                everywhere: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
                for (_, x, t), n in self.stands.items():
                    everywhere[x][t] += n
                self._built["all"] = everywhere
            pick = lambda d: {t: n for t, n in d.get(c, {}).items() if (t < 0) == byte}
            own, shared = pick(self._counts(group)), pick(self._built["all"])
            paged = 1.0 / float((a.bytes_ if byte else a.letters)[c])
            n_own, n_all = sum(own.values()), sum(shared.values())
            p = lambda t: (own.get(t, 0.0) + BACKED * (shared.get(t, 0.0) + PAGED * paged) / (n_all + PAGED)) / (n_own + BACKED)
            self._built[key] = ({t: math.log(p(t)) for t in shared}, math.log(p(None)))
        return self._built[key]

    def share(self, group: str) -> float:
        every = (sum(self.garbled.values()) + PRIOR * 100) / (sum(self.seen.values()) + 100)
        return min(0.9, (self.garbled.get(group, 0.0) + 200 * every) / (self.seen.get(group, 0.0) + 200))

    def line(self, group: str, c: int) -> np.ndarray:
        """Log probability of each letter for a character in a group."""
        key = (group, c, "line")
        if key not in self._built:
            known, other = self.emits(group, c, False)
            line = np.full(alphabet().own, other)
            line[list(known)] = list(known.values())
            self._built[key] = line
        return self._built[key]

    def decipher(self, word: str, group: str) -> tuple[float, str | None, list[tuple[float, list[tuple[int, int]], str]]]:
        """(log odds of being enciphered, likeliest decipherment, [(weight, what stands for what, decipherment)]).

        A decipherment is as likely as its text and what is learned of its characters, or as any table of pages."""
        a, b = alphabet(), self.bigrams
        base = self.score(word)
        found: list[tuple[float, list[tuple[int, int]], str]] = []
        readings, ways = byte_readings(word)
        for o, told, _ in readings:
            cost = 0.0
            for c, t in told:
                known, other = self.emits(group, c, True)
                cost += known.get(t, other)
            gain = self.score(o) - base + _either(cost, -ways)
            if gain > HOPELESS:
                found.append((gain, told, o))
        ids = [a.number.get(c, -1) for c in word]
        if min(ids) >= 0:
            strange = tuple(sorted({i for i in ids if not a.plain[i]}))
            tables = tables_of(strange)
            if len(tables):
                column = {c: k for k, c in enumerate(strange)}
                out = np.empty((len(tables), len(ids) + 2), np.int32)
                out[:, 0], out[:, -1] = a.begin, a.end
                cost = np.zeros(len(tables))
                for k, i in enumerate(ids):
                    if i in column:
                        out[:, k + 1] = letters = tables[:, column[i]]
                        cost += self.line(group, i)[letters]
                    else:
                        out[:, k + 1] = i
                gain = b[out[:, :-1], out[:, 1:]].sum(1) + np.logaddexp(cost, -math.log(len(tables))) - math.log(2) - base
                for k in np.flatnonzero(gain > max(gain.max() - 8, HOPELESS)):
                    found.append((float(gain[k]), [(c, int(tables[k, x])) for c, x in column.items()], "".join([a.chars[i] for i in out[k, 1:-1]])))
        if not found:
            return -math.inf, None, []
        pi = self.share(group)
        best = max(found, key=lambda f: f[0])
        weigh = [(math.exp(max(-50.0, f[0] - best[0])), f[1], f[2]) for f in found]
        total = sum(w for w, _, _ in weigh)
        odds = math.log(pi) - math.log1p(-pi) + best[0] + math.log(total)
        sound = 1 / (1 + math.exp(min(50.0, max(-50.0, odds))))
        return odds, best[2], [((1 - sound) * w / total, t, o) for w, t, o in weigh if w / total > 1e-3]

    def judge(self, word: str, group: str) -> str | None:
        """The decipherment, if the word is enciphered."""
        odds, best, found = self.decipher(word, group)
        if best is None or odds < (0 if any(o == best and utf8 for o, _, utf8 in byte_readings(word)[0]) else SURE):
            return None
        told = max(found)[1] if found else []
        one = len(told) == 1 and told[0][1] >= 0 and sum(c > "\x7f" for c in word) == 1
        return None if one and odds < SURE_ONE else best


def _either(x: float, y: float) -> float:
    """Log of the mean of two probabilities."""
    return max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)


class Expected:
    """What a task counts in one round. In the first, when nothing is known, a word that can be read as UTF-8 counts
    half as that, since hardly any other word can."""

    def __init__(self, model: Model, first: bool):
        self.model, self.first = model, first
        self.pairs, self.singles, self.stands, self.garbled, self.seen = (Counter() for _ in range(5))

    def read(self, word: str, n: float) -> None:
        a = alphabet()
        s = a.symbols(word).tolist()
        for x in zip(s, s[1:]):
            self.pairs[x] += n
        if max(s[1:-1]) >= a.own:
            for c in word:
                if ord(c) < 1 << 16 and c not in a.number:
                    self.singles[ord(c)] += n

    def add(self, word: str, source: str, n: int) -> None:
        g = self.model.group(source)
        self.seen[g] += n
        if self.first:
            found = [(told, o) for o, told, utf8 in byte_readings(word)[0] if utf8]
            found = [(0.5 / len(found), told, o) for told, o in found]
        else:
            found = self.model.decipher(word, g)[2]
        other = sum(w for w, _, _ in found)
        self.read(word, n * (1 - other))
        self.garbled[g] += n * other
        for w, told, o in found:
            if n * w > 1e-6:
                self.read(o, n * w)
                for c, t in told:
                    self.stands[g, c, t] += n * w

    def rows(self) -> list[tuple]:
        rows = [("p", "", x, y, n) for (x, y), n in self.pairs.items()] + [("s", "", c, 0, n) for c, n in self.singles.items()] + [("t", g, c, t, n) for (g, c, t), n in self.stands.items()]
        return rows + [("g", g, 0, 0, n) for g, n in self.garbled.items()] + [("n", g, 0, 0, float(n)) for g, n in self.seen.items()]


def _words(documents: DataFrame) -> DataFrame:
    """(word, source, n): in how many documents of a source each word stands, from one reading of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(words_of(x.as_py() or "")) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array(words, pa.list_(pa.string()))], names=["source", "words"])

    per = documents.select(source_name(F.col("source")).alias("source"), "text").mapInArrow(run, "source string, words array<string>")
    return per.select("source", F.explode("words").alias("word")).groupBy("word", "source").agg(F.count("*").alias("n"))


def learn(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` rounds over the words of all documents.

    What reaches the driver and the tasks is bounded by the alphabet: bigrams of symbols, characters beyond them, and
    what characters stand for, the last for each group of sources.
    """
    spark = documents.sparkSession
    # few bytes but much work a word: a number of parts of their own keeps all cores busy
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    table = cut(_words(documents).repartition(parts, "word"), "words")
    total = table.agg(F.sum("n")).first()[0] or 0
    large = table.groupBy("source").agg(F.sum("n").alias("n")).filter(F.col("n") >= OWN_TABLE * total)
    groups = {r["source"] for r in large.collect()}
    model = Model(groups, {}, {}, {}, {}, {})
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], first: bool = turn == 0) -> Iterator[pa.RecordBatch]:
            e = Expected(sent.value, first)
            for b in batches:
                for word, source, n in zip(b.column("word").to_pylist(), b.column("source").to_pylist(), b.column("n").to_pylist()):
                    e.add(word, source, n)
            rows = e.rows()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["what", "name", "x", "y", "n"])

        added = table.select("word", "source", "n").mapInArrow(count, "what string, name string, x int, y int, n double").groupBy("what", "name", "x", "y").agg(F.sum("n").alias("n"))
        got: dict[str, dict] = {k: {} for k in "pstgn"}
        for r in cut(added, "expected").toLocalIterator():
            what = r["what"]
            got[what][(r["x"], r["y"]) if what == "p" else r["x"] if what == "s" else (r["name"], r["x"], r["y"]) if what == "t" else r["name"]] = r["n"]
        model = Model(groups, got["p"], got["s"], got["t"], got["g"], got["n"])
    return model


class Restorer:
    """Applies a model to texts; what it has judged of late it remembers."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[tuple[str, str], str | None] = {}

    def word(self, word: str, group: str) -> str | None:
        """The word put right, or None if nothing of it is enciphered."""
        key = (group, word)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._judge(word, group)
        return self.known[key]

    def _judge(self, word: str, group: str) -> str | None:
        whole = self.model.judge(word, group)
        if whole is not None:
            return whole
        # a single letter says nothing without its context
        back = {p: o for p in pieces(word) if sum(c > "\x7f" for c in p) > 1 and (o := self.model.judge(p, group)) is not None}
        if not back:
            return None
        return re.sub("|".join(map(re.escape, sorted(back, key=len, reverse=True))), lambda m: back[m[0]], word)

    def text(self, text: str, source: str) -> tuple[str, int]:
        """(text put right, number of words that were)."""
        group, n = self.model.group(source), 0
        right = {w: o for w in words_of(text) if (o := self.word(w, group)) is not None}
        if not right:
            return text, 0

        def back(m: re.Match) -> str:
            nonlocal n
            n += m[0] in right
            return right.get(m[0], m[0])

        return _RUNS.sub(back, text), n


def restored(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text, words_restored, evidence, complete): the affected documents with what could be had back in place.

    ``evidence``: ``cipher`` if words were deciphered, ``mark`` if the text only holds signs for undecodable bytes or
    stray control characters, which no sound text does and nothing can restore, ``both``. Sound parts stay as they are.
    ``complete`` is false where such signs remain. Null, empty and ASCII texts are sound; equal rows give equal rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(learn(documents, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for b in batches:
            rows = []
            for doc, source, x in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                text = x.as_py() or ""
                if text.isascii():
                    continue
                right, n = restorer.text(text, source)
                mark = _MARKS.search(text) is not None
                if n or mark:
                    left = _MARKS.search(right) is not None
                    rows.append((doc, right, n, "cipher" if not left else "both" if n else "mark", not left))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "text", "words_restored", "evidence", "complete"])

    only = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return only.mapInArrow(run, "doc_id bigint, text string, words_restored bigint, evidence string, complete boolean")


def garbled(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id): the documents in whose text at least one character came from decoding with a wrong encoding, by
    whatever ``restored`` takes as evidence. Equal rows give one row."""
    return restored(documents, rounds).select("doc_id").distinct()
