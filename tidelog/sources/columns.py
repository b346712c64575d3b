"""Column encodings of the binary op log: run lengths, differences, differences of differences, and framing.

Fixed formats. A run-length token is a zigzag varint: n > 0 repeats the next value n times, n < 0 is followed by -n
values. A boolean column holds run lengths, beginning with false. Second differences are bits, first bit highest, in
classes of growing width, behind the first value and the number of bits used in the last byte.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, groupby

from tidelog.functions.versions import Cursor as Numbers
from tidelog.functions.versions import put_signed, put_unsigned

#: Rows a column may have; a few bytes could otherwise stand for any number of them.
MOST_ROWS = 1 << 20
#: Fixed values: (bits, what is subtracted) of the classes of second differences, after 1, 2, 3 and 4 leading ones.
CLASSES = [(7, 63), (9, 255), (12, 2047), (21, 1048575)]


class Cursor(Numbers):
    """Bounded reading of bytes, texts and columns."""

    def bytes(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise ValueError("the bytes end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.bytes(1)[0]

    def block(self) -> bytes:
        return self.bytes(self.unsigned())

    def text(self) -> str:
        return self.block().decode()

    def left(self) -> int:
        return len(self.data) - self.at

    def leb(self) -> int:
        """A signed number as two's complement in groups of seven bits (not zigzag)."""
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                n -= (b & 64) >> 6 << shift
                if not -(1 << 63) <= n < 1 << 63:
                    raise ValueError("a number of more than 64 bits")
                return n

    def runs(self, value: Callable[[], int], count: int | None = None) -> list[int]:
        """``count`` values, or all there are."""
        out: list[int] = []
        most = MOST_ROWS if count is None else count
        while self.left() if count is None else len(out) < count:
            n = self.signed()
            if n == 0 or abs(n) > most - len(out):
                raise ValueError("a run of no or too many rows")
            out += [value()] * n if n > 0 else [value() for _ in range(-n)]
        return out

    def flags(self, count: int) -> list[bool]:
        out: list[bool] = []
        now = False
        while len(out) < count:
            n = self.unsigned()
            if n > count - len(out):
                raise ValueError("too many flags")
            out += [now] * n
            now = not now
        return out

    def second_differences(self, count: int) -> list[int]:
        some = self.byte()
        if some > 1 or bool(some) != (count > 0):
            raise ValueError("a column of another length")
        first = self.signed() if some else 0
        self.byte()
        if not count:
            return []
        bits, begin = 0, self.at

        def take(n: int) -> int:
            nonlocal bits
            v = 0
            for _ in range(n):
                at = begin + bits // 8
                if at >= len(self.data):
                    raise ValueError("the bits end too early")
                v = v << 1 | self.data[at] >> 7 - bits % 8 & 1
                bits += 1
            return v

        out, step = [first], 0
        while len(out) < count:
            ones = 0
            while ones < 5 and take(1):
                ones += 1
            if ones == 5:
                v = take(64)
                step += v - (v >> 63 << 64)
            elif ones:
                width, less = CLASSES[ones - 1]
                step += take(width) - less
            out.append(out[-1] + step)
        self.at = begin + (bits + 7) // 8
        return out

    def columns(self, want: int) -> list["Cursor"]:
        """The columns of a framed table."""
        if self.unsigned() != 1 or self.unsigned() != want:
            raise ValueError("another number of columns")
        out = [Cursor(self.block()) for _ in range(want)]
        self.done()
        return out

    def differences(self) -> list[int]:
        return list(accumulate(self.runs(self.signed)))


def unsigned(out: bytearray, n: int) -> None:
    put_unsigned(out, n)


def signed(out: bytearray, n: int) -> None:
    put_signed(out, n)


def byte(out: bytearray, n: int) -> None:
    out.append(n)


def leb(out: bytearray, n: int) -> None:
    while True:
        b = n & 127
        n >>= 7
        if n == (-1 if b & 64 else 0):
            out.append(b)
            return
        out.append(b | 128)


def block(out: bytearray, data: bytes) -> None:
    put_unsigned(out, len(data))
    out += data


def runs(values: list[int], put: Callable[[bytearray, int], None]) -> bytes:
    out, single = bytearray(), []

    def flush() -> None:
        if single:
            put_signed(out, -len(single))
            for v in single:
                put(out, v)
            single.clear()

    for v, same in groupby(values):
        n = sum(1 for _ in same)
        if n == 1:
            single.append(v)
        else:
            flush()
            put_signed(out, n)
            put(out, v)
    flush()
    return bytes(out)


def differences(values: list[int]) -> bytes:
    return runs([b - a for a, b in zip([0, *values], values)], put_signed)


def flags(values: list[bool]) -> bytes:
    out, now = bytearray(), False
    for v, same in groupby(values):
        if v != now:
            put_unsigned(out, 0)
        put_unsigned(out, sum(1 for _ in same))
        now = not v
    return bytes(out)


def second_differences(values: list[int]) -> bytes:
    out = bytearray([bool(values)])
    if not values:
        out.append(0)
        return bytes(out)
    put_signed(out, values[0])
    bits: list[str] = []
    step = 0
    for a, b in zip(values, values[1:]):
        d = b - a - step
        step = b - a
        if not d:
            bits.append("0")
            continue
        for k, (width, less) in enumerate(CLASSES):
            if -less <= d < (1 << width) - less:
                bits.append("1" * (k + 1) + "0" + format(d + less, f"0{width}b"))
                break
        else:
            bits.append("11111" + format(d % (1 << 64), "064b"))
    stream = "".join(bits)
    out.append((len(stream) - 1) % 8 + 1 if stream else 0)
    stream += "0" * (-len(stream) % 8)
    out += int(stream, 2).to_bytes(len(stream) // 8, "big") if stream else b""
    return bytes(out)


def framed(columns: list[bytes]) -> bytes:
    out = bytearray([1])
    put_unsigned(out, len(columns))
    for c in columns:
        block(out, c)
    return bytes(out)
