"""Fractional indexes: byte strings that order siblings and always leave room between two of them.

Fixed value: each ends in the terminator 0x80, which by itself is the first index. Shown as upper-case hex.

An index without its terminator is a path of digits in base 256. The index between two is found on one way down, along
the digits its bounds share. A bound counts only while the way still touches it: one whose path ends, and one that the
next digit leaves behind, is dropped, and then any digit on the right side of the other bound will do. The way ends as
soon as it can, in the middle of two bounds or right beside a single one.
"""

from __future__ import annotations

END, LEAST, MOST = 0x80, 0, 0xFF


def between(lower: bytes | None, upper: bytes | None) -> bytes:
    """An index between two, either of which may be missing; ValueError if none fits."""
    bounds = {-1: lower, 1: upper}  # by the side on which they lie
    bounds = {side: b for side, b in bounds.items() if b is not None}
    path = bytearray()
    while bounds:
        i = len(path)
        digit = {side: b[i] for side, b in bounds.items()}
        if len(bounds) == 2:
            ended = [side for side, b in bounds.items() if i == len(b) - 1]
            if digit[-1] > digit[1] or len(ended) == 2 or ended == [1] and digit[-1] == END:
                raise ValueError("no index fits between")
            if not ended and digit[1] - digit[-1] > 1:
                return bytes([*path, (digit[-1] + digit[1]) // 2, END])
            path.append(digit[-ended[0]] if ended else digit[-1])
            if ended or digit[-1] < digit[1]:
                del bounds[ended[0] if ended else 1]
            continue
        ((side, x),) = digit.items()
        if (END - x) * side < 0:  # the terminator itself lies on the right side
            break
        if x != (MOST, LEAST)[side > 0]:
            path.append(x - side)
            break
        path.append(x)
    return bytes([*path, END])


def evenly(lower: bytes | None, upper: bytes | None, n: int) -> list[bytes]:
    """``n`` indexes in order between two: the middle one, then both halves alike."""
    if not n:
        return []
    middle = between(lower, upper)
    return [*evenly(lower, middle, n // 2), middle, *evenly(middle, upper, n - n // 2 - 1)] if n > 1 else [middle]
