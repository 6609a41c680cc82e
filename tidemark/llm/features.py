"""Hashed character and word n-grams of whole texts, as numpy arrays.

Texts are hashed a slice at a time, so that the arrays stay small; each slice carries what the next one
needs (the characters of n-grams that begin in it, and its open word), so the n-grams do not depend on SLICE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint32(0x9E3779B1)
_Q = np.uint32(0x85EBCA77)
#: Characters of a text that are hashed at a time.
SLICE = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _Q
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def _grams(c: np.ndarray, n: int, bits: int) -> np.ndarray:
    if len(c) < n:
        return np.zeros(0, dtype=np.int32)
    h = np.full(len(c) - n + 1, n, dtype=np.uint32)
    for i in range(n):
        h = (h + c[i : len(c) - n + 1 + i]) * _P
        h ^= h >> np.uint32(13)
    return _spread(h, bits)


def char_grams(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of these sizes, slice by slice: those of a slice begin in it."""
    most = max(sizes)
    for at in range(0, len(text), SLICE):
        c = code_points(text[at : at + SLICE + most - 1])
        own = min(SLICE, len(text) - at)
        yield np.concatenate([_grams(c[: own + n - 1], n, bits) for n in sizes])


_POWERS = np.cumprod(np.full(64, _P, dtype=np.uint32), dtype=np.uint32)


def word_grams(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all words between white space, and of all pairs of neighbours; a word beside itself has one bucket."""
    def buckets(h, before):
        pair = np.concatenate([before, h])
        pair = pair[1:] ^ pair[:-1]
        return np.concatenate([_spread(h ^ np.uint32(0x5BD1E995), bits), _spread(pair + np.uint32(77), bits)])

    none = np.zeros(0, dtype=np.uint32)
    before, part, place = none, none, 0  # hash of the last whole word, hash so far of the open one and its characters
    for start in range(0, len(text), SLICE):
        c = code_points(text[start : start + SLICE])
        inside = (c > 32) & (c != 160)
        at = np.flatnonzero(inside)
        done = none
        if place and (not len(at) or at[0]):
            done, part, place = part, none, 0
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            length = np.diff(np.append(first, len(at)))
            where = np.arange(len(at)) - np.repeat(first, length)
            where[: length[0]] += place
            h = np.add.reduceat(c[at] * _POWERS[where & 63], first, dtype=np.uint32)
            if place:
                h[:1] += part
            place = (place if len(first) == 1 else 0) + int(length[-1])
            if inside[-1]:
                part, h = h[-1:], h[:-1]
            else:
                part, place = none, 0
            done = np.concatenate([done, h])
        if len(done):
            yield buckets(done, before)
            before = done[-1:]
    if place:
        yield buckets(part, before)
