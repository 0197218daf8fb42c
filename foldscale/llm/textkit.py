"""Vectorised text kernels: code points, words and their 64-bit hashes.

A substring's hash is a polynomial in a fixed odd base modulo 2**64 over mixed code points, read off prefix
sums, so that all words of many texts are hashed without a Python step for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from foldscale.llm.runtime import SLICE_CHARS

SPACE, ALNUM, DIGIT, UPPER, LOWER, LETTER = 1, 2, 4, 8, 16, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_state: dict = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its lower case, its classes, its mixed value."""
    if "tables" not in _state:
        lower, kind = np.arange(65536, dtype=np.uint32), np.zeros(65536, np.uint8)
        for i in range(65536):
            c = chr(i)
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
            kind[i] = (
                SPACE * c.isspace()
                | ALNUM * c.isalnum()
                | DIGIT * c.isdigit()
                | UPPER * c.isupper()
                | LOWER * c.islower()
                | LETTER * c.isalpha()
            )
        kind[0] |= SPACE  # ends a text inside joined ones
        _state["tables"] = lower, kind, mixed(np.arange(1, 65537, dtype=np.uint64))
    return _state["tables"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the next call."""
    if len(_state.get("powers", ((), ()))[0]) < n:
        size = max(n, SLICE_CHARS + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _state["powers"] = tuple(both)
    return _state["powers"][0][:n], _state["powers"][1][:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def segments(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts that end at white space, where there is any."""
    at, space = 0, re.compile(r"\s")
    while len(text) - at > size:
        found = space.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def joined(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Runs ``texts[a:b]`` of about ``most`` characters."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        if held and held + len(t) > most:
            yield a, b, texts[a:b]
            a, held = b, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts), texts[a:]


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def substring_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[s:e]``; equal for equal substrings wherever they stand."""
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def lowered(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, classes, mixed values; beyond the basic plane: as they are, letters."""
    lower, kind, mix = tables()
    if len(cp) and cp.max() > 65535:
        high = cp > 65535
        base = np.where(high, 0, cp)
        low = np.where(high, cp, lower[base])
        value = np.where(high, mixed(cp.astype(np.uint64) + np.uint64(1)), mix[np.where(high, 0, low)])
        return low, np.where(high, ALNUM | LETTER, kind[base]).astype(np.uint8), value
    low = lower[cp]
    return low, kind[cp], mix[low]


def classes_of(cp: np.ndarray) -> np.ndarray:
    """Classes of code points as they stand."""
    kind = tables()[1]
    if len(cp) and cp.max() > 65535:
        return np.where(cp > 65535, ALNUM | LETTER, kind[np.where(cp > 65535, 0, cp)]).astype(np.uint8)
    return kind[cp]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased, white-space separated words of all texts, and each text's first word (n + 1)."""
    counts = np.zeros(len(texts) + 1, np.int64)
    found = []
    for a, b, run in joined(texts):
        if b - a == 1 and len(run[0]) > SLICE_CHARS:
            for part in segments(run[0]):
                h, _ = _words([part])
                counts[a + 1] += len(h)
                found.append(h)
            continue
        h, n = _words(run)
        counts[a + 1 : b + 1] = n
        found.append(h)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(counts)


def _words(run: list[str]) -> tuple[np.ndarray, np.ndarray]:
    _, kind, value = lowered(points("\0".join(run)))
    starts, ends = spans_of((kind & SPACE) == 0)
    limits = np.cumsum([len(t) + 1 for t in run])
    n = np.diff(np.searchsorted(starts, limits), prepend=0)
    return substring_hashes(value, starts, ends), n


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` consecutive words (fewer words: one of them all)."""
    h, first = words(texts)
    factor = mixed(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    out = []
    if len(h) >= width:
        n = len(h) - width + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += h[k : k + n] * factor[k]
        rolled = mixed(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mixed((h[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
