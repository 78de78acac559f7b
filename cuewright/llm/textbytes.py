"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts are joined with a separator byte, words are runs of bytes of a class, and a
word's hash comes from differences of a running polynomial sum, so that no Python
object is made per word. Work goes in pieces of about ``PIECE`` bytes (a longer
text is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64. Those of a piece are
    kept; more, for a word longer than a piece, are made for the call alone."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INVERSE):
        a = np.full(max(n, PIECE + 2), base, dtype=np.uint64)
        a[0] = 1
        made.append(np.cumprod(a, dtype=np.uint64))
    if n <= PIECE + 2:
        _powers[:] = made
    return made[0], made[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all 64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(texts: Sequence[str | bytes | None], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` characters (bytes, of bytes)."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, (str, bytes)) else 0
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


class Joined:
    """The bytes of some texts, each followed by a newline. A null text is empty."""

    def __init__(self, texts: Sequence[str | bytes | None]):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        self.starts = np.concatenate(([0], ends[:-1]))
        self.ends = ends - 1
        self.n = len(raw)

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of bytes whose class (bool[256]) is true."""
        m = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        m[1:-1] = member[self.bytes]
        step = np.diff(m)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return starts, ends, self.owner(starts)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right") if len(at) else np.zeros(0, np.int64)

    def count(self, member: np.ndarray) -> np.ndarray:
        """Bytes of a class in each text."""
        c = np.concatenate(([0], np.cumsum(member[self.bytes], dtype=np.int64)))
        return c[self.ends] - c[self.starts]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for sorted, disjoint ranges."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        at = int(starts[i])
        part = data[at : int(ends[j - 1])]
        up, down = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        lo, hi = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64)
        i = j
    return mixed(out)


def first_of(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key stands first, in order."""
    codes, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first


def byte_class(*wanted: int | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for w in wanted:
        out[list(w) if isinstance(w, range) else w] = True
    return out


#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased.
LETTER_DIGIT = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
#: Bytes of the words [^\x20\x09-\x0D]+.
NOT_BLANK = ~byte_class(0x20, range(0x09, 0x0E))
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes that start a character.
CHARACTER = ~byte_class(range(0x80, 0xC0))
