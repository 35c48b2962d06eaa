"""Cutting whole batches of texts into hashed words with array operations.

Texts come as one byte buffer with the start of each text.  A byte has a class, and two neighbouring
bytes are cut apart by their classes; a run between cuts is a word unless its class is BLANK.  Words
get hashes sum(code[byte] * base**place) modulo 2**64 from running sums, so no Python object is made
for a word.  The buffer is read in windows of ``WINDOW`` bytes that end between words; longer runs
than ``LONG`` bytes are hashed by xxhash instead, as polynomials of very long runs may collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

WINDOW, LONG, GROUP_BYTES = 1 << 17, 256, 1 << 20
BLANK = 0
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)


@lru_cache(maxsize=1)
def _powers() -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """For each hash: a code for each byte, and the powers of the base and of its inverse."""
    out = []
    for k, base in enumerate(_BASES):
        codes = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([b]), seed=k + 1) for b in range(256)), "<u8").copy()
        power = [np.full(WINDOW, np.uint64(x)) for x in (base, pow(base, -1, 1 << 64))]
        for p in power:
            p[0] = 1
            np.cumprod(p, out=p)
        out.append((codes, *power))
    return tuple(out)


@dataclass(frozen=True)
class Cutter:
    """Classes of bytes, and whether neighbours of two classes are cut apart."""

    classes: bytes  # for each byte; BLANK is 0
    cuts: bytes  # for each class before times 16 plus the class after: 1 for a cut, as always beside BLANK
    folded: bytes  # for each byte the one that counts
    raw: int = -1  # words with a byte of this class are hashed as they are, not folded
    hashes: int = 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    h2: np.ndarray | None


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its texts start; null texts are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``GROUP_BYTES`` together, or one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, starts: np.ndarray, cutter: Cutter) -> Words:
    """The words of ``data``; texts start at ``starts``, and a word never crosses one."""
    parts, at = [], 0
    while at < len(data):
        end = _window_end(data, starts, at, cutter)
        parts.append(_window(data, starts, at, end, cutter))
        at = end
    if not parts:
        none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(none, none, no, no if cutter.hashes > 1 else None)
    join = lambda i: np.concatenate([p[i] for p in parts])
    return Words(join(0), join(1), join(2), join(3) if cutter.hashes > 1 else None)


def _window_end(data: np.ndarray, starts: np.ndarray, at: int, cutter: Cutter) -> int:
    """The first place after about WINDOW bytes that is the end or follows a blank or starts a text."""
    end = at + WINDOW - LONG
    if end >= len(data):
        return len(data)
    following = np.searchsorted(starts, end)
    last = int(starts[following]) if following < len(starts) else len(data)
    while end < last:
        blank = np.nonzero(_mapped(data[end - 1 : min(end + 4096, last)], cutter.classes) == BLANK)[0]
        if len(blank):
            return int(end + blank[0])
        end += 4096
    return last


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def cuts(apart: dict[int, set[int]]) -> bytes:
    """A table of cuts from, for each class but BLANK, the classes from which it is cut apart when they follow."""
    return bytes(int(before == BLANK or after == BLANK or after in apart.get(before, ())) for before in range(16) for after in range(16))


def _window(data: np.ndarray, starts: np.ndarray, lo: int, hi: int, cutter: Cutter) -> tuple:
    part = data[lo:hi]
    kind = _mapped(part, cutter.classes)
    cut = np.ones(len(part), np.uint8)
    cut[1:] = _mapped(kind[:-1] * np.uint8(16) + kind[1:], cutter.cuts)
    inside = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo
    cut[inside] = 1
    at = np.nonzero(cut)[0]
    until = np.append(at[1:], len(part))
    kept = np.nonzero(kind[at])[0]
    start, end = at[kept], until[kept]
    folded = _mapped(part, cutter.folded)
    if cutter.raw >= 0 and len(start):
        marked = np.zeros(len(at), bool)
        marked[np.searchsorted(at, np.nonzero(kind == cutter.raw)[0], side="right") - 1] = True
        changed = np.nonzero(folded != part)[0]
        changed = changed[marked[np.searchsorted(at, changed, side="right") - 1]]
        folded = folded.copy()
        folded[changed] = part[changed]
    long = np.nonzero(end - start > LONG)[0]
    hashes = []
    for i in range(cutter.hashes):
        codes, power, inverse = _powers()[i]
        if len(part) <= WINDOW:
            summed = np.empty(len(part) + 1, np.uint64)
            summed[0] = 0
            by_place = np.take(codes, folded, mode="clip")
            by_place *= power[: len(part)]
            np.cumsum(by_place, out=summed[1:])
            h = (summed[end] - summed[start]) * inverse[start]
        else:  # one run is longer than a window
            h = np.zeros(len(start), np.uint64)
            for k in np.nonzero(end - start <= LONG)[0]:
                h[k] = (codes[folded[start[k] : end[k]]] * power[: end[k] - start[k]]).sum(dtype=np.uint64)
        for k in long:
            h[k] = xxhash.xxh64_intdigest(folded[start[k] : end[k]].tobytes(), seed=i)
        hashes.append(h)
    return (start + lo, end + lo, *hashes)
