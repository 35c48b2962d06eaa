"""Maximal runs of repeated words in whole texts, by suffix trees and branching tandem repeats.

Words are the runs of bytes other than ASCII white space.  A run is a stretch of words with smallest
period q, at least ``max(min_length, 2 q)`` long, that no neighbouring word extends.

1. The suffix trees of a group of texts are built together: words are numbered within their text, so
   no two texts share a prefix.  Prefix doubling ranks all suffixes and re-sorts only those that are
   not alone yet; the ranks of each round also give the longest common prefix of two suffixes, and
   intervals of suffixes with a common prefix are the inner nodes.
2. At every node of depth d all leaves but those of the largest child are listed (each leaf is listed
   in at most log2(n) nodes).  A listed leaf i and the leaf i + d or i - d of the same node make a
   tandem repeat of period d; it branches if the words after its two halves differ.
3. A branching repeat is the last one of its run: rotated to the left as long as the words allow, by
   the ranks again, it gives the whole run.  Runs with equal ends are merged to the smallest period.

Words are told apart by two 64-bit hashes, all else is exact.  Time is O(n log n) array steps for n
words of a text and memory O(n) numbers for each doubling round of a group of about 1 MB, or of one
longer text.  Defined results: null, empty and blank texts have no words and no run and collapse to
the empty text; repeated rows have equal runs; null ids are carried along; an empty table gives no
rows; other columns are not read.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches
from .segments import BLANK, Cutter, cuts, groups, texts, words

LISTED = 1 << 20  # leaves listed at a time
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Forest:
    """Suffix trees of word sequences: suffixes in order, ranks by doubling round, and inner nodes."""

    symbols: np.ndarray  # dense numbers of (sequence, word)
    begin: np.ndarray  # for each place the first place of its sequence
    end: np.ndarray  # for each place the place after its sequence
    order: np.ndarray
    levels: list[np.ndarray]  # levels[k]: equal numbers for places whose next 2**k words are equal

    @classmethod
    def build(cls, sequence: np.ndarray, word: np.ndarray) -> Forest:
        """From the sequence number of each place, ascending, and its word's number."""
        n = len(word)
        key = sequence.astype(np.int64) * (int(word.max()) + 1) + word
        order = np.argsort(key, kind="stable").astype(np.int32)
        fresh = _fresh(key[order])
        first = np.nonzero(_fresh(sequence))[0]
        size = np.diff(np.append(first, n))
        begin, end = np.repeat(first, size).astype(np.int32), np.repeat(first + size, size).astype(np.int32)
        rank = np.empty(n, np.int32)
        slots = np.arange(n, dtype=np.int32)
        levels = []
        while True:
            group = np.maximum.accumulate(np.where(fresh, slots, 0))  # the first slot of each slot's group
            rank[order[slots]] = group
            levels.append(rank.copy())
            slots = slots[~(fresh & np.append(fresh[1:], True))]
            if not len(slots):
                return cls(levels[0], begin, end, order, levels)
            place = order[slots]
            after = place.astype(np.int64) + (1 << len(levels) - 1)
            second = np.where(after < end[place], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[place].astype(np.int64) * (n + 1) + second
            by = np.argsort(key, kind="stable")
            order[slots], fresh = place[by], _fresh(key[by])

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j``, which differ, have in common."""
        out = np.zeros(len(i), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            inside = np.nonzero((a < self.end[i]) & (b < self.end[j]))[0]
            out[inside[self.levels[k][a[inside]] == self.levels[k][b[inside]]]] += 1 << k
        return out

    def common_suffix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the stretches before ``i`` and ``j``, places of one sequence, have in common."""
        out = np.zeros(len(i), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            inside = np.nonzero((a >= self.begin[i]) & (b >= self.begin[i]))[0]
            out[inside[self.levels[k][a[inside]] == self.levels[k][b[inside]]]] += 1 << k
        return out

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Children (node's depth, its first slot, its last slot + 1, child's range) of all inner nodes, as rows of arrays.

        Returned are depth, first, last of each child's node and, as one array of two rows, the child's slots;
        the largest child of each node is left out.
        """
        n = len(self.order)
        depth = np.zeros(n + 1, np.int32)  # common prefix of the suffixes before and after each border
        near = np.nonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]])[0]
        depth[near + 1] = self.common_prefix(self.order[near], self.order[near + 1])
        at = near + 1
        first, last = _smaller(depth, at, -1), _smaller(depth, at, 1)
        by = np.argsort(first * np.int64(n + 1) + last, kind="stable")
        at, first, last = at[by], first[by], last[by]
        fresh = _fresh(first) | _fresh(last)
        node = np.cumsum(fresh) - 1
        own = np.nonzero(fresh)[0]
        until = np.where(np.append(fresh[1:], True), last, np.append(at[1:], 0)) if len(at) else last
        child = np.concatenate([first[own], at]), np.concatenate([at[own], until])
        node = np.concatenate([node[own], node])
        size = child[1] - child[0]
        by = np.lexsort((size, node))
        by = by[~np.append(node[by][1:] != node[by][:-1], True)] if len(by) else by
        where = own[node[by]]
        return depth[at[where]], first[where], last[where], np.stack([child[0][by], child[1][by]])

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of all branching tandem repeats."""
        depth, first, last, child = self.nodes()
        rank, n, found = self.levels[-1], len(self.order), [np.zeros((2, 0), np.int64)]
        upto = np.append(0, np.cumsum(child[1] - child[0]))
        for lo in range(0, int(upto[-1]), LISTED):
            leaf = np.arange(lo, min(lo + LISTED, int(upto[-1])))
            which = np.searchsorted(upto, leaf, side="right") - 1
            i = self.order[child[0][which] + leaf - upto[which]].astype(np.int64)
            d, a, b = depth[which].astype(np.int64), first[which], last[which]
            for start, other in ((i, i + d), (i - d, i - d)):
                there = np.nonzero((other >= 0) & (other < n))[0]
                r = rank[other[there]]
                there = there[(r >= a[there]) & (r < b[there])]
                s, p = start[there], d[there]
                after = s + 2 * p
                ends = after >= self.end[s]
                ends |= self.symbols[s + p] != self.symbols[np.minimum(after, n - 1)]
                found.append(np.stack([s[ends], p[ends]]))
        pairs = np.concatenate(found, axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        kept = _fresh(pairs[0]) | _fresh(pairs[1])
        return pairs[0][kept], pairs[1][kept]

    def runs(self, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and period of all maximal runs, by start and period."""
        at, period = self.branching()
        back = self.common_suffix(at, at + period).astype(np.int64)
        start, length = at - back, back + 2 * period
        kept = length >= min_length
        start, length, period = start[kept], length[kept], period[kept]
        by = np.lexsort((period, length, start))
        start, length, period = start[by], length[by], period[by]
        smallest = _fresh(start) | _fresh(length)
        start, length, period = start[smallest], length[smallest], period[smallest]
        by = np.lexsort((period, start))
        return start[by], length[by], period[by]


def _fresh(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _smaller(depth: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each border ``at`` the nearest one before (step -1) or after it (1) with a smaller depth, by pointer jumping."""
    jump = np.arange(len(depth)) + step
    jump[0 if step < 0 else -1] = 0 if step < 0 else len(depth) - 1
    moving = at[depth[jump[at]] >= depth[at]]
    while len(moving):
        jump[moving] = jump[jump[moving]]
        moving = moving[depth[jump[moving]] >= depth[moving]]
    return jump[at]


def word_numbers(h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Dense numbers of words from their two hashes."""
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    if (h2[first][of] != h2).any():
        _, of = np.unique(np.stack([h, h2], 1), axis=0, return_inverse=True)
    return of.reshape(-1)


def _cutter() -> Cutter:
    kinds = bytearray([1]) * 256
    for b in b" \t\n\v\f\r":
        kinds[b] = BLANK
    return Cutter(bytes(kinds), cuts({}), bytes(range(256)), hashes=2)


def _collapsed(data: np.ndarray, start: np.ndarray, end: np.ndarray, sequence: np.ndarray, rows: int) -> pa.Array:
    """The given words of each sequence, joined by one space."""
    size = end - start + 1
    upto = np.cumsum(size)
    source = np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)
    out = data[np.minimum(source, len(data) - 1)]
    out[upto - 1] = 0x20
    last = upto[np.append(_fresh(sequence)[1:], True)] - 1 if len(upto) else upto
    per = np.bincount(sequence, size, rows).astype(np.int64)
    offsets = np.append(0, np.cumsum(np.maximum(per - 1, 0))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.delete(out, last))])


def find(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs`` (doc_id, text).

    ``runs`` holds (start, length, period) in words, by start, then period.  ``collapsed`` is the text without
    the words that a run holds after its first period, joined by one space.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def part(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        rows = len(ids)
        w = words(data, offsets[:-1][np.diff(offsets) > 0], _cutter())
        sequence = np.searchsorted(offsets, w.start, side="right") - 1
        upto = np.searchsorted(w.start, offsets)
        runs, kept, of = np.zeros((3, 0), np.int64), np.ones(len(w.start), bool), np.zeros(0, np.int64)
        if len(w.start):
            forest = Forest.build(sequence, word_numbers(w.h, w.h2))
            start, length, period = forest.runs(min_length)
            covered = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(covered, start + period, 1)
            np.add.at(covered, start + length, -1)
            kept = np.cumsum(covered)[:-1] == 0
            of = sequence[start]
            runs = np.stack([start - upto[of], length, period])
        each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), each)
        collapsed = _collapsed(data, w.start[kept], w.end[kept], sequence[kept], rows)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(upto), pa.int64()), lists, collapsed], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in groups(offsets):
                yield part(batch.column(0).slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    shape = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text_batches(rows).mapInArrow(lean(run), shape)


def repeated_tail(text: Column, at: Column, copies: Column) -> Column:
    """``text`` with its words from number ``at`` modulo n on replaced by the first of them over and over.

    n is the number of words and the period 1 + floor((n - a) / ``copies``) for a = ``at`` % n; a text
    without words is empty.  This plants known runs, to see whether they are found.
    """
    held = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), lambda w: _tail(w, at, copies))  # an array of one, so that its words are cut once
    return F.coalesce(held[0], F.lit(""))


def _tail(w: Column, at: Column, copies: Column) -> Column:
    n = F.size(w)
    a = (at % n).cast("int")
    p = (F.floor((n - a) / copies) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    planted = F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a))
    return F.when(n > 0, F.array_join(planted, " "))
