"""SentencePiece encoding by vectorised merge rounds, and decoding.

A text is cut into words wherever no piece of the model holds the two bytes around the place, so no
merge can cross a cut and equal words have equal ids; a table of ``ENTRIES`` words (told apart by two
64-bit hashes) remembers them.  Words that are not in it are encoded together: their symbols lie in
flat arrays, and each round finds the best (least) pair rank of every word by one segmented minimum,
merges its occurrences from the left in all words at once, compacts the arrays and looks up only the
pairs that changed, until no word has a pair left.

The library merges one pair at a time, the best and among equals the leftmost.  All occurrences of
a word's best rank may go at once if no pair with the merged piece can rank as well or better.  Where
the model has such a pair (a tenth of its pieces), only the leftmost occurrence is merged in a round;
a word with more than ``SWEEP`` of them is swept from the left by itself while that rank stays the best.

Models: byte-pair with byte fallback, identity normalisation, no user-defined pieces; others raise.
Defined results: null and empty texts are the begin and end ids alone; repeated rows are encoded
alike; an empty table gives no rows; other columns are not read.  Nothing is shuffled; memory is that
of one Arrow batch and, where larger, a small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remembered, text_batches
from .segments import groups, texts

ENTRIES, SWEEP, LONG, SLICE = 1 << 18, 64, 256, 1 << 18
SPACE, META = 0x20, "\u2581"
NONE = np.int32(np.iinfo(np.int32).max)
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 2: None, 5: 4}[tag & 7]
            size = number() if size is None else size
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, ranks and pairs of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            told = list(_fields(f.read()))
        part = lambda n: dict(_fields(next((v for k, v in told if k == n), b"")))
        trainer, normal = part(2), part(3)
        rows = [dict(_fields(v)) for k, v in told if k == 1]
        kinds = [r.get(3, NORMAL) for r in rows]
        # Field numbers of the public schema: model_type 3, treat_whitespace_as_suffix 24, byte_fallback 35; charsmap 2, dummy prefix 3, extra white space 4, escape 5.
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a byte-pair model with byte fallback, identity normalisation and no user-defined pieces is needed")
        self.prefix = bool(normal.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.bytes = np.zeros(256, np.int32)
        for i, (r, kind) in enumerate(zip(rows, kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(r[1][1:-1], 16)] = i
        texts_ = {i: rows[i][1].decode() for i, kind in enumerate(kinds) if kind == NORMAL}
        score = {i: float(np.frombuffer(rows[i].get(2, bytes(4)), "<f4")[0]) for i in texts_}
        self._pairs(texts_, score, len(rows))

    def _pairs(self, texts_: dict[int, str], score: dict[int, float], size: int) -> None:
        """Symbols are piece ids, and ``size`` plus the code point for characters that are no piece."""
        at = {t: i for i, t in texts_.items()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbol = lambda t: at.get(t, size + ord(t) if len(t) == 1 else -1)
        self.size, self.wide = size, np.int64(size + 0x110000)
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(size)
        inside, found = np.zeros(1 << 16, bool), {}
        rank, unsafe = np.full(size, NONE, np.int32), np.zeros(size, bool)
        for i, t in texts_.items():
            rank[i] = order[score[i]]
            raw = np.frombuffer(t.replace(META, " ").encode(), np.uint8).astype(np.int64)
            inside[raw[:-1] << 8 | raw[1:]] = True
            if len(t) == 1:
                self.char[ord(t)] = i
            for k in range(1, len(t)):
                pair = symbol(t[:k]), symbol(t[k:])
                if min(pair) >= 0:
                    found[pair] = i
        for (x, y), i in found.items():
            for part in (x, y):
                if part < size and rank[i] <= rank[part] and len(texts_[part]) > 1:
                    unsafe[part] = True
        self.char[SPACE] = self.char[ord(META)]
        keys = np.array([x * int(self.wide) + y for x, y in found], np.int64)
        by = np.argsort(keys)
        self.keys, self.merged = np.append(keys[by], np.iinfo(np.int64).max), np.append(np.array(list(found.values()), np.int32)[by], 0)
        self.ranks, self.unsafe = rank, unsafe
        # A place is cut unless some piece holds both bytes or the second continues a character.
        second = np.arange(1 << 16) & 0xC0
        self.apart = ~inside & (second != 0x80)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged piece of each pair and its rank, ``NONE`` where there is none."""
        key = left * self.wide + right
        at = np.searchsorted(self.keys, key)
        merged = self.merged[at]
        return merged, np.where(self.keys[at] == key, self.ranks[merged], NONE)


def merge_rounds(model: Model, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left of words that begin at ``starts`` of ``symbols``, none empty, and how many each has."""
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
    sym, done = symbols.astype(np.int64), []
    piece, rank = np.zeros(len(sym), np.int32), np.full(len(sym), NONE)
    near = np.nonzero(word[:-1] == word[1:])[0]
    piece[near], rank[near] = model.pairs(sym[near], sym[near + 1])
    while len(sym):
        first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(sym)))
        if (best == NONE).any():
            over = np.repeat(best == NONE, size)
            done.append((word[over], sym[over]))
            word, sym, piece, rank = word[~over], sym[~over], piece[~over], rank[~over]
            size, best = size[best < NONE], best[best < NONE]
            if not len(sym):
                break
        hit = np.nonzero(rank == np.repeat(best, size))[0]
        own = word[hit]
        fresh = np.append(True, own[1:] != own[:-1])  # the leftmost of each word
        at = np.nonzero(fresh)[0]
        many = np.diff(np.append(at, len(hit)))
        risky = model.unsafe[piece[hit[at]]]
        swept = risky & (many > SWEEP)
        # Of occurrences that overlap in a row, every second one from the left.
        chain = np.maximum.accumulate(np.where(np.append(True, hit[1:] != hit[:-1] + 1), np.arange(len(hit)), 0))
        chosen = (np.arange(len(hit)) - chain) % 2 == 0
        chosen &= fresh | ~np.repeat(risky, many)
        left = hit[chosen]
        kept = np.ones(len(sym), bool)
        if swept.any():
            left = hit[chosen & ~np.repeat(swept, many)]
        sym[left] = piece[left]
        kept[left + 1] = False
        changed = np.zeros(len(sym), bool)
        changed[left] = True
        for k in np.nonzero(swept)[0].tolist():
            a = int(np.searchsorted(word, own[at[k]]))
            b = int(np.searchsorted(word, own[at[k]], side="right"))
            _sweep(model, sym, kept, changed, a, b, hit[at[k] : at[k] + many[k]].tolist(), int(rank[hit[at[k]]]))
        word, sym, piece, rank, changed = word[kept], sym[kept], piece[kept], rank[kept], changed[kept]
        stale = changed.copy()
        stale[:-1] |= changed[1:]
        stale = np.nonzero(stale)[0]
        rank[stale] = NONE
        near = stale[stale < len(sym) - 1]
        near = near[word[near] == word[near + 1]]
        piece[near], rank[near] = model.pairs(sym[near], sym[near + 1])
    words, out = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
    by = np.argsort(words, kind="stable")
    return out[by], np.bincount(words, minlength=len(starts))


def _sweep(model: Model, sym: np.ndarray, kept: np.ndarray, changed: np.ndarray, a: int, b: int, places: list[int], rank: int) -> None:
    """Merge pairs of ``rank`` in the word [a, b) from the left until none is left or a better one appears."""
    after, before = list(range(1, b - a + 1)), list(range(-1, b - a - 1))  # linked by place

    @lru_cache(maxsize=4096)
    def pair(x: int, y: int) -> tuple[int, int]:
        merged, r = model.pairs(np.array([x]), np.array([y]))
        return int(merged[0]), int(r[0])

    waiting = [p - a for p in reversed(places)]  # the leftmost is last
    gone = set()
    while waiting:
        i = waiting.pop()
        if i in gone or after[i] >= b - a:
            continue
        j = after[i]
        merged, r = pair(int(sym[a + i]), int(sym[a + j]))
        if r != rank:
            continue
        sym[a + i], kept[a + j], changed[a + i] = merged, False, True
        gone.add(j)
        after[i] = after[j]
        if after[j] < b - a:
            before[after[j]] = i
        ahead = pair(int(sym[a + i]), int(sym[a + after[i]]))[1] if after[i] < b - a else int(NONE)
        behind = pair(int(sym[a + before[i]]), int(sym[a + i]))[1] if before[i] >= 0 else int(NONE)
        if min(ahead, behind) < rank:
            return
        if ahead == rank:
            waiting.append(i)
        if behind == rank:
            waiting.append(before[i])


@lru_cache(maxsize=1)
def _codes() -> list[tuple[np.ndarray, np.ndarray]]:
    """For two hashes: a code for each byte, and the powers of an odd base."""
    out = []
    for seed in (11, 12):
        codes = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([b]), seed=seed) for b in range(256)), "<u8").copy()
        power = np.full(LONG, np.uint64(xxhash.xxh64_intdigest(b"base", seed=seed) | 5))
        power[0] = 1
        out.append((codes, np.cumprod(power)))
    return out


def _hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word; words begin at ``starts``, which begin with 0, and fill ``data``."""
    ends = np.append(starts[1:], len(data))
    out = np.empty((2, len(starts)), np.uint64)
    lo = 0
    while lo < len(starts):  # a slice at a time, to stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE)))
        a, b = int(starts[lo]), int(ends[hi - 1])
        at = starts[lo:hi] - a
        place = np.arange(b - a) - np.repeat(at, ends[lo:hi] - starts[lo:hi])
        np.minimum(place, LONG - 1, out=place)
        for k, (codes, power) in enumerate(_codes()):
            out[k, lo:hi] = np.add.reduceat(codes[data[a:b]] * power[place], at)
        lo = hi
    for k in np.nonzero(ends - starts > LONG)[0].tolist():  # long words: polynomials of long runs may collide
        raw = data[starts[k] : ends[k]].tobytes()
        out[0, k], out[1, k] = xxhash.xxh64_intdigest(raw, seed=11), xxhash.xxh64_intdigest(raw, seed=12)
    return out[0], out[1]


class PieceEncoder:
    """Ids of whole batches of texts, as the library's ``encode`` gives them."""

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        self._clear()

    def _clear(self) -> None:
        self.h = np.full(1, np.iinfo(np.uint64).max, np.uint64)
        self.h2, self.at, self.n = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by merge rounds, and how many each has; the words fill ``data``."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        sym, n = merge_rounds(self.model, self.model.char[points], lead[starts])
        other = np.nonzero(sym >= self.model.size)[0]
        if not len(other):
            return sym.astype(np.int32), n
        # Characters that are no piece become the ids of their bytes.
        raw = [chr(c).encode() for c in (sym[other] - self.model.size).tolist()]
        width = np.ones(len(sym), np.int64)
        width[other] = [len(r) for r in raw]
        out = np.repeat(sym, width).astype(np.int32)
        first = (np.cumsum(width) - width)[other]
        spread = np.repeat(first, width[other]) + np.arange(int(width[other].sum())) - np.repeat(np.cumsum(width[other]) - width[other], width[other])
        out[spread] = self.model.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        upto = np.append(0, np.cumsum(width))
        ends = np.cumsum(n)
        return out, upto[ends] - upto[ends - n]

    def group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``offsets`` of ``data``, and how many each has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = self.model.apart[data[:-1].astype(np.uint16) << 8 | data[1:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.nonzero(cut)[0]
        h, h2 = _hashes(data, starts)
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        if (h2[first][of] != h2).any():  # two words share the first hash
            _, first, of = np.unique(np.stack([h, h2], 1), axis=0, return_index=True, return_inverse=True)
            of = of.reshape(-1)
        at = np.minimum(np.searchsorted(self.h, h[first]), len(self.h) - 1)
        missing = np.nonzero((self.h[at] != h[first]) | (self.h2[at] != h2[first]))[0]
        where, n = self.at[at], self.n[at]
        pool = self.ids
        if len(missing):
            begin = starts[first[missing]]
            size = np.append(starts[1:], len(data))[first[missing]] - begin
            upto = np.cumsum(size) - size
            found, m = self.words(data[np.repeat(begin - upto, size) + np.arange(int(size.sum()))], upto)
            where, n = where.copy(), n.copy()
            where[missing], n[missing] = len(pool) + np.cumsum(m) - m, m
            pool = np.concatenate([pool, found])
            self._remember(h[first[missing]], h2[first[missing]], where[missing], m, pool)
        where, n = where[of], n[of]
        ends = np.cumsum(n)
        ids = pool[np.repeat(where - (ends - n), n) + np.arange(int(ends[-1]))]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(starts, offsets)])

    def _remember(self, h: np.ndarray, h2: np.ndarray, at: np.ndarray, n: np.ndarray, pool: np.ndarray) -> None:
        if len(self.h) + len(h) > ENTRIES or len(pool) > 8 * ENTRIES:
            self._clear()
            return
        new = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
        new = new[self.h[np.searchsorted(self.h, h[new])] != h[new]]
        place = np.searchsorted(self.h, h[new])
        self.h, self.h2, self.at, self.n = (np.insert(old, place, x[new]) for old, x in ((self.h, h), (self.h2, h2), (self.at, at), (self.n, n)))
        self.ids = pool

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids with begin and end ids, offsets of the rows' ids) for ranges of rows; null texts are empty."""
        column = pc.fill_null(column, "")
        if pc.any(pc.match_substring(column, META)).as_py():
            column = pc.replace_substring(column, META, " ")
        if self.model.prefix:
            column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
        data, offsets = texts(column)
        for lo, hi in groups(offsets):
            ids, n = self.group(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.cumsum(n + 2)
            out = np.empty(int(ends[-1]), np.uint32)
            out[ends - n - 2], out[ends - 1] = self.model.begin, self.model.end
            inner = np.ones(len(out), bool)
            inner[ends - n - 2], inner[ends - 1] = False, False
            out[inner] = ids
            yield lo, out, np.append(0, ends)


def _encoder(path: str) -> PieceEncoder:
    return remembered(("pieces", path), lambda: PieceEncoder(path))


def _decoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of little-endian unsigned 32-bit ids."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


def encode(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of ``docs`` (doc_id, text), with begin and end ids.

    ``ids`` are little-endian unsigned 32-bit integers in a binary column; ``decoded`` adds what the
    library's ``decode`` makes of them as a column of that name.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        decoder = _decoder(model_path) if decoded else None
        for batch in batches:
            for lo, ids, offsets in encoder(batch.column(1)):
                rows = len(offsets) - 1
                columns = [batch.column(0).slice(lo, rows), pa.array(np.diff(offsets).astype(np.int64)), _binary(ids, offsets)]
                names = ["doc_id", "n_tokens", "ids"]
                if decoder:
                    lists = [ids[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    columns.append(pa.array(decoder.decode(lists, num_threads=1), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text_batches(rows).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) with ``ids`` as ``encode`` gives them; null ids are an empty text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model_path)
        for batch in batches:
            told = (decoder.decode(np.frombuffer(b.as_py() or b"", "<u4").tolist()) for b in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], names=["doc_id", "text"])

    return text_batches(rows).select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")
