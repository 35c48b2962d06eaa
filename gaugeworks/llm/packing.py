"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents become token ids with an end id appended; longer ones are cut into full pieces.  The
pieces are dealt by hash into shards of about ``SHARD_PIECES`` rows and each shard is packed by
best-fit decreasing: a segment tree over remaining capacities finds the tightest open bin in
logarithmic time per piece.  A shard wastes at most a few bins, so shards keep the number of
sequences within a fraction of a percent of the bound while no task grows with the corpus.

Defined results: null text counts as empty and becomes the end id alone; repeated rows are packed
once each; a null id is carried along; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, lean, remembered, text_batches
from .segments import BLANK, Cutter, Words, cuts, groups, texts, words

SHARD_PIECES = 50_000
#: Words whose ids a worker remembers; the table takes about 30 MB when full.
ENTRIES = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Counts of open bins by remaining capacity, with the tightest fit found in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.width
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity of at least ``size`` that an open bin has, or -1."""
        node, tree = size + self.width, self.open
        if tree[node]:
            return size
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; ``lengths`` must be in descending order, each 1..capacity."""
    tree, bins_with = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets, used = [], [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            room, chosen, used = capacity, used, used + 1
        else:
            chosen = bins_with[room].pop()
            tree.add(room, -1)
        bins.append(chosen)
        offsets.append(capacity - room)
        if room > n:
            bins_with[room - n].append(chosen)
            tree.add(room - n, 1)
    return bins, offsets


#: Fixed value: the pattern of the tokenizer's pre-tokenizer that ``BatchEncoder`` cuts texts by itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _MARK, _GLUE = 1, 2, 3, 4


def _cutter() -> Cutter:
    """Cuts where ``SPLIT`` ends a match whatever stands around.

    Apostrophes, control characters and all bytes outside ASCII stay with their neighbours, and such
    words keep their capitals, as normalisation may join what it finds there.
    """
    kinds = bytearray([_GLUE]) * 256
    for b in range(0x21, 0x7F):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kinds[ord("'")] = _GLUE
    for b in b" \t\n\r":
        kinds[b] = BLANK
    apart = {_LETTER: {_DIGIT, _MARK}, _DIGIT: {_LETTER, _DIGIT, _MARK}, _MARK: {_LETTER, _DIGIT}}
    return Cutter(bytes(kinds), cuts(apart), bytes(range(256)).lower(), _GLUE, 2)


class BatchEncoder:
    """Ids of a column of texts, exactly as the tokenizer gives them.

    For a tokenizer that normalises by NFC, white space and lower case only and splits by ``SPLIT``, words are
    cut and hashed in bulk; a table of ``ENTRIES`` words remembers their ids (two 64-bit hashes
    tell them apart), and only words that are not in it go to the tokenizer.  Texts that hold one of
    the tokenizer's added tokens, and all texts under any other tokenizer, go to it whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in told["added_tokens"]]
        self.cutter = _cutter() if _understood(told) else None
        if self.cutter:
            self.plain = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "added_tokens": []}))
            suffix = told["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(self.tokenizer.get_vocab(True).values()) + 1, bool)
            self.last[[i for w, i in told["model"]["vocab"].items() if w.endswith(suffix)]] = True
            (self.nul,) = self.whole(["\0"])[0].tolist()
        self._clear()

    def _clear(self) -> None:
        self.slot = np.zeros(4 * ENTRIES, np.int32)  # entry + 1
        self.h, self.h2 = np.zeros(ENTRIES, np.uint64), np.zeros(ENTRIES, np.uint64)
        self.at, self.n, self.entries = np.zeros(ENTRIES, np.int32), np.zeros(ENTRIES, np.int32), 0
        self.ids, self.used = np.zeros(4 * ENTRIES, np.uint32), 0

    def whole(self, texts_: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def _new(self, found: list[bytes], glued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, plain ones first, and how many each has."""
        plain, other = np.nonzero(~glued)[0].tolist(), np.nonzero(glued)[0].tolist()
        # Each plain word is one piece for the model, so each has one last id; their letters are ASCII, which NFC leaves alone.
        lines = [b" ".join([found[k] for k in plain[at : at + 100]]).lower().decode() for at in range(0, len(plain), 100)]
        got = [np.asarray(e.ids, np.uint32) for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        n = np.diff(np.nonzero(self.last[ids])[0] + 1, prepend=0)
        assert len(n) == len(plain)
        # The others may be several pieces each; a NUL, which is one id, stands between them.
        lines = [b" \0 ".join([*(found[k] for k in other[at : at + 50]), b""]).decode() for at in range(0, len(other), 50)]
        more = np.concatenate([ids[:0], *self.whole(lines)])
        ends = np.nonzero(more == self.nul)[0]
        if len(ends) != len(other):  # a word has a NUL of its own
            alone = self.whole([found[k].decode() for k in other])
            more, m = np.concatenate([ids[:0], *alone]), np.array([len(x) for x in alone])
        else:
            more, m = np.delete(more, ends), np.diff(ends, prepend=-1) - 1
        return np.concatenate([ids, more]), np.append(n, m).astype(np.int64)

    def _entries(self, w: Words, places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each word, and the words that have none."""
        entry, missing = self.slot[places[0]] - 1, None
        for place in (places[1], None):
            at = slice(None) if missing is None else missing
            wrong = np.nonzero((entry[at] < 0) | (self.h[entry[at]] != w.h[at]) | (self.h2[entry[at]] != w.h2[at]))[0]
            missing = wrong if missing is None else missing[wrong]
            if place is not None:
                entry[missing] = self.slot[place[missing]] - 1
        return entry, missing

    def group(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``data``, which start at ``starts``, and how many each text has."""
        w = words(data, starts, self.cutter)
        places = tuple((x >> np.uint64(64 - len(self.slot).bit_length() + 1)).astype(np.int64) for x in (w.h, w.h2))
        entry, missing = self._entries(w, places)
        if len(missing):
            _, first, of = np.unique(w.h[missing] ^ (w.h2[missing] << np.uint64(1)), return_index=True, return_inverse=True)
            first = missing[first]
            found = [data[a:b].tobytes() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            glued = np.array([_GLUE in f.translate(self.cutter.classes) for f in found])
            ids, n = self._new(found, glued)
            if self.entries + len(found) > ENTRIES or self.used + len(ids) > len(self.ids):
                if not self.entries:  # one text has more distinct words than the table
                    own = self.whole([data[a:b].tobytes().decode() for a, b in zip(starts, np.append(starts[1:], len(data)), strict=True)])
                    return np.concatenate(own), np.array([len(x) for x in own])
                self._clear()
                return self.group(data, starts)
            own = np.empty(len(found), np.int64)
            own[np.argsort(glued, kind="stable")] = self.entries + np.arange(len(found))
            n, starts_ = n[own - self.entries], (np.cumsum(n) - n)[own - self.entries]
            self.h[own], self.h2[own], self.n[own] = w.h[first], w.h2[first], n
            self.at[own] = self.used + starts_
            self.ids[self.used : self.used + len(ids)] = ids
            taken = self.slot[places[0][first]] > 0
            self.slot[places[0][first[~taken]]] = own[~taken] + 1
            self.slot[places[1][first[taken]]] = own[taken] + 1
            self.entries, self.used = self.entries + len(found), self.used + len(ids)
            entry[missing] = own[of]
        n = self.n[entry].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[entry] - (ends - n), n) + np.arange(int(n.sum()))]
        upto = np.append(0, ends)[np.searchsorted(w.start, np.append(starts, len(data)))]
        return ids, np.diff(upto)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of ``column``; null texts have none."""
        if self.cutter is None:
            for k in range(0, len(column), 64):
                yield from self.whole([t or "" for t in column.slice(k, 64).to_pylist()])
            return
        held = np.zeros(len(column), bool)
        for token in self.added:
            held |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        data, offsets = texts(column)
        for lo, hi in groups(offsets):
            part = data[offsets[lo] : offsets[hi]]
            ids, n = self.group(part, offsets[lo:hi] - offsets[lo])
            for k, own in enumerate(np.split(ids, np.cumsum(n)[:-1]), lo):
                yield self.whole([column[k].as_py()])[0] if held[k] else own


def _understood(told: dict) -> bool:
    """Is the tokenizer of the kind whose texts ``_cutter`` may cut?"""
    kinds = [(n.get("type"), n.get("pattern", {}).get("Regex"), n.get("content")) for n in (told["normalizer"] or {}).get("normalizers", [])]
    before = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [(p.get("type"), p.get("pattern", {}).get("Regex"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in before]
    model = told["model"]
    return (
        kinds == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and split == [("Split", SPLIT, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and (model["type"], model["dropout"], model["unk_token"], model["continuing_subword_prefix"]) == ("BPE", None, None, None)
        and bool(model["end_of_word_suffix"])
        and not told["post_processor"]
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
    )


def _encoder(path: str) -> BatchEncoder:
    return remembered(("ids", path), lambda: BatchEncoder(path))


def token_counts(rows: DataFrame, tokenizer_path: str, text_col: str = "text", count_col: str = "tokens") -> DataFrame:
    """``rows`` with ``text_col`` replaced by its number of ids, without the end id, as ``count_col``."""
    at, names = rows.columns.index(text_col), [count_col if c == text_col else c for c in rows.columns]
    kind = T.StructType([T.StructField(count_col, T.LongType()) if f.name == text_col else f for f in rows.schema.fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            n = pa.array([len(ids) for ids in encode(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([n if k == at else batch.column(k) for k in range(len(names))], names=names)

    return text_batches(rows).mapInArrow(lean(count), kind)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every document (columns of ``PIECES``)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, own in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(own, end_id).astype("<u4")
                out += [(doc_id, at // max_tokens, at, min(max_tokens, len(ids) - at), zlib.crc32(ids[at : at + max_tokens])) for at in range(0, len(ids), max_tokens)]
            columns = zip(*out, strict=True) if out else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(pieces), PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless from 0 in each sequence."""
    pieces = checkpointed(pieces)
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit_decreasing(table["length"].to_pylist(), capacity)
        base = table["shard"][0].as_py() << 32
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(np.asarray(bins, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))

    # The row's place in the checkpoint, which does not change, parts rows that are alike.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(shard, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise and pack every document: one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, max_tokens, end_id), max_tokens)
