"""Language identification with bit-sliced Bloom filters over character n-grams.

Every language owns one bit slice of a slot array of masks of as many 64-bit words as the languages need.  Looking an n-gram up in its k
slots and ANDing the masks returns all languages whose filter holds it; a document counts these
bits by language, corrects each count for that slice's false-positive rate, and the highest
corrected share decides.

Training reads a bounded, stratified sample: at most ``per_language`` documents of each language, the first in
the order of a hash, found by counting languages, letting about twice as many through by a threshold on the hash and
ranking these, so no task reads a whole language.  An n-gram counts for a language from its ``min_count``-th occurrence in
the sample.  Rates, filters and masks are made by joins and aggregations; the driver gets the languages and the masks, whose size
depends on the number of languages only (4 MB for 64); more than ``MASK_BYTES`` of them is an error.  Prediction reads every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language learned from more documents, then by name; repeated rows get equal answers; with no
learnable rows everything is ``und``; null ids and extra columns are carried or ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, remembered, text_batches

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (2, 3, 4)
SLOTS, HASHES, CACHE_WORDS, BROADCAST_ROWS = 1 << 19, 2, 200_000, 100_000
MASK_BYTES = 1 << 30  # of the masks, which every executor gets: 16,384 languages
PREDICTIONS = "doc_id long, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Runs of letters; signs such as those of fractions and circled numbers, which ``WORD`` takes in, are no letters."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(part) for w in found for letters, part in itertools.groupby(w, str.isalpha) if letters]


def ngrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in ORDERS for i in range(len(padded) - n + 1)]


def slots(gram: str) -> list[int]:
    """Positions of an n-gram by double hashing; stable between processes."""
    import xxhash

    h = xxhash.xxh64_intdigest(gram.encode())
    return [((h & 0xFFFFFFFF) + i * (h >> 32 | 1)) % SLOTS for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    masks: bytes  # SLOTS times ``words`` little-endian uint64, one bit a language

    @property
    def words(self) -> int:
        return max(1, -(-len(self.languages) // 64))

    def array(self) -> np.ndarray:
        """The masks, one after the other; ``words`` elements a slot."""
        return np.frombuffer(self.masks, "<u8")


def build(counts: dict[str, dict[str, int]], documents: dict[str, int], share: float = 0.25) -> Filters:
    """Filters with each n-gram under the languages that use it at ``share`` of its highest rate or more."""
    languages = tuple(sorted(counts, key=lambda x: (-documents.get(x, 0), x)))
    total = {x: sum(counts[x].values()) or 1 for x in languages}
    best: dict[str, float] = {}
    for x in languages:
        for g, n in counts[x].items():
            best[g] = max(best.get(g, 0.0), n / total[x])
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), "<u8")
    for bit, x in enumerate(languages):
        for g, n in counts[x].items():
            if n / total[x] >= share * best[g]:
                masks[slots(g), bit // 64] |= np.uint64(1 << bit % 64)
    return Filters(languages, masks.tobytes())


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows (doc_id, lang, text) of each language."""
    counts = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("of")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    mixed = F.xxhash64("doc_id", F.lit(5))
    passing = rows.join(counts, "lang").where((mixed / F.lit(2.0**64) + 0.5) * F.col("of") <= 2 * per_language)
    ranked = passing.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(mixed, "doc_id", "text")))
    return ranked.where(F.col("r") <= per_language).select("lang", "text")


def train(docs: DataFrame, usable: Column | None = None, per_language: int = 1500, min_count: int = 3, share: float = 0.25) -> Filters:
    """Learn from at most ``per_language`` documents of each language; n-grams as ``build`` chooses them."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    rows = (rows.where(usable) if usable is not None else rows).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        held: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = found.setdefault(lang, Counter())
                held[lang] += 1
                own.update(words_of(text))
        for lang, words in found.items():
            own: Counter = Counter()
            for word, n in words.items():
                for g in ngrams(word):
                    own[g] += n
            g, n = zip(*own.items(), strict=True) if own else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(g) + 1), pa.string()), pa.array([*g, ""], pa.string()), pa.array([*n, held[lang]], pa.int64())], names=["lang", "gram", "n"])

    grams = checkpointed(sample(rows, per_language).mapInArrow(lean(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    kept = grams.where((F.col("gram") != "") & (F.col("n") >= min_count))
    total = kept.groupBy("lang").agg(F.sum("n").alias("total"))
    documents = grams.where("gram = ''").select("lang", F.col("n").alias("documents"))
    n = documents.count()
    if SLOTS * -(-n // 64) * 8 > MASK_BYTES:
        raise ValueError(f"lang has {n} values, more than masks of {MASK_BYTES} bytes hold")
    # One row a language.
    found = [r["lang"] for r in documents.join(total, "lang").orderBy(F.desc("documents"), "lang").collect()]
    if not found:
        return build({}, {})
    bits = docs.sparkSession.createDataFrame(list(enumerate(found)), "bit int, lang string").join(total, "lang")
    rated = kept.join(bits, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([slots(g) for g in batch.column(0).to_pylist()], np.int64).reshape(-1, HASHES)
            bit = batch.column(1).to_numpy().astype(np.uint64)
            mask = (np.uint64(1) << (bit % np.uint64(64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.T.ravel()), pa.array(np.tile((bit // np.uint64(64)).astype(np.int64), HASHES)), pa.array(np.tile(mask, HASHES))], names=["slot", "word", "mask"])

    chosen = rated.join(best, "gram").where(F.col("rate") >= share * F.col("best")).select("gram", "bit").mapInArrow(place, "slot long, word long, mask long")
    told = chosen.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((SLOTS, -(-len(found) // 64)), np.int64)
    masks[told["slot"].to_numpy(), told["word"].to_numpy()] = told["mask"].to_numpy()
    return Filters(tuple(found), masks.astype("<i8").tobytes())


class Predictor:
    def __init__(self, filters: Filters) -> None:
        self.languages, self.masks = filters.languages, filters.array().reshape(SLOTS, filters.words)
        self.bits = [np.arange(min(64, len(self.languages) - at), dtype=np.uint64) for at in range(0, len(self.languages), 64)]
        fill = np.array([((self.masks[:, w] >> bit) & np.uint64(1)).mean() for w, bits in enumerate(self.bits) for bit in bits])
        self.false = np.minimum(fill**HASHES, 0.999)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.grams: dict[str, list[int]] = {}
        self.rows = np.zeros((1024, len(self.languages) + 1), np.int64)

    def _mask(self, gram: str) -> list[int]:
        mask = self.grams[gram] = np.bitwise_and.reduce(self.masks[slots(gram)]).tolist()
        return mask

    def _learn(self, words: set[str]) -> None:
        """Count, for each new word, the languages that its n-grams' masks name."""
        parts = [ngrams(w) for w in words]
        lengths = np.array([len(p) for p in parts])
        held = self.grams
        masks = np.array([m for p in parts for g in p for m in (held[g] if g in held else self._mask(g))], np.uint64).reshape(-1, self.masks.shape[1])
        named = np.concatenate([(masks[:, w, None] >> bits) & np.uint64(1) for w, bits in enumerate(self.bits)], axis=1)
        counts = np.add.reduceat(named.astype(np.int64), np.cumsum(lengths) - lengths)
        k = len(self.known)
        while k + len(parts) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k : k + len(parts), :-1] = counts
        self.rows[k : k + len(parts), -1] = lengths
        self.known.update(zip(words, range(k, k + len(parts)), strict=True))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.languages:
            return "und", 0.0
        new = {w for w in words if w not in self.known}
        if new:
            if len(self.known) + len(new) > CACHE_WORDS // self.masks.shape[1]:
                self._clear()
                new = set(words)
            self._learn(new)
        hits = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        share = np.clip((hits[:-1] / hits[-1] - self.false) / (1 - self.false), 0.0, 1.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """One row per document with the columns of ``PREDICTIONS``; score is the corrected share of n-grams."""

    # Broadcast: masks of a fixed number of slots.
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = remembered(("langid", shared.value), lambda: Predictor(shared.value))
        for batch in batches:
            out = [predictor(t.as_py()) for t in batch.column(1)]
            x, s = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.string()), pa.array(s, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(predicted), PREDICTIONS)
