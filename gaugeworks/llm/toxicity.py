"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence has probability sigmoid(prior + sum of the weights of its distinct words, each that of
the word and of its beginnings); a document's
score is the noisy-or of its sentences and of a leak that takes up label noise:
1 - (1 - leak) * prod(1 - p).  Weights are fitted from document labels alone by full-batch Adam on
that likelihood, over words that enough documents use between neighbours not seen before, so
copies of one text teach no more than one of them, and whose share of toxic documents is far
from the base rate.  Training uses a bounded sample of labelled rows: the first ``max_documents`` in the order of a hash,
as far as their whole texts have ``max_chars`` together.  Scoring reads every whole text; spans are places in the text as it is.

Defined results: null or empty texts have no sentences and score the leak; repeated rows get equal
scores; null ids are scored and never trained on; labels with several values for one id count as
toxic if any is; without labelled rows of both kinds, the model has no words; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, release, remembered, text_batches

CACHE_WORDS = 200_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SCORES = "doc_id long, score double, predicted int, n_sentences int, n_toxic int, worst_start int, worst_end int, worst_score double"


def traits(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, so that unseen endings are known too."""
    return [word + " ", *(word[:n] for n in range(4, min(8, len(word)) + 1))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = -10.0
    leak: float = 0.02

    def key(self) -> int:
        return hash((frozenset(self.weights.items()), self.prior, self.leak))

    def words(self) -> "WordScores":
        return WordScores(self.weights)


class WordScores(dict):
    """Summed weights by word, worked out once for each word."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        z = self[word] = sum(self.weights.get(t, 0.0) for t in traits(word))
        return z


def sentence_words(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.findall(text) if (w := WORD.findall(s.lower()))]


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_documents: int = 6000, max_chars: int = 60_000_000, min_documents: int = 5, steps: int = 120) -> Model:
    """Fit on at most ``max_documents`` labelled documents of ``max_chars`` together, chosen by a hash of their ids."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = (known.where(usable) if usable is not None else known).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(max_documents)
    # Broadcast: max_documents rows at most.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    # A running sum over the chosen rows only; repeated ids bring all their rows.
    upto = Window.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id", "n", "h").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"))
    last = sizes.withColumn("upto", F.sum("n").over(upto)).agg(F.max("upto")).first()[0] or 0
    if last > max_chars:
        within = sizes.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= max_chars).select("doc_id", "h").distinct()
        rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(within), ["doc_id", "h"], "left_semi")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(y, "\n".join(sorted({" ".join(s) for s in sentence_words(t)}))) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            y, bag = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(bag, pa.string())], names=["toxic", "bag"])

    found = text_batches(rows).select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(bags), "toxic int, bag string").distinct().toArrow()
    model = fit(sorted(zip(found["bag"].to_pylist(), found["toxic"].to_pylist(), strict=True)), min_documents, steps=steps)
    release()
    return model


def _indexed(bags: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The words, and for each token its word, document and sentence, numbered from 0."""
    ids: dict[str, int] = {}
    word, lengths, sentences = array("i"), [], []
    for bag in bags:
        lines = bag.split("\n") if bag else []
        sentences.append(len(lines))
        for line in lines:
            words = line.split()
            lengths.append(len(words))
            word.extend([ids.setdefault(w, len(ids)) for w in words])
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), sentences)[sentence] if lengths else np.zeros(0, np.int32)
    return list(ids), np.frombuffer(word, np.int32) if word else np.zeros(0, np.int32), doc, sentence


def _fresh(word: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Positions of tokens whose word stands between these neighbours for the first time."""
    same = sentence[1:] == sentence[:-1]
    context = np.zeros(len(word), np.uint64)
    context[1:][same] = word[:-1][same].astype(np.uint64) + np.uint64(1)
    context *= np.uint64(0x9E3779B97F4A7C15)
    context += word.astype(np.uint64)
    context *= np.uint64(0xBF58476D1CE4E5B9)
    context[:-1][same] += word[1:][same].astype(np.uint64) + np.uint64(1)
    part, found = (context >> np.uint64(61)).astype(np.uint8), []
    for k in range(8):  # in parts, so that sorting takes little memory
        at = np.nonzero(part == k)[0].astype(np.int32)
        found.append(at[np.unique(context[at], return_index=True)[1]])
    return np.concatenate(found)


class _Whole:
    """The words themselves as traits, without an array of long strings."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, i: int) -> str:
        return self.names[i] + " "


def _kinds(names: list[str]) -> Iterator[tuple]:
    """For each kind of trait, its values ('' for none) and the number of each word's; together as ``traits`` has them."""
    yield _Whole(names), np.arange(len(names))
    head, length = np.array([w[:8] for w in names], "U8"), np.array([len(w) for w in names])
    for n in range(4, 9):
        yield np.unique(np.where(length >= n, head.astype(f"U{n}"), ""), return_inverse=True)


def fit(bags: list[tuple[str, int]], min_documents: int = 5, min_deviations: float = 5.0, steps: int = 120, decay: float = 0.05) -> Model:
    """Full-batch Adam on the noisy-or likelihood; bags hold the words of a sentence in each line."""
    toxic = np.array([y for _, y in bags], float)
    if not len(bags) or toxic.min() == toxic.max():
        return Model()
    names, word, doc, sentence = _indexed([bag for bag, _ in bags])
    if not len(word):
        return Model()
    fresh = _fresh(word, sentence)
    pairs = np.unique(doc[fresh].astype(np.int64) * len(names) + word[fresh])
    pair_doc, pair_word = pairs // len(names), pairs % len(names)
    base, chosen = toxic.mean(), []
    once = np.unique(sentence.astype(np.int64) * len(names) + word)
    at_sentence, at_word, found = (once // len(names)).astype(np.int32), (once % len(names)).astype(np.int32), []
    of_sentence = doc[np.unique(sentence, return_index=True)[1]]
    del once, word, doc, sentence, fresh, pairs
    for kinds, at in _kinds(names):
        seen = np.unique(pair_doc * len(kinds) + at[pair_word])
        n, k = np.bincount(seen % len(kinds), minlength=len(kinds)), np.bincount(seen % len(kinds), toxic[seen // len(kinds)], len(kinds))
        told = np.nonzero((n >= min_documents) & (np.abs(k - n * base) >= min_deviations * np.sqrt(n * base * (1 - base))))[0]
        told = told[[kinds[i] != "" for i in told]] if len(told) else told
        number = np.full(len(kinds), -1, np.int32)
        number[told] = len(chosen) + np.arange(len(told))
        chosen += [str(kinds[i]) for i in told]
        feature = number[at[at_word]]
        found.append(np.stack([at_sentence[feature >= 0], feature[feature >= 0]]))
    held = np.concatenate(found, axis=1)
    if not held.shape[1]:
        return Model()
    held = held[:, np.argsort(held[0], kind="stable")]
    kept, at, of = np.unique(held[0], return_index=True, return_inverse=True)
    feature, owner = held[1], of_sentence[kept]
    prior, leak = Model.prior, Model.leak
    w, m, v = np.zeros(len(chosen)), np.zeros(len(chosen)), np.zeros(len(chosen))
    for step in range(1, steps + 1):
        now = prior + 8 * max(0.0, 1 - step / (0.7 * steps))  # from a prior under which evidence is felt at once
        p = 1 / (1 + np.exp(-(now + np.add.reduceat(w[feature], at))))
        p = np.minimum(p, 1 - 1e-9)
        clear = (1 - leak) * np.exp(np.bincount(owner, np.log1p(-p), len(toxic)))
        pull = np.where(toxic > 0, clear / np.maximum(1 - clear, 1e-9), -1.0)  # d log-likelihood / d(-log clear)
        g = np.bincount(feature, (p * pull[owner])[of], len(chosen)) - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w = np.minimum(w, 18.0)
    return Model({k: float(x) for k, x in zip(chosen, w, strict=True) if abs(x) >= 0.5}, prior, leak)


def score_text(text: str | None, model: Model, words_of: WordScores) -> tuple[float, int, int, int | None, int | None, float | None]:
    """Score, sentences, toxic sentences, and span and probability of the worst sentence.

    Sentences with no known word share the prior's tiny probability.
    """
    z_of, prior, clear, n, toxic, worst = words_of.__getitem__, model.prior, math.log1p(-model.leak), 0, 0, (None, None, None)
    quiet = math.log1p(-1 / (1 + math.exp(-prior)))
    for s in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(s.group().lower()))
        if not words:
            continue
        n += 1
        z = sum(map(z_of, words))
        if not z:
            clear += quiet
            continue
        p = 1 / (1 + math.exp(-max(-60.0, prior + z)))
        clear += math.log1p(-min(p, 1 - 1e-12))
        toxic += p >= 0.5
        if worst[2] is None or p > worst[2]:
            worst = (s.start(), s.end(), p)
    return (1 - math.exp(clear), n, toxic, *worst)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document with the columns of ``SCORES``; predicted is score >= 0.5."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        names = [c.split()[0] for c in SCORES.split(", ")]
        words_of = remembered(("toxicity", model.key()), model.words)
        for batch in batches:
            out = [(i, r[0], int(r[0] >= 0.5), *r[1:]) for i, r in zip(batch.column(0).to_pylist(), (score_text(t.as_py(), model, words_of) for t in batch.column(1)), strict=True)]
            columns = zip(*out, strict=True) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(scored), SCORES)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under 1/2."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = remembered(("toxicity", model.key()), model.words)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([score_text(t.as_py(), model, words_of)[0] < 0.5 for t in texts], pa.bool_()))

    return text_batches(docs).mapInArrow(lean(clean), docs.schema)
