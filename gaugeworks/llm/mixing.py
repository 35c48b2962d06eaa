"""Mixing sources to target weights: temperature, budgets and block permutations.

Source i with token share p_i gets weight p_i^a / sum p^a.  The exponent a in [0, 1] is bisected to
the flattest mixture that keeps to ``max_repeats`` passes over any source, or to a target entropy.
Budgets scale the weights so that the source repeated least is read exactly once: nothing is left
out.  Each source is then read in passes; a pass is a permutation of blocks of about ``BLOCK_DOCS``
documents, permuted inside too, and the last pass stops at the budget.

Tokens are ids of a tokenizer where its path is given, else words.  Per-source totals are collected (one row a source).  Running totals are taken over blocks in two
levels, so no task holds a whole source.

Defined results: a null source is the source ''; null or empty texts have no tokens and are read in
every whole pass; repeated rows are read once each; sources without tokens are read once; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .packing import token_counts

BLOCK_DOCS, BLOCKS_TOGETHER = 256, 1024


@dataclass(frozen=True)
class Share:
    tokens: int
    weight: float
    budget: int
    blocks: int


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    scale = sum(raised.values())
    return {s: x / scale for s, x in raised.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def repeats(tokens: dict[str, int], w: dict[str, float]) -> dict[str, float]:
    """Passes over each source when the one repeated least is read once."""
    rate = {s: x / tokens[s] for s, x in w.items()}
    least = min(rate.values(), default=1.0)
    return {s: x / least for s, x in rate.items()}


def bisect_exponent(tokens: dict[str, int], max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The smallest exponent in [0, 1] that keeps to the limit; entropy falls and repeats fall as it grows."""

    def fits(a: float) -> bool:
        w = weights(tokens, a)
        return (target_entropy is None or entropy(w) <= target_entropy) and (max_repeats is None or max(repeats(tokens, w).values(), default=1.0) <= max_repeats)

    lo, hi = 0.0, 1.0
    if not any(tokens.values()) or fits(lo):
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def plan(docs: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None) -> dict[str, Share]:
    """Weight, token budget and number of blocks of each source of ``docs`` (source, tokens)."""
    rows = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    tokens = {r["source"]: r["tokens"] for r in rows}
    w = weights(tokens, bisect_exponent(tokens, max_repeats, target_entropy)) if any(tokens.values()) else {}
    times = repeats(tokens, w)
    return {r["source"]: Share(r["tokens"], w.get(r["source"], 0.0), round(times.get(r["source"], 1.0) * r["tokens"]), max(1, -(-r["n"] // BLOCK_DOCS))) for r in rows}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with source_key, tokens and doc_key, which tells rows apart by id, source and text."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumn("source_key", source).withColumn("tokens", words(F.col("text"))).withColumn("doc_key", F.xxhash64("doc_id", source, "text"))


def draw(docs: DataFrame, shares: dict[str, Share], seed: int = 17) -> DataFrame:
    """(doc_key, doc_id, source, pass, token_start, tokens): every reading of ``docs`` (doc_key, doc_id, source, tokens).

    token_start is the place in the source's stream, gapless from 0.
    """
    spark = docs.sparkSession
    rows = [(s, x.tokens, x.weight, x.budget, x.blocks, max(1, -(-x.budget // x.tokens)) if x.tokens else 1) for s, x in shares.items()]
    of_source = spark.createDataFrame(rows, "source string, total long, weight double, budget long, blocks long, passes long")
    mixed = lambda *c: F.xxhash64(*c, F.lit(seed))
    # Broadcast: one row a source.
    dealt = docs.join(F.broadcast(of_source), "source").withColumn("block", F.pmod(mixed("doc_key"), "blocks"))
    per_block = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("held"), F.first("total").alias("total"), F.first("budget").alias("budget"), F.first("blocks").alias("blocks"), F.first("passes").alias("passes"))
    order = per_block.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))).withColumn("at", mixed("source", "block", "pass"))
    together = F.ceil(F.col("blocks") / BLOCKS_TOGETHER)
    order = order.withColumn("part", F.floor((F.col("at") / F.lit(2.0**64) + 0.5) * together))
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = order.groupBy("source", "pass", "part").agg(F.sum("held").alias("held"))
    parts = parts.select("source", "pass", "part", before(Window.partitionBy("source", "pass").orderBy("part")).alias("part_start"))
    order = order.withColumn("in_part", before(Window.partitionBy("source", "pass", "part").orderBy("at", "block"))).join(parts, ["source", "pass", "part"])
    start = order.select("source", "block", "pass", "total", "budget", (F.col("part_start") + F.col("in_part") + F.col("pass") * F.col("total")).alias("block_start"))
    read = dealt.select("doc_key", "doc_id", "source", "tokens", "block").join(start.where((F.col("block_start") < F.col("budget")) | (F.col("pass") == 0)), ["source", "block"])
    inside = Window.partitionBy("source", "pass", "block").orderBy(mixed("doc_key", "pass"), "doc_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("token_start", F.col("block_start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    read = read.where((F.col("pass") == 0) | (F.col("token_start") < F.col("budget")))
    return read.select("doc_key", "doc_id", "source", F.col("pass").cast("int").alias("pass"), "token_start", "tokens")


def counted(docs: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """(doc_key, doc_id, source, tokens) of each row of ``docs``."""
    keyed = with_key(docs)
    if tokenizer_path is None:
        return checkpointed(keyed.select("doc_key", "doc_id", F.col("source_key").alias("source"), "tokens"))
    return checkpointed(token_counts(keyed.select("doc_key", "doc_id", F.col("source_key").alias("source"), F.col("text").cast("string").alias("text")), tokenizer_path))


def mix(docs: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, seed: int = 17, tokenizer_path: str | None = None) -> DataFrame:
    """Every reading of the documents (doc_id, source, text) under the mixture, as ``draw`` returns it."""
    narrow = counted(docs, tokenizer_path)
    return draw(narrow, plan(narrow, max_repeats, target_entropy), seed)


def apply(docs: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, seed: int = 17, tokenizer_path: str | None = None) -> DataFrame:
    """``docs`` with every row repeated as often as the mixture reads it; the columns stay.

    Rows alike in id, source and text are repeated alike.
    """
    narrow = counted(docs, tokenizer_path)
    shares = plan(narrow, max_repeats, target_entropy)
    times = draw(narrow, shares, seed).select("doc_key", "doc_id", "pass").distinct().groupBy("doc_key", F.col("doc_id").alias("id")).agg(F.count("*").cast("int").alias("times"))
    same = (F.col("k.doc_key") == F.col("t.doc_key")) & F.col("k.doc_id").eqNullSafe(F.col("t.id"))
    whole = with_key(docs).alias("k").join(times.alias("t"), same).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return whole.select(*(F.col(f"k.`{c}`") for c in docs.columns))
