"""Maximum-inner-product search with a vantage-point tree in every shard.

Rows are dealt by hash into shards of at most about ``SHARD_ROWS`` vectors of one dimension, and
no fewer than ``LEAST_ROWS`` unless all are fewer.  Inner products become Euclidean
distances by one more component, sqrt(M^2 - |x|^2), where M is the largest norm of the shard:
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  A task builds the tree of a shard once and streams the queries
past it in batches, each of which descends the tree together.  A subtree is skipped when the triangle
inequality shows it farther than ``factor`` times the distance of the query's current k-th neighbour:
factor 1 is exact, less prunes more.  Candidates of a leaf that reach the current k-th score are ranked by
inner products on the original vectors, so ranks and scores are exact.

The queries are a stated set and visit every shard of their dimension; the vectors themselves are
shuffled once.  A task holds a shard and a batch of queries, and returns k rows for each query.

Defined results: vectors that are null, zero or with
null or non-finite components take no part; vectors of different dimensions are no candidates for each other; equal scores go to the smaller id; repeated rows with
one id count once each unless they are the query's own id; with fewer than k candidates all are
returned; an empty table gives no rows; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, usable

SHARD_ROWS, LEAST_ROWS, LEAF_ROWS, QUERY_ROWS = 32_768, 4_096, 512, 4_096
SLACK = 1e-9


class VPTree:
    """Nodes are (rows of a leaf) or (vantage row, radius, inner, outer); rows must be in the order of ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf_rows: int | None = None, seed: int = 3) -> None:
        self.ids, self.plain, self.leaf_rows, self.rng = ids, x, leaf_rows or LEAF_ROWS, np.random.default_rng(seed)
        squares = (x * x).sum(1)
        self.most = squares.max(initial=0.0)
        self.x = np.column_stack([x, np.sqrt(np.maximum(self.most - squares, 0))])
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf_rows:
            return rows
        tried = self.rng.choice(rows, min(5, len(rows)), replace=False)
        seen = self.rng.choice(rows, min(64, len(rows)), replace=False)
        spread = [np.linalg.norm(self.x[seen] - self.x[v], axis=1).std() for v in tried]
        vantage = tried[int(np.argmax(spread))]
        d = np.linalg.norm(self.x[rows] - self.x[vantage], axis=1)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # ties; nothing to split by
            inside = d < radius
            if not inside.any():
                return rows
            radius = float(d[inside].max())
        return vantage, radius, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows (-1 for none) of the k best of each query, best first, ties by id; rows of the query's own id are left out."""
        n = len(q)
        self.q_ids, self.q, self.k, self.factor = q_ids, q, k, factor
        self.squares = (q * q).sum(1)
        self.lifted = np.column_stack([q, np.zeros(n)])
        self.tolerance = SLACK * np.sqrt(self.squares * max(self.most, 1e-300))
        self.score, self.at = np.full((n, k), -np.inf), np.full((n, k), -1)
        self._visit(self.root, np.arange(n))
        return self.score, self.at

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """The distance of the k-th neighbour so far."""
        worst = self.score[rows, -1]
        d = np.sqrt(np.maximum(self.squares[rows] + self.most - 2 * np.where(np.isinf(worst), 0, worst), 0))
        return np.where(np.isinf(worst), np.inf, d)

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for lo in range(0, len(node), 4096):  # ties may leave long leaves
                self._leaf(node[lo : lo + 4096], active)
            return
        vantage, radius, inner, outer = node
        d = np.linalg.norm(self.lifted[active] - self.x[vantage], axis=1)
        near_inner, scale = d <= radius, np.sqrt(self.squares[active] + self.most)
        for first in (True, False):
            mine = near_inner == first
            chosen, gap = active[mine], np.abs(d - radius)[mine]
            if len(chosen):
                self._visit(inner if first else outer, chosen)
                # Near the largest score the distance is a small difference: its square may be off by SLACK of the scale.
                reach = self.factor * np.sqrt(self._reach(chosen) ** 2 + SLACK * scale[mine] ** 2) + SLACK * scale[mine]
                self._visit(outer if first else inner, chosen[gap <= reach])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        rough = self.q[active] @ self.plain[rows].T
        least = self.score[active, -1]
        unset = np.nonzero(np.isinf(least))[0]
        if len(unset) and len(rows) > self.k:  # the k-th best of this leaf will do
            part = rough[unset]
            part[self.ids[rows][None] == self.q_ids[active[unset]][:, None]] = -np.inf
            least[unset] = np.partition(part, len(rows) - self.k, axis=1)[:, len(rows) - self.k] - self.tolerance[active[unset]]
        qi, xi = np.nonzero(rough >= (least - self.tolerance[active])[:, None])
        other = self.ids[rows[xi]] != self.q_ids[active[qi]]
        asked, found = active[qi[other]], rows[xi[other]]
        if not len(asked):
            return
        exact = inner_products(self.q[asked], self.plain[found])
        some = np.unique(asked)
        asked, found = np.concatenate([asked, np.repeat(some, self.k)]), np.concatenate([found, self.at[some].ravel()])
        exact = np.concatenate([exact, self.score[some].ravel()])
        # Rows are in the order of ids; those not found yet are last.
        order = np.lexsort((np.where(found < 0, len(self.ids), found), -exact, asked))
        asked = asked[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        order, asked, place = order[place < self.k], asked[place < self.k], place[place < self.k]
        self.score[asked, place], self.at[asked, place] = exact[order], found[order]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so equal vectors get equal scores."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _answers(k: int, factor: float):
    """Streams of (shard, asks, id, v), by shard with the vectors before the queries, to (query_id, vec_id, score)."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.nonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0))[0] + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    shard, held, tree = shards[lo], [], None
                if not asks[lo]:
                    held.append((batch.column(2).slice(lo, hi - lo).to_numpy(), matrix(batch.column(3).slice(lo, hi - lo))))
                    continue
                if tree is None and held:
                    ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    order, held = np.argsort(ids, kind="stable"), []
                    tree = VPTree(ids[order], x[order])
                for at in range(lo, hi if tree else lo, QUERY_ROWS):
                    n = min(QUERY_ROWS, hi - at)
                    q_ids = batch.column(2).slice(at, n).to_numpy()
                    score, found = tree.search(q_ids, matrix(batch.column(3).slice(at, n)), k, factor)
                    qi, ki = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(tree.ids[found[qi, ki]]), pa.array(score[qi, ki])], names=["query_id", "vec_id", "score"])

    return answer


def nearest(rows: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product for each query."""
    valid = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = valid.where(F.col("id").isNotNull() & usable("v")).withColumn("size", F.size("v"))
    spark = rows.sparkSession
    slots = spark.sparkContext.defaultParallelism
    n = F.col("n")
    # As many shards as there are cores while they have LEAST_ROWS each; beyond that, by size.
    shards = F.greatest(F.ceil(n / SHARD_ROWS), F.least(F.lit(slots), F.ceil(n / LEAST_ROWS))).cast("int")
    sizes = valid.groupBy("size").agg(F.count("*").alias("n")).select("size", shards.alias("shards"))
    known = valid.join(sizes, "size")
    name = F.xxhash64("size", "part").alias("shard")
    data = known.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")).cast("int")).select(name, F.lit(False).alias("asks"), "id", "v")
    asked = known.where("asks").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(name, F.lit(True).alias("asks"), "id", "v")
    dealt = data.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(_answers(k, factor), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
