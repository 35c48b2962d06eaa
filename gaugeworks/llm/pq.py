"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Vectors are compared within rooms, one for each label and dimension.  A room is cut by hash into
blocks of about ``BLOCK`` vectors, and a task holds two blocks, or one; each pair of blocks meets
once.  A task fits its index to at most ``SAMPLE_ROWS`` vectors of its first block: a coarse quantiser
deals unit vectors into inverted lists, ``LIST_ROWS`` vectors each on average, and a product
quantiser codes their residuals by subspaces.  All vectors are indexed.  A vector
probes each list that can hold a neighbour within the threshold: a list is skipped only when the
ball around the vector lies beyond the hyperplane that bisects two centroids, or beyond the list's
own farthest or nearest member, so the probes suffice.  In a list, asymmetric distances come from look-up
tables; a code is dropped only
when its table distance exceeds the radius by more than the code's own quantisation error.  What is
left is compared by exact cosine in double precision, so no link is lost and none is added.

Equal vectors are folded into one class with a weight before the search, and a task returns counts and
a spanning forest of its links, never pairs.  In isotropic vectors half of the lists must be probed,
as a list then lies close to everything; copies by block pairs grow with the square of a room's blocks.

Defined results: only vectors with equal, non-null labels and of one dimension are compared; vectors that are null, zero
or hold null or non-finite components link with
nothing; exact copies link with each other; repeated ids are compared as separate vectors and share
their component; rows with a null id have no component and are not kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components, forest
from .vectors import matrix, usable

SAMPLE_ROWS, LIST_ROWS, MAX_LISTS = 8_192, 64, 1_024
BLOCK, ASK_ROWS, RERANK_PAIRS = 16_384, 1_024, 100_000
CODES, MARGIN = 64, 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest_centre(x, centres)
        order = np.argsort(of, kind="stable")
        held, at = np.unique(of[order], return_index=True)
        centres[held] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


class Index:
    """Inverted lists over unit vectors, with residual codes by subspaces."""

    def __init__(self, x: np.ndarray, subspaces: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        sample = x if len(x) <= SAMPLE_ROWS else x[np.sort(rng.choice(len(x), SAMPLE_ROWS, replace=False))]
        self.x, self.centres = x, kmeans(sample, max(1, min(MAX_LISTS, len(x) // LIST_ROWS)), 5, rng)
        rest = sample - self.centres[nearest_centre(sample, self.centres)]
        self.cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, 5, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.between = np.sqrt(np.maximum(self._squares(self.centres), 1e-24))
        of = nearest_centre(x, self.centres)
        residual = x - self.centres[of]
        parts = self.parts(residual)
        self.codes = np.stack([nearest_centre(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)
        coded = [b[self.codes[:, m]] for m, b in enumerate(self.books)]
        self.error = np.sqrt(sum(((p - c) ** 2).sum(1) for p, c in zip(parts, coded, strict=True)))
        self.stored = sum((c * c).sum(1) + 2 * (c * at).sum(1) for c, at in zip(coded, self.parts(self.centres[of]), strict=True))
        own = np.linalg.norm(residual, axis=1)
        order = np.argsort(of, kind="stable")
        self.lists = np.split(order, np.searchsorted(of[order], np.arange(1, len(self.centres))))
        sizes = np.cumsum([0, *(len(b) for b in self.books)])
        places = self.codes.astype(np.int64) + sizes[:-1]
        self.lookup = [np.ascontiguousarray(places[m].T) for m in self.lists]
        self.held, self.probed = np.array([len(m) for m in self.lists]), 0
        self.far = np.array([own[m].max() if len(m) else -np.inf for m in self.lists])
        self.near = np.array([own[m].min() if len(m) else np.inf for m in self.lists])

    def _squares(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def probes(self, d: np.ndarray, radius: float) -> np.ndarray:
        """Row by list, from squared distances to centroids: may the list hold a vector within the radius?"""
        of = d.argmin(1)
        past = (d - d[np.arange(len(d)), of][:, None]) / (2 * self.between[of])
        root = np.sqrt(d)
        return (past <= radius + MARGIN) & (root <= self.far + radius + MARGIN) & (root >= self.near - radius - MARGIN)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """For each row twice its inner products with all codewords, the subspaces one after the other."""
        return np.concatenate([2 * p @ b.T for p, b in zip(self.parts(x), self.books, strict=True)], axis=1).astype(np.float32)

    def near_pairs(self, asking: np.ndarray, radius: float, later: bool = False):
        """Pairs (row of ``asking``, row of the index) that the codes cannot rule out, list by list.

        With ``later``, ``asking`` are the index's own vectors and pairs with earlier blocks of rows are left out.
        |q - c - b|^2 = |q - c|^2 + (|b|^2 + 2 c.b) - 2 q.b: the middle term is stored with the code, the last is looked up.
        """
        for lo in range(0, len(asking), ASK_ROWS):
            part = asking[lo : lo + ASK_ROWS]
            d, table = self._squares(part), self.tables(part)
            probed = self.probes(d, radius)
            self.probed += int((probed * self.held).sum())
            for k, members in enumerate(self.lists):
                rows, first = np.nonzero(probed[:, k])[0], int(np.searchsorted(members, lo)) if later else 0
                members = members[first:]
                if len(rows) and len(members):
                    reach = (radius + self.error[members] + MARGIN) ** 2 + 1e-4  # what single precision may add
                    # What is left of the reach when the look-ups are added; negative rules the pair out.
                    left = (reach - self.stored[members]).astype(np.float32) - d[rows, k].astype(np.float32)[:, None]
                    own = table[rows]
                    for column in self.lookup[k][:, first:]:
                        left += np.take(own, column, axis=1)
                    q, x = np.nonzero(left >= 0)
                    if len(q):
                        yield rows[q] + lo, members[x]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def links(data: np.ndarray, asking: np.ndarray | None, threshold: float, subspaces: int):
    """Pairs of rows with cosine >= threshold: (of asking, of data), or each pair within data once."""
    data, asking = _scaled(data), None if asking is None else _scaled(asking)
    index = Index(_unit(data), subspaces)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    for q, x in index.near_pairs(index.x if asking is None else _unit(asking), radius, asking is None):
        if asking is None:
            q, x = q[q < x], x[q < x]
        for at in range(0, len(q), RERANK_PAIRS):
            i, j = q[at : at + RERANK_PAIRS], x[at : at + RERANK_PAIRS]
            a, b = (data if asking is None else asking)[i], data[j]
            ok = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= threshold
            yield i[ok], j[ok]


def near_duplicates(rows: DataFrame, threshold: float = 0.93, subspaces: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``rows``."""
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v")
    # A vector's class is a 128-bit key of its label and components.
    key = every.select("vec_id", F.when(able, F.unhex(F.md5(F.concat_ws(",", F.hex("label"), F.col("v").cast("array<string>"))))).alias("class"), "label", "v")
    classes = key.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = checkpointed(classes.withColumn("size", F.size("v")))
    found = _search(classes, threshold, subspaces)
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.select("class", "rep", "weight").join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("component", "class"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least")
    out = key.select("vec_id", "class").join(named, "class", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _search(classes: DataFrame, threshold: float, subspaces: int) -> DataFrame:
    """(a, b, n): the weight n linked with class a, in parts, with b null; and links (a, b) that span them."""
    rooms = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.select("class", "weight", "label", "size", "v").join(rooms, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Each block meets itself and every other block of its room once.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "weight", "v")

    def compare(table: pa.Table) -> pa.Table:
        first = table["block"].to_numpy() == table["i"][0].as_py()
        keys, weight, v = table["class"].to_pylist(), table["weight"].to_numpy(), matrix(table["v"])
        lone = bool(first.all()) and table["i"][0].as_py() == table["j"][0].as_py()
        if not lone and (first.all() or not first.any()):
            return _found([], [], [])
        x_at, q_at = np.nonzero(first)[0], np.nonzero(first if lone else ~first)[0]
        n, trees, held = np.zeros(len(keys), np.int64), [], 0
        for q, x in links(v[x_at], None if lone else v[q_at], threshold, subspaces):
            q, x = q_at[q], x_at[x]
            np.add.at(n, q, weight[x])
            np.add.at(n, x, weight[q])
            trees += zip(q.tolist(), x.tolist(), strict=True)
            held += len(q)
            if held > 500_000:
                trees, held = forest(trees), 0
        trees = forest(trees)
        some = np.nonzero(n)[0].tolist()
        return _found([keys[k] for k in some] + [keys[a] for a, _ in trees], [None] * len(some) + [keys[b] for _, b in trees], n[some].tolist() + [None] * len(trees))

    return checkpointed(dealt.groupBy("label", "size", "i", "j").applyInArrow(compare, "a binary, b binary, n long"))


def _found(a: list, b: list, n: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())})
