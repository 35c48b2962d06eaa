"""Connected components of an edge table, without collecting edges or labels.

First every bounded chunk of edges is reduced to a spanning forest by a union-find in its
own task; what is left is contracted by alternating large-star and small-star steps until
nothing changes.  Nodes are longs or binary keys and the label of a component is its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

CHUNK_EDGES = 200_000


def forest(pairs) -> list[tuple]:
    """(node, smallest node of its tree) for each node of ``pairs`` that is not itself smallest."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, find(x)) for x in parent if parent[x] != x]


def _reducer(kind: pa.DataType):
    """Fold the edges of one task into forests of at most CHUNK_EDGES edges at a time."""

    def edges(rows: list[tuple]) -> pa.RecordBatch:
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= 2 * CHUNK_EDGES:
                held = forest(held)
                if len(held) >= CHUNK_EDGES:
                    yield edges(held)
                    held = []
        yield edges(forest(held))

    return reduce


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (first two columns, binary or castable to long); other nodes are their own.

    Self loops, repeated edges and edges with a null end are allowed and add nothing; an empty
    table gives an empty result.
    """
    a, b = edges.columns[:2]
    kind = "binary" if edges.schema[a].dataType.typeName() == "binary" else "long"
    reduce, schema = _reducer(pa.binary() if kind == "binary" else pa.int64()), f"a {kind}, b {kind}"
    clean = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b")
    state = checkpointed(clean.mapInArrow(reduce, schema))
    n = state.count()
    chunks = -(-n // CHUNK_EDGES)
    if chunks > 0:
        state = checkpointed(state.repartition(chunks, "a").mapInArrow(reduce, schema))
        if not _settled(state):
            state = _stars(state)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct().unionByName(roots)


def _settled(state: DataFrame) -> bool:
    """Has every node one edge, to a node without one?"""
    several = state.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi")
    chained = state.join(state.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def _stars(state: DataFrame) -> DataFrame:
    """Large-star and small-star steps over (a, b), a > b, until the edges stay the same."""

    def digest(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    before = digest(state)
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        state = checkpointed(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        after = digest(state)
        if after == before:
            return state
        before = after
