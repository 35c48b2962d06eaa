"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

The n-grams of all documents have one global order, rare before frequent.  Two sets can only link if
they share ``SHARED`` n-grams within a short prefix of that order, at positions that leave enough to
share; this gives candidate pairs.  The order is cut into ``FRAGMENTS`` fragments; a set is shipped as one
segment a fragment, each fragment counts the partial overlaps of its own segments, they are summed by
pair, and the exact ratio decides.

Hot groups: equal sets are one class, named by a 128-bit hash, and a task emits a class once
however many of its rows hold it.  A first round pairs each set only with the foremost set of
each prefix n-gram, which joins groups of copies in linear work; the second round looks at all
candidate pairs whose ends are still in different components, each with one end outside the largest
component of its n-gram.  So
every pair of sets is either known to be connected or compared, and no link between components is lost.

The order's frequencies come from a count sketch over all documents, summed over all tasks, of which
the ``FREQUENT`` largest buckets are used; they only steer the order, so bounding them loses nothing.

Defined results: null or wordless texts have empty sets and link with nothing; repeated rows and
equal texts share a component; rows with a null id link like others and take the smallest id of their component, null if it
has none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, lean, remembered, text_batches
from .components import connected_components
from .segments import BLANK, Cutter, cuts, groups, texts, words

FRAGMENTS, SHARED, SKETCH_BITS, CHUNK_BUCKETS, FREQUENT, BROADCAST_IDS, SEEN = 4, 3, 22, 1 << 16, 1 << 18, 300_000, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words are runs of bytes other than space and 0x09 to 0x0D; A-Z count as a-z.
_WORDS = Cutter(bytes(BLANK if b == 0x20 or 0x09 <= b <= 0x0D else 1 for b in range(256)), cuts({}), bytes(range(256)).lower())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _shingled(w: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(w) - width + 1)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = _mixed(h * _MIX + w[i : i + n])
    return h


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; a shorter sequence is one shingle."""
    data, offsets = texts(column)
    for lo, hi in groups(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts = offsets[lo:hi] - offsets[lo]
        w = words(part, starts, _WORDS)
        upto = np.searchsorted(w.start, np.append(starts, len(part))).tolist()
        h = _shingled(w.h, n)
        for a, b in zip(upto, upto[1:], strict=False):
            yield np.unique(h[a : b - n + 1]) if b - a >= n else _shingled(w.h[a:b], b - a)[: b > a]


def set_class(h: np.ndarray) -> bytes | None:
    """A 128-bit key of the whole set; None for the empty set."""
    return xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None


def _fresh(seen: set[bytes], key: bytes | None) -> bool:
    """Is this the first row of its set that this task has met lately?"""
    if key is None or key in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(key)
    return True


def prefix_length(size: int, num: int, den: int) -> int:
    """Of two linked sets of n-grams, such prefixes have SHARED in common, or all that the sets must share."""
    return min(size, size - -(-num * size // den) + SHARED)


def _levels(order: tuple[bytes, bytes]) -> np.ndarray:
    def make() -> np.ndarray:
        table = np.zeros(1 << SKETCH_BITS, np.int32)
        table[np.frombuffer(order[0], np.int64)] = np.frombuffer(order[1], np.int32)
        return table

    return remembered(("levels", xxhash.xxh3_128_digest(order[0] + order[1])), make)


def ordered(h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order, by level and then hash, with the levels."""
    level = levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    at = np.argsort(level, kind="stable")
    return h[at], level[at]


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, size, class) with kind 0, and the task's count sketch in chunks with kind 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        schema = ["kind", "id", "size", "class", "counts"]
        for batch in batches:
            sizes, keys = [], []
            for h in shingle_sets(batch.column(1), n):
                bucket = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                counts[bucket[np.diff(bucket, prepend=-1) > 0]] += 1  # each bucket once a document
                sizes.append(len(h))
                keys.append(set_class(h))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(sizes), pa.binary())], names=schema)
        for k, c in enumerate(counts.reshape(-1, CHUNK_BUCKETS)):
            if c.any():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], names=schema)

    return text_batches(docs).mapInArrow(lean(scan), "kind int, id long, size long, class binary, counts binary")


def _frequent(sketches: DataFrame) -> DataFrame:
    """(bucket, n) of buckets with far more documents than most, from the tasks' sketches (id, counts)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = total.setdefault(chunk, np.zeros(CHUNK_BUCKETS, np.int64))
                own += np.frombuffer(zlib.decompress(packed.as_buffer()), np.uint32)
        for chunk, own in total.items():
            often = np.nonzero(own > own.mean() + 3 * np.sqrt(own.mean()) + 2)[0]
            yield pa.RecordBatch.from_arrays([pa.array(often + chunk * CHUNK_BUCKETS), pa.array(own[often])], names=["bucket", "n"])

    return sketches.repartition((1 << SKETCH_BITS) // CHUNK_BUCKETS, "id").mapInArrow(lean(add), "bucket long, n long")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batches`` that bound what is put out at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _prefixes(docs: DataFrame, n: int, num: int, den: int, order: Broadcast) -> DataFrame:
    """(s, class, place) for the prefix of each set; place holds position and size, position foremost."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = _levels(order.value), set()
        for part in _slices(batches, 1024):
            s, c, p = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for h in shingle_sets(part.column(1), n):
                if _fresh(seen, key := set_class(h)):
                    first = ordered(h, levels)[0][: prefix_length(len(h), num, den)]
                    s.append(first.view(np.int64))
                    c += [key] * len(first)
                    p.append((np.arange(len(first)) << 32) + len(h))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)), pa.array(c, pa.binary()), pa.array(np.concatenate(p))], names=["s", "class", "place"])

    return text_batches(docs).mapInArrow(lean(prefixes), "s long, class binary, place long")


def _segments(docs: DataFrame, n: int, order: Broadcast) -> DataFrame:
    """(class, fragment, size, segment) of each set: its hashes within each fragment of the order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = _levels(order.value), set()
        types = (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        for part in _slices(batches, 256):
            rows = []
            for h in shingle_sets(part.column(1), n):
                if not _fresh(seen, key := set_class(h)):
                    continue
                at, level = ordered(h, levels)
                fragment = np.where(level > 0, FRAGMENTS - 1, (at >> np.uint64(32)).astype(np.int64) * (FRAGMENTS - 1) >> 32)
                rows += [(key, int(f), len(h), at[fragment == f].view(np.int64)) for f in np.unique(fragment)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["class", "fragment", "size", "segment"])

    return text_batches(docs).mapInArrow(lean(segments), "class binary, fragment int, size long, segment array<long>")


def _null_safe(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A semi or anti join of ``left`` with ``right`` in which nulls equal nulls."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    right = F.broadcast(right) if right.count() <= BROADCAST_IDS else right
    return left.alias("l").join(right.alias("r"), on, how)


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, num: int, den: int, order: Broadcast) -> DataFrame:
    """The pairs (a, b) of classes with num/den of their union in common."""
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(reps, "class").select(F.col("rep").alias("id")).distinct())
    segments = _segments(_null_safe(docs, wanted, ["id"], "left_semi"), n, order).dropDuplicates(["class", "fragment"])
    segments = checkpointed(segments)
    left = segments.select(F.col("class").alias("a"), "fragment", F.col("size").alias("na"), F.col("segment").alias("x"))
    right = segments.select(F.col("class").alias("b"), "fragment", F.col("size").alias("nb"), F.col("segment").alias("y"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("n"))
    total = partial.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return checkpointed(total.where(F.col("n") * den >= (F.col("na") + F.col("nb") - F.col("n")) * num).select("a", "b"))


def _size(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(0xFFFFFFFF))


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Can an n-gram be one of the first SHARED that linked sets x and y share?

    They share what is left from it on at most, and before it no more than either has of n-grams
    that any other set has too (``before``), and SHARED - 1.
    """
    rest = lambda c: _size(c + "place") - F.shiftright(c + "place", 32)
    sizes = _size(x + "place"), _size(y + "place")
    need = (sizes[0] + sizes[1]) * num
    most = F.least(rest(x), rest(y)) + F.least(x + "before", y + "before", F.lit(SHARED - 1))
    return (most * (num + den) >= need) & (F.least(*sizes) * (num + den) >= need)


def _may_link_any(num: int, den: int) -> Column:
    """Can an n-gram be one of the first SHARED that a set shares with any set linked to it?

    Linked sets share num/den of either, so ``_may_link`` fails for every partner of a row that fails this; such rows of a
    frequent n-gram go before its windows.
    """
    size = _size("place")
    return (size - F.shiftright("place", 32) + F.least("before", F.lit(SHARED - 1))) * den >= size * num


def _candidates(rows: DataFrame, x: str, y: str, num: int, den: int) -> DataFrame:
    """(a, b): pairs of classes x and y in as many rows (one an n-gram) as linked sets must have."""
    must = F.ceil((_size(x + "place") + _size(y + "place")) * num / (num + den))
    rows = rows.where(_may_link(x, y, num, den)).select(F.least(x + "class", y + "class").alias("a"), F.greatest(x + "class", y + "class").alias("b"), F.least(must, F.lit(SHARED)).alias("must"))
    return checkpointed(rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("must").alias("must")).where("n >= must").select("a", "b"))


def _rooted(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class) of each document, and (class, rep, root): the smallest id of a set and its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    scanned = checkpointed(_scan(docs, n))
    keys = scanned.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "class")
    often = _frequent(scanned.where("kind = 1").select("id", "counts")).orderBy(F.desc("n"), "bucket").limit(FREQUENT).toArrow()
    counts = np.minimum(often["n"].to_numpy().astype(np.int64), 2**31 - 1).astype(np.int32)
    # Broadcast: FREQUENT buckets at most.
    order = spark.sparkContext.broadcast((often["bucket"].to_numpy().astype(np.int64).tobytes(), counts.tobytes()))
    reps = checkpointed(keys.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep")))

    by_gram = Window.partitionBy("s")
    shared = _prefixes(docs, n, num, den, order).repartition("s").dropDuplicates(["s", "class"])
    shared = shared.withColumn("lo", F.min("class").over(by_gram)).withColumn("hi", F.max("class").over(by_gram))
    shared = shared.where("lo <> hi").select("s", "class", "place")
    shared = shared.withColumn("before", F.row_number().over(Window.partitionBy("class").orderBy("place")) - 1)
    shared = checkpointed(shared.where(_may_link_any(num, den)))
    front = by_gram.orderBy("place", "class")
    star = shared.select("class", "place", "before", *(F.first(c).over(front).alias("f_" + c) for c in ("class", "place", "before"))).where("class <> f_class")
    links = _links(_candidates(star, "", "f_", num, den), docs, reps, n, num, den, order)
    roots = connected_components(links)

    told = shared.join(roots.withColumnRenamed("node", "class"), "class", "left").select("s", "class", "place", "before", F.coalesce("component", "class").alias("root"))
    told = told.withColumn("held", F.count("*").over(Window.partitionBy("s", "root")))
    told = told.withColumn("major", F.max(F.struct("held", "root")).over(by_gram)["root"]).withColumn("minor", F.max(F.col("root") != F.col("major")).over(by_gram))
    told = checkpointed(told.where("minor").select("s", "class", "place", "before", "root", "major"))
    other = told.select("s", *(F.col(c).alias("o_" + c) for c in ("class", "place", "before", "root")))
    apart = (F.col("root") != F.col("o_root")) & ((F.col("o_root") == F.col("major")) | (F.col("class") < F.col("o_class")))
    rest = told.where("root <> major").join(other, "s").where(apart & _may_link("", "o_", num, den))
    rest = _candidates(rest, "", "o_", num, den)
    if not rest.isEmpty():
        links = links.unionByName(_links(rest, docs, reps, n, num, den, order))
        roots = connected_components(links)
    rooted = reps.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "rep", F.coalesce("component", "class").alias("root"))
    return keys, rooted


def components(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document; links are |A & B| * den >= |A | B| * num."""
    keys, rooted = _rooted(docs, n, num, den)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    return keys.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def with_class(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the 128-bit key of each text's set as ``__class``; null for the empty set."""
    at, names = docs.columns.index("text"), [*docs.columns, "__class"]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([set_class(h) for h in shingle_sets(batch.column(at), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=names)

    return text_batches(docs).mapInArrow(lean(tag), T.StructType([*docs.schema.fields, T.StructField("__class", T.BinaryType())]))


def keep_first(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each group of linked texts.

    A row is known by its id and its set, so rows that share an id but not a text are judged each by
    its own text.  Of a group the row with the smallest id stays (null ids last, then by set), of
    repeated rows the first by text and other columns; rows with empty sets all stay.
    """
    keys, rooted = _rooted(docs, n, num, den)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), "rep", "class")).alias("f")).select("f.class", F.col("f.rep").alias("first_id"), F.lit(True).alias("first"))
    rows = keys.where("class is not null").groupBy("class", "doc_id").agg(F.count("*").alias("n")).join(first, "class", "left")
    rows = checkpointed(rows.withColumn("stays", F.coalesce(F.col("first") & F.col("doc_id").eqNullSafe(F.col("first_id")), F.lit(False))))
    name = lambda df: df.select("doc_id", F.col("class").alias("__class"))
    tagged = with_class(docs, n)
    kept = _null_safe(tagged, name(rows.where("not stays")), ["doc_id", "__class"], "left_anti")
    again = name(rows.where("stays and n > 1"))
    if again.isEmpty():
        return kept.select(docs.columns)
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    order = Window.partitionBy("doc_id", "__class").orderBy("text", *plain)
    one = _null_safe(kept, again, ["doc_id", "__class"], "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return _null_safe(kept, again, ["doc_id", "__class"], "left_anti").select(docs.columns).unionByName(one.select(docs.columns))
