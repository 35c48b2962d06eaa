"""Members of ZIP archives, listed by executors, and the rules they must pass before any is read."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import planning

MEMBERS = "archive string, at int, name string, mode int, encrypted boolean, size long, compressed long"
#: Names of members, and the types of files that may be unpacked (none told, or regular).
SAFE_MEMBER = r"^(?![.]{1,2}\z)[A-Za-z0-9_.-]+\z"
REGULAR = (0, 0o100000)
RATIO, SMALL = 1000, 1 << 20


def members(files: DataFrame) -> DataFrame:
    """Rows of ``MEMBERS`` for archives (path): only the directory at an archive's end is read, nothing is unpacked."""

    def listed(path: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)
        with store.open_input_file(name) as f, zipfile.ZipFile(f) as archive:
            for at, m in enumerate(archive.infolist()):
                mode = (m.external_attr >> 16) & 0o170000
                yield path, at, m.filename, 0o040000 if m.is_dir() else mode, bool(m.flag_bits & 1), m.file_size, m.compress_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                columns = list(zip(*listed(path), strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select(F.col("path").cast("string").alias("path")).mapInArrow(run, MEMBERS)


def _names(names: list[str]) -> Column:
    return F.array(*map(F.lit, sorted(names))).cast("array<string>")


def verdicts(rows: DataFrame, required: list[str], optional: list[str] = (), max_members: int = 128, max_bytes: int = 1 << 30) -> DataFrame:
    """(archive, reason, chosen, expanded): the first rule an archive of members (``MEMBERS``) breaks, null for none, and what may be unpacked.

    Members are judged in their order, before the archive as a whole: names in one flat folder, regular files, no
    encryption, no name twice, sizes that can be; then all required names, the sum of the chosen sizes, and no size out of proportion.
    """
    wanted = sorted({*required, *optional})
    place = F.row_number().over(Window.partitionBy("archive", "name").orderBy("at"))
    rules = [
        ("unsafe_name", ~F.coalesce(F.col("name").rlike(SAFE_MEMBER), F.lit(False))), ("not_a_file", ~F.col("mode").isin(*REGULAR)), ("encrypted", F.col("encrypted")),
        ("duplicate", F.col("__place") > 1), ("invalid_size", (F.col("size") < 0) | (F.col("compressed") < 0)),
    ]
    told = rows.withColumn("__place", place).withColumn("__flaw", planning.first_reason(rules))
    ours = F.col("name").isin(wanted) & (F.col("__place") == 1)
    per = told.groupBy("archive").agg(
        F.count("*").alias("n"), F.min_by("__flaw", F.when(F.col("__flaw").isNotNull(), F.col("at"))).alias("flaw"), F.array_sort(F.collect_set(F.when(ours, F.col("name")))).alias("chosen"),
        F.coalesce(F.sum(F.when(ours, F.col("size"))), F.lit(0)).alias("expanded"), F.coalesce(F.bool_or(ours & (F.col("size") > F.greatest(F.lit(SMALL), F.col("compressed") * RATIO))), F.lit(False)).alias("odd"),
    )
    whole = [("missing_fields", F.size(F.array_except(_names(required), F.col("chosen"))) > 0), ("over_budget", F.col("expanded") > max_bytes), ("suspicious_ratio", F.col("odd"))]
    reason = F.when(F.col("n") > max_members, "too_many_members").otherwise(F.coalesce("flaw", planning.first_reason(whole)))
    return per.select("archive", reason.alias("reason"), F.when(reason.isNull(), F.col("chosen")).otherwise(F.array().cast("array<string>")).alias("chosen"), F.when(reason.isNull(), F.col("expanded")).otherwise(0).cast("long").alias("expanded"))
