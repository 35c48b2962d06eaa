"""Frozen suites: manifest with counts and checksums, verification, and run folders."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from . import readers, sinks


CHUNK = 8 << 20


def file_hashes(files: DataFrame) -> DataFrame:
    """(name, bytes, sha256) of rows (name, paths): the hash of the files of ``paths`` one after the other.

    An executor reads a row's files in chunks of 8 MB, so their size does not matter; rows are hashed in parallel.  Paths are
    those of a store that Arrow knows (local and shared folders, HDFS, S3, GCS, ABFS).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_hashed(paths or []) for paths in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in told], pa.int64()), pa.array([h for _, h in told])], names=["name", "bytes", "sha256"])

    return files.select(F.col("name").cast("string").alias("name"), "paths").mapInArrow(run, "name string, bytes long, sha256 string")


def _hashed(paths: list[str]) -> tuple[int, str]:
    from pyarrow import fs

    digest, size = hashlib.sha256(), 0
    for path in paths:
        store, name = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)
        with store.open_input_stream(name) as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
                size += len(chunk)
    return size, digest.hexdigest()


def file_sha256(spark: SparkSession, path: str) -> str:
    """Hash of a file, or of a written folder's part files in the order of their names."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path")  # names only, no content
    return file_hashes(parts.agg(F.lit(path).alias("name"), F.array_sort(F.collect_list("path")).alias("paths"))).first()["sha256"]


def manifest(spark: SparkSession, folder: str, name: str) -> dict:
    items, envs = readers.read_suite(spark, folder)
    items_sha, envs_sha = (file_sha256(spark, f"{folder}/{f}.jsonl") for f in ("items", "envs"))
    suite_sha = spark.range(1).select(sinks.suite_sha(F.lit(items_sha), F.lit(envs_sha))).first()[0]
    axes = {r["axis"]: r["count"] for r in items.groupBy("axis").count().orderBy("axis").collect()}
    return {"name": name, "n_items": items.count(), "n_envs": envs.count(), "axes": axes, "items_sha256": items_sha, "envs_sha256": envs_sha, "suite_sha": suite_sha}


def freeze(items: DataFrame, envs: DataFrame, folder: str, name: str) -> dict:
    """Write a suite with its manifest, then read it again and verify it."""
    spark = items.sparkSession
    sinks.write_suite(items, envs, folder)
    found = manifest(spark, folder, name)
    spark.createDataFrame([(json.dumps(found, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
    load(spark, folder)
    return found


def load(spark: SparkSession, folder: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """Items and environments; with ``verify``, counts and checksums must be those of the manifest."""
    if verify:
        told = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()["value"])
        found = manifest(spark, folder, told.get("name", ""))
        wrong = [k for k in ("items_sha256", "envs_sha256", "n_items", "n_envs") if told.get(k) and told[k] != found[k]]
        if wrong:
            raise ValueError(f"{folder} does not match its manifest: {', '.join(wrong)}")
    return readers.read_suite(spark, folder)


def filtered(items: DataFrame, envs: DataFrame, told: dict, axes: list[str] = (), env_ids: list[str] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Items, their environments only, and (name, suite_sha) that say what was kept."""
    kept = corpus.suite_filter(items, axes, env_ids, limit, "item_id")
    name, sha = corpus.suite_label(told["name"], told["suite_sha"], axes, env_ids, limit)
    return kept, corpus.envs_of(envs, kept), {"name": name, "suite_sha": sha}


def describe(items: DataFrame) -> DataFrame:
    """(axis, n, n_cross, cross_share) of a suite."""
    cross = F.coalesce("certificate.cross_session", F.lit(False))
    return items.groupBy("axis").agg(F.count("*").alias("n"), F.count_if(cross).alias("n_cross")).withColumn("cross_share", F.col("n_cross") / F.col("n"))


def read_run(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a run folder; an error where there are none."""
    rows = readers.read_predictions(spark, f"{folder}/predictions.jsonl")
    if rows.isEmpty():
        raise ValueError(f"{folder} has no predictions")
    return rows


def csv_head(spark: SparkSession, path: str) -> tuple[list[str], list[str] | None]:
    """Header and first row of a CSV file, without reading on; None where there is no row."""
    rows = spark.read.option("header", True).csv(path)
    first = rows.first()
    return rows.columns, list(first) if first else None


def footer_counts(spark: SparkSession, paths: dict[str, str], columns: list[str]) -> DataFrame:
    """(dataset, n_items, low, high): rows of Parquet folders, and the least and greatest of each column, as texts by column.

    Count, minimum and maximum are pushed into the scan, which answers them from the files' footers: no data page
    is read.  A session of its own holds the settings for that.  Columns must be numbers, dates or booleans.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    out = []
    for name, path in paths.items():
        told = footer_totals(own.read.parquet(path), columns).first()
        said = lambda kind: {c: None if told[f"{kind}_{c}"] is None else str(told[f"{kind}_{c}"]) for c in columns}  # noqa: B023, E731
        out.append((name, told["n"] or 0, said("low"), said("high")))  # files without rows have no count to add up
    return spark.createDataFrame(out, "dataset string, n_items long, low map<string,string>, high map<string,string>")


def footer_totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def caption_queries(parts: dict[str, DataFrame]) -> DataFrame:
    """Query files under their categories, ordered by category as given and then by id."""
    rank = {name: i for i, name in enumerate(parts)}
    out = readers.tagged_union(parts, "category")
    order = F.element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), F.col("category"))
    return out.orderBy(order, "query_id")
