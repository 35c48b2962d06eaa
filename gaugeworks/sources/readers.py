"""Readers of line-delimited JSON, CSV, annotation files and text lists, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lenient: blank lines and lines that do not parse are left out, wherever they stand."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_jsonl(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows of a frame of text lines (``value``); lines that are no objects with the key, torn and blank ones too, are left out."""
    return lines.select(F.from_json("value", schema).alias("p")).where(F.col(f"p.{key}").isNotNull()).select("p.*")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_flagged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lenient, with ``_corrupt_record`` holding the lines that do not parse."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def lines_or_none(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file; none where there is no such file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return spark.read.text(path) if there else spark.createDataFrame([], "value string")


def count_corrupt(lines: DataFrame) -> DataFrame:
    """(n_rows, n_corrupt) of lines: objects, and those that do not parse; blank lines and other JSON are neither."""
    lines = lines.where(F.trim("value") != "")
    # The parser passes over what follows a value, so a line must be one value inside an array and inside an object.
    parsed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), "value", F.lit("}"))).isNotNull()
    return lines.agg(F.count_if(parsed & F.col("value").rlike(r"^\s*\{")).alias("n_rows"), F.count_if(~parsed).alias("n_corrupt"))


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, n_corrupt) of a log of JSON objects; a log that is not there yet is empty."""
    return count_corrupt(lines_or_none(spark, path))


def with_line_order(lines: DataFrame) -> DataFrame:
    """Adds ``ord``: file, block and place in it, which orders the lines of a file as they stand."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return lines.select("*", place.alias("ord"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; ``order`` must be unique within a key."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def read_predictions(spark: SparkSession, path: str, keep_order: bool = False) -> DataFrame:
    """Prediction log; a repeated item keeps its last line, torn and blank lines are left out; ``ord`` orders the rows as they stand."""
    rows = parse_predictions(with_line_order(spark.read.text(path)))
    return rows if keep_order else rows.drop("ord")


def parse_predictions(lines: DataFrame) -> DataFrame:
    """The last row of each item among lines (``value``, ``ord``) of a prediction log."""
    rows = lines.select(F.from_json("value", schemas.PREDICTIONS).alias("p"), "ord").where("p.item_id is not null")
    return last_wins(rows.select("p.*", "ord"), ["item_id"], "ord")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.JUDGMENTS)


def read_suite(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Items and environments of a suite; an item of an unknown environment fails the read."""
    items = read_jsonl_strict(spark, f"{folder}/items.jsonl", schemas.ITEMS)
    envs = read_jsonl_strict(spark, f"{folder}/envs.jsonl", schemas.ENVS)
    orphan = items.join(envs, "env_id", "left_anti").select("item_id").first()
    if orphan:
        raise ValueError(f"item {orphan['item_id']} is of no known environment")
    return items, envs


def sessions(envs: DataFrame) -> DataFrame:
    return envs.select("env_id", "dataset", F.explode("sessions").alias("s")).select("env_id", "dataset", "s.*")


def ordered_sessions(envs: DataFrame) -> DataFrame:
    """(env_id, place, session): each environment's sessions in their own order, from 0; ties keep the file's order."""
    place = F.transform("sessions", lambda s, i: F.struct(s["order"].alias("o"), i.alias("i"), s.alias("s")))
    return envs.select("env_id", F.posexplode(F.array_sort(place)).alias("place", "p")).select("env_id", "place", F.col("p.s").alias("session"))


def read_narrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def noun_vocabulary(rows: DataFrame, column: str = "key") -> DataFrame:
    return rows.select(F.lower(F.trim(F.substring_index(column, ":", 1))).alias("noun")).where("noun <> ''").distinct()


def read_noun_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Head words of a vocabulary file (key or noun column); none where there is no such file."""
    if lines_or_none(spark, path).isEmpty():
        return spark.createDataFrame([], "noun string")
    rows = spark.read.option("header", True).csv(path)
    named = [F.nullif(c, F.lit("")) for c in ("key", "noun") if c in rows.columns]
    return noun_vocabulary(rows.select(F.coalesce(*named).alias("key")))


def list_literal(c):
    """An array from a Python-style list of strings; empty when it does not parse."""
    return F.coalesce(F.from_json(c, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def read_annotations(spark: SparkSession, path: str, schema: str, key: str = "question_id") -> DataFrame:
    """A JSON array of objects whose key is present and unique, or an error; a folder must hold one all_qa.json."""
    if not path.endswith(".json"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "all_qa.json").load(path).select("path").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{path}: one all_qa.json is expected")
        path = found[0]["path"]
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    n = rows.agg(F.count("*").alias("n"), F.count(key).alias("k"), F.countDistinct(key).alias("d")).first()
    if not n["n"] or n["k"] != n["n"] or n["d"] != n["n"]:
        raise ValueError(f"{path}: {key} must be present and unique in a non-empty list")
    return rows


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Environments of a scan collection: reference, split and scans with their rigid moves and removals."""
    move = "instance_reference:int,instance_rescan:int,symmetry:int,transform:array<double>"
    schema = f"reference string, type string, scans array<struct<reference:string,rigid:array<struct<{move}>>,removed:array<int>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_moves(scans: DataFrame) -> DataFrame:
    """(reference, scan, instance, displacement): a move with a whole transform, columns first, translation at 13 to 15."""
    rows = scans.select("reference", F.explode("scans").alias("s")).select("reference", F.col("s.reference").alias("scan"), F.explode("s.rigid").alias("m"))
    rows = rows.where((F.size("m.transform") >= 16) & F.col("m.instance_reference").isNotNull())
    square = lambda i: F.pow(F.element_at("m.transform", i), 2)
    return rows.select("reference", "scan", F.col("m.instance_reference").alias("instance"), F.sqrt(square(13) + square(14) + square(15)).alias("displacement"))


def bounded_boxes(objects: DataFrame) -> DataFrame:
    """Rows with a centroid of three numbers within 1000 of the origin."""
    return objects.where((F.size("centroid") == 3) & F.forall("centroid", lambda x: x.isNotNull() & (F.abs(x) <= 1000)))


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (version, remote_path, md5) with 32 hex digits and unique keys, or an error."""
    rows = spark.read.option("header", True).csv(path)
    key = ["version", "remote_path"]
    bad = rows.where(~F.coalesce(F.col("md5").rlike(r"^[a-f0-9]{32}\z"), F.lit(False))).isEmpty()
    if not bad or not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: malformed or repeated hashes")
    return rows


def read_names(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Names of a text list without comments; a repeated name or another count than expected fails."""
    names = spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("name")).where("name <> ''")
    n = names.agg(F.count("*").alias("n"), F.countDistinct("name").alias("d")).first()
    if n["n"] != n["d"] or (expected is not None and n["n"] != expected):
        raise ValueError(f"{path}: {n['n']} names, {n['d']} distinct, {expected} expected")
    return names


def key_values(c, pairs: str = r"\|", pair: str = "="):
    """A map from ``k=v|k=v`` text."""
    return F.str_to_map(c, F.lit(pairs), F.lit(pair))


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(n_files, n_bytes) of a folder, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def inventory_verdict(counts: DataFrame) -> DataFrame:
    """Adds ``identical`` to (n_items, official): yes, no, or not downloaded for none."""
    have = F.coalesce("n_items", F.lit(0))
    return counts.withColumn("identical", F.when(have == 0, "not downloaded").when(have == F.col("official"), "yes").otherwise("no"))


def tagged_union(parts: dict[str, DataFrame], tag: str = "category") -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
