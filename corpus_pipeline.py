"""The training-data pipeline: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs; the folder before it then goes.  All stages but the last return the columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import jaccard, mixing, packing, secrets, toxicity
from gaugeworks.llm.common import checkpoint_dir, table
from gaugeworks.llm.queries import tokenizer_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose noisy-or score reaches 1/2; the model learns from all labels.

    Each row is judged by its own text: null and empty texts and rows with null ids stay or go by
    the leak's score, which is under 1/2; repeated rows go together; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by 5-word Jaccard of 0.8 or more, the one with the smallest id.

    Rows are judged by id and text, so rows that share an id only are apart; of repeated rows one
    stays; null ids come last; null and wordless texts link with nothing and all stay.
    """
    return jaccard.keep_first(docs, n=5, num=4, den=5)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets inside texts; no row goes, and texts without secrets (null and empty too) stay as they are."""
    return secrets.redact(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat rows as often as the mixture reads them; every row is read at least once.

    A null source is a source of its own ('' and null are one); texts without tokens are read in every whole pass;
    rows alike in id, source and text are repeated alike.
    """
    return mixing.apply(docs, tokenizer_path=tokenizer_path())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens, with its sequence and offset; a null or empty text is its end id."""
    return packing.pack_documents(docs, tokenizer_path(), 2048, 0)


STAGES = [("toxicity", toxic_out), ("near_copies", near_copies_out), ("secrets", secrets_masked), ("mixing", sources_mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, writing each result to the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            _remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own access to the store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
