"""Reading and writing of the engine's relations."""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswork.sources.schemas import RELATIONS, conformed


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A relation of the registry below ``folder``, in its declared columns; empty where there is no such table."""
    path = f"{folder}/{name}.parquet"
    if not exists(spark, path):
        return spark.createDataFrame([], RELATIONS[name].schema())
    return conformed(spark.read.parquet(path), name)


def tracking_table(ner: bool, sentiment: bool, topic: bool, second_rater: bool) -> str:
    """The table that tells which articles are done: the second rater's if it runs alone."""
    return "qwen_article_sentiments" if second_rater and not (ner or sentiment or topic) else "article_sentiments"


def labelled_csv(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = ("langue", "texte")) -> DataFrame:
    """The first CSV of ``paths`` that exists; an error if none does or a required column is missing."""
    tried = [paths] if isinstance(paths, str) else list(paths)
    found = next((p for p in tried if exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"none of {tried}")
    df = spark.read.csv(found, header=True, multiLine=True, escape='"')
    if missing := set(required) - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; give partitionColumn, bounds and numPartitions for parallel reads."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def replace_table(df: DataFrame, path: str, keep_if_empty: bool = False) -> int:
    """A result table's new rows, written beside the old ones and swapped in when whole; how many they are.

    ``df`` may read the table that it replaces, and a failed write leaves the old rows. An empty frame empties the
    table, so no stale rows stay, unless ``keep_if_empty``."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = path.rstrip("/")
    as_path = jvm.org.apache.hadoop.fs.Path
    new, old, here = (as_path(f"{base}{end}") for end in (f".{uuid.uuid4().hex}.new", f".{uuid.uuid4().hex}.old", ""))
    df.write.parquet(new.toString())
    rows = spark.read.schema(df.schema).parquet(new.toString()).count()
    files = here.getFileSystem(conf)
    if not rows and keep_if_empty:
        files.delete(new, True)
        return 0
    had = files.exists(here)
    if had:
        files.rename(here, old)
    if not files.rename(new, here):
        if had:
            files.rename(old, here)
        raise OSError(f"could not move the new rows to {base}")
    if had:
        files.delete(old, True)
    spark.catalog.refreshByPath(base)
    return rows


def report_csv(df: DataFrame, path: str, limit: int = 100_000, if_rows: bool = False) -> int:
    """A small report as one CSV file with a byte-order mark; refuses frames beyond ``limit`` rows. ``if_rows``: an
    empty frame makes no file."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report on the driver: write the frame with Spark instead")
    if if_rows and not rows:
        return 0
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(rows)
    return len(rows)


def lookup(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the given values."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
