"""What the operators of this subpackage share: words, tables in the shared folder, the registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.session import checkpoint_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space between words: blank and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, *by: str, bucketed: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder, split by the columns ``by``, and read it back.

    The table cuts lineage: a lost executor costs tasks of the step at hand, and what one
    attempt of a task wrote (chunk numbers, say) is what every later step sees. ``bucketed``
    (column, number) lets later groupings by that column read the table without a shuffle.
    """
    spark = df.sparkSession
    name = f"granula_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    write = df.write.option("compression", "zstd")
    write = write.partitionBy(*by) if by else write
    if not bucketed:
        write.parquet(path)
        return written(spark.read.schema(df.schema).parquet(path), path)
    write.bucketBy(bucketed[1], bucketed[0]).option("path", path).saveAsTable(name)
    return written(spark.table(name).select(*df.columns), path, name)  # the catalog entry stays while results are read


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """Column of the words of ``text``, an empty array for null and for blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
