"""Order-dependent computations that never sort one group on one task.

A running total over a global (or very large) ordering is split into blocks by
range partitioning. Each block is scanned on its own and shifted by the total of
the blocks before it, which is a table with one row per block and group.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


BLOCK_ROWS = 2_000_000


def _blocks(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows written out (range partitioning reads them twice), and blocks enough that none outgrows a task."""
    df = cut(df)
    return df, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BLOCK_ROWS))


def running(df: DataFrame, group: Sequence[str], order: Sequence, sums: Mapping[str, str],
            inclusive: bool = True) -> DataFrame:
    """Add running totals: ``sums`` maps each new column to the column it adds up.

    ``order`` must be unique within a group. ``inclusive`` counts the row itself.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    df, n = _blocks(df)
    blocks = cut(df.repartitionByRange(n, *(F.col(g) for g in group), *keys)
                 .withColumn("_block", F.spark_partition_id()))
    totals = blocks.groupBy(*group, "_block").agg(*(F.sum(src).alias("_t_" + dst) for dst, src in sums.items()))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_block",
                            *(F.coalesce(F.sum("_t_" + d).over(before), F.lit(0)).alias("_o_" + d) for d in sums))
    end = 0 if inclusive else -1
    within = Window.partitionBy(*group, "_block").orderBy(*keys).rowsBetween(Window.unboundedPreceding, end)
    out = blocks.join(offsets, [*group, "_block"])
    for dst, src in sums.items():
        out = out.withColumn(dst, F.coalesce(F.sum(src).over(within), F.lit(0)) + F.col("_o_" + dst))
    return out.drop("_block", *("_o_" + d for d in sums))


def running_within(df: DataFrame, group: Sequence[str], order: Sequence, sums: Mapping[str, str], inclusive: bool = True) -> DataFrame:
    """``running`` for many small groups: where none has more than ``BLOCK_ROWS`` rows, each is scanned whole and nothing is written.

    ``df`` is read once more to count, so it should be cheap to read.
    """
    most = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most > BLOCK_ROWS:
        return running(df, group, order, sums, inclusive)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    within = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    known = df.dropna(subset=list(group))  # as the join on blocks
    return known.withColumns({dst: F.coalesce(F.sum(src).over(within), F.lit(0)) for dst, src in sums.items()})


def numbered(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """1-based position of each row in its group."""
    return running(df.withColumn("_one", F.lit(1)), group, order, {name: "_one"}).drop("_one")


def upper_middle(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Element n/2 (zero-based) of each sorted group: the upper of two middles."""
    per_value = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    upto = running(per_value, group, [value], {"_upto": "_c"})
    marked = upto.withColumn("_from", F.col("_upto") - F.col("_c"))
    n = upto.groupBy(*group).agg(F.max("_upto").alias("_n"))
    if group:
        marked = marked.join(n, list(group))
    else:
        marked = marked.withColumn("_n", F.lit(n.first()["_n"]))
    half = F.floor(F.col("_n") / 2)
    return marked.filter((F.col("_upto") > half) & (F.col("_from") <= half)).select(
        *group, F.col(value).alias("upper_middle"))


def rank_quantiles(df: DataFrame, group: Sequence[str], value: str, names: Mapping[str, float]) -> DataFrame:
    """Nearest-rank quantiles per group: the element at round((n - 1) p) of the sorted values."""
    per_value = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    upto = running(per_value, group, [value], {"_upto": "_c"})
    n = upto.groupBy(*group).agg(F.max("_upto").alias("_n"))
    marked = upto.join(n, list(group))
    at = {k: F.round((F.col("_n") - 1) * float(p)) for k, p in names.items()}
    return marked.groupBy(*group).agg(*(
        F.max(F.when((F.col("_upto") - F.col("_c") <= i) & (F.col("_upto") > i), F.col(value))).alias(k) for k, i in at.items()))


def chains(df: DataFrame, group: Sequence[str], value: str, tol: float, name: str = "chain") -> DataFrame:
    """Number the runs of values whose neighbours lie within ``tol``; values are distinct per group.

    The value before the first row of a block is the largest of the blocks before it.
    """
    df, n = _blocks(df)
    blocks = cut(df.repartitionByRange(n, *(F.col(g) for g in group), F.col(value)).withColumn("_block", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.groupBy(*group, "_block").agg(F.max(value).alias("_max")).select(*group, "_block", F.max("_max").over(before).alias("_prev"))
    within = Window.partitionBy(*group, "_block").orderBy(value)
    gap = F.col(value) - F.coalesce(F.lag(value).over(within), F.col("_prev"))
    marked = blocks.join(heads, [*group, "_block"]).withColumn("_new", F.coalesce((gap > tol).cast("int"), F.lit(1)))
    return running(marked.drop("_block", "_prev"), group, [value], {name: "_new"}).drop("_new")
