"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, else one of our own (tests, laptops)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:  # one machine: its own temporary folder will do
        named = tempfile.mkdtemp(prefix="granula-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


class Blocks(list):
    """Open blocks, innermost last; functions that are sent to executors take none of them along."""

    def __reduce__(self):
        return Blocks, ()


_OPEN = Blocks()


class WorkTables:
    """Remembers the tables that ``cut`` and its like write inside a ``with`` block, so that they can go when used up.

    Tables still held when the block ends pass to the block around it.
    """

    def __enter__(self):
        self.made: list[tuple[DataFrame, str, str | None]] = []
        _OPEN.append(self.made)
        return self

    def __exit__(self, *failure):
        _OPEN[:] = [m for m in _OPEN if m is not self.made]
        if _OPEN:
            _OPEN[-1].extend(self.made)

    def drop(self, *but: DataFrame) -> None:
        """Remove all tables except those read by the frames ``but`` (as ``cut`` returned them)."""
        for table, path, name in self.made:
            if not any(table is b for b in but):
                spark = table.sparkSession
                if name:
                    spark.sql(f"DROP TABLE IF EXISTS {name}")
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.made[:] = [m for m in self.made if any(m[0] is b for b in but)]


def written(table: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Note a table in the checkpoint folder with the block at hand."""
    if _OPEN:
        _OPEN[-1].append((table, path, name))
    return table


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the checkpoint folder and continue from there.

    Later steps neither recompute it nor carry its plan, a lost executor costs only the
    step at hand, and Spark knows the table's size when it picks the next join. (A
    ``checkpoint()`` would compute the last stage twice.)
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/granula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return written(spark.read.schema(df.schema).parquet(path), path)


def spread(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Distribute few rows that each expand to many over all tasks before they do."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that holds far more rows than its input (explodes, grid cells, template faces).

    Spark takes such a side to be as large as its input and would gather millions of rows on the driver to
    broadcast them; joined this way both sides are shuffled and sorted instead.
    """
    return df.hint("merge")


def fan_out(scan: DataFrame) -> DataFrame:
    """Spread a plain scan of fewer files than the cluster has cores; larger tables pass through untouched."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if len(scan.inputFiles()) < cores else scan


def q6(c: Column) -> Column:
    """Round to about 1e-6 for comparison with SQL; never negative zero.

    The threshold sits off one half, so short decimals such as 0.8203125 are not ties
    that the last bit of a sum could tip either way.
    """
    return F.floor(c * 1e6 + 0.4370016).cast("double") / 1e6 + 0.0
