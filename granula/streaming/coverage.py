"""Voxel coverage counts kept in step with particle moves.

A move takes a particle's old voxels away and adds its new ones. Fed as a stream of
(ix, iy, iz, delta) rows, the count of every touched voxel is one keyed sum, updated in
place; a voxel another particle still covers never clears. The stream's checkpoint
folder makes a stopped run resume with the counts it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MOVES = "particle bigint, ix bigint, iy bigint, iz bigint, delta int"


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that turn one coverage table (particle, ix, iy, iz) into another; shared voxels cancel."""
    cols = ["particle", "ix", "iy", "iz"]
    gone = old.select(*cols, F.lit(-1).alias("delta"))
    come = new.select(*cols, F.lit(1).alias("delta"))
    net = gone.unionByName(come).groupBy(*cols).agg(F.sum("delta").cast("int").alias("delta"))
    return net.filter("delta <> 0")


def read_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of move files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(MOVES).parquet(folder)


def counts(stream: DataFrame) -> DataFrame:
    """Current cover of every touched voxel."""
    return stream.groupBy("ix", "iy", "iz").agg(F.sum("delta").alias("cover"))


def start_to_table(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's changed counts to a Parquet table; the highest ``batch`` of a voxel is current."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(folder)

    return (counts(stream).writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(table: DataFrame) -> DataFrame:
    """Latest count per voxel of a ``start_to_table`` folder, occupied voxels only."""
    last = table.groupBy("ix", "iy", "iz").agg(F.max(F.struct("batch", "cover")).alias("m"))
    return last.select("ix", "iy", "iz", F.col("m.cover").alias("cover")).filter("cover > 0")
