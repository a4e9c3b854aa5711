"""File formats as Spark data sources: STL, RAW and TIFF slices, VTU, NPY, histogram CSV, PNG, JSON.

``register(spark)`` makes the readers available as ``spark.read.format("stl" | "raw_slices" |
"tiff_slices" | "vtu" | "npy")`` and the STL writer as ``df.write.format("stl")``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .npy import NpyDataSource
from .slices import RawSlices, TiffSlices
from .stl import StlDataSource
from .vtu import VtuDataSource


def register(spark: SparkSession) -> None:
    for source in (StlDataSource, RawSlices, TiffSlices, VtuDataSource, NpyDataSource):
        spark.dataSource.register(source)
