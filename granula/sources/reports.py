"""Histogram CSV, PNG, JSON records and text reports."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

RECORD = (
    "entity_id string, acceptance_index bigint, particle bigint, attempt int, shape int, scale double, rotation struct<quaternion:array<double>>, "
    "translation array<double>, equivalent_diameter double, volume struct<full:double>")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Diameter histogram (bin, right, frequency): edges checked and completed, frequencies normalised.

    A histogram is a short configuration table; its rules compare neighbouring rows.
    """
    raw = spark.read.csv(path, header=True, schema="bin double, right double, frequency double", mode="FAILFAST")
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    h = raw.withColumn("next", F.lead("bin").over(w)).withColumn("width", F.lag("right").over(w) - F.lag("bin").over(w))
    h = h.withColumn("width", F.coalesce("width", F.col("bin") - F.lag("bin").over(w)))
    h = h.withColumn("right", F.coalesce("right", "next", F.col("bin") + F.col("width")))
    checks = h.agg(
        F.count("*").alias("n"), F.countDistinct("bin").alias("distinct"), F.min("bin").alias("lowest"), F.sum("frequency").alias("total"), F.min("frequency").alias("least"),
        F.max((F.col("right").isNull() | (F.col("right") <= F.col("bin"))).cast("int")).alias("bad_edge"),
        F.max((F.col("right") > F.col("next")).cast("int")).alias("overlap")).first()
    if not checks["n"] or checks["distinct"] != checks["n"] or checks["bad_edge"] or checks["overlap"]:
        raise ValueError(f"{path}: bins must increase, end after they start and not overlap")
    if checks["least"] is None or checks["least"] < 0 or abs(checks["total"] - 1.0) > 1e-6:
        raise ValueError(f"{path}: frequencies must be non-negative and add up to 1")
    return h.select("bin", "right", (F.col("frequency") / checks["total"]).alias("frequency"))


def write_png(lines: DataFrame, path: str, width: int, height: int) -> None:
    """PNG from the image lines of ``scene.image``, streamed to the file line by line."""
    if not path.lower().endswith(".png"):
        raise ValueError("only .png images are written")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    pack = zlib.compressobj()
    with open(path, "wb") as h:
        h.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)))
        for row in lines.orderBy("py").select("line").toLocalIterator():
            piece = pack.compress(b"\0" + bytes(row["line"]))
            if piece:
                h.write(chunk(b"IDAT", piece))
        h.write(chunk(b"IDAT", pack.flush()) + chunk(b"IEND", b""))


def write_records(records: DataFrame, folder: str) -> None:
    """Particle records as JSON lines, one file per partition; ``read_records`` gives them back."""
    nested = records.select("entity_id", "acceptance_index", "particle", "attempt", "shape", "scale", F.struct(F.array(*(F.col(f"quaternion.{k}") for k in "wxyz")).alias("quaternion")).alias("rotation"),
                            "translation", "equivalent_diameter", F.struct(F.col("volume").alias("full")).alias("volume"))
    nested.write.mode("errorifexists").json(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records as they were written, rotations and volumes flat again."""
    q = F.col("rotation.quaternion")
    rows = spark.read.schema(RECORD).json(folder)
    return rows.select("entity_id", "acceptance_index", "particle", "attempt", "shape", "scale", F.struct(*(q[i].alias(k) for i, k in enumerate("wxyz"))).alias("quaternion"),
                       "translation", "equivalent_diameter", F.col("volume.full").alias("volume"))


def write_csv(rows: DataFrame, folder: str) -> None:
    """Report rows with 12 decimals for floating-point columns."""
    cols = [F.format_string("%.12f", F.col(f.name)).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cols).write.option("header", True).csv(folder)


def manifest(paths: dict[str, str]) -> list[dict]:
    """Role, path, digest and size of every output file."""
    out = []
    for role, path in sorted(paths.items()):
        digest = hashlib.sha256()
        with open(path, "rb") as h:
            for block in iter(lambda: h.read(1 << 20), b""):
                digest.update(block)
        out.append({"role": role, "path": path, "sha256": digest.hexdigest(), "bytes": os.path.getsize(path)})
    return out


def write_json(path: str, value) -> None:
    with open(path, "w") as h:
        h.write(json.dumps(value, indent=2) + "\n")


def measurement_text(volume_fraction: float, curves: dict[str, DataFrame], l2: float | None = None) -> str:
    """Volume fraction, S2 curves by method and, for two methods, their distance; six decimals."""
    lines = [f"Volume Fraction: {volume_fraction:.6f}", "Compute Backend: " + ", ".join(f"{name}=spark" for name in curves), f"Method: {'both' if len(curves) == 2 else next(iter(curves))}"]
    for name, curve in curves.items():
        values = [(r["r"], r["s2"]) for r in curve.orderBy("r").select("r", "s2").toLocalIterator()]
        lines.append(f"S2(0)-VF diff [{name}]: {abs(values[0][1] - volume_fraction):.6f}")
        lines.append("S2 Values:" if len(curves) == 1 else f"S2 Values [{name}]:")
        lines += [f"{r}: {v:.6f}" for r, v in values]
    if l2 is not None:
        lines.append(f"L2 error [exact vs monte_carlo]: {l2:.6f}")
    return "\n".join(lines) + "\n"
