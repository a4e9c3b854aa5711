"""From raw documents to training tokens: quality, shared lines, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Every stage works on all rows its predecessor kept. Results are meant
to be written before the next stage starts: a stage begins by dropping the working tables that the
stage before it left in the checkpoint folder.

Defined cases, for all stages: null texts count as empty (quality rules reject both; otherwise such
rows link with nothing and have no tokens); null sources are a source of their own; rows with null
ids are documents like others; repeated rows are one group of near copies; further columns pass
through whatever their names; an empty table passes all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.llm.base import fresh, keep
from granula.llm.bpe import bpe
from granula.llm.lines import drop_lines
from granula.llm.mixing import mix
from granula.llm.near_copies import near_copies
from granula.llm.quality import quality
from granula.session import WorkTables

_LEFT = WorkTables()
_LEFT.made = []


def stage(function: Callable) -> Callable:
    """Drop what the stage before left, then note what this one leaves."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT.drop()
        with WorkTables() as own:
            result = function(spark, docs, sf_dir)
            _LEFT.made[:], own.made[:] = own.made, []
        return result

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality suffices; the others go."""
    return quality(docs).filter("kept").select(docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more are dropped everywhere; ``n_chars`` follows the text."""
    cut = drop_lines(docs).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (of repeated rows, one)."""
    first = fresh("first", docs)
    return near_copies(docs, first=first).filter(first).select(docs.columns)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    taken = mix(docs).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(fresh("copy", taken))
    return taken.select(*docs.columns, times).select(docs.columns)


@stage
def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, and proofs of what they encode and decode to."""
    return bpe(docs, "word_bpe_49k.json", ["n_tokens", "ids", "ids_sha256", "decoded_sha256"], carry=["doc_id"])


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixture", mixture), ("bpe_tokens", bpe_tokens)]

#: SQL can express neither the fitted rules nor the mixture; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each from the written result of the one before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES[:-1]:
        result = step(spark, docs, sf_dir)
        with WorkTables() as own:
            docs, made = keep(result), own.made[:]
            own.made[:] = []
        if before:
            before.drop()
        before, own.made = own, made
    return STAGES[-1][1](spark, docs, sf_dir)
