"""Mixing sources to target weights by entropy balancing.

Every document of a source s gets a rate r = min(cap, exp(m_s * size)): among all rates up to
``cap`` whose expected words meet the source's target, these stay closest (in relative entropy)
to taking each document once. The multipliers m_s maximise a concave dual, one constraint
per source, so its Hessian is diagonal: each Newton iteration is one grouped sum over the
table of (source, size, documents), guarded by a bracket per source. Terms are summed as whole
decimals, so the order of addition cannot change a result.

Rounding: with a source's documents in order of size, a document's copies are the step of the
rounded running total of rates. Each document gets its rate rounded down or up, and the words
taken miss the expectation by one document's size at most; of STARTS places where the rounding
may start, each source takes the one that comes nearest to its target. Running totals are taken block by
block; no source is sorted in one task.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at
``cap`` times the source's size, the excess is shared anew by weight: level filling, solved by
sorting the sources (one row each) by cap to weight.

Defined cases: null and empty texts have size 0, take no words and stay once; a source
without words has target 0; repeated rows count as documents of their own; an empty table gives an empty one; columns
named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.operators.ordered import running

from .base import fresh, keep, query, table, words

CAP = 3
UNIT = 1 << 20
STARTS = 32
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add weight and target to a table of sources (``source``, ``source_size``)."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("limit", (cap * F.col("source_size")).cast("double"))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole)
    # sources before the first level that fits stand at their limit; later levels are lower
    return levels.withColumn("target", F.least("limit", F.coalesce(fits, F.col("level")) * F.col("weight"))).drop("limit", "level", "weight")


def rate(multiplier, size, scale, cap: int):
    return F.least(F.lit(float(cap)), F.exp(multiplier * size / scale))


def whole(x):
    """``x`` in units of 2 ** -20 as a whole decimal: sums do not depend on their order."""
    return F.round(x * UNIT).cast("decimal(38,0)")


def solve(sizes: DataFrame, goals: DataFrame, cap: int, rounds: int = 60, close: float = 1e-9) -> DataFrame:
    """Newton on the dual. ``sizes``: key, size, n (size > 0); ``goals``: key, target. Returns key, multiplier, scale."""
    span = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.min("size").alias("least"), F.sum("n").alias("docs"))
    start = goals.join(span, "key").withColumn("scale", F.col("words") / F.col("docs"))
    step = F.col("scale") / F.col("least")
    state = keep(start.select("key", "target", "scale", F.lit(0.0).alias("multiplier"),
                              (-F.abs(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("words"))) * step - 1).alias("low"), (F.lit(math.log(cap)) * step + 1).alias("high"), F.lit(False).alias("met")))
    for _ in range(rounds):
        r = rate(F.col("multiplier"), F.col("size"), F.col("scale"), cap)
        mass = F.col("n") * F.col("size")
        sums = sizes.join(state, "key").groupBy("key").agg(F.sum(whole(mass * r)).cast("double").alias("got"), F.sum(F.when(r < cap, whole(mass * F.col("size") / F.col("scale") * r)).otherwise(F.lit(0))).cast("double").alias("slope"))
        gap = F.col("got") / UNIT - F.col("target")
        now = state.join(sums, "key").withColumn("met", F.abs(gap) <= F.greatest(F.col("target") * close, F.lit(0.5)))
        now = now.withColumn("low", F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high")))
        newton = F.col("multiplier") - gap * UNIT / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        state = keep(now.withColumn("multiplier", F.when(F.col("met"), F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)).select(*state.columns))
        if state.filter("NOT met").isEmpty():
            break
    return state.select("key", "multiplier", "scale")


def mix(docs: DataFrame, text: str = "text", source: str = "source", carry: list[str] | None = None, cap: int = CAP) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    row, key, order = (fresh(n, docs) for n in ("row", "key", "order"))
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    stored = keep(docs.select(*carry, F.size(words(F.col(text))).cast("long").alias("size"), named.alias(key), F.xxhash64(*(c for c in carry if c != text), text).alias(order))
                  .withColumn(row, F.monotonically_increasing_id()))
    slim = stored.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(order).alias("order"), "size")
    sizes = keep(slim.groupBy("key", "size").agg(F.count("*").alias("n")))
    source_of = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30))
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("source", source_of)
    goals = keep(targets(sources, cap).drop("source"))
    solved = solve(sizes.filter("size > 0"), goals.select("key", "target").filter("target > 0"), cap)
    known = goals.join(solved, "key", "left")
    r = F.when(F.col("size") == 0, 1.0).when(F.col("multiplier").isNull(), 0.0).otherwise(rate(F.col("multiplier"), F.col("size"), F.col("scale"), cap))
    rated = slim.join(keep(known), "key").select("row", "key", "size", "order", "source_size", "target", F.round(r * UNIT).cast("long").alias("units"))
    total = keep(running(rated, ["key"], ["size", "order", "row"], {"upto": "units"}))
    step = lambda start: F.shiftright(F.col("upto") + start, 20) - F.shiftright(F.col("upto") - F.col("units") + start, 20)
    tried = total.groupBy("key").agg(F.first("target").alias("target"), *(F.sum(F.col("size") * step(j * UNIT // STARTS)).alias(f"t{j}") for j in range(STARTS)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j * UNIT // STARTS).alias("start")) for j in range(STARTS))))
    copies = step(F.col("start"))
    total = total.join(keep(tried.select("key", best["start"].alias("start"))), "key")
    chosen = total.select(F.col("row").alias(row), "source_size", "target", copies.alias("copies"))
    return stored.join(chosen, row).select(*carry, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@query("op5_mixing")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, carry=["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
