"""Particle populations: filters, statistics, histograms, rebalancing, size classes."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rng import u01

from .ordered import numbered, running


def filter_chain(df: DataFrame, rules: Sequence[tuple[str, Column]], group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Apply named rules in order.

    Returns the survivors and one row per rule with the counts before and after it.
    A row is charged to the first rule it fails.
    """
    step = F.lit(None).cast("int")
    for i, (_, ok) in reversed(list(enumerate(rules))):
        step = F.when(~F.coalesce(ok, F.lit(False)), F.lit(i)).otherwise(step)
    marked = df.withColumn("_failed", step)
    counts = marked.groupBy(*group, "_failed").agg(F.count("*").alias("n"))
    alive = F.coalesce(F.col("_failed"), F.lit(len(rules)))
    per = counts.select(*group, "n", F.explode(F.array(*(F.struct(
        F.lit(i).alias("step"), F.lit(n).alias("rule"), (alive >= i).alias("before"), (alive > i).alias("after"))
        for i, (n, _) in enumerate(rules)))).alias("s"))
    report = per.groupBy(*group, F.col("s.step").alias("step"), F.col("s.rule").alias("rule")).agg(
        F.sum(F.when(F.col("s.before"), F.col("n")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("s.after"), F.col("n")).otherwise(0)).alias("after"))
    return marked.filter("_failed IS NULL").drop("_failed"), report


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule a row breaks, NULL when it breaks none."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(list(rules)):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def funnel(df: DataFrame, reason: str, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows per reason, with a zero for every reason that never occurred."""
    counts = [F.sum(F.when(F.col(reason) == n, 1).otherwise(0)).cast("bigint") for n in names]
    wide = df.groupBy(*group).agg(F.array(*(F.struct(F.lit(n).alias("reason"), c.alias("rejected")) for n, c in zip(names, counts))).alias("a"))
    return wide.select(*group, F.explode("a").alias("r")).select(*group, "r.*")


def summary(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, extrema, mean and median (mean of the two middles), computed without gathering a group.

    The median comes from value counts with running totals, so ties and hot groups
    are combined before anything is shuffled.
    """
    per_value = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    upto = running(per_value, group, [value], {"_upto": "_c"})
    stats_ = upto.groupBy(*group).agg(
        F.sum("_c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"))
    if group:
        marked = upto.join(stats_.select(*group, "n"), list(group))
    else:
        marked = upto.withColumn("n", F.lit(stats_.select("n").first()["n"]))
    below = F.col("_upto") - F.col("_c")
    mids = []
    for target in (F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)):
        mids.append(F.max(F.when((below <= target) & (F.col("_upto") > target), F.col(value))))
    med = marked.groupBy(*group).agg(((mids[0] + mids[1]) / 2.0).alias("median"))
    if group:
        return stats_.join(med, list(group))
    return stats_.withColumn("median", F.lit(med.first()["median"]))


def histogram(df: DataFrame, value: str, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over [min, max]; bins clamped to 4..32, the last one closed.

    A range narrower than 1e-12 collapses to bin 0.
    """
    bins = min(max(bins, 4), 32)
    ext = df.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    if group:
        j = df.select(*group, value).join(ext, list(group))
    else:
        row = ext.first()
        j = df.select(value).withColumn("lo", F.lit(row["lo"])).withColumn("hi", F.lit(row["hi"]))
    b = F.when(F.col("hi") - F.col("lo") < 1e-12, F.lit(0)).otherwise(stats.bin_index(F.col(value), F.col("lo"), F.col("hi"), bins))
    return j.groupBy(*group, b.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("_lo"), F.first("hi").alias("_hi")).select(
        *group, "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("left"), "n")


def lognormal_rebalance(df: DataFrame, value: str, ids: Sequence[str], bins: int = 12, over_factor: float = 1.25, seed: int = 0) -> DataFrame:
    """Thin over-full log-size bins to what a fitted lognormal expects; adds ``keep``.

    Each of B equal bins of ln(value) keeps at most ceil(ceil(p n) * over) rows, drawn at
    random by ``seed`` and the whole-number ``ids``. Fewer than four positive values, or no spread, keep everything.
    """
    bins, over_factor = min(max(bins, 4), 64), max(over_factor, 1.0)
    lv = F.ln(F.col(value))
    good = df.filter(F.col(value) > 0)
    fit = good.agg(F.count("*").alias("n"), F.avg(lv).alias("mu"), F.var_pop(lv).alias("var"), F.min(lv).alias("lo"), F.max(lv).alias("hi")).first()
    if (fit["n"] or 0) < 4 or abs(fit["hi"] - fit["lo"]) < 1e-12:
        return df.withColumn("keep", F.lit(True))
    mu, sigma = fit["mu"], max(fit["var"] ** 0.5, 1e-9)
    lo, width = fit["lo"], (fit["hi"] - fit["lo"]) / bins
    b = F.when(F.col(value) > 0, F.greatest(F.least(F.floor((lv - lo) / width), F.lit(bins - 1)), F.lit(0)).cast("int"))
    ranked = numbered(df.withColumn("bin", b).withColumn("_draw", u01(seed, "rebalance", *map(F.col, ids))), ["bin"], ["_draw", *ids]).drop("_draw")
    left = F.lit(lo) + F.col("bin") * width
    p = stats.normal_cdf_poly((left + width - mu) / sigma) - stats.normal_cdf_poly((left - mu) / sigma)
    expected = F.ceil(F.greatest(p, F.lit(0.0)) * fit["n"])
    allowed = F.ceil(expected * over_factor)
    return ranked.withColumn("keep", F.col("bin").isNull() | (F.col("rank") <= allowed)).drop("rank")


def size_classes(df: DataFrame, value: str, lo: float, hi: float, count: int) -> Column:
    """Class of a size among equal-width classes; sizes outside go to the end classes."""
    return stats.bin_index(F.col(value), F.lit(lo), F.lit(hi), count)


def largest_remainder(df: DataFrame, weight: str, order: str, total: int) -> DataFrame:
    """Whole counts that add up to ``total`` in proportion to ``weight``: adds ``quota`` (one row per bin)."""
    s = df.agg(F.sum(weight).alias("s")).first()["s"]
    share = df.withColumn("_x", F.col(weight) * float(total) / s).withColumn("_base", F.floor("_x"))
    left = total - int(share.agg(F.sum("_base")).first()[0])
    ranked = numbered(share, [], [(F.col("_base") - F.col("_x")), F.col(order)], "_rk")
    return ranked.withColumn("quota", F.col("_base") + (F.col("_rk") <= left).cast("bigint")).drop("_x", "_base", "_rk")


def cumulative_bins(bins: DataFrame, order: str, weight: str) -> DataFrame:
    """Cumulative probability interval [c0, c1) of each histogram bin (a bounded table)."""
    total = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = bins.withColumn("_t", F.sum(weight).over(total)).withColumn("_c", F.sum(weight).over(upto))
    return s.withColumn("c1", F.col("_c") / F.col("_t")).withColumn("c0", (F.col("_c") - F.col(weight)) / F.col("_t")).drop("_t", "_c")
