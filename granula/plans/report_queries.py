"""Packing reports: thinning, samples, gaps, distribution and size-class tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rng import u01, u01_sql
from ..operators import ordered, placement, scene
from ..operators.population import size_classes
from ..session import cut, q6 as r6
from . import derive as D
from .derive import q6
from .population_queries import _erfc
from .registry import query, table

_HISTO = [(0.0, 50.0, 0.30), (50.0, 100.0, 0.40), (100.0, 200.0, 0.25), (200.0, 500.0, 0.05)]
_BIN = "CASE " + " ".join(f"WHEN value >= {lo} AND value < {hi} THEN {i}" for i, (lo, hi, _) in enumerate(_HISTO)) + " END"


@query("random_thinning", f"""WITH {D.BODIES_SQL}, v AS (SELECT part, CAST(floor(8 * hx * hy * hz * 1e6) AS BIGINT) AS v, {u01_sql(21, 'thin', 'part')} AS u FROM bodies),
 t AS (SELECT floor(sum(v) * 0.7::DOUBLE) AS target FROM v), r AS (SELECT part, v, CAST(sum(v) OVER (ORDER BY u, part) AS BIGINT) AS upto FROM v)
 SELECT part, upto FROM r, t WHERE upto < target OR (upto - v < target AND upto - target <= target - (upto - v))""")
def random_thinning(spark, sf):
    """Bodies kept when thinning at random to 70 % of the volume, as close as whole bodies allow."""
    b = D.bodies(spark, sf).select("part", F.floor(8 * F.col("hx") * F.col("hy") * F.col("hz") * 1e6).alias("v"), u01(21, "thin", F.col("part")).alias("u"))
    b = cut(b)
    target = float(b.agg(F.floor(F.sum("v") * 0.7)).first()[0])
    kept = placement.stop_at_target(b.withColumn("order", F.struct("u", "part")), "v", target)
    return kept.select("part", F.col("running_volume").alias("upto"))


@query("seeded_sample", f"WITH s AS (SELECT o_orderkey, {u01_sql(23, 'sample', 'o_orderkey')} AS u FROM orders) SELECT o_orderkey, {q6('u')} AS u FROM s ORDER BY s.u, o_orderkey LIMIT 100")
def seeded_sample(spark, sf):
    """A reproducible sample of 100 particles."""
    o = table(spark, sf, "orders").select("o_orderkey", u01(23, "sample", F.col("o_orderkey")).alias("u"))
    return o.orderBy("u", "o_orderkey").limit(100).select("o_orderkey", r6(F.col("u")).alias("u"))


_QUANTILES = (0.0, 0.1, 0.5, 0.9, 1.0)


@query("rank_quantiles", f"""WITH r AS (SELECT event_type AS grp, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT grp, {', '.join(f"max(CASE WHEN k = CAST(round((n - 1) * {p}::DOUBLE) AS BIGINT) THEN value END) AS q{int(p * 100)}" for p in _QUANTILES)} FROM r GROUP BY grp""")
def rank_quantiles(spark, sf):
    """Nearest-rank quantiles per group: the value at round((n - 1) p)."""
    return ordered.rank_quantiles(table(spark, sf, "events").withColumnRenamed("event_type", "grp"), ["grp"], "value", {f"q{int(p * 100)}": p for p in _QUANTILES})


@query("distribution_comparison", f"""WITH t(bin, f) AS (VALUES {', '.join(f'({i}, {f}::DOUBLE)' for i, (_, _, f) in enumerate(_HISTO))}), a AS (SELECT {_BIN} AS bin, count(*) AS n FROM events GROUP BY 1)
 SELECT t.bin, coalesce(n, 0) AS actual, {q6('coalesce(n, 0) / (SELECT count(*) FROM events)')} AS frequency, {q6('coalesce(n, 0) / (SELECT count(*) FROM events) - f')} AS error FROM t LEFT JOIN a USING (bin)""")
def distribution_comparison(spark, sf):
    return _comparison(spark, sf).select("bin", "actual", r6(F.col("frequency")).alias("frequency"), r6(F.col("error")).alias("error"))


def _comparison(spark, sf):
    e = table(spark, sf, "events")
    b = F.lit(None).cast("int")
    for i, (lo, hi, _) in reversed(list(enumerate(_HISTO))):
        b = F.when((F.col("value") >= lo) & (F.col("value") < hi), F.lit(i)).otherwise(b)
    target = spark.createDataFrame([(i, f) for i, (_, _, f) in enumerate(_HISTO)], "bin int, f double")
    n = e.count()
    counts = e.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    j = target.join(counts, "bin", "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return j.withColumn("frequency", F.col("actual") / n).withColumn("error", F.col("frequency") - F.col("f"))


@query("distribution_summary", f"""WITH t(bin, f) AS (VALUES {', '.join(f'({i}, {f}::DOUBLE)' for i, (_, _, f) in enumerate(_HISTO))}), a AS (SELECT {_BIN} AS bin, count(*) AS n FROM events GROUP BY 1),
 e AS (SELECT abs(coalesce(n, 0) / (SELECT count(*) FROM events) - f) AS e FROM t LEFT JOIN a USING (bin)) SELECT {q6('max(e)')} AS max_error, {q6('sum(e) / 2')} AS total_variation FROM e""")
def distribution_summary(spark, sf):
    return _comparison(spark, sf).agg(r6(F.max(F.abs("error"))).alias("max_error"), r6(F.sum(F.abs("error")) / 2).alias("total_variation"))


@query("size_class_report", f"""WITH c AS (SELECT greatest(least(CAST(floor((value - 20) / (200::DOUBLE / 8)) AS INT), 7), 0) AS class, event_type <> 'error' AS placed FROM events), p AS (SELECT class, count(*) AS drawn, CAST(sum(CAST(placed AS INT)) AS BIGINT) AS placed FROM c GROUP BY class)
 SELECT CAST(k.class AS INT) AS class, coalesce(drawn, 0) AS drawn, coalesce(placed, 0) AS placed, coalesce(drawn, 0) - coalesce(placed, 0) AS shortfall, CAST(round((SELECT count(*) FROM events) / 8) AS BIGINT) AS target FROM (SELECT unnest(range(8)) AS class) k LEFT JOIN p USING (class)""")
def size_class_report(spark, sf):
    """Drawn, placed and missing particles per size class, every class present."""
    e = table(spark, sf, "events")
    n = e.count()
    per = e.groupBy(size_classes(e, "value", 20.0, 220.0, 8).alias("class")).agg(F.count("*").alias("drawn"), F.sum((F.col("event_type") != "error").cast("bigint")).alias("placed"))
    every = spark.range(8).select(F.col("id").cast("int").alias("class"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return every.join(per, "class", "left").select("class", z("drawn").alias("drawn"), z("placed").alias("placed"), (z("drawn") - z("placed")).alias("shortfall"), F.round(F.lit(n) / 8).cast("bigint").alias("target"))


@query("tet_only_points", f"WITH {D.KUHN_SQL}, n AS (SELECT mesh_id, cid, unnest([na, nb, nc, nd]) AS pid FROM tets) SELECT mesh_id, count(DISTINCT cid) AS cells, count(DISTINCT pid) AS points FROM n GROUP BY mesh_id")
def tet_only_points(spark, sf):
    """Tetrahedra of a grid with their points, other cell types dropped."""
    cells = D.kuhn_tets(D.cubes(spark, sf)).select("mesh_id", "cid", "vtk_type", "nodes")
    faces = cells.select("mesh_id", (-F.col("cid") - 1).alias("cid"), F.lit(scene.TRIANGLE).alias("vtk_type"), F.slice("nodes", 1, 3).alias("nodes"))
    only = scene.volume_only(cells.unionByName(faces))
    pts = only.select("mesh_id", "cid", F.explode("nodes").alias("pid"))
    c = only.groupBy("mesh_id").agg(F.count("*").alias("cells"))
    return c.join(pts.select("mesh_id", "pid").distinct().groupBy("mesh_id").agg(F.count("*").alias("points")), "mesh_id")


@query("shading", f"SELECT p_partkey, {q6('0.25 + 0.75 * abs(sin(p_size))')} AS light FROM part")
def shading(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(scene.shade(F.abs(F.sin("p_size")), 0.25)).alias("light"))


_Z = lambda x: "0.5 * " + _erfc(f"(-((ln({x}) - mu) / sg) / sqrt(2))")


@query("lognormal_class_shares", f"""WITH o AS (SELECT avg(ln(o_totalprice)) AS mu, stddev_pop(ln(o_totalprice)) AS sg, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 c AS (SELECT *, unnest(range(8)) AS class FROM o), e AS (SELECT class, mu, sg, lo, hi, lo + (hi - lo) * class / 8 AS l, lo + (hi - lo) * (class + 1) / 8 AS r FROM c)
 SELECT CAST(class AS INT) AS class, {q6(f"(({_Z('r')}) - ({_Z('l')})) / (({_Z('hi')}) - ({_Z('lo')}))")} AS share FROM e""")
def lognormal_class_shares(spark, sf):
    """Expected share of each size class under the lognormal fitted to order totals."""
    o = table(spark, sf, "orders").agg(F.avg(F.ln("o_totalprice")).alias("mu"), F.stddev_pop(F.ln("o_totalprice")).alias("sg"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    c = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("class"))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 8
    z = lambda x: stats.normal_cdf_cheb((F.ln(x) - F.col("mu")) / F.col("sg"))
    inside = z(F.col("hi")) - z(F.col("lo"))
    return c.select("class", r6((z(edge(F.col("class") + 1)) - z(edge(F.col("class")))) / inside).alias("share"))
