"""Population filters, statistics, size plans and reports on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as B
from ..functions import solids as S
from ..functions import stats
from ..functions.rng import u01, u01_sql
from ..operators import meshes, ordered, placement, population
from ..session import cut, q6 as r6
from . import derive as D
from .derive import q6
from .registry import query, table

_FLUX = "(ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)) / 6"
_AREA = ("sqrt(((by - ay) * (cz - az) - (bz - az) * (cy - ay)) ** 2 + ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) ** 2"
         " + ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) ** 2) / 2")
_EXT = ", ".join(f"max(greatest(a{k}, b{k}, c{k})) - min(least(a{k}, b{k}, c{k}))" for k in "xyz")
_SHAPES = f"""sh AS (SELECT part, abs(sum({_FLUX})) AS v, sum({_AREA}) AS a, greatest({_EXT}) / greatest(least({_EXT}), 1e-12) AS aspect FROM tri GROUP BY part),
 st AS (SELECT *, a * a * a / (36 * pi() * v * v) AS sharp FROM sh)"""


def _shapes(spark, sf):
    tri = D.triangles(D.bodies(spark, sf))
    m = meshes.measures(tri, ["part"]).join(meshes.bbox(tri, ["part"]), "part")
    return m.select("part", "volume", "area", B.aspect_ratio(B.box()).alias("aspect"), S.sharpness(F.col("volume"), F.col("area")).alias("sharp"))


def _rules():
    return [("aspect", F.col("aspect") <= 2.0), ("sharpness", F.col("sharp") <= 2.2), ("volume", (F.col("volume") >= 0.5) & (F.col("volume") <= 6.0))]


@query("filter_chain", f"""WITH {D.TRI_SQL}, {_SHAPES} SELECT part, {q6('v')} AS volume FROM st WHERE aspect <= 2 AND sharp <= 2.2 AND v >= 0.5 AND v <= 6""")
def filter_chain(spark, sf):
    kept, _ = population.filter_chain(_shapes(spark, sf), _rules())
    return kept.select("part", r6(F.col("volume")).alias("volume"))


@query("filter_report", f"""WITH {D.TRI_SQL}, {_SHAPES}, f AS (SELECT aspect <= 2 AS k0, sharp <= 2.2 AS k1, v >= 0.5 AND v <= 6 AS k2 FROM st)
 SELECT 0 AS step, 'aspect' AS rule, count(*) AS before, CAST(sum(CAST(k0 AS INT)) AS BIGINT) AS after FROM f
 UNION ALL SELECT 1, 'sharpness', CAST(sum(CAST(k0 AS INT)) AS BIGINT), CAST(sum(CAST(k0 AND k1 AS INT)) AS BIGINT) FROM f
 UNION ALL SELECT 2, 'volume', CAST(sum(CAST(k0 AND k1 AS INT)) AS BIGINT), CAST(sum(CAST(k0 AND k1 AND k2 AS INT)) AS BIGINT) FROM f""")
def filter_report(spark, sf):
    return population.filter_chain(_shapes(spark, sf), _rules())[1]


@query("library_reasons", f"""WITH {D.TRI_SQL}, {_SHAPES} SELECT part, CASE WHEN v < 1 THEN 'min_volume' WHEN aspect > 2 THEN 'max_aspect_ratio' WHEN sharp > 2.2 THEN 'max_sharpness_ratio' END AS reason FROM st""")
def library_reasons(spark, sf):
    r = population.first_reason([("min_volume", F.col("volume") < 1.0), ("max_aspect_ratio", F.col("aspect") > 2.0), ("max_sharpness_ratio", F.col("sharp") > 2.2)])
    return _shapes(spark, sf).select("part", r.alias("reason"))


@query("population_summary", f"""SELECT o_orderpriority AS grp, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, {q6('avg(o_totalprice)')} AS mean, {q6('median(o_totalprice)')} AS median FROM orders GROUP BY ALL""")
def population_summary(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "grp")
    s = population.summary(o, "o_totalprice", ["grp"])
    return s.select("grp", "n", "min", "max", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"))


_HIST = """e AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY ALL),
 b AS (SELECT p_brand, lo, hi, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE greatest(least(CAST(floor((p_retailprice - lo) / ((hi - lo) / 12)) AS INT), 11), 0) END AS bin FROM part JOIN e USING (p_brand))"""


@query("histogram", f"WITH {_HIST} SELECT p_brand, bin, {q6('lo + bin * (hi - lo) / 12')} AS \"left\", count(*) AS n FROM b GROUP BY p_brand, bin, lo, hi")
def histogram(spark, sf):
    h = population.histogram(table(spark, sf, "part"), "p_retailprice", 12, ["p_brand"])
    return h.select("p_brand", "bin", r6(F.col("left")).alias("left"), "n")


@query("histogram_comparison", f"""WITH {D.TRI_SQL}, {_SHAPES}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM st),
 b AS (SELECT greatest(least(CAST(floor((v - lo) / ((hi - lo) / 12)) AS INT), 11), 0) AS bin, aspect <= 2 AS kept FROM st, e)
 SELECT bin, count(*) AS before, CAST(sum(CAST(kept AS INT)) AS BIGINT) AS after FROM b GROUP BY bin""")
def histogram_comparison(spark, sf):
    """Volumes before and after the aspect filter on common bins."""
    s = cut(_shapes(spark, sf))
    e = s.agg(F.min("volume").alias("lo"), F.max("volume").alias("hi")).first()
    b = stats.bin_index(F.col("volume"), F.lit(e["lo"]), F.lit(e["hi"]), 12)
    return s.groupBy(b.alias("bin")).agg(F.count("*").alias("before"), F.sum((F.col("aspect") <= 2.0).cast("bigint")).alias("after"))


def _erf(x):
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
    poly = f"(((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t})"
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - {poly} * exp(-({x}) * ({x}))))"


def _cdf(x):
    return f"(0.5 * (1 + {_erf(f'(({x}) / sqrt(2))')}))"


@query("lognormal_rebalance", f"""WITH f AS (SELECT count(*) AS n, avg(ln(o_totalprice)) AS mu, greatest(sqrt(var_pop(ln(o_totalprice))), 1e-9) AS sg, min(ln(o_totalprice)) AS lo, max(ln(o_totalprice)) AS hi FROM orders),
 b AS (SELECT o_orderkey, n, mu, sg, lo, (hi - lo) / 12 AS w, greatest(least(CAST(floor((ln(o_totalprice) - lo) / ((hi - lo) / 12)) AS INT), 11), 0) AS bin FROM orders, f),
 r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {u01_sql(0, "rebalance", "o_orderkey")}, o_orderkey) AS rk FROM b),
 a AS (SELECT *, ceil(ceil(greatest({_cdf('(lo + bin * w + w - mu) / sg')} - {_cdf('(lo + bin * w - mu) / sg')}, 0) * n) * 1.25) AS allowed FROM r)
 SELECT o_orderkey, bin, rk <= allowed AS keep FROM a""")
def lognormal_rebalance(spark, sf):
    r = population.lognormal_rebalance(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])
    return r.select("o_orderkey", "bin", "keep")


def _poly(x, cs):
    e = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        e = f"({e} * {x} + {c!r}::DOUBLE)"
    return e


@query("inverse_normal_cdf", f"""WITH p AS (SELECT o_orderkey, {u01_sql(3, 'size', 'o_orderkey')} AS p FROM orders), q AS (SELECT o_orderkey, p, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c,
 sqrt(-ln(least(p, 1 - p))) AS r FROM p WHERE p > 0), v AS (SELECT o_orderkey, q, CASE WHEN abs(q) <= 0.425 THEN q * {_poly('c', stats.AS241_CENTRAL_NUM)} / {_poly('c', stats.AS241_CENTRAL_DEN)}
 WHEN r <= 5 THEN sign(q) * {_poly('(r - 1.6::DOUBLE)', stats.AS241_MIDDLE_NUM)} / {_poly('(r - 1.6::DOUBLE)', stats.AS241_MIDDLE_DEN)}
 ELSE sign(q) * {_poly('(r - 5)', stats.AS241_TAIL_NUM)} / {_poly('(r - 5)', stats.AS241_TAIL_DEN)} END AS x FROM q) SELECT o_orderkey, {q6('x')} AS quantile FROM v""")
def inverse_normal_cdf(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", u01(3, "size", F.col("o_orderkey")).alias("p")).filter("p > 0")
    return o.select("o_orderkey", r6(stats.inverse_normal_cdf(F.col("p"))).alias("quantile"))


def _erfc(x):
    t = f"(1 / (1 + 0.5 * abs({x})))"
    y = f"({t} * exp(-({x}) * ({x}) + {_poly(t, stats.ERFC_CHEB)}))"
    return f"(CASE WHEN {x} < 0 THEN 2 - {y} ELSE {y} END)"


@query("normal_cdf", f"SELECT event_id, {q6(_cdf('((value - 100) / 50)'))} AS poly, {q6('0.5 * ' + _erfc('(-((value - 100) / 50) / sqrt(2))'))} AS cheb FROM events")
def normal_cdf(spark, sf):
    x = (F.col("value") - 100) / 50
    return table(spark, sf, "events").select("event_id", r6(stats.normal_cdf_poly(x)).alias("poly"), r6(stats.normal_cdf_cheb(x)).alias("cheb"))


@query("size_classes", f"""WITH c AS (SELECT event_id, value, greatest(least(CAST(floor((value - 20) / (200::DOUBLE / 8)) AS INT), 7), 0) AS class FROM events)
 SELECT class, count(*) AS drawn, {q6('avg(value)')} AS mean FROM c GROUP BY class""")
def size_classes(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(population.size_classes(e, "value", 20.0, 220.0, 8).alias("class")).agg(F.count("*").alias("drawn"), r6(F.avg("value")).alias("mean"))


_HISTO = [(0.0, 10.0, 0.1), (10.0, 25.0, 0.35), (25.0, 60.0, 0.3), (60.0, 120.0, 0.2), (120.0, 200.0, 0.05)]


@query("cumulative_sampling", f"""WITH b(lo, hi, f) AS (VALUES {', '.join(str(r) for r in _HISTO)}), c AS (SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, (sum(f::DOUBLE) OVER (ORDER BY lo) - f::DOUBLE) / sum(f::DOUBLE) OVER () AS c0, (sum(f::DOUBLE) OVER (ORDER BY lo)) / sum(f::DOUBLE) OVER () AS c1 FROM b),
 d AS (SELECT o_orderkey, {u01_sql(5, 'bin', 'o_orderkey')} AS u, {u01_sql(5, 'inside', 'o_orderkey')} AS w FROM orders)
 SELECT o_orderkey, {q6('lo + w * (hi - lo)')} AS diameter FROM d JOIN c ON u >= c0 AND u < c1""")
def cumulative_sampling(spark, sf):
    """Diameters drawn from a histogram: the bin by cumulative share, then uniform inside it."""
    bins = spark.createDataFrame(_HISTO, "lo double, hi double, f double")
    table_ = [r.asDict() for r in population.cumulative_bins(bins, "lo", "f").orderBy("lo").collect()]
    u, w = F.col("u"), F.col("w")
    size = F.lit(None).cast("double")
    for r in reversed(table_):
        size = F.when((u >= r["c0"]) & (u < r["c1"]), F.lit(r["lo"]) + w * (r["hi"] - r["lo"])).otherwise(size)
    d = table(spark, sf, "orders").select("o_orderkey", u01(5, "bin", F.col("o_orderkey")).alias("u"), u01(5, "inside", F.col("o_orderkey")).alias("w"))
    return d.select("o_orderkey", r6(size).alias("diameter"))


@query("largest_remainder", """WITH w AS (SELECT p_brand, sum(p_size) AS w FROM part GROUP BY p_brand), s AS (SELECT *, w * 1000::DOUBLE / sum(w) OVER () AS x FROM w),
 r AS (SELECT *, floor(x) AS b, 1000 - sum(floor(x)) OVER () AS spare, row_number() OVER (ORDER BY floor(x) - x, p_brand) AS rk FROM s)
 SELECT p_brand, CAST(b + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def largest_remainder(spark, sf):
    w = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("w"))
    return population.largest_remainder(w, "w", "p_brand", 1000).select("p_brand", "quota")


@query("size_plan", """WITH t AS (SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) * 0.4 AS target FROM orders), r AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v,
 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey) AS BIGINT) AS running FROM orders)
 SELECT o_orderkey, running FROM r, t WHERE running < target OR (running - v < target AND running - target <= target - (running - v))""")
def size_plan(spark, sf):
    """Draws taken in order until the planned volume is closest to 40 % of the whole."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    target = float(o.agg(F.sum("v")).first()[0]) * 0.4
    return placement.stop_at_target(o, "v", target).select(F.col("order").alias("o_orderkey"), F.col("running_volume").alias("running"))


@query("placement_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def placement_order(spark, sf):
    return ordered.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("rejection_funnel", f"""WITH {D.BOXES_SQL}, r AS (SELECT CASE WHEN NOT ({' AND '.join(f'{k}0 >= 5.5 AND {k}1 <= 94.5' for k in 'xyz')}) THEN 'outside_domain' WHEN status = 'P' THEN 'inside_void' END AS reason FROM boxes)
 SELECT n.reason, count(r.reason) AS rejected FROM (VALUES ('outside_domain'), ('inside_void'), ('clip_too_shallow')) n(reason) LEFT JOIN r USING (reason) GROUP BY n.reason""")
def rejection_funnel(spark, sf):
    b = D.bodies(spark, sf).select("part", "status", *B.columns(B.Box(*((D.F.col("cx") + s * D.F.col("hx"), D.F.col("cy") + s * D.F.col("hy"), D.F.col("cz") + s * D.F.col("hz")) for s in (-1, 1)))))
    reason = placement.unary_reason(B.lit_box((5, 5, 5), (95, 95, 95)), B.box(), "strict", margin=0.5, in_void=F.col("status") == "P")
    return population.funnel(b.withColumn("reason", reason), "reason", ["outside_domain", "inside_void", "clip_too_shallow"])


@query("triangle_ranges", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 8 END AS faces, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)
 SELECT 'p' || lpad(CAST(k - 1 AS VARCHAR), 6, '0') AS entity_id, CAST(sum(faces) OVER w - faces AS BIGINT) AS tri_start, CAST(sum(faces) OVER w AS BIGINT) AS tri_end FROM r WINDOW w AS (ORDER BY o_orderkey)""")
def triangle_ranges(spark, sf):
    b = D.bodies(spark, sf).select(F.col("part").alias("order"), F.when(F.col("kind") == 0, 12).otherwise(8).cast("bigint").alias("faces"), F.lit(1).alias("one"))
    t = ordered.running(b, [], ["order"], {"tri_end": "faces", "k": "one"})
    return t.select(placement.entity_id(F.col("k") - 1).alias("entity_id"), (F.col("tri_end") - F.col("faces")).alias("tri_start"), "tri_end")


@query("upper_middle", "SELECT o_orderpriority AS grp, o_totalprice AS upper_middle FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = n // 2")
def upper_middle(spark, sf):
    return ordered.upper_middle(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "grp"), ["grp"], "o_totalprice")


@query("population_spread", f"SELECT {q6('stddev_samp(ln(o_totalprice))')} AS sigma_log, {q6('avg(o_totalprice)')} AS mean FROM orders")
def population_spread(spark, sf):
    return table(spark, sf, "orders").agg(r6(F.stddev_samp(F.ln("o_totalprice"))).alias("sigma_log"), r6(F.avg("o_totalprice")).alias("mean"))


@query("remaining_draws", """WITH a AS (SELECT l_quantity, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_quantity, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
 SELECT l_quantity, l_linenumber, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS n FROM a LEFT JOIN b USING (l_quantity, l_linenumber) WHERE a.n > coalesce(b.n, 0)""")
def remaining_draws(spark, sf):
    """Planned draws left after those already placed, as a multiset difference."""
    li = table(spark, sf, "lineitem")
    rest = placement.multiset_except(li, li.filter("l_returnflag = 'R'"), ["l_quantity", "l_linenumber"])
    return rest.groupBy("l_quantity", "l_linenumber").agg(F.count("*").alias("n"))


@query("bed_profile", f"WITH {D.BODIES_SQL}, e AS (SELECT min(cz) AS lo, max(cz) AS hi FROM bodies), s AS (SELECT greatest(least(CAST(floor((cz - lo) / ((hi - lo) / 20)) AS INT), 19), 0) AS slab, 8 * hx * hy * hz AS v FROM bodies, e) SELECT slab, count(*) AS bodies, {q6('sum(v)')} AS volume FROM s GROUP BY slab")
def bed_profile(spark, sf):
    """Solid volume in 20 slabs of the bed height."""
    b = D.bodies(spark, sf)
    e = b.agg(F.min("cz").alias("lo"), F.max("cz").alias("hi")).first()
    slab = stats.bin_index(F.col("cz"), F.lit(e["lo"]), F.lit(e["hi"]), 20)
    return b.groupBy(slab.alias("slab")).agg(F.count("*").alias("bodies"), r6(F.sum(8 * F.col("hx") * F.col("hy") * F.col("hz"))).alias("volume"))


_RECORD = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("translation", T.ArrayType(T.DoubleType())), T.StructField("size_class", T.LongType())])


@query("record_round_trip", f"""WITH {D.BODIES_SQL} SELECT 'p' || lpad(CAST(part AS VARCHAR), 6, '0') AS entity_id, {q6('cx')} AS tx, CAST(part % 7 AS BIGINT) AS size_class FROM bodies""")
def record_round_trip(spark, sf):
    """Particle records written as JSON and read back."""
    b = D.bodies(spark, sf).select(F.to_json(F.struct(placement.entity_id(F.col("part")).alias("entity_id"), F.array("cx", "cy", "cz").alias("translation"), (F.col("part") % 7).alias("size_class"))).alias("j"))
    r = b.select(F.from_json("j", _RECORD).alias("r"))
    return r.select("r.entity_id", r6(F.col("r.translation")[0]).alias("tx"), "r.size_class")


@query("digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
