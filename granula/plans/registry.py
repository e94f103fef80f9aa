"""The reference-scope operators as queries over the driver's tables, each with its SQL.

Most work on the plane view of `embeddings` (first two components) with a given partition into 40
granules, so that closed forms in SQL can check them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import dpc, granule, labels, natural, scale, score, split
from granula.plans import pipelines
from granula.sources import io

K, LAMBDA, BINS = 6, 4, 12


class View:
    """The fixture relations of one table folder; what several steps share is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def p(self):
        return io.plane(io.load(self.spark, self.dir))

    @cached_property
    def gr(self):
        return durable(granule.granules(self.p))

    @cached_property
    def pr(self):
        return durable(dpc.mahalanobis_pairs(self.gr))

    @cached_property
    def dp(self):
        return durable(dpc.attributes(self.gr, self.pr))

    @cached_property
    def ce(self):
        return durable(dpc.top_k(self.dp, K))

    @cached_property
    def la(self):
        return durable(labels.propagate(self.dp, self.ce, self.pr))

    @cached_property
    def gv(self):
        return durable(labels.graph_vote(self.dp, self.pr, self.la, self.ce, 1.05))

    @cached_property
    def kn(self):
        return durable(natural.ranks(self.pr))

    @cached_property
    def ed(self):
        return durable(natural.edges(self.kn, LAMBDA))

    @cached_property
    def unit(self):
        return scale.column_minmax(self.p, ["x", "y"])

    @cached_property
    def contingency(self):
        pts = self.p.select("id", "label", "g").join(self.la.withColumnRenamed("label", "pred"), "g")
        return score.contingency(pts)

    @cached_property
    def paired(self):
        n = self.table("supplier").selectExpr("s_nationkey % 5 as test", "s_acctbal as a", "s_suppkey * 10.0 as b")
        return n


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to significant digits that both engines agree on; -0.0 is 0.0."""
    out = []
    for name, kind in df.dtypes:
        out.append((F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name))
    return df.select(*out)


R = "round({}, 6) + 0.0 AS {}"


def r(*cols: str) -> str:
    """SQL for rounded columns; 'expression AS name' or a name."""
    out = []
    for c in cols:
        e, _, n = c.rpartition(" AS ")
        out.append(R.format(e or n, n))
    return ", ".join(out)


BASE = f"""
WITH RECURSIVE
p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label, (label * 4 + vec_id % 4)::BIGINT AS g FROM embeddings),
mo AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy, covar_pop(x, x) + 1e-6 AS a, covar_pop(x, y) AS b, covar_pop(y, y) + 1e-6 AS c FROM p GROUP BY g),
me AS (SELECT *, greatest((c * (x - cx) * (x - cx) - 2 * b * (x - cx) * (y - cy) + a * (y - cy) * (y - cy)) / (a * c - b * b), 0) AS m2 FROM p JOIN mo USING (g)),
g0 AS (SELECT g, n, cx, cy, a, b, c, a * c - b * b AS det, sqrt(max(m2)) AS rho, sum(sqrt(m2)) AS ms FROM me GROUP BY ALL),
g1 AS (SELECT *, greatest((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 1e-12) AS e1, greatest((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 1e-12) AS e2 FROM g0),
g2 AS (SELECT *, rho * sqrt(e1) AS l1, rho * sqrt(e2) AS l2 FROM g1),
gr AS (SELECT *, n * n / (greatest(l1 + l2, 1e-12) * greatest(ms, 1e-12)) AS density FROM g2),
pa AS (SELECT u.g AS i, v.g AS j, u.cx - v.cx AS dx, u.cy - v.cy AS dy, (u.a + v.a) / 2 AS a, (u.b + v.b) / 2 AS b, (u.c + v.c) / 2 AS c, greatest(u.l1, u.l2) + greatest(v.l1, v.l2) AS reach FROM gr u JOIN gr v ON u.g <> v.g),
pr AS (SELECT i, j, sqrt(greatest((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b), 0)) AS d FROM pa),
pe AS (SELECT i, j, sqrt(dx * dx + dy * dy) AS d FROM pa),
od AS (SELECT g, density AS rho, row_number() OVER (ORDER BY density DESC, g) AS pos FROM gr),
cd AS (SELECT pr.i, pr.j, d, u.rho, v.rho AS rho_j, u.pos, v.pos AS pos_j FROM pr JOIN od u ON u.g = i JOIN od v ON v.g = j),
hi AS (SELECT i AS g, min(d) AS d, arg_min(j, d) AS parent FROM cd WHERE rho_j > rho GROUP BY i),
dp AS (SELECT od.g, rho, CASE WHEN d IS NOT NULL THEN d WHEN pos = 1 THEN (SELECT max(d) FROM hi) ELSE 0 END AS delta, parent, pos FROM od LEFT JOIN hi ON hi.g = od.g),
ga AS (SELECT *, rho * delta AS gamma, row_number() OVER (ORDER BY rho * delta DESC, g) AS pick FROM dp),
ce AS (SELECT g, (pick - 1)::INT AS label FROM ga WHERE pick <= {K}),
nc AS (SELECT i AS g, arg_min(label, d) AS near FROM pr JOIN ce ON ce.g = j GROUP BY i),
ch AS (SELECT g, g AS at FROM dp UNION ALL SELECT ch.g, dp.parent FROM ch JOIN dp ON dp.g = ch.at WHERE dp.parent IS NOT NULL AND ch.at NOT IN (SELECT g FROM ce)),
cl AS (SELECT ch.g, any_value(ce.label) AS label FROM ch JOIN ce ON ce.g = ch.at GROUP BY ch.g),
la AS (SELECT dp.g, coalesce(cl.label, near, 0)::INT AS label FROM dp LEFT JOIN cl ON cl.g = dp.g LEFT JOIN nc ON nc.g = dp.g),
kn AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pr),
mk AS (SELECT x.i, x.j, x.d, x.r, y.r AS s, greatest(x.r, y.r) AS m FROM kn x JOIN kn y ON y.i = x.j AND y.j = x.i),
e0 AS (SELECT i, j, d, r, s, false AS is_fallback FROM mk WHERE m <= {LAMBDA}),
ed AS (SELECT * FROM e0 UNION ALL SELECT i, j, d, r, s, true FROM mk WHERE r = 1 AND i NOT IN (SELECT i FROM e0)),
ra AS (SELECT i AS g, count(*) AS degree, max(d) AS radius, greatest(coalesce(median(CASE WHEN d > 0 THEN d END), 1e-12), 1e-12) AS scale FROM ed GROUP BY i),
si AS (SELECT ed.*, 0.7 * exp(-(d * d) / (u.scale * v.scale)) + 0.3 / (1 + r + s) AS sim FROM ed JOIN ra u ON u.g = i JOIN ra v ON v.g = j),
vo AS (SELECT i, label, sum(rho_j / (d + 1e-9 * (SELECT median(d) FROM pr WHERE d > 0))) AS v, min(k) AS first
  FROM (SELECT cd.*, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM cd WHERE rho_j > rho) JOIN la ON la.g = j
  WHERE k <= greatest(2, ceil(log2((SELECT count(*) FROM gr)))) GROUP BY i, label),
vb AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, first) AS o FROM vo),
gv AS (SELECT la.g, CASE WHEN ce.g IS NULL AND b.v > 1.05 * greatest(coalesce(w.v, 0), 1e-12) THEN b.label ELSE la.label END AS label
  FROM la LEFT JOIN vo w ON w.i = la.g AND w.label = la.label LEFT JOIN vb b ON b.i = la.g AND b.o = 1 LEFT JOIN ce ON ce.g = la.g),
re AS (SELECT label, arg_max(dp.g, rho) AS g, max(rho) AS rho FROM dp JOIN la ON la.g = dp.g GROUP BY label),
rp AS (SELECT u.label AS li, v.label AS lj, d FROM pr JOIN re u ON u.g = i JOIN re v ON v.g = j WHERE u.label < v.label),
sz AS (SELECT label, count(*) AS m FROM la GROUP BY label),
ct AS (SELECT p.label AS t, la.label AS p, count(*) AS n FROM p JOIN la ON la.g = p.g GROUP BY ALL),
f1 AS (SELECT me.g, id, x, y, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d FROM me),
f2 AS (SELECT g, arg_min(x, (d, id)) AS qx, arg_min(y, (d, id)) AS qy FROM f1 GROUP BY g),
f3 AS (SELECT p.g, arg_max(id, ((x - qx) * (x - qx) + (y - qy) * (y - qy), -id)) AS i2, arg_max(x, ((x - qx) * (x - qx) + (y - qy) * (y - qy), -id)) AS p2x, arg_max(y, ((x - qx) * (x - qx) + (y - qy) * (y - qy), -id)) AS p2y FROM p JOIN f2 ON f2.g = p.g GROUP BY p.g),
ep AS (SELECT p.g, any_value(i2) AS p2_id, any_value(p2x) AS p2x, any_value(p2y) AS p2y, arg_max(id, ((x - p2x) * (x - p2x) + (y - p2y) * (y - p2y), -id)) AS p3_id, arg_max(x, ((x - p2x) * (x - p2x) + (y - p2y) * (y - p2y), -id)) AS p3x, arg_max(y, ((x - p2x) * (x - p2x) + (y - p2y) * (y - p2y), -id)) AS p3y FROM p JOIN f3 ON f3.g = p.g GROUP BY p.g),
s0 AS (SELECT p.g, id, x, y, CASE WHEN (x - p2x) * (x - p2x) + (y - p2y) * (y - p2y) < (x - p3x) * (x - p3x) + (y - p3y) * (y - p3y) THEN 0 ELSE 1 END AS child FROM p JOIN ep ON ep.g = p.g),
sp AS (SELECT * FROM s0 QUALIFY sum(child) OVER (PARTITION BY g) BETWEEN 1 AND count(*) OVER (PARTITION BY g) - 1),
km AS (SELECT g, child, avg(x) AS cx, avg(y) AS cy, covar_pop(x, x) + 1e-6 AS a, covar_pop(x, y) AS b, covar_pop(y, y) + 1e-6 AS c FROM sp GROUP BY g, child),
s1 AS (SELECT sp.g, id, x, y, CASE WHEN max(CASE WHEN km.child = 0 THEN q END) < max(CASE WHEN km.child = 1 THEN q END) THEN 0 ELSE 1 END AS child
  FROM (SELECT sp.*, km.child AS kc, greatest((c * (x - cx) * (x - cx) - 2 * b * (x - cx) * (y - cy) + a * (y - cy) * (y - cy)) / (a * c - b * b), 0) AS q, km.child FROM sp JOIN km ON km.g = sp.g) sp(g, id, x, y, was, kc, q, c2), LATERAL (SELECT kc AS child) km GROUP BY sp.g, id, x, y),
se AS (SELECT * FROM s1 QUALIFY sum(child) OVER (PARTITION BY g) BETWEEN 1 AND count(*) OVER (PARTITION BY g) - 1),
b0 AS (SELECT g, id, sqrt(d) AS d, abs(x - cx) + abs(y - cy) AS e FROM f1 JOIN mo USING (g)),
ba AS (SELECT g, count(*) AS n, max(d) AS r, avg(d) AS dm, avg(e / 2) AS mr FROM b0 GROUP BY g),
u AS (SELECT id, label, g, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM p),
gc AS (SELECT *, least({BINS - 1}, greatest(0, floor(x * {BINS})))::INT AS kx, least({BINS - 1}, greatest(0, floor(y * {BINS})))::INT AS ky FROM u),
oc AS (SELECT kx, ky, count(*) AS n, avg(x) AS mx, avg(y) AS my, min(id) AS first FROM gc GROUP BY kx, ky),
ad AS (SELECT o.kx, o.ky, q.kx AS nx, q.ky AS ny FROM oc o JOIN oc q ON abs(o.kx - q.kx) <= 1 AND abs(o.ky - q.ky) <= 1 AND (o.kx <> q.kx OR o.ky <> q.ky)),
rc AS (SELECT kx * {BINS} + ky AS u, kx * {BINS} + ky AS v FROM oc UNION SELECT rc.u, nx * {BINS} + ny FROM rc JOIN ad ON ad.kx * {BINS} + ad.ky = rc.v),
gp AS (SELECT u // {BINS} AS kx, u % {BINS} AS ky, min(v)::INT AS component FROM rc GROUP BY u)
"""

#: name -> (query of a View, SQL behind BASE or a whole statement)
ALL: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        ALL[name] = (f, sql)
        return f

    return put


# Sources and column transforms.
query("scan_points", f"SELECT vec_id AS point_id, label, len(embedding)::INT AS dims, {r('embedding[1]::DOUBLE AS first')} FROM embeddings")(
    lambda v: io.load(v.spark, v.dir).select("point_id", "label", F.size("features").alias("dims"), F.col("features")[0].alias("first"))
)
query("scan_text_matrix", "SELECT s_suppkey AS point_id, round(s_acctbal, 6) + 0.0 AS x, (s_suppkey * 1.0)::DOUBLE AS y FROM supplier")(
    lambda v: io.parse_matrix(v.table("supplier").select(F.col("s_suppkey").alias("point_id"), F.format_string("  %.6f\t%d ", "s_acctbal", "s_suppkey").alias("value"))).selectExpr("point_id", "features[0] as x", "features[1] as y")
)
query("scan_comma_matrix", "SELECT p_partkey AS point_id, p_size::DOUBLE AS x, round(p_retailprice, 2) + 0.0 AS y FROM part")(
    lambda v: io.parse_matrix(v.table("part").select(F.col("p_partkey").alias("point_id"), F.format_string("%d,%.2f", "p_size", "p_retailprice").alias("value")), ",").selectExpr("point_id", "features[0] as x", "features[1] as y")
)
query("scan_labels", "SELECT p_partkey AS point_id, p_size AS label FROM part")(
    lambda v: io.labels(v.table("part").select(F.col("p_partkey").alias("point_id"), F.format_string(" %d.0", "p_size").alias("value"))).select("point_id", "label")
)
query("row_ids", "SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1)::BIGINT AS point_id, l_orderkey, l_linenumber FROM lineitem")(
    lambda v: io.number_by(v.table("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").select("point_id", "l_orderkey", "l_linenumber")
)
query("validate_points", "SELECT count(*) AS rows, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_width, count(*) FILTER (WHERE len(list_filter(embedding, lambda e: NOT isfinite(e))) > 0) AS not_finite FROM embeddings")(lambda v: io.validate(io.load(v.spark, v.dir), 64))
query("align_labels", "SELECT vec_id AS point_id, label FROM embeddings")(lambda v: io.align(io.load(v.spark, v.dir).drop("label"), io.load(v.spark, v.dir).select("point_id", "label")).select("point_id", "label"))
query("matrix_lines", "SELECT printf('%.10f %.10f', p_size::DOUBLE, p_retailprice) AS value FROM part")(lambda v: io.matrix_lines(v.table("part").select(F.array(F.col("p_size").cast("double"), "p_retailprice").alias("features"))))

_XY = ["x", "y"]
_KEY = ["id", "x", "y"]
query("scale_none", BASE + f"SELECT id, {r('x', 'y')} FROM p")(lambda v: scale.scale(v.p, _XY, " None ").select(*_KEY))
query("scale_standard", BASE + f"SELECT id, {r('(x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x', '(y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y')} FROM p")(lambda v: scale.scale(v.p, _XY, "standard").select(*_KEY))
query("scale_minmax", BASE + f"SELECT id, {r('x', 'y')} FROM u")(lambda v: scale.scale(v.p, _XY, "minmax").select(*_KEY))
query("scale_robust", BASE + ", q AS (SELECT quantile_cont(x, 0.25) AS x1, median(x) AS x2, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1, median(y) AS y2, quantile_cont(y, 0.75) AS y3 FROM p) " + f"SELECT id, {r('(x - x2) / (x3 - x1) AS x', '(y - y2) / (y3 - y1) AS y')} FROM p, q")(lambda v: scale.scale(v.p, _XY, "robust").select(*_KEY))
_TRAIN = "t AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)"
query("scale_fit_clip", f"WITH {_TRAIN} SELECT l_orderkey, l_linenumber, {r('least(1, greatest(0, (l_quantity - a) / (b - a))) AS x', 'least(1, greatest(0, (l_extendedprice - c) / (d - c))) AS y')} FROM lineitem, t")(
    lambda v: scale.fit_minmax_clip(v.table("part").selectExpr("cast(p_size as double) as x", "p_retailprice as y"), v.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity as x", "l_extendedprice as y"), _XY)
)
query("scale_columns_safe", BASE + f"SELECT id, {r('x')}, 0.0::DOUBLE AS y FROM u")(lambda v: scale.column_minmax(v.p.withColumn("y", F.lit(3.5)), _XY).select(*_KEY))
query("vector_minmax", BASE + f"SELECT g, {r('(density - min(density) OVER ()) / greatest(max(density) OVER () - min(density) OVER (), 1e-12) AS v')} FROM gr")(lambda v: v.gr.select("g", scale.vector_minmax(F.col("density")).alias("v")))
query("vector_minmax_zero", BASE + f"SELECT g, {r('(rho - min(rho) OVER ()) / (max(rho) OVER () - min(rho) OVER ()) AS v')}, 0.0::DOUBLE AS z FROM gr")(lambda v: v.gr.select("g", scale.vector_minmax_or_zero(F.col("rho")).alias("v"), scale.vector_minmax_or_zero(F.lit(2.0) + F.col("g") * 0).alias("z")))
query("unit_scale_quantile", BASE + f", q AS (SELECT quantile_cont(density, 0.05) AS lo, quantile_cont(density, 0.95) AS hi FROM gr) SELECT g, {r('least(1, greatest(0, (density - lo) / (hi - lo))) AS v')} FROM gr, q")(lambda v: v.gr.select("g", scale.unit_scale(F.col("density")).alias("v")))
query("mad", BASE + f", q AS (SELECT median(density) AS m FROM gr) SELECT {r('any_value(m) AS median', 'median(abs(density - m)) AS mad')} FROM gr, q")(lambda v: scale.mad(v.gr, "density"))
query("relative_margin", BASE + f"SELECT g, {r('(greatest(l1, 0) - greatest(l2, 0)) / (greatest(l1, 0) + 1e-12) AS margin')} FROM gr")(lambda v: v.gr.select("g", scale.relative_margin(F.col("l1"), F.col("l2")).alias("margin")))
query("label_recode", "SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")(lambda v: scale.recode(v.table("part").select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "p_brand", "code"))
query("pca_plane")(lambda v: scale.pca2(io.load(v.spark, v.dir)).select("point_id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2")))
_FAULTS = "case when (i + j) % 7 = 0 and i < j then d + 1 when i % 11 = 1 and j % 5 = 0 then -d when i % 13 = 2 and j % 3 = 0 then {nan} else d end"
query("check_distances", BASE + f", fa AS (SELECT i, j, {_FAULTS.format(nan="'nan'::DOUBLE")} AS d FROM pr) SELECT count(*) AS n, count(*) FILTER (WHERE a.d < -1e-12) AS negative, count(*) FILTER (WHERE isnan(a.d)) AS not_finite, count(*) FILTER (WHERE b.d IS NULL OR isnan(a.d) OR isnan(b.d) OR abs(a.d - b.d) > 1e-9) AS uneven FROM fa a LEFT JOIN fa b ON b.i = a.j AND b.j = a.i")(
    lambda v: scale.check_distances(v.pr.select("i", "j", F.expr(_FAULTS.format(nan="double('nan')")).alias("d")))
)

# Granules.
query("granule_count_center", BASE + f"SELECT g, n, {r('cx', 'cy')} FROM mo")(lambda v: granule.moments(v.p).select("g", "n", "cx", "cy"))
query("granule_shape", BASE + f"SELECT g, {r('a', 'b', 'c')} FROM mo")(lambda v: granule.moments(v.p).select("g", "a", "b", "c"))
query("granule_inverse", BASE + "SELECT g, round(c / det, 4) + 0.0 AS ia, round(-b / det, 4) + 0.0 AS ib, round(a / det, 4) + 0.0 AS ic FROM gr")(lambda v: rounded(granule.inverse(granule.moments(v.p)).select("g", "ia", "ib", "ic"), 4))
query("granule_cholesky", BASE + f"SELECT g, {r('sqrt(a) AS l11', 'b / sqrt(a) AS l21', 'sqrt(c - b * b / a) AS l22')} FROM mo")(lambda v: granule.cholesky(granule.moments(v.p)).select("g", "l11", "l21", "l22"))
query("mahal_points", BASE + f"SELECT id, g, {r('m2')} FROM me")(lambda v: granule.mahalanobis(v.p, granule.moments(v.p)).select("id", "g", "m2"))
query("cover_radius", BASE + f"SELECT g, {r('rho')} FROM gr")(lambda v: v.gr.select("g", "rho"))
query("axis_lengths", BASE + f"SELECT g, {r('l1', 'l2')} FROM gr")(lambda v: v.gr.select("g", "l1", "l2"))
query("outer_radius", BASE + f"SELECT g, {r('greatest(l1, l2) AS outer_radius')} FROM gr")(lambda v: v.gr.select("g", F.greatest("l1", "l2").alias("outer_radius")))
query("axis_endpoints", BASE + "SELECT g, p2_id, p3_id FROM ep")(lambda v: granule.endpoints(v.p).select("g", "p2_id", "p3_id"))
query("principal_endpoints", BASE + ", t AS (SELECT me.g, id, (x - cx) * cos(0.5 * atan2(2 * b, a - c)) + (y - cy) * sin(0.5 * atan2(2 * b, a - c)) AS q FROM me) SELECT g, arg_min(id, (q, id)) AS low_id, arg_max(id, (q, -id)) AS high_id FROM t GROUP BY g")(lambda v: granule.axis_endpoints(v.p))
query("granule_density", BASE + f"SELECT g, {r('density')} FROM gr")(lambda v: v.gr.select("g", "density"))
query("penalized_density", BASE + f"SELECT g, n <= 1 OR a + c - 2e-6 <= 1e-12 AS degenerate, {r('CASE WHEN n < 14 THEN least(density, greatest(1, n)) * 0.2 ELSE density END * CASE WHEN n <= 1 OR a + c - 2e-6 <= 1e-12 THEN 0.05 ELSE 1 END AS penalised')} FROM gr")(lambda v: granule.penalised(v.gr, 14).select("g", "degenerate", "penalised"))
query("ellipse_params", BASE + f"SELECT g, {r('2 * l1 AS width', '2 * l2 AS height', 'degrees(0.5 * atan2(2 * b, a - c)) AS angle')} FROM gr")(lambda v: granule.ellipse(v.gr))
query("ball_radius", BASE + f"SELECT g, {r('r', 'dm')} FROM ba")(lambda v: granule.balls(v.p).select("g", "r", "dm"))
query("ball_quality", BASE + f"SELECT g, n, {r('mr', 'n * exp(-0.5 * r) AS quality')} FROM ba")(lambda v: granule.balls(v.p).select("g", "n", "mr", "quality"))
query("ball_density", BASE + f"SELECT g, {r('n / (r * r * mr) AS density')}, n AS by_size FROM ba")(lambda v: granule.balls(v.p).select("g", "density", F.col("n").alias("by_size")))

# Splits.
query("split_threshold", "SELECT greatest(5, ceil(sqrt(count(*)) * 0.6))::INT AS num, ceil(sqrt(count(*)))::INT AS core FROM embeddings")(lambda v: v.spark.createDataFrame([(split.threshold(n := v.p.count(), 0.6), split.threshold(n, 1.0, 0))], "num int, core int"))
query("split_endpoints", BASE + "SELECT id, g, child FROM sp")(lambda v: split.split_once(v.p).select("id", "g", "child"))
query("split_ellipsoid", BASE + "SELECT id, g, child FROM se")(lambda v: split.split_ellipsoid(v.p).select("id", "g", "child"))
query("split_axis_median", BASE + ", t AS (SELECT me.g, id, (x - cx) * cos(0.5 * atan2(2 * b, a - c)) + (y - cy) * sin(0.5 * atan2(2 * b, a - c)) AS q FROM me) SELECT id, g, CASE WHEN q <= median(q) OVER (PARTITION BY g) THEN 0 ELSE 1 END AS child FROM t")(lambda v: split.split_axis_median(v.p).select("id", "g", "child"))
query("split_gates")(lambda v: split.judge(v.p, 3))
query("outlier_candidates_mean", BASE + "SELECT g FROM gr WHERE l1 + l2 > 1.2 * (SELECT avg(l1 + l2) FROM gr)")(lambda v: split.outlier_candidates(v.gr, 1.2).select("g"))
query("outlier_candidates_median", BASE + "SELECT g FROM gr WHERE l1 + l2 > 1.2 * (SELECT median(l1 + l2) FROM gr)")(lambda v: split.outlier_candidates(v.gr, 1.2, "median").select("g"))
query("farthest_pair_split", BASE + """, fp AS (SELECT a.g, arg_max([a.x, a.y, b.x, b.y], ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), -a.id, -b.id)) AS e FROM p a JOIN p b ON a.g = b.g AND a.id < b.id GROUP BY a.g),
t AS (SELECT id, p.g, CASE WHEN (x - e[1]) * (x - e[1]) + (y - e[2]) * (y - e[2]) <= (x - e[3]) * (x - e[3]) + (y - e[4]) * (y - e[4]) THEN 0 ELSE 1 END AS child FROM p JOIN fp ON fp.g = p.g)
SELECT * FROM t QUALIFY sum(child) OVER (PARTITION BY g) >= 2 AND count(*) OVER (PARTITION BY g) - sum(child) OVER (PARTITION BY g) >= 2""")(lambda v: split.farthest_pair_split(v.p).select("id", "g", "child"))
_PARENT = "(SELECT label AS g, count(*) * exp(-0.5 * max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)))) AS quality FROM (SELECT *, avg(x) OVER (PARTITION BY label) AS mx, avg(y) OVER (PARTITION BY label) AS my FROM p) GROUP BY label)"
query("prune_level", BASE + f"SELECT a.g::BIGINT AS g, {r('quality', 'greatest(quality, s) AS best')}, quality >= s AS keep FROM {_PARENT} a JOIN (SELECT g // 4 AS g, sum(n * exp(-0.5 * r)) AS s FROM ba GROUP BY g // 4) b ON a.g = b.g")(
    lambda v: split.prune_level(granule.balls(v.p.withColumn("g", F.col("label").cast("long"))), granule.balls(v.p).select(F.expr("g div 4 as g"), F.col("quality").alias("best"))).select("g", "quality", "best", "keep")
)
query("dm_gate", BASE + f""", kc AS (SELECT g, child, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM sp GROUP BY g, child),
kd AS (SELECT sp.g, sp.child, any_value(n) AS n, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS dm FROM sp JOIN kc ON kc.g = sp.g AND kc.child = sp.child GROUP BY sp.g, sp.child),
ks AS (SELECT g, min(n) AS least, sum(n * dm) / sum(n) AS kids FROM kd GROUP BY g)
SELECT ba.g, {r('dm', 'kids AS kids_dm')}, least >= 3 AND kids < dm AS split FROM ba JOIN ks ON ks.g = ba.g WHERE n >= 6""")(lambda v: split.dm_gate(v.p))
query("radius_gate", BASE + f", t AS (SELECT 2 * greatest(avg(r), median(r)) AS th FROM ba WHERE r > 0) SELECT g, {r('r', 'th AS threshold')}, r >= th AND r > 1e-5 AS split FROM ba, t")(lambda v: split.radius_gate(granule.balls(v.p)))
query("grid_bins", "SELECT least(64, greatest(4, ceil(sqrt(ceil(count(*) / 16.0)))))::INT AS bins FROM embeddings")(lambda v: v.spark.createDataFrame([(split.bins(v.p.count(), 2),)], "bins int"))
query("grid_cells", BASE + f"SELECT kx, ky, n, {r('mx', 'my')} FROM oc")(lambda v: split.occupied(split.cells(v.unit, BINS)).drop("first"))
query("grid_point_cell", BASE + "SELECT id, kx, ky FROM gc")(lambda v: split.cells(v.unit, BINS).select("id", "kx", "ky"))
query("grid_adjacency", BASE + "SELECT * FROM ad")(lambda v: split.adjacent(split.occupied(split.cells(v.unit, BINS))))
query("grid_components", BASE + "SELECT kx::INT AS kx, ky::INT AS ky, component FROM gp")(lambda v: split.grid_components(durable(split.occupied(split.cells(v.unit, BINS))), BINS, durable))
query("grid_seeds", BASE + ", z AS (SELECT component, count(*) AS n, min(id) AS f FROM gc JOIN gp ON gp.kx = gc.kx AND gp.ky = gc.ky GROUP BY component), w AS (SELECT component, row_number() OVER (ORDER BY n DESC, f) - 1 AS seed FROM z) SELECT id, seed FROM gc JOIN gp ON gp.kx = gc.kx AND gp.ky = gc.ky JOIN w ON w.component = gp.component")(
    lambda v: split.seeds(split.cells(v.unit, BINS), split.grid_components(durable(split.occupied(split.cells(v.unit, BINS))), BINS, durable))
)

def _no_null(attributes: DataFrame) -> DataFrame:
    """No parent as -1."""
    return attributes.withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


# Pairs and density-peak attributes.
query("pair_mahalanobis", BASE + f"SELECT i, j, {r('d')} FROM pr")(lambda v: v.pr)
query("pair_euclid", BASE + f"SELECT i, j, {r('d')} FROM pe")(lambda v: dpc.euclid_pairs(v.gr))
_FAR = "sqrt(dx * dx + dy * dy) > 0.2 * reach"
query("pair_pruned", BASE + f"SELECT i AS g, j AS h, {_FAR} AS pruned, {r(f'CASE WHEN {_FAR} THEN sqrt(dx * dx + dy * dy) ELSE sqrt(greatest((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b), 0)) END AS d')} FROM pa WHERE i < j")(lambda v: dpc.pruned_pairs(v.gr, 0.2))
query("pair_pruned_stats", BASE + f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT ({_FAR})) AS exact, count(*) FILTER (WHERE {_FAR}) AS pruned FROM pa WHERE i < j")(
    lambda v: dpc.pruned_pairs(v.gr, 0.2).agg(F.count("*").alias("total"), F.count_if(~F.col("pruned")).alias("exact"), F.count_if("pruned").alias("pruned"))
)
_DPC = f"SELECT g, {r('rho', 'delta')}, coalesce(parent, -1) AS parent, {r('rho * delta AS gamma')} FROM "
query("nearest_denser", BASE + _DPC + "dp")(lambda v: _no_null(v.dp))
query("nearest_denser_row_max", BASE + _DPC + "(SELECT g, rho, coalesce(CASE WHEN parent IS NOT NULL THEN delta END, (SELECT max(d) FROM pr WHERE i = dp.g)) AS delta, parent FROM dp)")(lambda v: _no_null(dpc.attributes(v.gr, v.pr, "row")))
_EARLY = "ea AS (SELECT i AS g, min(d) AS d, arg_min(j, (d, pos_j)) AS parent FROM cd WHERE pos_j < pos GROUP BY i)"
query("nearest_denser_ordered", BASE + f", {_EARLY} " + _DPC + "(SELECT od.g, rho, coalesce(d, (SELECT max(d) FROM pr WHERE i = od.g)) AS delta, parent FROM od LEFT JOIN ea ON ea.g = od.g)")(lambda v: _no_null(dpc.attributes(v.gr, v.pr, "ordered")))
query("nearest_denser_patched", BASE + _DPC + "dp")(lambda v: _no_null(dpc.attributes(v.gr, v.pr, "patched")))
query("ball_delta", BASE + f", eb AS (SELECT x.i, x.j, d, u.pos, w.pos AS pos_j, u.rho FROM pe x JOIN od u ON u.g = i JOIN od w ON w.g = j), ea AS (SELECT i AS g, min(d) AS d, arg_min(j, (d, pos_j)) AS parent FROM eb WHERE pos_j < pos GROUP BY i), z AS (SELECT od.g, rho, coalesce(d, (SELECT max(d) FROM pe WHERE i = od.g)) AS delta, coalesce(parent, 0) AS parent FROM od LEFT JOIN ea ON ea.g = od.g) " + _DPC + "(SELECT g, rho, CASE WHEN max(delta) OVER () < 1 THEN delta * 10 ELSE delta END AS delta, parent FROM z)")(
    lambda v: dpc.attributes(v.gr, dpc.euclid_pairs(v.gr), "ball")
)
query("gamma_rank", BASE + f"SELECT g, {r('gamma')}, pick::INT AS pick FROM ga")(lambda v: v.dp.select("g", "gamma", F.row_number().over(Window.orderBy(F.desc("gamma"), "g")).alias("pick")))
query("centers_topk", BASE + "SELECT g, label FROM ce")(lambda v: v.ce)
query("centers_threshold", BASE + ", t AS (SELECT avg(gamma) + stddev_pop(gamma) AS t FROM ga), k AS (SELECT least(10, greatest(2, count(*))) AS k FROM ga, t WHERE gamma > t) SELECT g, (pick - 1)::INT AS label FROM ga, k WHERE pick <= k")(lambda v: dpc.above_mean(v.dp))
query("centers_knee", BASE + ", t AS (SELECT *, (pick - 1) / (count(*) OVER () - 1.0) + (gamma - min(gamma) OVER ()) / (max(gamma) OVER () - min(gamma) OVER ()) - 1 AS f FROM ga), k AS (SELECT least(10, greatest(2, arg_max(pick, (round(abs(f), 12), -pick)))) AS k FROM t) SELECT g, (pick - 1)::INT AS label FROM ga, k WHERE pick <= k")(lambda v: dpc.knee(v.dp))
query("centers_robust", BASE + f", t AS (SELECT ga.g, row_number() OVER (ORDER BY gamma DESC, ga.g) AS o FROM ga JOIN gr ON gr.g = ga.g WHERE n >= 13 AND a + c - 2e-6 > 1e-12) SELECT g, (o - 1)::INT AS label FROM t WHERE o <= {K}")(lambda v: dpc.robust_top_k(v.dp, granule.penalised(v.gr, 13), K, 13))
query("centers_two_peaks", BASE + ", m AS (SELECT median(rho) AS m FROM dp), t AS (SELECT g, gamma, row_number() OVER (PARTITION BY rho > m ORDER BY delta * (1 + 0.05 * rho) DESC, g) AS o FROM ga, m) SELECT g, (row_number() OVER (ORDER BY gamma DESC) - 1)::INT AS label FROM t WHERE o = 1")(lambda v: dpc.two_peaks(v.dp))
query("centers_rectangle", BASE + "SELECT g, (row_number() OVER (ORDER BY gamma DESC, g) - 1)::INT AS label FROM ga WHERE rho BETWEEN 1 AND 1000 AND delta BETWEEN 0.1 AND 100")(lambda v: dpc.rectangle(v.dp, (1, 1000), (0.1, 100)))
query("center_separation", BASE + f"SELECT {r('greatest(quantile_cont(d, 0.25), 0.2 * median(d), 1e-12) AS min_sep')} FROM pr WHERE i < j AND d > 0")(lambda v: dpc.separation(v.pr))
query("centers_separated")(lambda v: dpc.separated(v.dp, v.pr, K))
query("center_relative_drop")(lambda v: dpc.relative_drop(v.dp))

# Labels.
query("nearest_center", BASE + "SELECT g, near FROM nc")(lambda v: labels.nearest_centre(v.pr, v.ce))
query("chain_labels", BASE + "SELECT * FROM la")(lambda v: v.la)
query("chain_labels_noise", BASE + f"SELECT dp.g, coalesce(label, {K})::INT AS label FROM dp LEFT JOIN cl ON cl.g = dp.g")(lambda v: labels.propagate(v.dp, v.ce, noise=True))
query("chain_labels_from_one", BASE + "SELECT g, label + 1 AS label FROM la")(lambda v: labels.propagate(v.dp, v.ce, v.pr, base=1))
query("graph_votes", BASE + "SELECT * FROM gv")(lambda v: v.gv)
query("graph_safety", BASE + f", s AS (SELECT max(c) / sum(c) AS largest FROM (SELECT count(*) AS c FROM gv GROUP BY label)), x AS (SELECT avg((gv.label <> la.label)::INT) AS changed FROM gv JOIN la ON la.g = gv.g) SELECT {r('largest', 'changed')}, largest <= 0.85 AND changed <= 0.35 AS accepted FROM s, x")(lambda v: labels.safe(v.la, v.gv))
query("cluster_ratios", BASE + f"SELECT {r('max(m) / sum(m) AS largest', 'min(m) / sum(m) AS smallest')}, count(*) AS clusters FROM sz")(lambda v: labels.ratios(v.la))
query("cluster_ratios_mass", BASE + f"SELECT {r('max(m) / sum(m) AS largest', 'min(m) / sum(m) AS smallest')}, count(*) AS clusters FROM (SELECT label, sum(n) AS m FROM la JOIN gr ON gr.g = la.g GROUP BY label)")(lambda v: labels.ratios(v.la.join(v.gr.select("g", "n"), "g"), "n"))
query("changed_ratio", BASE + f"SELECT {r('avg((gv.label <> la.label)::INT) AS changed')} FROM gv JOIN la ON la.g = gv.g")(lambda v: labels.changed(v.la, v.gv))
query("representatives", BASE + f"SELECT label, g, {r('rho')} FROM re")(lambda v: labels.representatives(v.dp, v.la))
query("representative_pairs", BASE + f"SELECT li, lj, {r('d')} FROM rp")(lambda v: labels.representative_pairs(labels.representatives(v.dp, v.la), v.pr))
query("merge_light", BASE + ", q AS (SELECT quantile_cont(d, 0.2) AS c FROM rp WHERE d > 0), e AS (SELECT li, lj FROM rp, q WHERE d > 0 AND d <= c UNION ALL SELECT lj, li FROM rp, q WHERE d > 0 AND d <= c), w AS (SELECT label AS u, label AS v FROM sz UNION SELECT w.u, e.lj FROM w JOIN e ON e.li = w.v), z AS (SELECT u, arg_max(v, (rho, -v)) AS root FROM w JOIN re ON re.label = w.v GROUP BY u), c AS (SELECT u, (dense_rank() OVER (ORDER BY root) - 1)::INT AS code FROM z) SELECT la.g, code AS label FROM la JOIN c ON c.u = la.label")(lambda v: labels.merge_light(v.dp, v.la, v.pr))
query("point_labels", BASE + "SELECT id, la.label FROM p JOIN la ON la.g = p.g")(lambda v: labels.to_points(v.p, v.la))
query("centroid_refine", BASE + ", c AS (SELECT la.label, avg(x) AS mx, avg(y) AS my FROM p JOIN la ON la.g = p.g GROUP BY la.label) SELECT id, arg_min(c.label, ((x - mx) * (x - mx) + (y - my) * (y - my), c.label)) AS label FROM p, c GROUP BY id")(lambda v: labels.centroid_round(v.p.select("id", "x", "y"), labels.to_points(v.p, v.la)))

# Natural neighbours.
query("knn_rank", BASE + f"SELECT i, j, {r('d')}, r::INT AS r FROM kn")(lambda v: v.kn)
query("mutual_neighbors", BASE + "SELECT i, j, r::INT AS r, s::INT AS s, is_fallback FROM ed")(lambda v: v.ed.select("i", "j", "r", "s", "is_fallback"))
query("degree_cap", BASE + "SELECT i, j FROM ed QUALIFY row_number() OVER (PARTITION BY i ORDER BY r + s, d, j) <= 2")(lambda v: natural.cap_degree(v.ed, 2).select("i", "j"))
_LAM = BASE + """, fi AS (SELECT i, min(m) AS f FROM mk GROUP BY i), nn AS (SELECT count(*) AS m FROM fi),
ks AS (SELECT k, (SELECT count(*) FROM fi WHERE f > k) AS l, m FROM nn, (SELECT unnest(range(1, (SELECT {most} FROM nn) + 1)) AS k)),
st AS (SELECT *, k - 1 - coalesce((SELECT max(o.k) FROM (SELECT k, l, lag(l) OVER (ORDER BY k) AS was FROM ks) o WHERE o.k <= ks.k AND (o.was IS NULL OR o.was <> o.l)) - 1, 0) AS streak FROM ks)
SELECT coalesce(min(k) FILTER (WHERE {stop}), max(k)) AS natural_k FROM st"""
query("natural_lambda", _LAM.format(most="m - 1", stop="l = 0 OR streak >= ceil(ln(m) + ln(k))"))(lambda v: natural.search(v.kn))
query("natural_lambda_coverage", _LAM.format(most="least(m - 1, greatest(1, ceil(2 * log2(m))))::BIGINT", stop="1 - l / m >= 0.95 AND streak >= 2"))(lambda v: natural.search(v.kn, "coverage"))
query("natural_lambda_empty", _LAM.format(most="least(m - 1, greatest(4, ceil(sqrt(m)) + 4))::BIGINT", stop="l = 0 AND streak >= 2"))(lambda v: natural.search(v.kn, "empty"))
query("nn_occurrence", BASE + f"SELECT gr.g, {r(f'count(j) / ((SELECT count(*) FROM gr) * {LAMBDA}.0) AS occurrence')} FROM gr LEFT JOIN kn ON kn.j = gr.g AND r <= {LAMBDA} GROUP BY gr.g")(lambda v: natural.occurrence(v.kn, LAMBDA))
query("nn_radius", BASE + f"SELECT g, degree, {r('radius', 'scale')} FROM ra")(lambda v: natural.radii(v.ed))
query("nn_mean_degree", BASE + f"SELECT {r('avg(degree) AS degree')} FROM ra")(lambda v: natural.radii(v.ed).agg(F.avg("degree").alias("degree")))
query("nn_outliers", BASE + f"SELECT g, {r('radius')}, radius > avg(radius) OVER () AS outlier FROM ra")(lambda v: natural.outliers(natural.radii(v.ed)))
query("edge_similarity", BASE + f"SELECT i, j, {r('sim')} FROM si")(lambda v: natural.similarity(v.ed, natural.radii(v.ed)).select("i", "j", "sim"))
query("graph_consistency", BASE + f"SELECT {r('sum(CASE WHEN u.label = w.label THEN 1 / (1 + d) ELSE 0 END) / sum(1 / (1 + d)) AS consistency')} FROM ed JOIN la u ON u.g = i JOIN la w ON w.g = j")(lambda v: natural.consistency(v.ed, v.la))
_ST = "sd AS (SELECT i AS g, count(*) + sum(exp(-(d * d) / (u.scale * w.scale)) * sqrt(x.n * y.n) * (1 + w.degree)) AS structural FROM ed JOIN ra u ON u.g = i JOIN ra w ON w.g = j JOIN gr x ON x.g = i JOIN gr y ON y.g = j GROUP BY i)"
query("structural_density", BASE + f", {_ST} SELECT g, {r('structural')} FROM sd")(lambda v: natural.structural_density(v.ed, v.gr))
query("hybrid_density", BASE + f", {_ST}, z AS (SELECT gr.g, least(0.8, greatest(0.2, n / (n + (SELECT median(n) FROM gr)))) AS al, (density - min(density) OVER ()) / (max(density) OVER () - min(density) OVER ()) AS a1, (structural - min(structural) OVER ()) / (max(structural) OVER () - min(structural) OVER ()) AS b1 FROM gr JOIN sd ON sd.g = gr.g) SELECT g, {r('al * a1 + (1 - al) * b1 + 1e-12 * g AS hybrid')} FROM z")(lambda v: natural.hybrid_density(v.gr, natural.structural_density(v.ed, v.gr)))
_US = "least(1, greatest(0, ({0} - quantile_cont({0}, 0.05) OVER ()) / (quantile_cont({0}, 0.95) OVER () - quantile_cont({0}, 0.05) OVER ())))"
_OW = f"ow AS (SELECT gr.g, count(j) / ((SELECT count(*) FROM gr) * {LAMBDA}.0) AS occ FROM gr LEFT JOIN kn ON kn.j = gr.g AND r <= {LAMBDA} GROUP BY gr.g)"
query("weighted_density", BASE + f""", {_OW}, zl AS (SELECT gr.g, n, density, occ, ln(1 + greatest(density, 0)) AS ld FROM gr JOIN ow ON ow.g = gr.g), zi AS (SELECT *, {_US.format('ld')} AS own FROM zl),
zn AS (SELECT ed.i AS g, sum((0.5 * exp(-(d * d) / (x.scale * y.scale)) + 0.5 / (1 + r + s)) * greatest(occ, 1e-12) ** 0.5 * ln(1 + n) ** 0.5 * (0.5 + 0.5 * own)) AS near, median(density) AS mid FROM ed JOIN zi ON zi.g = ed.j JOIN ra x ON x.g = ed.i JOIN ra y ON y.g = ed.j GROUP BY ed.i),
zr AS (SELECT zi.g, own, ln(1 + coalesce(near, 0)) AS nb, ln(1 + coalesce(density / (mid + 1e-12), 1)) AS rel FROM zi LEFT JOIN zn ON zn.g = zi.g)
SELECT g, {r('0.55 * own + 0.25 * ' + _US.format('nb') + ' + 0.2 * ' + _US.format('rel') + ' + 1e-12 * g AS weighted')} FROM zr""")(lambda v: natural.weighted_density(v.ed, v.gr, natural.occurrence(v.kn, LAMBDA)))
_PM = "pm AS (SELECT gr.g, coalesce(least(1, greatest(-1, ln(greatest(any_value(gr.density), 1e-12) / greatest(median(o.density), 1e-12)))), 0) AS prominence FROM gr LEFT JOIN ed ON i = gr.g LEFT JOIN gr o ON o.g = j GROUP BY gr.g)"
query("prominence", BASE + f", {_PM} SELECT g, {r('prominence')} FROM pm")(lambda v: natural.prominence(v.ed, v.gr))
_SU = "su0 AS (SELECT j AS g, count(*) AS seen FROM ed GROUP BY j), su AS (SELECT gr.g, least(3, coalesce(seen, 0) / (SELECT median(seen) FROM su0)) AS support FROM gr LEFT JOIN su0 ON su0.g = gr.g)"
query("nn_support", BASE + f", {_SU} SELECT g, {r('support::DOUBLE AS support')} FROM su")(lambda v: natural.support(v.ed, v.gr))
query("natural_gamma", BASE + f", {_PM}, {_SU}, md AS (SELECT median(support) AS m FROM su), mm AS (SELECT m, median(abs(support - m)) AS mad FROM su, md GROUP BY m) SELECT ga.g, {r('gamma * exp(0.5 * least(2, greatest(-2, (support - m) / (mad + 1e-12))) + 0.5 * prominence) AS gamma')} FROM ga JOIN pm ON pm.g = ga.g JOIN su ON su.g = ga.g, mm")(lambda v: dpc.natural_gamma(v.dp, natural.prominence(v.ed, v.gr), natural.support(v.ed, v.gr)))
query("center_score", BASE + f", z AS (SELECT gr.g, count(j) / ((SELECT count(*) FROM gr) * {LAMBDA}.0) AS o FROM gr LEFT JOIN kn ON kn.j = gr.g AND r <= {LAMBDA} GROUP BY gr.g), y AS (SELECT dp.g, rho, delta, o FROM dp JOIN z ON z.g = dp.g) SELECT g, {r(_US.format('rho') + ' * ' + _US.format('delta') + ' * (1 + 0.2 * ' + _US.format('o') + ') AS score')} FROM y")(
    lambda v: v.dp.join(natural.occurrence(v.kn, LAMBDA), "g").select("g", score.centre_score(F.col("rho"), F.col("delta"), F.col("occurrence")).alias("score"))
)
query("fuzzy_membership", BASE + f", oc2 AS (SELECT gr.g, count(j) / ((SELECT count(*) FROM gr) * {LAMBDA}.0) AS o FROM gr LEFT JOIN kn ON kn.j = gr.g AND r <= {LAMBDA} GROUP BY gr.g), wi AS (SELECT i AS j, sum(1 / (1 + d)) AS wj FROM ed GROUP BY i), z AS (SELECT i, label, 1 / (1 + d) AS w, wj, o, sum(o) OVER (PARTITION BY i) AS os FROM ed JOIN wi ON wi.j = ed.j JOIN oc2 ON oc2.g = ed.j JOIN la ON la.g = ed.j) SELECT i AS g, label, {r('sum(w / wj * w * o / greatest(os, 1e-12)) AS membership')} FROM z GROUP BY i, label")(lambda v: natural.membership(v.ed, v.la, natural.occurrence(v.kn, LAMBDA)))
AMBIGUOUS = """az AS (SELECT ed.i AS g, min(label) <> max(label) AS mixed, max(d) AS radius FROM ed JOIN {labels} t ON t.g = ed.j GROUP BY ed.i), am AS (SELECT median(radius) AS m FROM az WHERE radius > 0),
at0 AS (SELECT any_value(m) + 1.5 * median(abs(radius - m)) AS top FROM az, am WHERE radius > 0),
ab AS (SELECT t.g, t.label IS NULL AS open, t.label IS NOT NULL AND confidence > 0 AND confidence < 0.7 AS weak, t.label IS NOT NULL AND coalesce(mixed, false) AS mixed, t.label IS NOT NULL AND coalesce(radius > top, false) AS wide,
  t.label IS NOT NULL AND coalesce(parent IS NOT NULL AND delta > top, false) AS far FROM {labels} t LEFT JOIN az ON az.g = t.g JOIN dp ON dp.g = t.g, at0)"""
#: Labels with holes and doubts: of every fifth granule none, of every third a low confidence.
_DOUBT = "lx AS (SELECT g, CASE WHEN g % 5 = 1 THEN NULL ELSE label END AS label, CASE WHEN g % 3 = 1 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM la)"
query("ambiguous_flags", BASE + f", {_DOUBT}, {AMBIGUOUS.format(labels='lx')} SELECT *, open OR weak OR mixed OR wide OR far AS ambiguous FROM ab")(
    lambda v: natural.ambiguous(v.ed, v.la.selectExpr("g", "if(g % 5 = 1, null, label) as label", "if(g % 3 = 1, 0.6D, 0.9D) as confidence"), v.dp)
)

# Scores and tests.
query("internal_score", BASE + f", s AS (SELECT avg(d) AS separation FROM rp), b AS (SELECT u.label, sum(d) AS t FROM pr JOIN la u ON u.g = i JOIN la w ON w.g = j WHERE u.label = w.label GROUP BY u.label), c AS (SELECT avg(coalesce(t / (m * m), 0)) AS compactness, max(m) / sum(m) AS lg, min(m) / sum(m) AS sm FROM sz LEFT JOIN b ON b.label = sz.label) SELECT {r('separation', 'compactness', 'separation / (compactness + 1e-12) * CASE WHEN lg > 0.85 THEN 0.2 ELSE 1 END * CASE WHEN sm < 0.02 THEN 0.5 ELSE 1 END AS score')} FROM s, c")(lambda v: score.internal_score(v.dp, v.la, v.pr))
query("point_weighted_score", BASE + f", s AS (SELECT avg(d) AS separation FROM rp), c AS (SELECT sum(coalesce(d, 0) * n) / sum(n) AS compactness FROM la JOIN re ON re.label = la.label JOIN gr ON gr.g = la.g LEFT JOIN pr ON i = la.g AND j = re.g) SELECT {r('separation', 'compactness', 'separation / (compactness + 1e-12) AS score')} FROM s, c")(lambda v: score.weighted_score(v.dp, v.la, v.pr, v.gr.select("g", "n")))
query("label_distribution", BASE + "SELECT label, m FROM sz")(lambda v: v.la.groupBy("label").agg(F.count("*").alias("m")))
query("confusion", BASE + "SELECT * FROM ct")(lambda v: v.contingency)
query("nmi", BASE + f", t AS (SELECT t, sum(n) AS k FROM ct GROUP BY t), q AS (SELECT p, sum(n) AS k FROM ct GROUP BY p), a AS (SELECT sum(n) AS a FROM ct), h AS (SELECT (SELECT -sum(k / a * ln(k / a)) FROM t, a) AS ht, (SELECT -sum(k / a * ln(k / a)) FROM q, a) AS hp, (SELECT sum(n / a * ln(n * a / (t.k * q.k))) FROM ct JOIN t USING (t) JOIN q USING (p), a) AS mi) SELECT {r('greatest(0, mi / ((ht + hp) / 2)) AS nmi')} FROM h")(lambda v: score.nmi(v.contingency))
query("ari", BASE + f", h AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS s, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM ct GROUP BY t)) AS st, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM ct GROUP BY p)) AS sq, (SELECT sum(n) * (sum(n) - 1) / 2 FROM ct) AS a) SELECT {r('(s - st * sq / a) / ((st + sq) / 2 - st * sq / a) AS ari')} FROM h")(lambda v: score.ari(v.contingency))
query("acc_hungarian")(lambda v: v.spark.createDataFrame([(score.accuracy(v.contingency)[0],)], "acc double"))
_WX = "w AS (SELECT s_nationkey % 5 AS test, round(s_acctbal - s_suppkey * 10.0, 12) AS d FROM supplier), x AS (SELECT *, rank() OVER (PARTITION BY test ORDER BY abs(d)) + (count(*) OVER (PARTITION BY test, abs(d)) - 1) / 2 AS k FROM w WHERE d <> 0)"
query("wilcoxon_stat", f"WITH {_WX} SELECT test, count(*) AS m, {r('sum(CASE WHEN d > 0 THEN k ELSE 0 END)::DOUBLE AS w_plus', 'sum(CASE WHEN d < 0 THEN k ELSE 0 END)::DOUBLE AS w_minus', 'least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END))::DOUBLE AS statistic')} FROM x GROUP BY test")(lambda v: score.wilcoxon(v.paired))
query("holm", "WITH t AS (SELECT s_suppkey AS test, (s_suppkey * 37 % 101) / 1000.0::DOUBLE AS p FROM supplier), i AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM t), a AS (SELECT test, p, least(1, max((m - i + 1) * p) OVER (ORDER BY i)) AS adj FROM i) " + f"SELECT test, {r('p::DOUBLE AS p', 'adj::DOUBLE AS adjusted')}, p < 0.05 AS raw_significant, adj < 0.05 AS significant FROM a")(lambda v: score.holm(v.table("supplier").selectExpr("s_suppkey as test", "(s_suppkey * 37 % 101) / cast(1000.0 as double) as p")))
query("win_tie_loss", "SELECT s_nationkey % 5 AS test, count(*) FILTER (WHERE s_acctbal > s_suppkey * 10.0) AS win, count(*) FILTER (WHERE abs(s_acctbal - s_suppkey * 10.0) <= 1e-8) AS tie, count(*) FILTER (WHERE s_acctbal < s_suppkey * 10.0) AS loss FROM supplier GROUP BY 1")(lambda v: score.win_tie_loss(v.paired))
query("repeat_means", f"SELECT l_suppkey, {r('avg(l_quantity) AS quantity', 'avg(l_discount) AS discount')}, count(*) AS repeats FROM lineitem GROUP BY l_suppkey")(lambda v: score.repeat_means(v.table("lineitem").selectExpr("l_suppkey", "l_quantity as quantity", "l_discount as discount"), "l_suppkey", ["quantity", "discount"]))

# Whole pipelines: iterative, so without SQL.
for _name, _config in pipelines.CONFIGS.items():
    query(_name)(lambda v, c=_config: pipelines.confusion(io.load(v.spark, v.dir), c))


def queries():
    def run(f):
        return lambda spark, sf_dir: rounded(f(View(spark, sf_dir)))

    return {name: run(f) for name, (f, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark, sf_dir):
    return pipelines.confusion(io.load(spark, sf_dir), pipelines.CONFIGS["ellipsoid_dpc"])


from granula.plans import graphs, more  # noqa: E402, F401  their queries are added to ALL
