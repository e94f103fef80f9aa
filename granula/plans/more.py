"""More operators as queries with their SQL: ties, greedy centres, gates, shapes in any dimension,
scores, refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import candidates, dpc, granule, labels, natural, refine, rounds, scale, score, shape, split
from granula.plans.registry import AMBIGUOUS, BASE, K, LAMBDA, _no_null, query, r
from granula.sources import io


def _kept(name):
    """A table of a View that is written once."""

    def put(make):
        def get(v):
            if name not in v.__dict__:
                v.__dict__[name] = durable(make(v))
            return v.__dict__[name]

        return get

    return put


# Ties: the number of points as density.
_tied = _kept("tied")(lambda v: v.gr.withColumn("density", F.col("n").cast("double")))
_TIES = BASE + """, ot AS (SELECT g, n::DOUBLE AS rho, row_number() OVER (ORDER BY n DESC, g) AS pos FROM gr),
tc AS (SELECT pr.i, pr.j, d, u.rho, v.rho AS rho_j, u.pos, v.pos AS pos_j FROM pr JOIN ot u ON u.g = i JOIN ot v ON v.g = j),
ht AS (SELECT i AS g, min(d) AS d, arg_min(j, (d, j)) AS parent FROM tc WHERE rho_j > rho GROUP BY i),
rm AS (SELECT i AS g, max(d) AS m FROM pr GROUP BY i),
tt AS (SELECT ot.g, rho, pos, d, parent, m, max(d) OVER () AS top, lag(ot.g) OVER (ORDER BY pos) AS prev FROM ot LEFT JOIN ht ON ht.g = ot.g LEFT JOIN rm ON rm.g = ot.g),
te AS (SELECT i AS g, min(d) AS d, arg_min(j, (d, pos_j)) AS parent FROM tc WHERE pos_j < pos GROUP BY i),
tp AS (SELECT tt.g, rho, coalesce(tt.d, s.d) AS d, coalesce(parent, prev) AS parent FROM tt LEFT JOIN pr s ON s.i = tt.g AND s.j = prev)
"""
_OUT = f"SELECT g, {r('rho', 'delta')}, coalesce(parent, -1) AS parent, {r('rho * delta AS gamma')} FROM "
for _mode, _sql in {
    "strict": "(SELECT *, CASE WHEN d IS NOT NULL THEN d WHEN pos = 1 THEN top ELSE 0 END AS delta FROM tt)",
    "row": "(SELECT *, coalesce(d, m) AS delta FROM tt)",
    "row_positive": "(SELECT *, coalesce(d, m) AS delta FROM tt)",
    "max_or_row": "(SELECT *, CASE WHEN d IS NOT NULL THEN d WHEN pos = 1 AND top > 0 THEN top WHEN pos = 1 THEN m ELSE 0 END AS delta FROM tt)",
    "ordered": "(SELECT ot.g, rho, coalesce(te.d, m) AS delta, te.parent FROM ot LEFT JOIN te ON te.g = ot.g LEFT JOIN rm ON rm.g = ot.g)",
    "patched": "(SELECT g, rho, coalesce(d, max(d) OVER ()) AS delta, parent FROM tp)",
}.items():
    query(f"tied_delta_{_mode}", _TIES + _OUT + _sql)(lambda v, m=_mode: _no_null(dpc.attributes(_tied(v), v.pr, m)))

# Greedy centres: a recursive walk down the order with the list of those chosen.
_SEP = "sep AS (SELECT greatest(quantile_cont(d, 0.25), {f} * median(d), 1e-12) AS s FROM pr WHERE i < j AND d > 0)"


def _walk(order: str, near: str, k: str, least: str, x: str = "") -> str:
    """CTEs on order (g, pick) and near (g, h): cs{x} (g, label)."""
    return f"""
nl{x} AS (SELECT g, list(h) AS near FROM ({near}) GROUP BY g),
wo{x} AS (SELECT o.g, o.pick, coalesce(near, []) AS near FROM ({order}) o LEFT JOIN nl{x} ON nl{x}.g = o.g),
gs{x} AS (SELECT [g] AS chosen, pick AS nth FROM wo{x} WHERE pick = 1 UNION ALL
  SELECT CASE WHEN len(chosen) < {k} AND NOT list_has_any(chosen, near) THEN list_append(chosen, wo{x}.g) ELSE chosen END, nth + 1 FROM gs{x} JOIN wo{x} ON wo{x}.pick = nth + 1),
fi{x} AS (SELECT chosen FROM gs{x} WHERE nth = (SELECT max(pick) FROM wo{x})),
cs{x} AS (SELECT g, (row_number() OVER (ORDER BY NOT list_contains(chosen, g), pick) - 1)::INT AS label FROM wo{x}, fi{x} QUALIFY label < greatest(len(chosen), least({k}, {least})))"""


_ALLGA = "SELECT g, pick FROM ga"
query("centers_separated", BASE + f", {_SEP.format(f=0.2)}, {_walk(_ALLGA, 'SELECT i AS g, j AS h FROM pr, sep WHERE d < s', str(K), str(K))} SELECT g, label FROM cs")(lambda v: dpc.separated(v.dp, v.pr, K))
query("centers_separated_wide", BASE + f", {_SEP.format(f=0.9)}, {_walk(_ALLGA, 'SELECT i AS g, j AS h FROM pr, sep WHERE d < s', str(K), str(K))} SELECT g, label FROM cs")(lambda v: dpc.separated(v.dp, v.pr, K, 0.9))
query("centers_pool_k", BASE + f", {_SEP.format(f=0.2)}, {_walk(_ALLGA, 'SELECT i AS g, j AS h FROM pr, sep WHERE d < s', '4', '4')} SELECT g, label FROM cs")(lambda v: dpc.pool(v.dp, v.pr, 2, 0.2, 4, 9))
query("centers_pool_k_plain", BASE + "SELECT g, (pick - 1)::INT AS label FROM ga WHERE pick <= 5")(lambda v: dpc.pool(v.dp, v.pr, 2, k=5, prune=False))
_VALID = BASE + "rv AS (SELECT dp.g, gamma, row_number() OVER (ORDER BY gamma DESC, dp.g) AS pick, count(*) OVER () AS m FROM (SELECT g, rho * delta AS gamma FROM dp) dp JOIN gr ON gr.g = dp.g WHERE n >= 13 AND n > 1 AND a + c > 2e-6 + 1e-12)".replace("rv AS", ", rv AS", 1)
_robust = lambda mode, **limits: lambda v: dpc.robust(v.dp, granule.penalised(v.gr, 13), mode, small=13, **limits)
query("centers_robust_threshold", _VALID + ", t AS (SELECT avg(gamma) + stddev_pop(gamma) AS t FROM rv), k AS (SELECT greatest(1, count(*)) AS k FROM rv, t WHERE gamma > t) SELECT g, (pick - 1)::INT AS label FROM rv, k WHERE pick <= k")(_robust("threshold"))
query("centers_robust_knee", _VALID + ", t AS (SELECT *, (pick - 1) / (m - 1.0) + (gamma - min(gamma) OVER ()) / (max(gamma) OVER () - min(gamma) OVER ()) - 1 AS f FROM rv), k AS (SELECT least(5, greatest(2, arg_max(pick, (round(abs(f), 12), -pick)))) AS k FROM t) SELECT g, (pick - 1)::INT AS label FROM rv, k WHERE pick <= k")(_robust("knee", least=2, most=5))
query("centers_robust_none", BASE + "SELECT g, (pick - 1)::INT AS label FROM ga WHERE pick <= 3")(lambda v: dpc.robust(v.dp, granule.penalised(v.gr), k=3, small=1_000_000))
query("centers_rectangle_default", BASE + "SELECT g, (row_number() OVER (ORDER BY gamma DESC, g) - 1)::INT AS label FROM ga WHERE rho >= (SELECT quantile_cont(rho, 0.85) FROM dp) AND delta >= (SELECT quantile_cont(delta, 0.9) FROM dp)")(lambda v: dpc.rectangle_default(v.dp))
query("graph_consistency_similarity", BASE + f", us AS (SELECT DISTINCT least(ed.i, ed.j) AS i, greatest(ed.i, ed.j) AS j, 0.5 * exp(-(d * d) / (x.scale * y.scale)) + 0.5 / (1 + r + s) AS w FROM ed JOIN ra x ON x.g = ed.i JOIN ra y ON y.g = ed.j), ug AS (SELECT i, j, max(w) AS w FROM us GROUP BY i, j) SELECT {r('sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) / sum(w) AS consistency')} FROM ug JOIN la a ON a.g = i JOIN la b ON b.g = j")(
    lambda v: natural.consistency(v.ed, v.la, "similarity")
)
query("graph_consistency_mass", BASE + f", us AS (SELECT i, j, sqrt(x.n * y.n) / (1 + d) AS w FROM ed JOIN gr x ON x.g = i JOIN gr y ON y.g = j WHERE j > i) SELECT {r('sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) / sum(w) AS consistency')} FROM us JOIN la a ON a.g = i JOIN la b ON b.g = j")(lambda v: natural.consistency(v.ed, v.la, "mass", v.gr))
_DROP = """un AS (SELECT g, pick, (gamma - min(gamma) OVER ()) / (max(gamma) OVER () - min(gamma) OVER ()) AS u, count(*) OVER () AS m FROM ga),
dr AS (SELECT pick, m, round((u - lead(u) OVER (ORDER BY pick)) / greatest(u, 1e-12), 12) AS f FROM un),
kk AS (SELECT greatest(2, arg_max(pick, (f, -pick))) AS k, any_value(m) AS m FROM dr WHERE f IS NOT NULL AND pick <= ceil(sqrt(m)) + 2),
ps AS (SELECT least(m, greatest(3 * k, 6, ceil(sqrt(m))))::BIGINT AS size FROM kk)"""
query("centers_pool", BASE + f", {_SEP.format(f=0.25)}, {_DROP}, {_walk('SELECT g, pick FROM ga, ps WHERE pick <= size', 'SELECT i AS g, j AS h FROM pr, sep WHERE d < s', '(SELECT size FROM ps)', '2')} SELECT g, label FROM cs")(lambda v: dpc.pool(v.dp, v.pr))
query("center_relative_drop", BASE + ", d AS (SELECT pick, count(*) OVER () AS m, round((gamma - lead(gamma) OVER (ORDER BY pick)) / greatest(gamma, 1e-12), 12) AS f FROM ga), e AS (SELECT * FROM d WHERE f IS NOT NULL AND pick BETWEEN 2 AND ceil(sqrt(m)) + 2) SELECT arg_max(pick, (f, -pick))::INT AS k, round(max(f), 6) AS drop FROM e")(lambda v: dpc.relative_drop(v.dp))
query("centers_basin", BASE + f", {_SEP.format(f=0.9)}, {_walk(_ALLGA, 'SELECT pr.i AS g, pr.j AS h FROM pr, sep WHERE d < s AND EXISTS (SELECT 1 FROM ed WHERE (ed.i = pr.i AND ed.j = pr.j) OR (ed.i = pr.j AND ed.j = pr.i))', str(K), str(K))} SELECT g, label FROM cs")(lambda v: dpc.basin_separated(v.dp, v.pr, v.ed, K, 0.9))
query("centers_local", BASE + f", {_walk(_ALLGA, 'SELECT pr.i AS g, pr.j AS h FROM pr JOIN ra u ON u.g = pr.i JOIN ra w ON w.g = pr.j WHERE d < 0.8 * 0.5 * (u.scale + w.scale)', str(K), str(K))} SELECT g, label FROM cs")(lambda v: dpc.locally_separated(v.dp, v.pr, natural.radii(v.ed), K))
query("centers_not_redundant", BASE + f", tau AS (SELECT median(delta) AS s FROM dp WHERE delta > 0), {_walk('SELECT g, pick FROM ga WHERE pick <= 12', 'SELECT i AS g, j AS h FROM pr, tau WHERE d <= s', '12', '1')} SELECT g, label FROM cs")(lambda v: dpc.not_redundant(v.dp, v.pr, 12))

# Gates of a split, and a round of outlier refinement.
_KIDS = """, c0 AS (SELECT id, x, y, (g * 2 + child)::BIGINT AS g FROM se),
cm AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy, covar_pop(x, x) + 1e-6 AS a, covar_pop(x, y) AS b, covar_pop(y, y) + 1e-6 AS c FROM c0 GROUP BY g),
cq AS (SELECT *, greatest((c * (x - cx) * (x - cx) - 2 * b * (x - cx) * (y - cy) + a * (y - cy) * (y - cy)) / (a * c - b * b), 0) AS m2 FROM c0 JOIN cm USING (g)),
c1 AS (SELECT g, n, cx, cy, a, b, c, sqrt(max(m2)) AS rho, sum(sqrt(m2)) AS ms FROM cq GROUP BY ALL),
c2 AS (SELECT *, rho * sqrt(greatest((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 1e-12)) AS l1, rho * sqrt(greatest((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 1e-12)) AS l2 FROM c1),
kg AS (SELECT *, n * n / (greatest(l1 + l2, 1e-12) * greatest(ms, 1e-12)) AS density FROM c2),
kp AS (SELECT gr.g, gr.n, gr.a, gr.b, gr.c, gr.det, gr.rho, gr.l1, gr.l2, gr.density, u.n AS n_0, w.n AS n_1, u.cx - w.cx AS dx, u.cy - w.cy AS dy, (u.a + w.a) / 2 AS pa, (u.b + w.b) / 2 AS pb, (u.c + w.c) / 2 AS pc,
  u.density AS d_0, w.density AS d_1, u.l1 AS p0, u.l2 AS q0, w.l1 AS p1, w.l2 AS q1, least(u.n, w.n) > 1 AND least(u.a + u.c, w.a + w.c) > 2e-6 + 1e-12 AS full FROM gr JOIN kg u ON u.g = gr.g * 2 JOIN kg w ON w.g = gr.g * 2 + 1)"""
query("split_gates", BASE + _KIDS + """ SELECT g, n_0, n_1, least(n_0, n_1) >= 3 AS leaf_ok, d_0 + d_1 > density AS density_ok,
(l1 + l2) / 2 <= 1e-12 OR sqrt(dx * dx + dy * dy) >= 0.1 * (l1 + l2) / 2 AS axis_ok,
sqrt((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det) >= 0.25 * greatest(rho, 1e-12) AS parent_ok,
sqrt((pc * dx * dx - 2 * pb * dx * dy + pa * dy * dy) / (pa * pc - pb * pb)) >= 1.0 AS pair_ok,
NOT (least(n_0, n_1) <= 3 AND greatest(n_0, n_1) >= n - 3) AS balance_ok, p0 + q0 + p1 + q1 < l1 + l2 AS axes_ok, kp.full AS shape_ok FROM kp""")(lambda v: split.judge(v.p, 3))
query("refine_outliers", BASE + _KIDS + """, ok AS (SELECT g FROM kp WHERE l1 + l2 > 1.1 * (SELECT avg(l1 + l2) FROM gr) AND least(n_0, n_1) >= greatest(2, ceil(0.1 * sqrt((SELECT count(*) FROM p)))) AND d_0 + d_1 > 0.9 * density)
SELECT p.id, p.g, coalesce(CASE WHEN ok.g IS NOT NULL THEN child END, -1) AS child FROM p LEFT JOIN se ON se.id = p.id LEFT JOIN ok ON ok.g = p.g""")(lambda v: split.refine_round(v.p, 1.1, 0.9).select("id", "g", F.coalesce("child", F.lit(-1)).alias("child")))
# The median of the first axis, halves where none is above it, then the children's shapes.
_MEDIAN = """, mq AS (SELECT me.g, id, x, y, (x - cx) * cos(0.5 * atan2(2 * b, a - c)) + (y - cy) * sin(0.5 * atan2(2 * b, a - c)) AS q FROM {me} me),
mw AS (SELECT *, median(q) OVER w AS cut, max(q) OVER w AS top, count(*) OVER w AS m, row_number() OVER (PARTITION BY g ORDER BY q, id) AS nth FROM mq WINDOW w AS (PARTITION BY g)),
mh AS (SELECT g, id, x, y, CASE WHEN top > cut THEN (q > cut)::INT ELSE (nth > m // 2)::INT END AS child FROM mw),
mb AS (SELECT * FROM mh QUALIFY sum(child) OVER (PARTITION BY g) BETWEEN 1 AND count(*) OVER (PARTITION BY g) - 1),
mm AS (SELECT g, child, avg(x) AS cx, avg(y) AS cy, covar_pop(x, x) + 1e-6 AS a, covar_pop(x, y) AS b, covar_pop(y, y) + 1e-6 AS c FROM mb GROUP BY g, child),
mr AS (SELECT mb.g, id, x, y, mm.child AS k, greatest((c * (x - cx) * (x - cx) - 2 * b * (x - cx) * (y - cy) + a * (y - cy) * (y - cy)) / (a * c - b * b), 0) AS q FROM mb JOIN mm ON mm.g = mb.g),
mt AS (SELECT g, id, x, y, (NOT max(q) FILTER (WHERE k = 0) < max(q) FILTER (WHERE k = 1))::INT AS child FROM mr GROUP BY g, id, x, y),
mz AS (SELECT * FROM mt QUALIFY sum(child) OVER (PARTITION BY g) BETWEEN 1 AND count(*) OVER (PARTITION BY g) - 1)"""
query("split_median_ellipsoid", BASE + _MEDIAN.format(me="me") + " SELECT id, g, child FROM mz")(lambda v: split.split_median_ellipsoid(v.p).select("id", "g", "child"))
for _rule, _of, _kids, _gate in (
    ("core", "avg", _KIDS, "least(n_0, n_1) >= ceil(sqrt((SELECT count(*) FROM p))) * 0.1"),
    ("four", "median", _MEDIAN.format(me="me") + _KIDS.replace("FROM se)", "FROM mz)"), "least(n_0, n_1) >= {m} AND NOT (least(n_0, n_1) <= {m} AND greatest(n_0, n_1) >= n - {m}) AND p0 + q0 + p1 + q1 < l1 + l2".format(m="greatest(2, ceil(0.1 * sqrt((SELECT count(*) FROM p))))")),
    ("whole", "avg", _KIDS, "least(n_0, n_1) >= 4 AND kp.full"),
):
    query(f"refine_{_rule}", BASE + _kids + f""", ok AS (SELECT g FROM kp WHERE l1 + l2 > 1.1 * (SELECT {_of}(l1 + l2) FROM gr) AND {_gate} AND d_0 + d_1 > 0.9 * density)
SELECT p.id, p.g, CASE WHEN ok.g IS NULL THEN '' ELSE child::VARCHAR END AS path FROM p LEFT JOIN {'mz' if _rule == 'four' else 'se'} k ON k.id = p.id LEFT JOIN ok ON ok.g = p.g""")(lambda v, rule=_rule: rounds.refine(v.p, rule, 1.1, 0.9, 1).select("id", "g", "path"))
    query(f"refine_{_rule}_rounds")(lambda v, rule=_rule: rounds.refine(v.p, rule, 1.1, 0.9).select("id", "g", "path"))
query("pca_plane_2d", BASE + f", m AS (SELECT avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) AS t FROM p) SELECT id AS point_id, {r('abs((x - cx) * cos(t) + (y - cy) * sin(t)) AS pc1', 'abs((y - cy) * cos(t) - (x - cx) * sin(t)) AS pc2')} FROM p, m")(
    lambda v: scale.pca2(v.p.select(F.col("id").alias("point_id"), F.array("x", "y").alias("features"))).select("point_id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"))
)


# Shapes in any dimension, by kind; closed forms at two and three components.
def _points(v, dims: int):
    return io.load(v.spark, v.dir).select("point_id", F.slice("features", 1, dims).alias("features"), (F.col("label") * 4 + F.pmod("point_id", F.lit(4))).cast("long").alias("g"))


_EIG = """, ev AS (SELECT g, n, cx, cy, 0.5 * atan2(2 * b, a - c) AS t, (a + c) / 2 - 1e-6 + sqrt((a - c) * (a - c) / 4 + b * b) AS v1, (a + c) / 2 - 1e-6 - sqrt((a - c) * (a - c) / 4 + b * b) AS v2 FROM mo),
pj AS (SELECT p.id, p.g, ev.n, t, v1, v2, (x - cx) * cos(t) + (y - cy) * sin(t) AS q1, (y - cy) * cos(t) - (x - cx) * sin(t) AS q2 FROM p JOIN ev ON ev.g = p.g)"""
_STATS = """, fr AS (SELECT g, any_value(n) AS n, sqrt(max(m2)) AS rho, sum(sqrt(m2)) AS ms, any_value(s1) AS s1, any_value(s2) AS s2 FROM fm GROUP BY g)
SELECT g, n, {out} FROM (SELECT *, rho * (sqrt(greatest(s1, 1e-12)) + sqrt(greatest(s2, 1e-12))) AS axes FROM fr)"""
_STATS = _STATS.format(out=r("rho", "axes", "n * n / (greatest(axes, 1e-12) * greatest(ms, 1e-12)) AS density"))
_M2 = {
    "full": "q1 * q1 / (v1 + 1e-6) + q2 * q2 / (v2 + 1e-6) AS m2, v1 + 1e-6 AS s1, v2 + 1e-6 AS s2",
    "lowrank": "q1 * q1 / (v1 + 1e-6) + q2 * q2 / 1e-6 AS m2, v1 + 1e-6 AS s1, 1e-6 AS s2",
    "adaptive": "q1 * q1 / greatest(v1 + h, 1e-6) + q2 * q2 / greatest(v2 + h, 1e-6) AS m2, greatest(v1 + h, 1e-6) AS s1, greatest(v2 + h, 1e-6) AS s2",
}
for _kind, _form in {"full": "full", "pinv": "full", "auto": "full", "lowrank": "lowrank", "adaptive": "adaptive"}.items():
    query(f"granule_fit_{_kind}", BASE + _EIG + f", fm AS (SELECT *, {_M2[_form]} FROM (SELECT *, 1e-6 * greatest((v1 + v2) / 2, 1) AS h FROM pj))" + _STATS)(
        lambda v, k=_kind: shape.granules(_points(v, 2), k, 1).select("g", "n", "rho", F.expr("aggregate(lengths, 0D, (s, e) -> s + e)").alias("axes"), "density")
    )
query("mahal_points_lowrank", BASE + _EIG + f" SELECT id AS point_id, g, round(q1 * q1 / (v1 + 1e-6) + q2 * q2 / 1e-6, 3) + 0.0 AS m2 FROM pj")(lambda v: shape.mahalanobis(_points(v, 2), durable(shape.fits(_points(v, 2), "lowrank", 1))).select("point_id", "g", F.round("m2", 3).alias("m2")))
query("pair_lowrank", BASE + _EIG + f""", lp AS (SELECT u.g AS i, w.g AS j, u.cx - w.cx AS dx, u.cy - w.cy AS dy, (u.v1 * cos(u.t) * cos(u.t) + w.v1 * cos(w.t) * cos(w.t)) / 2 + 1e-6 AS a, (u.v1 * cos(u.t) * sin(u.t) + w.v1 * cos(w.t) * sin(w.t)) / 2 AS b,
(u.v1 * sin(u.t) * sin(u.t) + w.v1 * sin(w.t) * sin(w.t)) / 2 + 1e-6 AS c FROM ev u JOIN ev w ON u.g <> w.g) SELECT i, j, round(sqrt(greatest((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b), 0)), 4) + 0.0 AS d FROM lp""")(
    lambda v: shape.lowrank_pairs(durable(shape.fits(_points(v, 2), "lowrank", 1))).select("i", "j", F.round("d", 4).alias("d"))
)
query("granule_fit_3d", """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (label * 4 + vec_id % 4)::BIGINT AS g FROM embeddings),
m AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) + 1e-6 AS a, covar_pop(y, y) + 1e-6 AS b, covar_pop(z, z) + 1e-6 AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM p GROUP BY g),
q AS (SELECT *, a * (b * c - f * f) - d * (d * c - e * f) + e * (d * f - e * b) AS det, (a + b + c) / 3 AS t FROM m),
s AS (SELECT *, sqrt(((a - t) * (a - t) + (b - t) * (b - t) + (c - t) * (c - t) + 2 * (d * d + e * e + f * f)) / 6) AS w FROM q),
u AS (SELECT *, acos(least(1, greatest(-1, ((a - t) * ((b - t) * (c - t) - f * f) - d * (d * (c - t) - e * f) + e * (d * f - e * (b - t))) / (2 * w * w * w)))) / 3 AS h FROM s),
v AS (SELECT *, t + 2 * w * cos(h) AS e1, t + 2 * w * cos(h + 2 * pi() / 3) AS e3 FROM u),
k AS (SELECT p.id, v.*, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM p JOIN v ON v.g = p.g),
y AS (SELECT *, ((b * c - f * f) * dx * dx + (a * c - e * e) * dy * dy + (a * b - d * d) * dz * dz + 2 * ((e * f - d * c) * dx * dy + (d * f - b * e) * dx * dz + (d * e - a * f) * dy * dz)) / det AS m2 FROM k),
z AS (SELECT g, n, cx, cy, cz, sqrt(e1) + sqrt(3 * t - e1 - e3) + sqrt(e3) AS roots, sqrt(max(m2)) AS rho, sum(sqrt(m2)) AS ms FROM y GROUP BY ALL)
""" + f"SELECT g, n, {r('cx', 'cy', 'cz', 'rho', 'rho * roots AS axes', 'n * n / (rho * roots * ms) AS density')} FROM z")(
    lambda v: shape.granules(_points(v, 3)).select("g", "n", F.col("centre")[0].alias("cx"), F.col("centre")[1].alias("cy"), F.col("centre")[2].alias("cz"), "rho", F.expr("aggregate(lengths, 0D, (s, e) -> s + e)").alias("axes"), "density")
)
query("granule_fit_all")(lambda v: shape.granules(_points(v, 64), "auto").select("g", "n", "rho", "density"))

# Scores, gates and choices.
_IN = "s AS (SELECT avg(d) AS separation FROM rp), b AS (SELECT u.label, sum(d) AS t FROM pr JOIN la u ON u.g = i JOIN la w ON w.g = j WHERE u.label = w.label GROUP BY u.label), c AS (SELECT avg(coalesce(t / (m * m), 0)) AS compactness, max(m) / sum(m) AS lg, min(m) / sum(m) AS sm, min(m) AS least, count(*) AS k FROM sz LEFT JOIN b ON b.label = sz.label)"
for _k in (K, K + 1):
    query(f"strict_score_{_k}", BASE + f", {_IN} SELECT {r('separation', 'compactness', f'CASE WHEN k <> {_k} OR lg > 0.65 OR sm < 0.025 THEN -1e18 ELSE separation / (compactness + 1e-12) / (1 + 8 * greatest(lg - 1.0 / {_k}, 0)) * CASE WHEN least <= 1 THEN 0.1 ELSE 1 END END AS score')} FROM s, c")(lambda v, k=_k: score.strict_score(v.dp, v.la, v.pr, k))
_MS = "ms AS (SELECT la.label, sum(n)::BIGINT AS m FROM la JOIN gr ON gr.g = la.g GROUP BY la.label), mr AS (SELECT max(m) / sum(m) AS lg, min(m) / sum(m) AS sm FROM ms), c AS (SELECT sum(coalesce(d, 0) * n) / sum(n) AS compactness FROM la JOIN re ON re.label = la.label JOIN gr ON gr.g = la.g LEFT JOIN pr ON i = la.g AND j = re.g)"
for _name, _w, _hi, _f in (("products", "x.m * y.m", 0.92, 0.2), ("plain", "1", 0.9, 0.25)):
    query(f"mass_score_{_name}", BASE + f", {_MS}, s AS (SELECT sum({_w} * d) / sum({_w}) AS separation FROM rp JOIN ms x ON x.label = li JOIN ms y ON y.label = lj) SELECT {r('separation', 'compactness', f'separation / (compactness + 1e-12) * CASE WHEN lg > {_hi} THEN {_f} ELSE 1 END * CASE WHEN sm < 0.01 THEN 0.5 ELSE 1 END AS score')} FROM s, c, mr")(
        lambda v, n=_name, h=_hi, f=_f: score.mass_score(v.dp, v.la, v.pr, v.gr.select("g", "n"), n == "products", h, 0.01, f)
    )
query("changed_mass", BASE + f"SELECT {r('sum(CASE WHEN gv.label <> la.label THEN n ELSE 0 END) / sum(n) AS changed_mass')} FROM gv JOIN la ON la.g = gv.g JOIN gr ON gr.g = la.g")(lambda v: labels.changed_mass(v.la, v.gv, v.gr.select("g", "n")))
query("graph_safety_k", BASE + f", s AS (SELECT max(c) / sum(c) AS largest, min(c) / sum(c) AS smallest, count(*) AS clusters FROM (SELECT count(*) AS c FROM gv GROUP BY label)), x AS (SELECT avg((gv.label <> la.label)::INT) AS changed FROM gv JOIN la ON la.g = gv.g) SELECT {r('largest', 'smallest')}, clusters, {r('changed')}, clusters = {K} AND largest <= 0.65 AND smallest >= 0.025 AND changed <= 0.35 AS accepted FROM s, x")(lambda v: labels.safe_for_k(v.la, v.gv, K))
_PT = "pt AS (SELECT p.id, la.label FROM p JOIN la ON la.g = p.g)"
query("wants_refinement", BASE + f", {_PT}, s AS (SELECT max(c) / sum(c) AS largest, min(c) / sum(c) AS smallest FROM (SELECT count(*) AS c FROM pt GROUP BY label)) SELECT {r('largest', 'smallest')}, largest > 0.70 OR smallest < 0.03 AS refine FROM s")(lambda v: labels.wants_refinement(labels.to_points(v.p, v.la), K))
_LLOYD = "{b} AS (SELECT id, arg_min(c.label, ((x - mx) * (x - mx) + (y - my) * (y - my), c.label)) AS label FROM p, (SELECT q.label, avg(x) AS mx, avg(y) AS my FROM p JOIN {a} q ON q.id = p.id GROUP BY q.label) c GROUP BY id)"
_TWO = f"{_PT}, {_LLOYD.format(a='pt', b='r1')}, {_LLOYD.format(a='r1', b='r2')}, n1 AS (SELECT count(DISTINCT label) = {K} AS ok FROM r1), n2 AS (SELECT count(DISTINCT label) = {K} AS ok FROM r2), rf AS (SELECT pt.id, CASE WHEN n1.ok AND n2.ok THEN r2.label WHEN n1.ok THEN r1.label ELSE pt.label END AS label FROM pt JOIN r1 ON r1.id = pt.id JOIN r2 ON r2.id = pt.id, n1, n2)"
_refined = _kept("refined")(lambda v: labels.centroid_refine(v.p.select("id", "x", "y"), labels.to_points(v.p, v.la)))
query("centroid_refine_rounds", BASE + f", {_TWO} SELECT id, label FROM rf")(_refined)
query("keep_refined", BASE + f", {_TWO}, o AS (SELECT max(c) / sum(c) AS l0, min(c) / sum(c) AS s0, count(*) AS c0 FROM (SELECT count(*) AS c FROM pt GROUP BY label)), n AS (SELECT max(c) / sum(c) AS l1, min(c) / sum(c) AS s1, count(*) AS c1 FROM (SELECT count(*) AS c FROM rf GROUP BY label)) SELECT {r('l0', 'l1', 's0', 's1')}, c0 = c1 AND l1 <= l0 AND s1 >= s0 AS keep FROM o, n")(lambda v: labels.keep_refined(labels.to_points(v.p, v.la), _refined(v)))
query("acc_hungarian", BASE + f", fu AS (SELECT a.t, b.p, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT t FROM ct) a CROSS JOIN (SELECT DISTINCT p FROM ct) b LEFT JOIN ct ON ct.t = a.t AND ct.p = b.p), am AS (SELECT 0 AS p, 0::BIGINT AS mask, 0::BIGINT AS total UNION ALL SELECT am.p + 1, mask | (1::BIGINT << t), total + n FROM am JOIN fu ON fu.p = am.p WHERE (mask & (1::BIGINT << t)) = 0) SELECT round(max(total) / (SELECT sum(n) FROM ct), 6) + 0.0 AS acc FROM am WHERE p = (SELECT count(DISTINCT p) FROM ct)")(
    lambda v: v.spark.createDataFrame([(score.accuracy(v.contingency)[0],)], "acc double")
)
query("best_config", f"SELECT s_nationkey AS k, {r('s_acctbal AS score', 's_suppkey::DOUBLE AS consistency')}, row_number() OVER (ORDER BY tied DESC, CASE WHEN tied THEN s_suppkey::DOUBLE ELSE s_acctbal END DESC, s_nationkey) = 1 AS chosen FROM (SELECT *, s_acctbal >= max(s_acctbal) OVER () - 1e-12 AS tied FROM supplier)")(lambda v: refine.best_config(v.table("supplier").selectExpr("s_nationkey as k", "s_acctbal as score", "cast(s_suppkey as double) as consistency")))
query("mode_summary", "SELECT min(p_size) AS least, avg(p_size) AS mean, max(p_size) AS most, (SELECT string_agg(p_brand || '=' || c, ' ' ORDER BY p_brand || '=' || c) FROM (SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand)) AS modes FROM part")(lambda v: score.summary(v.table("part"), "p_size", "p_brand"))


def _by_k(k: int) -> str:
    """CTEs of the plain and the graph's labels with k separated centres, and their scores."""
    x = f"_{k}"
    return f"""{_walk(_ALLGA, 'SELECT i AS g, j AS h FROM pr, sep WHERE d < s', str(k), str(k), x)},
ch{x} AS (SELECT g, g AS at FROM dp UNION ALL SELECT ch{x}.g, dp.parent FROM ch{x} JOIN dp ON dp.g = ch{x}.at WHERE dp.parent IS NOT NULL AND ch{x}.at NOT IN (SELECT g FROM cs{x})),
cl{x} AS (SELECT ch{x}.g, any_value(cs{x}.label) AS label FROM ch{x} JOIN cs{x} ON cs{x}.g = ch{x}.at GROUP BY ch{x}.g),
nc{x} AS (SELECT i AS g, arg_min(label, (d, label)) AS near FROM pr JOIN cs{x} ON cs{x}.g = j GROUP BY i),
la{x} AS (SELECT dp.g, coalesce(cl{x}.label, near, 0)::INT AS label FROM dp LEFT JOIN cl{x} ON cl{x}.g = dp.g LEFT JOIN nc{x} ON nc{x}.g = dp.g),
vo{x} AS (SELECT i, label, sum(rho_j / (d + 1e-9 * (SELECT median(d) FROM pr WHERE d > 0))) AS v, min(k) AS first FROM (SELECT cd.*, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM cd WHERE rho_j > rho) JOIN la{x} ON la{x}.g = j
  WHERE k <= greatest(2, ceil(log2((SELECT count(*) FROM gr)))) GROUP BY i, label),
vb{x} AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, first) AS o FROM vo{x}),
gv{x} AS (SELECT la{x}.g, CASE WHEN cs{x}.g IS NULL AND b.v > 1.05 * greatest(coalesce(w.v, 0), 1e-12) THEN b.label ELSE la{x}.label END AS label
  FROM la{x} LEFT JOIN vo{x} w ON w.i = la{x}.g AND w.label = la{x}.label LEFT JOIN vb{x} b ON b.i = la{x}.g AND b.o = 1 LEFT JOIN cs{x} ON cs{x}.g = la{x}.g),
sf{x} AS (SELECT (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM gv{x} GROUP BY label)) <= 0.85 AND (SELECT avg((a.label <> b.label)::INT) FROM la{x} a JOIN gv{x} b ON a.g = b.g) <= 0.35 AS ok)"""


_KS = (3, K)
_CAND = " UNION ALL ".join(f"SELECT {2 * n} AS o, {k} AS k, 'single' AS mode, g, label FROM la_{k} UNION ALL SELECT {2 * n + 1}, {k}, 'graph', g, label FROM gv_{k}, sf_{k} WHERE ok" for n, k in enumerate(_KS))
_BEST = BASE + f", {_SEP.format(f=0.2)}, {', '.join(_by_k(k) for k in _KS)}, ca AS ({_CAND})" + """,
cr AS (SELECT o, label, arg_max(dp.g, (rho, -dp.g)) AS g, count(*) AS m FROM ca JOIN dp ON dp.g = ca.g GROUP BY o, label),
cse AS (SELECT a.o, avg(d) AS sep FROM cr a JOIN cr b ON a.o = b.o AND a.label < b.label JOIN pr ON i = a.g AND j = b.g GROUP BY a.o),
cbl AS (SELECT a.o, a.label, sum(d) AS t FROM pr JOIN ca a ON a.g = i JOIN ca b ON b.g = j AND a.o = b.o AND a.label = b.label GROUP BY a.o, a.label),
cco AS (SELECT cr.o, avg(coalesce(t / (m * m), 0)) AS comp, max(m) / sum(m) AS lg, min(m) / sum(m) AS sm, count(*) AS c FROM cr LEFT JOIN cbl ON cbl.o = cr.o AND cbl.label = cr.label GROUP BY cr.o),
csc AS (SELECT cco.o, CASE WHEN c < 2 THEN -1e18 ELSE sep / (comp + 1e-12) * CASE WHEN lg > 0.85 THEN 0.2 ELSE 1 END * CASE WHEN sm < 0.02 THEN 0.5 ELSE 1 END END AS score FROM cco LEFT JOIN cse ON cse.o = cco.o),
cbe AS (SELECT o, score, row_number() OVER (ORDER BY score DESC, o) = 1 AS chosen FROM csc)"""
query("best_labels_candidates", _BEST + f" SELECT k, mode, {r('score')}, chosen FROM cbe JOIN (SELECT DISTINCT o, k, mode FROM ca) USING (o)")(lambda v: refine.best_labels(v.dp, v.pr, _KS, 1.05)[0])
query("best_labels", _BEST + " SELECT g, label FROM ca JOIN cbe USING (o) WHERE chosen")(lambda v: refine.best_labels(v.dp, v.pr, _KS, 1.05)[1])

# Refinement.
_mass = lambda v: v.gr.select("g", "n")
_occ = lambda v: natural.occurrence(v.kn, LAMBDA)
_OC = f"oc3 AS (SELECT gr.g, count(j) / ((SELECT count(*) FROM gr) * {LAMBDA}.0) AS o FROM gr LEFT JOIN kn ON kn.j = gr.g AND r <= {LAMBDA} GROUP BY gr.g)"
_SIGN = """sg AS (SELECT ed.i AS g, count(*) AS degree, min(b.label) <> max(b.label) AS mixed, avg((a.label = b.label)::INT) AS same FROM ed JOIN la a ON a.g = ed.i JOIN la b ON b.g = ed.j GROUP BY ed.i),
pn AS (SELECT dp.g, dp.rho, la.label, coalesce(u.label <> la.label, false) AS parted FROM dp JOIN la ON la.g = dp.g LEFT JOIN la u ON u.g = dp.parent),
su AS (SELECT DISTINCT ed.i AS g, la.label AS best FROM ed JOIN dp a ON a.g = ed.i JOIN dp b ON b.g = ed.j JOIN la ON la.g = ed.j WHERE b.rho > a.rho),
bv AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, label) AS o FROM vt),
nn AS (SELECT g, label, avg(d) AS far FROM (SELECT pr.i AS g, la.label, d, row_number() OVER (PARTITION BY pr.i, la.label ORDER BY d, pr.j) AS o FROM pr JOIN la ON la.g = pr.j) WHERE o <= 3 GROUP BY g, label),
al AS (SELECT la.g, la.label AS old, degree, mixed, same, parted, b1.label AS best, b1.v, coalesce(b2.v, 0) AS second, coalesce(ow.v, 0) AS own, su.g IS NOT NULL AS supported, ce.g IS NOT NULL AS centre, coalesce(n1.far, 'inf'::DOUBLE) AS there, coalesce(n0.far, 'inf'::DOUBLE) AS here
  FROM la LEFT JOIN sg ON sg.g = la.g LEFT JOIN pn ON pn.g = la.g LEFT JOIN bv b1 ON b1.g = la.g AND b1.o = 1 LEFT JOIN bv b2 ON b2.g = la.g AND b2.o = 2 LEFT JOIN vt ow ON ow.g = la.g AND ow.label = la.label
  LEFT JOIN su ON su.g = la.g AND su.best = b1.label LEFT JOIN ce ON ce.g = la.g LEFT JOIN nn n1 ON n1.g = la.g AND n1.label = b1.label LEFT JOIN nn n0 ON n0.g = la.g AND n0.label = la.label)"""
_END = "SELECT g, CASE WHEN outcome = 'changed' THEN best ELSE old END::INT AS label, outcome FROM ou"
_A = f""", {_OC}, wi3 AS (SELECT i AS j, sum(1 / (1 + d)) AS wj FROM ed GROUP BY i), z3 AS (SELECT i, label, 1 / (1 + d) AS w, wj, o, sum(o) OVER (PARTITION BY i) AS os FROM ed JOIN wi3 ON wi3.j = ed.j JOIN oc3 ON oc3.g = ed.j JOIN la ON la.g = ed.j),
vt AS (SELECT i AS g, label, sum(w / wj * w * o / greatest(os, 1e-12)) AS v FROM z3 GROUP BY i, label), {_SIGN},
ol AS (SELECT g, radius > avg(radius) OVER () AS outlier FROM ra),
ou AS (SELECT al.*, CASE WHEN centre THEN 'centre' WHEN v IS NULL THEN 'alone' WHEN NOT (mixed OR parted OR outlier) THEN 'certain' WHEN best = old THEN 'same' WHEN v <= 1.5 * greatest(own, 1e-15) THEN 'margin' WHEN NOT supported THEN 'support'
  WHEN coalesce(t.d, 0) >= coalesce(h.d, 0) THEN 'distance' ELSE 'changed' END AS outcome
  FROM al LEFT JOIN ol ON ol.g = al.g LEFT JOIN re rt ON rt.label = al.best LEFT JOIN re rh ON rh.label = al.old LEFT JOIN pr t ON t.i = al.g AND t.j = rt.g LEFT JOIN pr h ON h.i = al.g AND h.j = rh.g)"""
_a = _kept("proposal_a")(lambda v: refine.propose_membership(v.dp, v.la, v.ed, _occ(v), v.ce, v.pr))
query("propose_membership", BASE + _A + _END)(_a)
_RANGE = "least(1, greatest(0, (b.rho - (SELECT quantile_cont(rho, 0.05) FROM dp)) / ((SELECT quantile_cont(rho, 0.95) FROM dp) - (SELECT quantile_cont(rho, 0.05) FROM dp))))"
_B = f""", {_OC}, e3 AS (SELECT ed.i, la.label, (0.5 * exp(-(d * d) / (x.scale * y.scale)) + 0.5 / (1 + r + s)) * sqrt(greatest(o, 1e-12)) * (0.2 + 0.8 * {_RANGE}) * sqrt(ln(1 + gr.n)) * CASE WHEN b.rho > a.rho THEN 1 ELSE 0.3 END AS w
  FROM ed JOIN ra x ON x.g = ed.i JOIN ra y ON y.g = ed.j JOIN dp a ON a.g = ed.i JOIN dp b ON b.g = ed.j JOIN oc3 ON oc3.g = ed.j JOIN gr ON gr.g = ed.j JOIN la ON la.g = ed.j),
vt AS (SELECT i AS g, label, sum(w) / sum(sum(w)) OVER (PARTITION BY i) AS v FROM e3 GROUP BY i, label), {_SIGN},
wd AS (SELECT g, scale > (SELECT quantile_cont(scale, 0.75) FROM ra) AS wide FROM ra),
ou AS (SELECT al.*, CASE WHEN centre THEN 'centre' WHEN v IS NULL THEN 'alone' WHEN mixed::INT + parted::INT + (own < 0.6)::INT + wide::INT < 2 THEN 'certain' WHEN best = old THEN 'same' WHEN v < 0.6 OR v - second < 0.15 THEN 'margin' WHEN NOT supported THEN 'support'
  WHEN isinf(there) OR there >= 0.98 * here THEN 'distance' ELSE 'changed' END AS outcome FROM al LEFT JOIN wd ON wd.g = al.g)"""
_b = _kept("proposal_b")(lambda v: refine.propose_weighted(v.dp, v.la, v.ed, _occ(v), v.ce, v.pr, _mass(v)))
query("propose_weighted", BASE + _B + _END)(_b)
_LOGS = "(ln(1 + b.rho) - (SELECT ln(1 + min(rho)) FROM dp)) / (SELECT ln(1 + max(rho)) - ln(1 + min(rho)) FROM dp)"
_SUP = "su0 AS (SELECT j AS g, count(*) AS seen FROM ed GROUP BY j), su1 AS (SELECT gr.g, least(3, coalesce(seen, 0) / (SELECT median(seen) FROM su0)) AS o FROM gr LEFT JOIN su0 ON su0.g = gr.g)"
_C = f""", {_SUP}, e3 AS (SELECT ed.i, la.label, 1 / (1 + d) * (0.5 + 0.5 / (1 + r + s)) * (0.5 + 0.25 * least(o, 2)) * sqrt(ln(1 + gr.n)) * (0.5 + 0.5 * {_LOGS}) * CASE WHEN b.rho > a.rho THEN 1 ELSE 0.3 END AS w
  FROM ed JOIN dp a ON a.g = ed.i JOIN dp b ON b.g = ed.j JOIN su1 ON su1.g = ed.j JOIN gr ON gr.g = ed.j JOIN la ON la.g = ed.j),
vt AS (SELECT i AS g, label, sum(w) / sum(sum(w)) OVER (PARTITION BY i) AS v FROM e3 GROUP BY i, label), {_SIGN},
ou AS (SELECT al.*, CASE WHEN centre THEN 'centre' WHEN v IS NULL OR degree < 2 THEN 'alone' WHEN mixed::INT + parted::INT + (same < 0.62)::INT + (NOT isinf(here) AND best <> old AND there < here)::INT < 2 THEN 'certain' WHEN best = old THEN 'same' WHEN v < 0.62 OR v - second < 0.15 THEN 'margin'
  WHEN isinf(there) OR (NOT isinf(here) AND there > 0.98 * here) THEN 'distance' ELSE 'changed' END AS outcome FROM al)"""
query("propose_assisted", BASE + _C + _END)(lambda v: refine.propose_assisted(v.dp, v.la, v.ed, natural.support(v.ed, v.gr), v.ce, v.pr, _mass(v)))
query("proposal_funnel", BASE + _A + "SELECT outcome, count(*) AS c FROM ou GROUP BY outcome")(lambda v: _a(v).groupBy("outcome").agg(F.count("*").alias("c")))


def _gate(weigh: bool) -> str:
    """CTE lm: the limits of gv against la; sc, cc: scores and consistencies of both."""
    m, j = ("sum(n)", "JOIN gr ON gr.g = gv.g") if weigh else ("count(*)", "")
    mass = "sum(CASE WHEN gv.label <> la.label THEN n ELSE 0 END) / sum(n)" if weigh else "max(0.0::DOUBLE)"
    return f"""lm AS (SELECT max(c) / sum(c) AS largest, min(c) / sum(c) AS smallest, count(*) = (SELECT count(DISTINCT label) FROM la) AS same_count, (SELECT avg((gv.label <> la.label)::INT) FROM gv JOIN la ON la.g = gv.g) AS changed,
(SELECT {mass} FROM gv JOIN la ON la.g = gv.g JOIN gr ON gr.g = la.g) AS changed_mass FROM (SELECT {m} AS c FROM gv {j} GROUP BY label)),
cc AS (SELECT sum(CASE WHEN u.label = w.label THEN 1 / (1 + d) ELSE 0 END) / sum(1 / (1 + d)) AS old_consistency, sum(CASE WHEN x.label = y.label THEN 1 / (1 + d) ELSE 0 END) / sum(1 / (1 + d)) AS new_consistency FROM ed JOIN la u ON u.g = i JOIN la w ON w.g = j JOIN gv x ON x.g = i JOIN gv y ON y.g = j)"""


def _score_of(t: str, low: float = 0.02) -> str:
    return f"""(WITH re2 AS (SELECT label, arg_max(dp.g, (rho, -dp.g)) AS g, count(*) AS m FROM dp JOIN {t} ON {t}.g = dp.g GROUP BY label),
b2 AS (SELECT u.label, sum(d) AS t FROM pr JOIN {t} u ON u.g = i JOIN {t} w ON w.g = j WHERE u.label = w.label GROUP BY u.label)
SELECT CASE WHEN count(*) < 2 THEN -1e18 ELSE (SELECT avg(d) FROM re2 a JOIN re2 b ON a.label < b.label JOIN pr ON i = a.g AND j = b.g) / (avg(coalesce(t / (m * m), 0)) + 1e-12) * CASE WHEN max(m) / sum(m) > 0.85 THEN 0.2 ELSE 1 END * CASE WHEN min(m) / sum(m) < {low} THEN 0.5 ELSE 1 END END FROM re2 LEFT JOIN b2 ON b2.label = re2.label)"""


def _mass_of(t: str) -> str:
    return f"""(WITH re2 AS (SELECT label, arg_max(dp.g, (dp.rho, -dp.g)) AS g, sum(n) AS m FROM dp JOIN {t} ON {t}.g = dp.g JOIN gr ON gr.g = dp.g GROUP BY label)
SELECT (SELECT avg(d) FROM re2 a JOIN re2 b ON a.label < b.label JOIN pr ON i = a.g AND j = b.g) / ((SELECT sum(coalesce(d, 0) * n) / sum(n) FROM {t} JOIN re2 ON re2.label = {t}.label JOIN gr ON gr.g = {t}.g LEFT JOIN pr ON i = {t}.g AND j = re2.g) + 1e-12) * CASE WHEN max(m) / sum(m) > 0.9 THEN 0.25 ELSE 1 END * CASE WHEN min(m) / sum(m) < 0.01 THEN 0.5 ELSE 1 END FROM re2)"""


_LM, _CC, _SC = ("largest", "smallest", "changed", "changed_mass"), ("old_consistency", "new_consistency"), ("old_score", "new_score")
query("accept_membership", BASE + f", {_gate(False)}, sc AS (SELECT {_score_of('la')} AS old_score, {_score_of('gv')} AS new_score) SELECT {r(*_LM)}, same_count, {r(*_SC, *_CC)}, changed > 0 AND same_count AND largest <= 0.85 AND changed <= 0.35 AND new_score + 1e-12 >= old_score AND new_consistency + 1e-12 >= old_consistency AS accepted FROM lm, sc, cc")(lambda v: refine.accept_membership(v.dp, v.la, v.gv, v.pr, v.ed))
query("accept_rounds", BASE + f", {_gate(False)}, sc AS (SELECT {_score_of('la', 0.01)} AS old_score, {_score_of('gv', 0.01)} AS new_score) SELECT {r(*_LM)}, same_count, {r(*_SC)}, same_count AND changed <= 0.35 AND largest <= 0.85 AND smallest >= 0.01 AND new_score + 1e-12 >= old_score AS accepted FROM lm, sc")(lambda v: refine.accept_rounds(v.dp, v.la, v.gv, v.pr))
query("accept_weighted", BASE + f", {_gate(True)}, sc AS (SELECT *, (new_score - old_score) / (abs(old_score) + 1e-12) AS gain FROM (SELECT {_mass_of('la')} AS old_score, {_mass_of('gv')} AS new_score)) SELECT {r(*_LM)}, same_count, {r(*_SC, *_CC, 'gain')}, changed > 0 AND same_count AND changed <= 0.2 AND changed_mass <= 0.1 AND largest <= 0.9 AND gain >= 0.002 AND new_consistency + 0.002 >= old_consistency AS accepted FROM lm, sc, cc")(lambda v: refine.accept_weighted(v.dp, v.la, v.gv, v.pr, v.ed, _mass(v)))
query("accept_assisted", BASE + f", {_gate(True)} SELECT {r(*_LM)}, same_count, same_count AND changed <= 0.15 AND changed_mass <= 0.08 AND largest <= 0.92 AS accepted FROM lm")(lambda v: refine.accept_assisted(v.la, v.gv, _mass(v)))


def _round(a: str, b: str) -> str:
    return f"""{b}v AS (SELECT fv.i AS g, {a}.label, sum(fv.v) AS v FROM fv JOIN {a} ON {a}.g = fv.j WHERE {a}.label >= 0 GROUP BY fv.i, {a}.label),
{b}o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, label) AS o FROM {b}v),
{b}m AS (SELECT x.g, x.label FROM {b}o x LEFT JOIN {b}o y ON y.g = x.g AND y.o = 2 WHERE x.o = 1 AND (x.v - coalesce(y.v, 0)) / (x.v + 1e-12) >= 0.15),
{b} AS (SELECT {a}.g, coalesce({b}m.label, {a}.label)::INT AS label FROM {a} LEFT JOIN {b}m ON {b}m.g = {a}.g)"""


_ambiguous = lambda v: natural.ambiguous(v.ed, v.la, v.dp).where("ambiguous").select("g")
_AMB = AMBIGUOUS.format(labels="(SELECT g, label, 1.0 AS confidence FROM la)").replace("ab AS (", "ab0 AS (") + ", ab AS (SELECT g FROM ab0 WHERE open OR weak OR mixed OR wide OR far)"
_FV = "iw AS (SELECT i AS j, greatest(sum(1 / (1 + d)), 1e-12) AS wj FROM ed GROUP BY i), fv AS (SELECT ed.i, ed.j, 1 / (1 + d) / wj * (1 / (1 + d)) * greatest(dp.rho, 1e-12) * sqrt(greatest(gr.n, 1)) AS v FROM ed JOIN iw ON iw.j = ed.j JOIN dp ON dp.g = ed.j JOIN gr ON gr.g = ed.j WHERE ed.i IN (SELECT g FROM ab) AND ed.i NOT IN (SELECT g FROM ce))"
query("assign_rounds", BASE + f", {_AMB}, {_FV}, fz0 AS (SELECT la.g, CASE WHEN ab.g IS NOT NULL AND ce.g IS NULL THEN -1 ELSE la.label END AS label FROM la LEFT JOIN ab ON ab.g = la.g LEFT JOIN ce ON ce.g = la.g), {_round('fz0', 'fz1')}, {_round('fz1', 'fz2')}, {_round('fz2', 'fz3')} SELECT fz3.g, CASE WHEN fz3.label < 0 THEN near ELSE fz3.label END::INT AS label FROM fz3 LEFT JOIN nc ON nc.g = fz3.g")(
    lambda v: refine.assign_rounds(v.dp, v.la.join(_ambiguous(v).withColumn("a", F.lit(True)), "g", "left").join(v.ce.select("g", F.lit(True).alias("c")), "g", "left").selectExpr("g", "if(a and c is null, -1, label) as label"), v.ed, _ambiguous(v), v.ce, v.pr, _mass(v), rounds=3)
)
_PICK = """, cz AS (SELECT 0 AS c, 'baseline' AS name, g, label FROM la UNION ALL SELECT 1, 'graph', g, label FROM gv UNION ALL SELECT 2, 'same', g, label FROM la),
sh AS (SELECT c, name, string_agg(label, ',' ORDER BY g) AS s FROM cz GROUP BY c, name), kp2 AS (SELECT c FROM sh QUALIFY row_number() OVER (PARTITION BY s ORDER BY c) = 1), cy AS (SELECT cz.* FROM cz JOIN kp2 ON kp2.c = cz.c),
rs AS (SELECT cy.c, label, arg_max(dp.g, (dp.rho, -dp.g)) AS rep, sum(n) AS m FROM cy JOIN dp ON dp.g = cy.g JOIN gr ON gr.g = cy.g GROUP BY cy.c, label),
sp2 AS (SELECT a.c, sum(a.m * b.m * d) / sum(a.m * b.m) AS sep FROM rs a JOIN rs b ON a.c = b.c AND a.label < b.label JOIN pr ON i = a.rep AND j = b.rep GROUP BY a.c),
cp AS (SELECT cy.c, sum(coalesce(d, 0) * n) / sum(n) AS comp FROM cy JOIN rs ON rs.c = cy.c AND rs.label = cy.label JOIN gr ON gr.g = cy.g LEFT JOIN pr ON i = cy.g AND j = rep GROUP BY cy.c),
pt2 AS (SELECT c, max(m) / sum(m) AS lg, min(m) / sum(m) AS sm FROM rs GROUP BY c),
ew AS (SELECT DISTINCT i, j, sqrt(x.n * y.n) / (1 + d) AS w FROM ed JOIN gr x ON x.g = i JOIN gr y ON y.g = j WHERE i < j),
cn AS (SELECT a.c, sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) / sum(w) AS consistency FROM ew JOIN cy a ON a.g = i JOIN cy b ON b.g = j AND a.c = b.c GROUP BY a.c),
mv AS (SELECT cy.c, any_value(name) AS name, avg((cy.label <> la.label)::INT) AS changed FROM cy JOIN la ON la.g = cy.g GROUP BY cy.c),
tb AS (SELECT mv.c, name, changed, consistency, sep / (comp + 1e-12) * CASE WHEN lg > 0.92 THEN 0.2 ELSE 1 END * CASE WHEN sm < 0.01 THEN 0.5 ELSE 1 END AS score FROM mv JOIN pt2 USING (c) JOIN cp USING (c) JOIN sp2 USING (c) JOIN cn USING (c)),
tg AS (SELECT tb.*, ln(tb.score / z.score) + 0.25 * (tb.consistency - z.consistency) - 0.75 * tb.changed AS gain FROM tb, tb z WHERE z.c = 0)
"""
query("pick_candidate", BASE + _PICK + f"SELECT name, {r('score', 'consistency', 'changed', 'gain')}, row_number() OVER (ORDER BY CASE WHEN c > 0 AND gain >= 0.005 THEN gain WHEN c = 0 THEN 0.0025 END DESC NULLS LAST, c) = 1 AS chosen FROM tg")(lambda v: refine.pick_candidate(v.dp, v.pr, v.ed, _mass(v), v.la, {"graph": v.gv, "same": v.la}))


# Scored lists of centres: the greedy choice once, then every list's chains and score.
_scored = _kept("scored_lists")(lambda v: candidates.scored(v.dp, v.pr)[0])
_LISTS = BASE + f""", tau AS (SELECT coalesce(median(delta) FILTER (WHERE delta > 0), 0) AS s FROM dp),
no AS (SELECT g, gamma, pick, count(*) OVER () AS m, (gamma - min(gamma) OVER ()) / (max(gamma) OVER () - min(gamma) OVER () + 1e-12) AS norm, lead(gamma) OVER (ORDER BY pick) AS nx, max(gamma) OVER () AS hi FROM ga),
nz AS (SELECT max(norm) FILTER (WHERE pick = 1) AS a, max(norm) FILTER (WHERE pick = m) AS z, avg(norm) + 0.5 * stddev_pop(norm) AS ov FROM no),
ru AS (SELECT unnest([(0, arg_max(pick, (round(greatest((gamma - nx) / (abs(gamma) + 1e-12), 0), 12), -pick)) FILTER (WHERE nx IS NOT NULL)), (1, max(pick) FILTER (WHERE gamma >= 0.2 * hi)), (2, max(pick) FILTER (WHERE norm >= ov)),
  (3, arg_max(pick, (round(abs((pick - 1) / (m - 1) * (z - a) - (norm - a)), 12), -pick))), (4, any_value(CASE WHEN (SELECT gamma FROM ga WHERE pick = 2) / (hi + 1e-12) >= 0.5 AND (SELECT d FROM pr JOIN ga x ON x.g = i AND x.pick = 1 JOIN ga y ON y.g = j AND y.pick = 2) > (SELECT s FROM tau) THEN 2 ELSE 1 END))]) AS e FROM no, nz),
ls0 AS (SELECT e[1] AS o, e[2] AS size FROM ru),
{_walk(_ALLGA, 'SELECT i AS g, j AS h FROM pr, tau WHERE d <= s', '1000000', '1', '9')},
kp9 AS (SELECT ga.g, gamma, pick, (row_number() OVER (ORDER BY pick) - 1)::INT AS label FROM ga, fi9 WHERE list_contains(chosen, ga.g)),
lc AS (SELECT min(o) AS o, k FROM (SELECT o, count(*) AS k FROM ls0 JOIN kp9 ON pick <= size GROUP BY o) GROUP BY k),
ow AS (SELECT o, k, kp9.* FROM lc JOIN kp9 ON label < k),
wk AS (SELECT o, dp.g, dp.g AS at FROM lc, dp UNION ALL SELECT wk.o, wk.g, dp.parent FROM wk JOIN dp ON dp.g = wk.at WHERE dp.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ow WHERE ow.o = wk.o AND ow.g = wk.at)),
rt AS (SELECT wk.o, wk.g, ow.label FROM wk JOIN ow ON ow.o = wk.o AND ow.g = wk.at),
ne AS (SELECT o, i AS g, arg_min(label, (d, label)) AS near FROM pr JOIN ow ON ow.g = j GROUP BY o, i),
lb AS (SELECT lc.o, dp.g, coalesce(rt.label, near, 0) AS label FROM lc CROSS JOIN dp LEFT JOIN rt ON rt.o = lc.o AND rt.g = dp.g LEFT JOIN ne ON ne.o = lc.o AND ne.g = dp.g),
ni AS (SELECT lb.o, avg(coalesce(d, 0)) AS i FROM lb JOIN ow ON ow.o = lb.o AND ow.label = lb.label LEFT JOIN pr ON pr.i = lb.g AND pr.j = ow.g GROUP BY lb.o),
nu AS (SELECT a.o, avg(d) AS u FROM ow a JOIN ow b ON a.o = b.o AND a.label < b.label JOIN pr ON i = a.g AND j = b.g GROUP BY a.o),
nv AS (SELECT o, avg((s <= 1)::INT) AS tiny, stddev_pop(s) / (avg(s) + 1e-12) AS vary FROM (SELECT o, label, count(*) AS s FROM lb GROUP BY o, label) GROUP BY o),
ng AS (SELECT o, sum(gamma) / ((SELECT sum(gamma) FROM ga) + 1e-12) AS share FROM ow GROUP BY o),
sl AS (SELECT lc.o, lc.k, coalesce(u, 0) / (ni.i + 1e-12) + 0.35 * share - 0.6 * tiny - 0.25 * CASE WHEN lc.k > 1 THEN vary ELSE 0 END - 0.2 * lc.k / (SELECT count(*) FROM dp) AS score FROM lc JOIN ni ON ni.o = lc.o LEFT JOIN nu ON nu.o = lc.o JOIN nv ON nv.o = lc.o JOIN ng ON ng.o = lc.o),
bl AS (SELECT arg_max(o, (score, -o)) AS o FROM sl)
"""
query("scored_centre_lists", _LISTS + f"SELECT sl.k::INT AS k, {r('score')}, sl.o = bl.o AS chosen FROM sl, bl")(_scored)
query("centers_scored", _LISTS + "SELECT ow.g, ow.label FROM ow JOIN bl ON bl.o = ow.o")(lambda v: candidates.scored(v.dp, v.pr)[1])
