"""Queries of the metric index and of order-dependent propagation; their SQL walks all pairs and all granules."""

from __future__ import annotations

from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import graph, grid, index, labels
from granula.plans.registry import BASE, LAMBDA, query, r
from granula.sources import io


def _centroids(v):
    """Granules of the whole vectors, (label, vec_id % 4), with their centres."""
    rows = io.load(v.spark, v.dir).select(F.expr("label * 4L + point_id % 4").alias("g"), F.posexplode("features").alias("p", "x"))
    means = rows.groupBy("g", "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return durable(means.groupBy("g").agg(F.max("n").cast("double").alias("density"), F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("centre")))


def _strong(v):
    rows = durable(index.plane(v.gr))
    return graph.strong_graph(graph.strong_links(rows), rows, v.ce, labels.nearest_centre(v.pr, v.ce))


def _reliable(v, share):
    return graph.reliable(v.ed, v.gr.select("g", F.col("density").alias("rho"), "n"), v.ce, share).withColumn("label", F.coalesce("label", F.lit(-1)))


query("knn_index", BASE + f"SELECT i, j, {r('d')}, r::INT AS r FROM kn WHERE r <= 5")(lambda v: index.nearest(index.plane(v.gr), 5).links)
query("knn_index_zero_based", BASE + f"SELECT i, j, {r('d')}, (r - 1)::INT AS r FROM kn WHERE r <= 3")(lambda v: index.zero_based(index.nearest(index.plane(v.gr), 3).links))
_DEEP = """WITH c0 AS (SELECT (label * 4 + vec_id % 4)::BIGINT AS g, unnest(range(1, 65)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
c1 AS (SELECT g, p, avg(x) AS x, count(*) AS n FROM c0 GROUP BY g, p), c AS (SELECT g, list(x ORDER BY p) AS v, max(n) AS n FROM c1 GROUP BY g),
d AS (SELECT a.g AS i, b.g AS j, list_distance(a.v, b.v) AS d, a.n AS ni, b.n AS nj FROM c a JOIN c b ON a.g <> b.g)
"""
query("knn_index_64d", _DEEP + f"SELECT i, j, {r('d')}, row_number() OVER (PARTITION BY i ORDER BY d, j)::INT AS r FROM d QUALIFY r <= 5")(lambda v: index.nearest(index.balls(_centroids(v)), 5).links)
query("denser_index_64d", _DEEP + f"SELECT i, j, {r('d')}, row_number() OVER (PARTITION BY i ORDER BY d, j)::INT AS r FROM d WHERE nj > ni QUALIFY r <= 3")(lambda v: index.nearest(index.balls(_centroids(v)), 3, denser=True).links)
query("nearest_denser_index", BASE + f"SELECT g, {r('rho', 'delta')}, coalesce(parent, -1) AS parent, {r('rho * delta AS gamma')} FROM dp")(
    lambda v: index.attributes(durable(index.plane(v.gr))).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))
)
#: The granules one after the other, in the order of density; ls holds the labels given so far.
query("strong_graph_labels", BASE + """, so AS (SELECT x.i, x.j, x.k, x.rho_j / (x.d + 1e-9 * m) AS w, x.pos, x.pos_j
  FROM (SELECT cd.*, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM cd WHERE rho_j > rho) x, (SELECT median(d) AS m FROM (SELECT d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM cd WHERE rho_j > rho) WHERE d > 0 AND k <= greatest(2, ceil(log2((SELECT count(*) FROM gr)))))
  WHERE k <= greatest(2, ceil(log2((SELECT count(*) FROM gr))))),
oc1 AS (SELECT od.pos, od.g, ce.label AS own, nc.near FROM od LEFT JOIN ce ON ce.g = od.g LEFT JOIN nc ON nc.g = od.g),
sq AS (SELECT 0::BIGINT AS step, []::INT[] AS ls UNION ALL
  SELECT step, list_append(ls, coalesce(own, arg_max(lab, (v, -first)), near, 0)) FROM
    (SELECT step + 1 AS step, ls, o.own, o.near, ls[so.pos_j] AS lab, sum(so.w) AS v, min(so.k) AS first FROM sq JOIN oc1 o ON o.pos = step + 1 LEFT JOIN so ON so.pos = o.pos GROUP BY ALL)
  GROUP BY step, ls, own, near)
SELECT od.g, (SELECT ls FROM sq ORDER BY step DESC LIMIT 1)[od.pos] AS label FROM od""")(_strong)
_RELIABLE = BASE + """, wt AS (SELECT i, median(d) FILTER (WHERE d > 0) AS s FROM ed GROUP BY i),
wv AS (SELECT u.pos, x.pos AS pos_j, ed.r, exp(-((d / greatest(coalesce(wt.s, 1), 1e-12)) ** 2)) * greatest(gr.density, 1e-12) * sqrt(greatest(gr.n, 1)) AS w FROM ed JOIN wt ON wt.i = ed.i JOIN od u ON u.g = ed.i JOIN od x ON x.g = ed.j JOIN gr ON gr.g = ed.j),
nm AS (SELECT count(*) AS m FROM gr),
rs AS (SELECT 0::BIGINT AS step, (SELECT list(coalesce(ce.label, -1)::INT ORDER BY od.pos) FROM od LEFT JOIN ce ON ce.g = od.g) AS ls, (SELECT list((CASE WHEN ce.g IS NULL THEN 0 ELSE 1 END)::DOUBLE ORDER BY od.pos) FROM od LEFT JOIN ce ON ce.g = od.g) AS cs UNION ALL
  SELECT step + 1, CASE WHEN hit THEN list_concat(ls[1:place - 1], [lab], ls[place + 1:]) ELSE ls END, CASE WHEN hit THEN list_concat(cs[1:place - 1], [conf], cs[place + 1:]) ELSE cs END FROM
    (SELECT step, ls, cs, place, arg_max(lab, (v, -first)) FILTER (WHERE v IS NOT NULL) AS lab, max(v) / (sum(v) + 1e-12) AS conf, ls[place] < 0 AND coalesce(max(v) / (sum(v) + 1e-12) >= {share} AND sum(v) > 0, false) AS hit FROM
      (SELECT step, ls, cs, place, lab, sum(w) AS v, min(r) AS first FROM
        (SELECT rs.step, rs.ls, rs.cs, (rs.step % m + 1) AS place, rs.ls[wv.pos_j] AS lab, wv.w, wv.r FROM rs JOIN nm ON rs.step < m * 12 LEFT JOIN wv ON wv.pos = rs.step % m + 1)
        WHERE lab IS NULL OR lab >= 0 OR true GROUP BY step, ls, cs, place, lab)
      GROUP BY step, ls, cs, place))
SELECT od.g, ls[od.pos] AS label, round(cs[od.pos], 6) + 0.0 AS confidence FROM od, (SELECT ls, cs FROM rs ORDER BY step DESC LIMIT 1)"""
#: Neighbours without label do not vote.
_RELIABLE = _RELIABLE.replace("WHERE lab IS NULL OR lab >= 0 OR true GROUP BY", "GROUP BY").replace("sum(w) AS v, min(r)", "sum(CASE WHEN lab >= 0 THEN w END) AS v, min(r)")
query("reliable_labels", _RELIABLE.format(share=0.7))(lambda v: _reliable(v, 0.7))
query("reliable_labels_all", _RELIABLE.format(share=0.0))(lambda v: _reliable(v, 0.0))


# The grid at three components.
_BINS = 7


class _Grid:
    """The grid's tables of a View, each written once."""

    def __init__(self, v):
        points = io.load(v.spark, v.dir).select(F.col("point_id").alias("id"), F.slice("features", 1, 3).alias("features"))
        self.cells = durable(grid.cells(grid.unit(points), _BINS))
        self.occ = durable(grid.occupied(self.cells))


def _grid(v) -> _Grid:
    if "grid" not in v.__dict__:
        v.__dict__["grid"] = _Grid(v)
    return v.__dict__["grid"]


_GRID = f"""WITH RECURSIVE gp0 AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
gp1 AS (SELECT id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS z FROM gp0),
gc AS (SELECT *, least({_BINS - 1}, floor(x * {_BINS}))::INT AS kx, least({_BINS - 1}, floor(y * {_BINS}))::INT AS ky, least({_BINS - 1}, floor(z * {_BINS}))::INT AS kz FROM gp1),
oc AS (SELECT kx, ky, kz, min(id) AS node, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM gc GROUP BY ALL),
ad AS (SELECT a.node AS u, b.node AS v FROM oc a JOIN oc b ON abs(a.kx - b.kx) <= 1 AND abs(a.ky - b.ky) <= 1 AND abs(a.kz - b.kz) <= 1 AND a.node <> b.node),
re AS (SELECT node AS u, node AS v FROM oc UNION SELECT re.u, ad.v FROM re JOIN ad ON ad.u = re.v),
co AS (SELECT u AS node, min(v) AS component FROM re GROUP BY u),
sz AS (SELECT component, sum(n) AS n, row_number() OVER (ORDER BY sum(n) DESC, component) - 1 AS seed FROM oc JOIN co ON co.node = oc.node GROUP BY component HAVING sum(n) >= 2)
"""
_keys = lambda: [F.col("cell")[i].alias(k) for i, k in enumerate(("kx", "ky", "kz"))]
query("grid3_point_cell", _GRID + "SELECT id, kx, ky, kz FROM gc")(lambda v: _grid(v).cells.select("id", *_keys()))
query("grid3_cells", _GRID + f"SELECT kx, ky, kz, node, n, {r('mx', 'my', 'mz')} FROM oc")(lambda v: _grid(v).occ.select(*_keys(), "node", "n", *(F.col("centre")[i].alias(k) for i, k in enumerate(("mx", "my", "mz")))))
query("grid3_adjacency", _GRID + "SELECT u, v FROM ad")(lambda v: grid.adjacent(_grid(v).occ))
query("grid3_components", _GRID + "SELECT node, component FROM co")(lambda v: grid.components(_grid(v).occ, grid.adjacent(_grid(v).occ)))
query("grid3_seeds", _GRID + "SELECT gc.id, coalesce(seed, -1)::BIGINT AS seed FROM gc JOIN oc USING (kx, ky, kz) JOIN co ON co.node = oc.node LEFT JOIN sz ON sz.component = co.component")(
    lambda v: grid.seeds(_grid(v).cells, grid.components(_grid(v).occ, grid.adjacent(_grid(v).occ)), _grid(v).occ, 2)
)
