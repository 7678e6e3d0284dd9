"""Registered queries: spatial operators (X1-X10, J6, J7). Oracles are
brute force: all pairs inside each group, which is fine for the small
correctness fixture and is exactly what the Spark jobs avoid."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import spatial as SP
from sitewise.plans import bindings as B
from sitewise.plans.registry import r6, register
from sitewise.session import shared_path
from sitewise.sources import io as IO

XS, YS = SP.utm_sql("lon", "lat")
PTS_SQL = f"""SELECT id, grp, lon, lat, round({XS}, 3) AS x, round({YS}, 3) AS y FROM ({B.POINTS_SQL}) p
WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)"""
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

# Test polygons (lon/lat rings) standing in for the region layer.
POLYGONS = [
    ("North", [(29.0, -6.0), (41.0, -6.0), (41.0, 0.0), (29.0, 0.0)]),
    ("South-West", [(29.0, -12.0), (35.0, -12.0), (35.0, -6.0), (29.0, -6.0)]),
    ("South-East", [(35.0, -12.0), (41.0, -12.0), (41.0, -6.0), (38.0, -9.0), (35.0, -6.0)]),
]


def pts(s, d):
    return SP.to_points(B.points(s, d))


register("project_utm", sql=f"SELECT id, x, y FROM ({PTS_SQL}) t")(lambda s, d: pts(s, d).select("id", "x", "y"))

register(
    "region_centroid",
    sql=f"SELECT grp, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, COUNT(*) AS n FROM ({PTS_SQL}) t GROUP BY grp",
)(lambda s, d: SP.centroids(pts(s, d), ["grp"]).select("grp", r6("cx"), r6("cy"), "n"))

register(
    "centroid_outliers",
    sql=f"""WITH p AS ({PTS_SQL}), c AS (SELECT grp, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM p GROUP BY grp),
d AS (SELECT p.grp, p.id, round(sqrt((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy)), 6) AS dist FROM p JOIN c ON p.grp = c.grp),
q AS (SELECT grp, quantile_cont(dist, 0.99) AS threshold FROM d GROUP BY grp)
SELECT d.grp, d.id, d.dist, round(q.threshold, 6) AS threshold, COALESCE(d.dist > q.threshold, false) AS is_outlier
FROM d LEFT JOIN q ON d.grp = q.grp""",
)(lambda s, d: SP.centroid_outliers(pts(s, d), ["grp"], "id").withColumn("threshold", F.round("threshold", 6)))

KNN_K = 5
register(
    "knn_grid",
    sql=f"""WITH p AS ({PTS_SQL}),
d AS (SELECT a.grp, a.id, b.id AS nbr_id, {DIST} AS dist FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY dist, nbr_id) AS rank FROM d)
SELECT grp, id, CAST(rank AS INTEGER) AS rank, nbr_id, round(dist, 6) AS dist FROM r WHERE rank <= {KNN_K}""",
)(lambda s, d: SP.knn_points(pts(s, d).select("grp", "id", "x", "y"), ["grp"], "id", KNN_K).withColumn("dist", F.round("dist", 6)))

LOF_K, LOF_TOP = 15, 5.0


def lof_sql(only_outliers: bool = False) -> str:
    kn = LOF_K - 1
    body = f"""WITH p AS ({PTS_SQL}),
sz AS (SELECT grp, COUNT(*) AS n FROM p GROUP BY grp),
d AS (SELECT a.grp, a.id, b.id AS nid, {DIST} AS dist FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY dist, nid) AS rn FROM d) t WHERE rn <= {kn}),
kd AS (SELECT grp, id, max(dist) AS kdist FROM nn GROUP BY grp, id),
lrd AS (SELECT nn.grp, nn.id, {float(kn)} / SUM(greatest(kd.kdist, nn.dist)) AS lrd
        FROM nn JOIN kd ON nn.grp = kd.grp AND nn.nid = kd.id GROUP BY nn.grp, nn.id),
lof AS (SELECT nn.grp, nn.id, round(SUM(l2.lrd) / ({float(kn)} * MAX(l1.lrd)), 9) AS lof
        FROM nn JOIN lrd l1 ON nn.grp = l1.grp AND nn.id = l1.id JOIN lrd l2 ON nn.grp = l2.grp AND nn.nid = l2.id
        GROUP BY nn.grp, nn.id),
th AS (SELECT grp, quantile_cont(lof, {1 - LOF_TOP / 100}) AS q FROM lof GROUP BY grp),
res AS (SELECT p.grp, p.id, CASE WHEN sz.n <= {LOF_K} THEN NULL ELSE round(lof.lof, 6) END AS lof,
               COALESCE(sz.n > {LOF_K} AND lof.lof > th.q, false) AS is_outlier
        FROM p JOIN sz ON p.grp = sz.grp LEFT JOIN lof ON p.grp = lof.grp AND p.id = lof.id LEFT JOIN th ON p.grp = th.grp)
SELECT * FROM res"""
    return body + (" WHERE is_outlier" if only_outliers else "")


def lof(s, d):
    out = SP.lof_by_group(pts(s, d).select("grp", "id", "x", "y"), ["grp"], "id", LOF_K, LOF_TOP)
    return out.withColumn("lof", F.round("lof", 6))


register("lof_by_group", sql=lof_sql())(lof)
register("lof_outliers", sql=lof_sql(True))(lambda s, d: lof(s, d).where("is_outlier"))

register(
    "region_spread",
    sql=f"""WITH p AS ({PTS_SQL})
SELECT a.grp, round(max({DIST}), 6) AS spread FROM p a JOIN p b ON a.grp = b.grp GROUP BY a.grp""",
)(lambda s, d: SP.region_spread(pts(s, d), "grp").select("grp", r6("spread")))


def polygons_df(s):
    rows = [(name, [{"x": x, "y": y} for x, y in ring]) for name, ring in POLYGONS]
    path = shared_path(s, "polygons")
    s.createDataFrame(rows, IO.POLYGON_SCHEMA).write.json(path)
    return IO.read_polygons(s, path)


def _edges_sql():
    vals = []
    for name, ring in POLYGONS:
        for i, (x1, y1) in enumerate(ring):
            x2, y2 = ring[(i + 1) % len(ring)]
            vals.append(f"('{name}', {x1!r}, {y1!r}, {x2!r}, {y2!r})")
    return "SELECT * FROM (VALUES " + ", ".join(vals) + ") e(name, x1, y1, x2, y2)"


register(
    "region_polygon_check",
    sql=f"""WITH p AS ({B.POINTS_SQL}), e AS ({_edges_sql()}),
bb AS (SELECT name, min(x1) AS x0, max(x1) AS xm, min(y1) AS y0, max(y1) AS ym FROM e GROUP BY name),
c AS (SELECT p.id, e.name,
        SUM(CASE WHEN ((e.y1 > p.lat) <> (e.y2 > p.lat)) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
                 THEN 1 ELSE 0 END) AS k
      FROM p JOIN e ON TRUE JOIN bb ON bb.name = e.name
      WHERE p.lon BETWEEN bb.x0 AND bb.xm AND p.lat BETWEEN bb.y0 AND bb.ym GROUP BY p.id, e.name),
ins AS (SELECT id, min(name) AS poly_region FROM c WHERE k % 2 = 1 GROUP BY id)
SELECT p.id, p.grp, p.lon, p.lat, ins.poly_region FROM p LEFT JOIN ins ON p.id = ins.id""",
)(lambda s, d: SP.point_in_polygons(B.points(s, d), polygons_df(s)))

register(
    "map_extent_filter",
    sql=f"SELECT id, grp, lon, lat FROM ({B.POINTS_SQL}) p WHERE lon BETWEEN 25 AND 45 AND lat BETWEEN -15 AND 0",
)(lambda s, d: SP.extent_filter(B.points(s, d), "lon", "lat", (25.0, 45.0), (-15.0, 0.0)))

register(
    "map_points_grid",
    sql=f"""SELECT grp, CAST(floor(lon / 0.5) AS BIGINT) AS bin_x, CAST(floor(lat / 0.5) AS BIGINT) AS bin_y, COUNT(*) AS n
FROM ({B.POINTS_SQL}) p GROUP BY 1, 2, 3""",
)(lambda s, d: SP.grid_counts(B.points(s, d), "lon", "lat", 0.5, 0.5, ["grp"]))

register(
    "scatter_bins",
    sql=f"""SELECT status_group, CAST(floor(o_totalprice / 50000.0) AS BIGINT) AS bin_x, CAST(floor(c_acctbal / 1000.0) AS BIGINT) AS bin_y,
  COUNT(*) AS n FROM ({B.ORDER_SITES_SQL}) o GROUP BY 1, 2, 3""",
)(lambda s, d: SP.grid_counts(B.order_sites(s, d), "o_totalprice", "c_acctbal", 50000.0, 1000.0, ["status_group"]))
