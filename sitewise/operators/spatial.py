"""Spatial operators (X1-X10, J6, J7): projection, centroids, exact grid kNN,
local outlier factor, spread via convex hulls, point-in-polygon.

Scale notes
-----------
* Projection is native Column maths (no UDF).
* kNN never compares all pairs of a group. Points are first collapsed to
  distinct locations with a multiplicity (a pile of copies at one spot is one
  row), then each location looks only at the grid cells around it; the few
  locations whose k-th neighbour may lie outside the searched block are
  retried with a doubled ring until the ring covers the group's extent. Each
  round's leftovers are checkpointed into the shared checkpoint folder.
* LOF works on locations: all copies at a location share the same k-distance,
  reachability density and score, so nothing is enumerated per copy.
* The largest pairwise distance lies between convex-hull vertices: partial
  hulls per partition, then one small hull per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import checkpoint as _ckpt

from sitewise.functions import columns as C
from sitewise.functions.quantiles import exact_quantiles
from sitewise.operators.windows import attach

# WGS84 ellipsoid and UTM zone 37 south (EPSG 32737).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM37_LON0 = 39.0
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0


def _utm_constants(a: float = WGS84_A, f: float = WGS84_F) -> dict:
    """Krüger series to third order in n (Karney 2011, eqs. 35-36)."""
    n = f / (2 - f)
    return {
        "A": a / (1 + n) * (1 + n * n / 4 + n**4 / 64),
        "c": 2 * math.sqrt(n) / (1 + n),
        "alpha": [n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240],
    }


def project_utm(lon: str | Column, lat: str | Column, lon0: float = UTM37_LON0, south: bool = True) -> tuple[Column, Column]:
    """(easting, northing) in metres of WGS84 lon/lat degrees."""
    k = _utm_constants()
    lam = (F.col(lon) if isinstance(lon, str) else lon) - F.lit(lon0)
    phi = F.col(lat) if isinstance(lat, str) else lat
    lam, phi = F.radians(lam), F.radians(phi)
    sphi = F.sin(phi)
    t = F.sinh(F.atanh(sphi) - F.lit(k["c"]) * F.atanh(F.lit(k["c"]) * sphi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    e_sum, n_sum = eta, xi
    for j, a in enumerate(k["alpha"], start=1):
        e_sum = e_sum + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        n_sum = n_sum + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    scale = UTM_K0 * k["A"]
    x = F.lit(UTM_FALSE_EASTING) + F.lit(scale) * e_sum
    y = (F.lit(UTM_FALSE_NORTHING_SOUTH) if south else F.lit(0.0)) + F.lit(scale) * n_sum
    return x, y


def utm_sql(lon: str, lat: str, lon0: float = UTM37_LON0) -> tuple[str, str]:
    """The same projection as SQL text (for oracles)."""
    k = _utm_constants()
    c = repr(k["c"])
    lam = f"radians({lon} - {lon0!r})"
    phi = f"radians({lat})"
    t = f"sinh(atanh(sin({phi})) - {c} * atanh({c} * sin({phi})))"
    xi = f"atan2({t}, cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt(1.0 + ({t}) * ({t})))"
    e_terms = " + ".join(f"{a!r} * cos({2.0 * j!r} * {xi}) * sinh({2.0 * j!r} * {eta})" for j, a in enumerate(k["alpha"], 1))
    n_terms = " + ".join(f"{a!r} * sin({2.0 * j!r} * {xi}) * cosh({2.0 * j!r} * {eta})" for j, a in enumerate(k["alpha"], 1))
    scale = repr(UTM_K0 * k["A"])
    return (f"({UTM_FALSE_EASTING!r} + {scale} * ({eta} + {e_terms}))",
            f"({UTM_FALSE_NORTHING_SOUTH!r} + {scale} * ({xi} + {n_terms}))")


def to_points(df: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 3) -> DataFrame:
    """Rows with both coordinates present, projected to metres (rounded to mm)."""
    ok = df.where(~C.is_missing(lon) & ~C.is_missing(lat))
    x, y = project_utm(lon, lat)
    return ok.withColumns({"x": F.round(x, digits), "y": F.round(y, digits)})


def _dist(ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))


# ---------------------------------------------------------------- centroids

def centroids(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Centroid of a point set = mean coordinate; plus count."""
    return df.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("n"))


def centroid_outliers(df: DataFrame, by: Sequence[str], id_col: str, x: str = "x", y: str = "y", p: float = 0.99,
                      centroid_digits: int | None = 6) -> DataFrame:
    """Distance to the group centroid; flag above the group's p-quantile (strict).

    The centroid is rounded (default 1 micrometre) so the result does not
    depend on the order in which partial sums were added."""
    by = list(by)
    c = centroids(df, by, x, y)
    if centroid_digits is not None:
        c = c.withColumns({"cx": F.round("cx", centroid_digits), "cy": F.round("cy", centroid_digits)})
    d = attach(df, c.drop("n"), by, "inner").withColumn("dist", _dist(F.col(x), F.col(y), F.col("cx"), F.col("cy")))
    d = d.withColumn("dist", F.round("dist", 6))
    q = exact_quantiles(d, "dist", [p], ["threshold"], by)
    return attach(d, q, by).select(*by, id_col, "dist", "threshold",
                                        F.coalesce(F.col("dist") > F.col("threshold"), F.lit(False)).alias("is_outlier"))


# ---------------------------------------------------------------- exact grid kNN (J7, inside X3 and SMOTE)

def _locations(df: DataFrame, by: list[str], id_col: str, x: str, y: str) -> DataFrame:
    """Distinct locations with multiplicity ``m`` and smallest id ``loc``."""
    return df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("m"), F.min(id_col).alias("loc")
    )


def _group_cells(locs: DataFrame, by: list[str], per_cell: int) -> DataFrame:
    """Per group: origin, base cell size (about ``per_cell`` locations per cell
    at the group's average density) and the diagonal of its extent."""
    g = locs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_nl"),
        F.min("x").alias("x0"), F.max("x").alias("_x1"), F.min("y").alias("y0"), F.max("y").alias("_y1"),
    )
    w = F.col("_x1") - F.col("x0")
    h = F.col("_y1") - F.col("y0")
    area = w * h
    size = F.when(area > 0, F.sqrt(area * F.lit(per_cell) / F.col("_nl"))).otherwise(
        F.greatest(F.greatest(w, h) * F.lit(per_cell) / F.col("_nl"), F.lit(1e-6))
    )
    return g.select(*by, "x0", "y0", size.alias("s0"), F.sqrt(w * w + h * h).alias("diag"))


def _cell(coord: str, origin: str, level: Column | int) -> Column:
    lv = F.lit(level) if isinstance(level, int) else level
    return F.floor((F.col(coord) - F.col(origin)) / (F.col("s0") / F.pow(F.lit(2.0), lv))).cast("long")


MAX_LEVEL = 30  # finest cell = base / 2^30
REFINE_FACTOR = 4  # a fine cell may hold up to 4x the target before refining


def _refine_levels(locs: DataFrame, by: list[str], per_cell: int, max_iter: int = 10) -> DataFrame:
    """Level per coarse cell, quadtree style: start from the cell's count,
    recount locations per fine cell at that level and refine the coarse cells
    whose densest fine cell is still above REFINE_FACTOR * per_cell. Each pass
    is one aggregate over the (collapsed) locations; passes stop when no cell
    needs refining. Output: by, c0x, c0y, clvl."""
    counts = locs.groupBy(*by, "c0x", "c0y").agg(F.count(F.lit(1)).alias("cc"))
    limit = REFINE_FACTOR * per_cell
    if counts.where(F.col("cc") > limit).isEmpty():
        # No crowded cell anywhere: the base grid is already bounded.
        return counts.select(*by, "c0x", "c0y", F.lit(0).alias("clvl"))
    start = F.when(F.col("cc") <= limit, F.lit(0)).otherwise(
        F.least(F.lit(MAX_LEVEL), F.ceil(F.log(4.0, F.col("cc") / F.lit(float(per_cell))))))
    lv = _ckpt(counts.select(*by, "c0x", "c0y", start.cast("int").alias("clvl")))
    for _ in range(max_iter):
        at = locs.select(*by, "c0x", "c0y", "x", "y", "x0", "y0", "s0").join(lv, [*by, "c0x", "c0y"])
        fine = at.groupBy(*by, "c0x", "c0y", "clvl", _cell("x", "x0", F.col("clvl")).alias("fx"),
                          _cell("y", "y0", F.col("clvl")).alias("fy")).agg(F.count(F.lit(1)).alias("fc"))
        worst = fine.groupBy(*by, "c0x", "c0y", "clvl").agg(F.max("fc").alias("fmax"))
        over = worst.where((F.col("fmax") > limit) & (F.col("clvl") < MAX_LEVEL))
        if over.isEmpty():
            break
        step = F.greatest(F.lit(1), F.ceil(F.log(4.0, F.col("fmax") / F.lit(float(per_cell))))).cast("int")
        bumped = worst.select(*by, "c0x", "c0y", F.when(F.col("fmax") > limit, F.least(F.lit(MAX_LEVEL), F.col("clvl") + step))
                              .otherwise(F.col("clvl")).alias("clvl"))
        lv = _ckpt(bumped)
    return lv
RING_MAX = 4    # at most (2*4+1)^2 = 81 cells searched per location and round


def knn_locations(df: DataFrame, by: Sequence[str], id_col: str, k: int, x: str = "x", y: str = "y",
                  max_rounds: int = 80) -> tuple[DataFrame, DataFrame]:
    """Exact weighted k-nearest neighbours of every distinct location.

    Returns (locs, nbrs):
      locs: by, x, y, m, loc, kdist, w0 (copies of itself used as neighbours)
      nbrs: by, loc, nbr_loc, dist, take (how many copies of nbr_loc are used)
    Neighbour order is (distance, location id); k counts points, not locations.

    Cells adapt to local density: a coarse grid (about 2(k+1) locations per
    cell on average) gives each coarse cell a level j so that the densest cell
    of its 3x3 neighbourhood splits into cells of about 2(k+1) locations at
    size base / 2^j. A location searches the (2r+1)^2 cells around it at its
    level; it is resolved when its k-th neighbour is closer than r cells (so
    nothing outside the block can be nearer) or the block covers the group.
    Otherwise the searched distance doubles: first by widening the ring up to
    ``RING_MAX``, then by moving to the next coarser level in use.
    """
    by = list(by)
    per_cell = 2 * (k + 1)
    locs = _locations(df, by, id_col, x, y)
    locs = locs.join(_group_cells(locs, by, per_cell), by)
    locs = locs.withColumns({"c0x": _cell("x", "x0", 0), "c0y": _cell("y", "y0", 0)})
    locs = _ckpt(locs)  # read by every step below: materialise once in the shared folder
    cell_lvl = _refine_levels(locs, by, per_cell)
    # A location searches at the finest level of its 3x3 coarse neighbourhood:
    # finer cells only split counts, so every searched cell stays bounded.
    off1 = F.sequence(F.lit(-1), F.lit(1))
    spread = cell_lvl.withColumn("dx", F.explode(off1)).withColumn("dy", F.explode(off1)).select(
        *by, (F.col("c0x") + F.col("dx")).alias("c0x"), (F.col("c0y") + F.col("dy")).alias("c0y"), "clvl")
    block = spread.groupBy(*by, "c0x", "c0y").agg(F.max("clvl").alias("lvl"))
    locs = locs.join(block, [*by, "c0x", "c0y"], "left")
    locs = locs.withColumns({
        "lvl": F.coalesce("lvl", F.lit(0)),
        "w0": F.least(F.col("m") - 1, F.lit(k)),
        "need": F.lit(k) - F.least(F.col("m") - 1, F.lit(k)),
    }).drop("c0x", "c0y")
    # Levels in use plus the base level (so coarsening always has a target);
    # at most MAX_LEVEL + 1 small integers.
    levels = sorted({0} | {r[0] for r in locs.select("lvl").distinct().collect()})

    # Data side: every location indexed at every level in use.
    data = locs.select(*by, "x0", "y0", "s0", F.col("loc").alias("nbr_loc"), "x", "y", F.col("m").alias("om"),
                       F.explode(F.array(*[F.lit(v) for v in levels])).alias("lvl"))
    data = data.select(*by, "lvl", "nbr_loc", F.col("x").alias("ox"), F.col("y").alias("oy"), "om",
                       _cell("x", "x0", F.col("lvl")).alias("ocx"), _cell("y", "y0", F.col("lvl")).alias("ocy"))
    data = _ckpt(data)

    coarser = None  # next coarser level in use, as a CASE over the (few) levels
    for lo, hi in zip(levels, levels[1:]):
        coarser = (F.when if coarser is None else coarser.when)(F.col("lvl") == hi, F.lit(lo))
    coarser = (coarser.otherwise(F.col("lvl")) if coarser is not None else F.col("lvl"))

    pending = locs.where(F.col("need") > 0).select(*by, "loc", "x", "y", "x0", "y0", "s0", "diag", "need", "lvl",
                                                  F.lit(1).alias("r"))
    pending = _ckpt(pending)
    found = []
    for _ in range(max_rounds):
        if pending.isEmpty():
            break
        q = pending.withColumns({"cx": _cell("x", "x0", F.col("lvl")), "cy": _cell("y", "y0", F.col("lvl"))})
        off = F.sequence(-F.col("r"), F.col("r"))
        q = q.withColumn("dx", F.explode(off)).withColumn("dy", F.explode(off))
        q = q.withColumns({"ocx": F.col("cx") + F.col("dx"), "ocy": F.col("cy") + F.col("dy")}).drop("dx", "dy")
        cand = q.join(data, [*by, "lvl", "ocx", "ocy"]).where(F.col("nbr_loc") != F.col("loc"))
        cand = cand.withColumn("dist", _dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
        w = Window.partitionBy(*by, "loc").orderBy("dist", "nbr_loc")
        before = F.coalesce(F.sum("om").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cand = cand.withColumn("take", F.least(F.col("om"), F.col("need") - before))
        # The one heavy step of the round (block join + ranking), written once.
        taken = _ckpt(cand.where(F.col("take") > 0).select(*by, "loc", "nbr_loc", "dist", "take"))
        stat = taken.groupBy(*by, "loc").agg(F.sum("take").alias("got"), F.max("dist").alias("kd"))
        reach = F.col("r") * F.col("s0") / F.pow(F.lit(2.0), F.col("lvl"))
        judged = pending.withColumn("reach", reach).join(stat, [*by, "loc"], "left")
        ok = (F.coalesce(F.col("got"), F.lit(0)) >= F.col("need")) & (F.col("kd") < F.col("reach"))
        full = F.col("reach") >= F.col("diag")
        done_keys = judged.where(ok | full).select(*by, "loc")
        found.append(taken.join(done_keys, [*by, "loc"], "left_semi"))
        left = judged.where(~(ok | full))
        # Double the searched distance: widen the ring, or step to a coarser level.
        nxt = F.col("_nl")
        widen = (F.col("r") * 2 <= RING_MAX) | (F.col("lvl") == nxt)
        left = left.withColumn("_nl", coarser).withColumns({
            "r": F.when(widen, F.col("r") * 2).otherwise(
                F.ceil(F.col("r") * F.lit(2.0) * F.pow(F.lit(2.0), nxt - F.col("lvl"))).cast("int")),
            "lvl": F.when(widen, F.col("lvl")).otherwise(nxt),
        })
        pending = _ckpt(left.select(*by, "loc", "x", "y", "x0", "y0", "s0", "diag", "need", "lvl", "r"))
    else:
        # The searched distance doubles every round, so this is unreachable for
        # finite coordinates; never return a partial neighbour table.
        if not pending.isEmpty():
            raise RuntimeError("kNN search did not cover every location")
    # Nothing is searched when every neighbour is a copy at the same spot.
    nbrs = locs.where(F.lit(False)).select(
        *by, "loc", F.col("loc").alias("nbr_loc"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("take"))
    for f in found:
        nbrs = nbrs.unionByName(f)
    kd = nbrs.groupBy(*by, "loc").agg(F.max("dist").alias("kdist"))
    out = locs.join(kd, [*by, "loc"], "left").withColumn("kdist", F.coalesce("kdist", F.lit(0.0)))
    return out.select(*by, "x", "y", "m", "loc", "kdist", "w0"), nbrs


def _wrapped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group columns as one-field structs: these are never null and compare
    equal when their fields do or are both missing, so a missing group is a
    group of its own in every join below."""
    return df.withColumns({c: F.struct(F.col(c).alias("v")) for c in by})


def _unwrapped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c)["v"] for c in by})


def knn_points(df: DataFrame, by: Sequence[str], id_col: str, k: int, x: str = "x", y: str = "y") -> DataFrame:
    """k nearest other points of every point: by, id, rank, nbr_id, dist.

    Copies at the same spot come first (by id), then other locations by
    (distance, location id, id). Output is k rows per point at most. Rows of a
    missing group are neighbours of each other."""
    by = list(by)
    return _unwrapped(_knn_points(_wrapped(df, by), by, id_col, k, x, y), by)


def _knn_points(df: DataFrame, by: list[str], id_col: str, k: int, x: str, y: str) -> DataFrame:
    locs, nbrs = knn_locations(df, by, id_col, k, x, y)
    pts = df.select(*by, id_col, F.col(x).alias("x"), F.col(y).alias("y")).join(locs.select(*by, "x", "y", "loc"), [*by, "x", "y"])
    # First k+1 ids of every location (top-k per key: bounded per task).
    wl = Window.partitionBy(*by, "loc").orderBy(id_col)
    heads = pts.withColumn("j", F.row_number().over(wl)).where(F.col("j") <= k + 1).select(
        *by, "loc", F.col(id_col).alias("nbr_id"), "j")
    same = pts.join(heads, [*by, "loc"]).where(F.col("nbr_id") != F.col(id_col)).select(
        *by, id_col, "nbr_id", F.lit(0.0).alias("dist"), F.lit(0).alias("o1"), F.lit(0).cast("long").alias("o2"), "j")
    other = pts.join(nbrs, [*by, "loc"]).join(
        heads.withColumnRenamed("loc", "nbr_loc"), [*by, "nbr_loc"]).where(F.col("j") <= F.col("take")).select(
        *by, id_col, "nbr_id", "dist", F.lit(1).alias("o1"), F.col("nbr_loc").alias("o2"), "j")
    allnb = same.unionByName(other)
    wr = Window.partitionBy(*by, id_col).orderBy("o1", "dist", "o2", "j")
    return allnb.withColumn("rank", F.row_number().over(wr).cast("int")).where(F.col("rank") <= k).select(
        *by, id_col, "rank", "nbr_id", "dist")


# ---------------------------------------------------------------- local outlier factor

def lof_by_group(df: DataFrame, by: Sequence[str], id_col: str, k: int = 15, top_percent: float = 5.0,
                 include_self: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """Local outlier factor per group (Breunig et al. 2000) and a top-percent flag.

    ``k`` counts the point itself when ``include_self`` (k - 1 neighbours).
    Groups with at most k rows get a missing score and FALSE. Ties are broken
    by location id so the neighbour set is exactly k - 1 (or k) points. A
    missing group is a group like any other."""
    by = list(by)
    return _unwrapped(_lof(_wrapped(df, by), by, id_col, k, top_percent, include_self, x, y), by)


def _lof(df: DataFrame, by: list[str], id_col: str, k: int, top_percent: float, include_self: bool, x: str, y: str) -> DataFrame:
    kn = k - 1 if include_self else k
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    big = df.join(sizes, by).where(F.col("_n") > k).drop("_n")
    locs, nbrs = knn_locations(big, by, id_col, kn, x, y)
    kd = locs.select(*by, "loc", "kdist", "w0")
    other = nbrs.join(kd.select(*by, F.col("loc").alias("nbr_loc"), F.col("kdist").alias("okd")), [*by, "nbr_loc"])
    reach = other.groupBy(*by, "loc").agg(F.sum(F.greatest("okd", "dist") * F.col("take")).alias("rsum"))
    lrd = kd.join(reach, [*by, "loc"], "left").withColumn(
        "rsum", F.coalesce("rsum", F.lit(0.0)) + F.col("w0") * F.col("kdist"))
    lrd = lrd.withColumn("lrd", F.try_divide(F.lit(float(kn)), F.col("rsum")))
    nl = nbrs.join(lrd.select(*by, F.col("loc").alias("nbr_loc"), F.col("lrd").alias("olrd")), [*by, "nbr_loc"])
    s = nl.groupBy(*by, "loc").agg(F.sum(F.col("olrd") * F.col("take")).alias("s_other"))
    j = lrd.join(s, [*by, "loc"], "left")
    tot = F.coalesce("s_other", F.lit(0.0)) + F.col("w0") * F.col("lrd")
    score = F.when(F.col("rsum") == 0, F.lit(1.0)).otherwise(tot / (F.lit(float(kn)) * F.col("lrd")))
    scores = j.select(*by, "loc", F.round(score, 9).alias("lof"))
    loc_of = locs.select(*by, "x", "y", "loc")
    pts = big.select(*by, id_col, F.col(x).alias("x"), F.col(y).alias("y")).join(loc_of, [*by, "x", "y"]).join(
        scores, [*by, "loc"])
    th = exact_quantiles(pts, "lof", [1 - top_percent / 100.0], ["threshold"], by)
    flagged = pts.join(th, by, "left").select(
        *by, id_col, "lof", F.coalesce(F.col("lof") > F.col("threshold"), F.lit(False)).alias("is_outlier"))
    small = df.join(sizes, by).where(F.col("_n") <= k).select(
        *by, id_col, F.lit(None).cast("double").alias("lof"), F.lit(False).alias("is_outlier"))
    return flagged.unionByName(small)


# ---------------------------------------------------------------- spread via hulls

def _hull(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Indices of convex-hull vertices (Andrew's monotone chain)."""
    n = len(xs)
    if n <= 2:
        return np.arange(n)
    order = np.lexsort((ys, xs))

    def cross(o, a, b):
        return (xs[a] - xs[o]) * (ys[b] - ys[o]) - (ys[a] - ys[o]) * (xs[b] - xs[o])

    lower: list[int] = []
    for i in order:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], i) <= 0:
            lower.pop()
        lower.append(i)
    upper: list[int] = []
    for i in order[::-1]:
        while len(upper) >= 2 and cross(upper[-2], upper[-1], i) <= 0:
            upper.pop()
        upper.append(i)
    return np.array(sorted(set(lower[:-1] + upper[:-1])))


def region_spread(df: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """Largest pairwise distance per group: partial hulls per partition
    (mapInPandas), then the pairwise maximum over hull vertices only."""
    pts = df.select(F.col(by).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
    schema = f"g {dict(pts.dtypes)['g']}, x double, y double"

    def partial(batches):
        # Running hull per group: memory is the hull size, not the partition size.
        kept: dict = {}
        for b in batches:
            for g, part in b.groupby("g", sort=False, dropna=False):
                prev = kept.get(g)
                cur = part if prev is None else pd.concat([prev, part], ignore_index=True)
                kept[g] = cur.iloc[_hull(cur["x"].to_numpy(), cur["y"].to_numpy())].reset_index(drop=True)
        for h in kept.values():
            yield h

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        idx = _hull(xs, ys)
        hx, hy = xs[idx], ys[idx]
        best = 0.0
        for i in range(len(hx)):
            d = np.sqrt((hx[i] - hx) ** 2 + (hy[i] - hy) ** 2)
            best = max(best, float(d.max()) if len(d) else 0.0)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "spread": [best], "n_hull": [len(idx)]})

    hulls = pts.mapInPandas(partial, schema)
    out = hulls.groupBy("g").applyInPandas(final, f"g {dict(pts.dtypes)['g']}, spread double, n_hull long")
    return out.withColumnRenamed("g", by)


# ---------------------------------------------------------------- polygons

def point_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat",
                      name: str = "region", ring: str = "ring") -> DataFrame:
    """Adds ``poly_region``: the (smallest) name of the polygons holding each
    point by even-odd ray casting, or null.

    Polygons are listed by the cells of a grid (cells of the mean polygon's
    size) that their boxes touch; a point meets the polygons of its own cell
    only. The cell table is attached by a checked broadcast, or a shuffle join
    when it is large. A ring may be closed or not; a missing coordinate, name
    or ring matches nothing."""
    polys = polygons.select(F.col(name).alias("name"), F.col(ring).alias("ring")).where(F.size("ring") > 0)
    xs, ys = F.transform("ring", lambda q: q["x"]), F.transform("ring", lambda q: q["y"])
    polys = polys.select("name", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
                         F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    size = polys.agg(F.struct(F.avg(F.col("x1") - F.col("x0")).alias("w"), F.avg(F.col("y1") - F.col("y0")).alias("h")).alias("s")).first()["s"]
    w, h = size["w"] or 1.0, size["h"] or 1.0

    def cell(c, step):
        return F.floor(c / F.lit(float(step))).cast("long")

    cells = polys.withColumn("_cx", F.explode(F.sequence(cell(F.col("x0"), w), cell(F.col("x1"), w))))
    cells = cells.withColumn("_cy", F.explode(F.sequence(cell(F.col("y0"), h), cell(F.col("y1"), h))))
    cells = cells.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("name", "ring")).alias("_polys"))
    px, py = F.col(x), F.col(y)

    def inside(poly):
        rg = poly["ring"]
        n = F.size(rg)
        xs = F.transform(rg, lambda q: q["x"])
        ys = F.transform(rg, lambda q: q["y"])
        in_box = (px >= F.array_min(xs)) & (px <= F.array_max(xs)) & (py >= F.array_min(ys)) & (py <= F.array_max(ys))

        def flip(acc, i):
            a = F.element_at(rg, i + 1)
            b = F.element_at(rg, F.pmod(i + 1, n) + 1)
            straddle = (a["y"] > py) != (b["y"] > py)
            xint = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
            return acc != (straddle & F.coalesce(px < xint, F.lit(False)))

        return in_box & F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), flip)

    withp = attach(points.withColumns({"_cx": cell(px, w), "_cy": cell(py, h)}), cells, ["_cx", "_cy"])
    hits = F.filter("_polys", inside)
    return withp.withColumn("poly_region", F.array_min(F.transform(hits, lambda p: p["name"]))).drop("_polys", "_cx", "_cy")


# ---------------------------------------------------------------- chart data

def extent_filter(df: DataFrame, x: str, y: str, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    return df.where(F.col(x).between(*xlim) & F.col(y).between(*ylim))


def grid_counts(df: DataFrame, x: str, y: str, sx: float, sy: float, by: Sequence[str] = ()) -> DataFrame:
    """2-D bin counts: the scalable form of a point map or scatter plot."""
    return df.groupBy(
        *by, F.floor(F.col(x) / sx).cast("long").alias("bin_x"), F.floor(F.col(y) / sy).cast("long").alias("bin_y")
    ).agg(F.count(F.lit(1)).alias("n"))
