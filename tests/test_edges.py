"""Hand-made edge frames: nulls, NaN, ties, tiny groups, duplicates, bad text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions import columns as C
from sitewise.functions import quantiles as Q
from sitewise.operators import clean as CL
from sitewise.operators import metrics as ME
from sitewise.operators import quality as QU
from sitewise.operators import spatial as SP
from sitewise.operators import windows as WI
from sitewise.sources import io as IO


def test_null_and_nan_are_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 3.0)], "id int, x double")
    na = {r["column"]: r["na_count"] for r in QU.na_counts(df).collect()}
    assert na == {"id": 0, "x": 2}
    imp = {r["id"]: r["x"] for r in CL.median_impute(df, ["x"]).collect()}
    assert imp == {1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0}


def test_all_null_column_and_empty_frame(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert [r["x"] for r in CL.median_impute(df, ["x"]).collect()] == [None, None]
    empty = df.where("id > 10")
    assert [r["m"] for r in Q.exact_quantiles(empty, "x", [0.5], ["m"]).collect()] == [None]
    assert Q.exact_quantiles(empty, "x", [0.5], ["m"], ["id"]).count() == 0
    with pytest.raises(ValueError):
        IO.require_nonempty(empty)
    assert IO.require_columns(df, ["id", "x"]) and not IO.require_columns(df, ["nope"])


@pytest.mark.parametrize("parts", ["1", "7"])
def test_quantiles_match_builtin_and_keep_the_null_group(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(1)
        rows = [(None if g == 3 else int(g), float(v)) for g, v in zip(rng.integers(0, 4, 400), np.round(rng.normal(size=400), 2))]
        df = spark.createDataFrame(rows, "g int, v double")
        got = {r["g"]: (r["a"], r["b"], r["c"]) for r in Q.exact_quantiles(df, "v", [0.1, 0.5, 0.99], ["a", "b", "c"], ["g"]).collect()}
        ref = df.groupBy("g").agg(F.percentile("v", 0.1).alias("a"), F.percentile("v", 0.5).alias("b"),
                                  F.percentile("v", 0.99).alias("c")).collect()
        assert len(ref) == len(got) == 4
        for r in ref:
            assert got[r["g"]] == pytest.approx((r["a"], r["b"], r["c"]), abs=1e-12)
        pref = Q.ordered_prefix(df, "v", ["g"]).collect()
        assert len(pref) == 400
        for r in pref:
            assert r["_cum"] == sum(1 for g, v in rows if g == r["g"] and v <= r["v"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_group_of_one_and_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.0), ("b", 10.0, 10.0)], "g string, lat double, lon double")
    out = {r["g"]: r for r in QU.spread_check(df, ["g"], "lat", "lon", 0.0).collect()}
    assert "a" not in out and out["b"]["n"] == 2


def test_mapping_counts_missing_as_value(spark):
    df = spark.createDataFrame([("r1", 1), ("r1", 1), ("r2", 1), ("r2", 2), ("r3", 1), ("r3", None)], "region string, code int")
    got = {r["region"]: r["n_distinct"] for r in QU.mapping_violations(df, "region", "code").collect()}
    assert got == {"r2": 2, "r3": 2}


def test_null_keys_join_only_when_null_safe(spark):
    v = spark.createDataFrame([(None, "a"), (1, "b")], "k int, x string")
    lab = spark.createDataFrame([(None, "L0"), (1, "L1")], "k int, y string")
    plain = {r["x"]: r["y"] for r in CL.left_join(v, lab, ["k"]).collect()}
    safe = {r["x"]: r["y"] for r in CL.left_join(v, lab, ["k"], null_safe=True).collect()}
    assert plain == {"a": None, "b": "L1"} and safe == {"a": "L0", "b": "L1"}


def test_bad_text_becomes_missing(spark):
    df = spark.createDataFrame([("2013-02-31", "x", "TRUE"), ("", "1e3", "False"), (None, " ", "NA"), ("2013-02-28", "7", "yes")],
                               "d string, n string, b string")
    r = df.select(C.parse_date("d").alias("d"), C.safe_numeric("n").alias("n"), C.safe_boolean("b").alias("b")).collect()
    assert [x["d"] for x in r][:3] == [None, None, None] and str(r[3]["d"]) == "2013-02-28"
    assert [x["n"] for x in r] == [None, 1000.0, None, 7.0]
    assert [x["b"] for x in r] == [True, False, None, True]


def test_label_outside_levels(spark):
    df = spark.createDataFrame([("functional",), ("broken",), (None,)], "s string")
    out = IO.with_levels(df, "s", ["functional", "non functional"], "o").collect()
    assert [(r["s"], r["o"]) for r in out] == [("functional", 1), (None, None), (None, None)]


def test_box_edges_are_valid(spark):
    df = spark.createDataFrame([(29.0, -6.0), (41.0, -6.0), (35.0, 0.0), (35.0, -12.0), (28.99, -6.0), (None, -6.0),
                                (35.0, float("nan"))], "lon double, lat double")
    assert [r[0] for r in df.select(QU.invalid_coords()).collect()] == [False, False, False, False, True, True, True]


def test_utm_fixed_points(spark):
    df = spark.createDataFrame([(39.0, 0.0), (39.0, -6.0), (33.0, -6.0), (45.0, -6.0)], "lon double, lat double")
    x, y = SP.project_utm("lon", "lat")
    r = df.select(x.alias("x"), y.alias("y")).collect()
    assert r[0]["x"] == pytest.approx(500000.0, abs=1e-6) and r[0]["y"] == pytest.approx(10000000.0, abs=1e-6)
    assert r[1]["x"] == pytest.approx(500000.0, abs=1e-6) and r[1]["y"] == pytest.approx(9336795.433, abs=2e-3)
    # symmetric about the central meridian
    assert r[2]["x"] - 500000.0 == pytest.approx(500000.0 - r[3]["x"], abs=1e-6)
    assert r[2]["y"] == pytest.approx(r[3]["y"], abs=1e-6)


def _brute_knn(pts, k):
    out = {}
    for gid, i, x, y in pts:
        c = sorted((math.hypot(x - x2, y - y2), j) for g2, j, x2, y2 in pts if g2 == gid and j != i)
        out[i] = [j for _, j in c[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "duplicates", "collinear", "dense_cluster"])
def test_knn_exact_against_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    pts = []
    for i in range(120):
        g = i % 2
        if kind == "random":
            x, y = rng.normal(size=2) * [1000, 300]
        elif kind == "duplicates":
            x, y = (0.0, 0.0) if i < 40 else tuple(np.round(rng.normal(size=2) * 50, 0))
        elif kind == "dense_cluster":
            # a third of the points packed in a tiny square inside a wide area
            x, y = (rng.random(2) * 0.01) if i % 3 == 0 else (rng.random(2) * 1000.0)
        else:
            x, y = float(i * 3 % 97), 0.0
        pts.append((g, i, float(x), float(y)))
    df = spark.createDataFrame(pts, "g int, id long, x double, y double")
    got = SP.knn_points(df, ["g"], "id", 5).collect()
    mine = {}
    for r in got:
        mine.setdefault(r["id"], []).append((r["rank"], r["nbr_id"], r["dist"]))
    want = _brute_knn(pts, 5)
    for i, lst in mine.items():
        lst.sort()
        dists = [d for _, _, d in lst]
        ref = sorted(math.hypot(pts[i][2] - pts[j][2], pts[i][3] - pts[j][3]) for j in want[i])
        assert dists == pytest.approx(ref, abs=1e-9)
        if kind in ("random", "dense_cluster"):
            assert [n for _, n, _ in lst] == want[i]
    assert len(mine) == 120


def test_lof_small_group_and_duplicates(spark):
    rows = [("a", i, float(i % 7), float(i // 7)) for i in range(40)] + [("b", 100 + i, 0.0, float(i)) for i in range(5)]
    rows += [("a", 200, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    out = {r["id"]: r for r in SP.lof_by_group(df, ["g"], "id", k=15, top_percent=5).collect()}
    assert all(out[100 + i]["lof"] is None and not out[100 + i]["is_outlier"] for i in range(5))
    assert out[200]["is_outlier"] and out[200]["lof"] > 2
    dup = spark.createDataFrame([("a", i, 0.0, 0.0) for i in range(30)] + [("a", 99, 5.0, 5.0)], "g string, id long, x double, y double")
    d = {r["id"]: r["lof"] for r in SP.lof_by_group(dup, ["g"], "id", k=5).collect()}
    assert d[0] == 1.0


def test_spread_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(int(i % 3), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)) * 100)]
    df = spark.createDataFrame(pts, "g int, x double, y double").repartition(5)
    got = {r["g"]: r["spread"] for r in SP.region_spread(df, "g").collect()}
    for g in range(3):
        p = np.array([(x, y) for gg, x, y in pts if gg == g])
        d = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(-1)).max()
        assert got[g] == pytest.approx(d, abs=1e-9)


def test_point_in_polygon_nonconvex(spark):
    poly = spark.createDataFrame([("U", [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 3.0, "y": 3.0},
                                         {"x": 2.0, "y": 3.0}, {"x": 2.0, "y": 1.0}, {"x": 1.0, "y": 1.0},
                                         {"x": 1.0, "y": 3.0}, {"x": 0.0, "y": 3.0}])],
                                 "region string, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1, 0.5, 2.0), (2, 1.5, 2.0), (3, 1.5, 0.5), (4, 5.0, 5.0)], "id int, lon double, lat double")
    got = {r["id"]: r["poly_region"] for r in SP.point_in_polygons(pts, poly).collect()}
    assert got == {1: "U", 2: None, 3: "U", 4: None}


def test_auc_ties_and_missing_predictions(spark):
    df = spark.createDataFrame([("a", "a", 0.5, 0.5), ("b", "a", 0.5, 0.5), ("a", "a", 0.5, 0.5), ("b", "a", 0.5, 0.5)],
                               "truth string, pred string, pa double, pb double")
    assert ME.hand_till_auc(df, "truth", {"a": "pa", "b": "pb"}).first()["roc_auc"] == 0.5
    m = ME.macro_prf(df, "truth", "pred", ["a", "b"]).first()
    assert m["precision"] is None  # level b is never predicted: precision undefined
    df2 = spark.createDataFrame([("a", 0.9), ("a", 0.4), ("b", 0.4), ("b", 0.1)], "truth string, s double")
    assert ME.binary_auc(df2, "truth", "s", "a").first()["auc"] == pytest.approx((1 + 0.5 + 1 + 1) / 4)


def test_sliced_prefix_matches_single_task(spark):

    rng = np.random.default_rng(11)
    rows = [(i, ["a", "b", "c"][int(rng.integers(0, 3))], float(np.round(rng.random(), 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, truth string, s double")

    def run():
        split = sorted(WI.stratified_split(df, "truth", "id").select("id", "split").collect())
        folds = sorted(WI.vfold_assign(df, "truth", "id", 5).select("id", "fold").collect())
        auc = ME.binary_auc(df, "truth", "s", "a").first()["auc"]
        roc = sorted((r["threshold"], r["sensitivity"], r["specificity"]) for r in ME.roc_points(df, "truth", "s", "a").collect())
        idx = sorted(Q.row_index(df.withColumn("k", F.col("id").cast("double")), "k").select("id", "_pos").collect())
        return split, folds, auc, roc, idx

    single = run()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sliced = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert single[0] == sliced[0] and single[1] == sliced[1] and single[4] == sliced[4]
    assert single[2] == pytest.approx(sliced[2], abs=1e-12)
    flat = lambda rows: [v for r in rows for v in r]
    assert flat(single[3]) == pytest.approx(flat(sliced[3]), abs=1e-12)
    assert [p for _, p in single[4]] == list(range(600))


def test_null_groups_and_tied_hashes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 2 else "a", float(np.round(rng.random(), 3)), float(np.round(rng.random(), 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    named = df.withColumn("g", F.coalesce("g", F.lit("b")))
    split, want = (WI.stratified_split(d, "g", "id").select("id", "split").collect() for d in (df, named))
    assert sorted(split) == sorted(want) and len(split) == 60
    folds, want = (WI.vfold_assign(d, "g", "id", 5).select("id", "fold").collect() for d in (df, named))
    assert sorted(folds) == sorted(want) and len(folds) == 60
    for fn in (lambda d: SP.lof_by_group(d, ["g"], "id", 5), lambda d: SP.centroid_outliers(d, ["g"], "id"),
               lambda d: SP.knn_points(d, ["g"], "id", 3)):
        got, want = (sorted(tuple(r)[1:] for r in fn(d).collect()) for d in (df, named))
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    ranks = WI.dense_rank_within(df, ["g"], "x", "r").where("g is null and r is null").count()
    assert ranks == 0
    ties = spark.createDataFrame([(i,) for i in range(4)], "id long").withColumn("h", F.lit(0))
    assert sorted(r["_pos"] for r in Q.row_index(ties, ["h", "id"]).collect()) == [0, 1, 2, 3]


def test_spatial_without_any_search(spark):
    small = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 1.0, 0.0), (3, "b", 0.0, 1.0)], "id long, g string, x double, y double")
    out = SP.lof_by_group(small, ["g"], "id", 5).collect()
    assert len(out) == 3 and all(r["lof"] is None and not r["is_outlier"] for r in out)
    spot = spark.createDataFrame([(i, "a", 2.0, 2.0) for i in range(6)], "id long, g string, x double, y double")
    assert SP.knn_points(spot, ["g"], "id", 2).count() == 12


def test_metrics_with_absent_levels(spark):
    rows = [("a", "a", 0.8, 0.1, 0.1), ("b", "a", 0.6, 0.3, 0.1), ("b", "b", 0.2, 0.7, 0.1), (None, "b", 0.3, 0.6, 0.1), ("a", None, 0.4, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "truth string, pred string, pa double, pb double, pc double")
    prob = {"a": "pa", "b": "pb", "c": "pc"}
    assert ME.hand_till_auc(df, "truth", prob).first()["roc_auc"] == pytest.approx(0.75)
    cells = {(r["truth"], r["pred"]): r["n"] for r in ME.confusion_matrix(df, "truth", "pred", ["a", "b", "c"]).collect()}
    assert sum(cells.values()) == 5 and cells[(None, "b")] == 1 and cells[("a", None)] == 1 and cells[("c", "c")] == 0
    roc = ME.roc_points_all(df, "truth", prob).collect()
    assert {r["level"] for r in roc} == {"a", "b", "c"}
    assert all(r["sensitivity"] is None for r in roc if r["level"] == "c" and r["threshold"] is not None)
    assert sum(r["threshold"] is None for r in roc) == 3
    assert ME.roc_points(df, "truth", "pc", "c").where("sensitivity is not null").count() == 0


def test_inferred_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,when,flag\n1,2.5,2013-02-01,true\n2,,2013-02-03,false\n")
    out = IO.read_csv_inferred(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in out.dtypes] == ["int", "double", "date", "boolean"] and out.count() == 2
