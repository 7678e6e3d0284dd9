"""Modelling with Spark ML.

The recipe is a ``Pipeline``; estimators are Spark ML's distributed ones.
Driver-side loops run over *parameters* (grid points, folds, boosting
rounds), never over data. Interpretation methods build their perturbed rows
with DataFrame operations and score them with one ``transform`` each.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import checkpoint as _ckpt

from sitewise.operators import metrics as ME
from sitewise.operators.boosting import BoostedTrees
from sitewise.operators.forest import DeepForest, DeepForestModel
from sitewise.operators.mixtures import Forest, slot_sources, walk_parts, with_codes


# ---------------------------------------------------------------- recipe (M3-M8)

def feature_recipe(
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    levels: Sequence[str],
    date_col: str | None = None,
    impute: bool = True,
) -> Pipeline:
    """label ~ features: date -> year, quarter; median imputation (learnt on
    the rows the pipeline is fitted on); missing category -> its own level;
    one-hot with all levels kept; assemble. The date column and the key are
    never features."""
    stages = []
    num = list(numeric)
    if date_col:
        stages.append(SQLTransformer(statement=(
            f"SELECT *, CAST(year({date_col}) AS DOUBLE) AS {date_col}_year, "
            f"CAST(quarter({date_col}) AS DOUBLE) AS {date_col}_quarter FROM __THIS__")))
        num += [f"{date_col}_year", f"{date_col}_quarter"]
    cast = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}__d" for c in num) + " FROM __THIS__")
    stages.append(cast)
    num_d = [f"{c}__d" for c in num]
    if impute:
        imp_out = [f"{c}__i" for c in num]
        stages.append(Imputer(strategy="median", inputCols=num_d, outputCols=imp_out))
        num_d = imp_out
    idx_out = [f"{c}__idx" for c in categorical]
    stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx_out, handleInvalid="keep",
                                stringOrderType="alphabetAsc"))
    oh_out = [f"{c}__oh" for c in categorical]
    # The indexer already gives unseen levels their own index (step_unknown),
    # so the encoder needs no extra slot of its own.
    stages.append(OneHotEncoder(inputCols=idx_out, outputCols=oh_out, dropLast=False, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=num_d + oh_out, outputCol="features", handleInvalid="keep"))
    stages.append(StringIndexerModel.from_labels(list(levels), inputCol=label, outputCol="label", handleInvalid="keep"))
    return Pipeline(stages=stages)


def one_hot_columns(df: DataFrame, col: str, levels: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Relational one-hot: one 0/1 column per level (all levels kept). The
    level list is read from the data when not given (bounded by the column's
    cardinality; pass ``levels`` for high-cardinality columns)."""
    import re

    if levels is None:
        levels = sorted(r[0] for r in df.select(col).distinct().where(F.col(col).isNotNull()).collect())
    pre = prefix or col
    cols = {}
    for lv in levels:
        name = re.sub(r"[^0-9a-zA-Z]+", "_", f"{pre}_{lv}").strip("_").lower()
        cols[name] = (F.col(col) == F.lit(lv)).cast("int")
    return df.withColumns(cols)


# ---------------------------------------------------------------- estimators

def random_forest(num_trees: int = 50, mtry: int | None = None, min_n: int = 1, seed: int = 123, max_bins: int = 64,
                  max_depth: int = 30):
    """30 is the deepest tree Spark grows; ``min_n`` ends the branches. Each row's
    nodes are kept between levels: walking every row down every tree anew makes
    a pass dearer with each level. The trees are the same either way."""
    return RandomForestClassifier(
        numTrees=num_trees, featureSubsetStrategy=str(mtry) if mtry else "sqrt", minInstancesPerNode=min_n,
        maxDepth=max_depth, seed=seed, maxBins=max_bins, cacheNodeIds=True, labelCol="label", featuresCol="features",
    )


def deep_forest(num_trees: int = 500, mtry: int | None = None, min_n: int = 1, seed: int = 123, max_bins: int = 64,
                max_depth: int = 30):
    """The forest of ``random_forest`` for hundreds of deep trees: the same rules, other
    random draws. Nodes that fit one task are grown there, and stay on the executors."""
    return DeepForest(num_trees, mtry, min_n, max_depth, max_bins, seed)


def boosted_trees(trees: int = 20, depth: int = 3, learn_rate: float = 0.1):
    """Multinomial boosting, all classes in one pass (Spark's GBT is binary)."""
    return BoostedTrees(trees, depth, learn_rate)


def logistic(reg: float = 0.0):
    return LogisticRegression(family="multinomial", regParam=reg, maxIter=100, labelCol="label", featuresCol="features")


def linear_svm(reg: float = 0.01):
    return OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=50), labelCol="label", featuresCol="features")


def decision_tree(depth: int = 5, seed: int = 123):
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, labelCol="label", featuresCol="features")


def fit(recipe: Pipeline, estimator, train: DataFrame) -> PipelineModel:
    return Pipeline(stages=[*recipe.getStages(), estimator]).fit(train)


def predict(model: PipelineModel, df: DataFrame, key: str, truth: str, levels: Sequence[str]) -> DataFrame:
    """(key, truth, pred, p_<level>...) -- class and class probabilities.

    Models without a probability column (one-vs-rest) get a softmax of their
    raw scores."""
    out = model.transform(df)
    prob_col = "probability" if "probability" in out.columns else None
    if prob_col:
        arr = vector_to_array(F.col(prob_col))
    else:
        raw = vector_to_array(F.col("rawPrediction"))
        mx = F.array_max(raw)
        ex = F.transform(raw, lambda v: F.exp(v - mx))
        tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
        arr = F.transform(ex, lambda v: v / tot)
    names = prob_names(levels)
    sel = [F.col(key), F.col(truth).alias("truth")] + [arr[i].alias(names[lv]) for i, lv in enumerate(levels)]
    res = out.select(*sel)
    return res.withColumn("pred", ME.argmax_level(names))


def prob_names(levels: Sequence[str]) -> dict[str, str]:
    import re

    return {lv: "p_" + re.sub(r"[^0-9a-zA-Z]+", "_", lv).strip("_").lower() for lv in levels}


# ---------------------------------------------------------------- tuning

def latin_hypercube(ranges: Mapping[str, tuple[float, float]], size: int, seed: int = 123,
                    integer: Sequence[str] = (), log10: Sequence[str] = ()) -> list[dict]:
    """Latin hypercube design: each parameter's range cut into ``size`` strata,
    one point per stratum, strata shuffled independently per parameter.
    Parameters in ``log10`` are sampled on the log scale (range in log10)."""
    rng = random.Random(seed)
    cols = {}
    for name, (lo, hi) in ranges.items():
        perm = list(range(size))
        rng.shuffle(perm)
        vals = []
        for s in perm:
            u = (s + rng.random()) / size
            v = lo + u * (hi - lo)
            if name in log10:
                v = 10 ** v
            if name in integer:
                v = int(round(v))
            vals.append(v)
        cols[name] = vals
    return [{k: cols[k][i] for k in ranges} for i in range(size)]


def tune_grid(recipe: Pipeline, make_estimator, grid: Sequence[Mapping], data: DataFrame, fold_col: str,
              key: str, truth: str, levels: Sequence[str], model_name: str, parallelism: int = 4) -> DataFrame:
    """Fit every grid point on every fold's complement, score the held-out
    fold: long table (model, param_id, fold, metric, estimate). The fits of a
    fold are submitted ``parallelism`` at a time, so one fit's narrow stages
    leave no executors idle; each is scored at once, so the driver holds
    ``parallelism`` models and not the whole grid's."""
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())
    names = prob_names(levels)
    data = _ckpt(data)  # read once per fit: cut the lineage
    preds = None
    for k in folds:
        # the recipe learns from the fold's training rows once, not per grid point
        prep = recipe.fit(data.where(F.col(fold_col) != k))
        train = _ckpt(prep.transform(data.where(F.col(fold_col) != k)))
        held = prep.transform(data.where(F.col(fold_col) == k))

        def scored(point, rows=train, out=held, fold=int(k)):
            m = make_estimator(**point[1]).fit(rows)
            pr = predict(m, out, key, truth, levels)
            pr = _ckpt(pr.withColumns({"param_id": F.lit(point[0]), "fold": F.lit(fold).cast("int")}))
            if isinstance(m, DeepForestModel):
                m.release()
            return pr

        with ThreadPoolExecutor(parallelism) as pool:
            fold_preds = list(pool.map(scored, enumerate(grid)))
        for pr in fold_preds:
            preds = pr if preds is None else preds.unionByName(pr)
    # Every (grid point, fold) is scored in one grouped metric job.
    return ME.metric_table(preds, "truth", "pred", names, model_name, ["param_id", "fold"])


def select_best(metrics: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Grid point with the best mean metric over folds (ties: lower param_id)."""
    m = metrics.where(F.col("metric") == metric).groupBy("model", "param_id").agg(F.avg("estimate").alias("mean"))
    return m.orderBy(F.desc("mean"), "param_id").limit(1)


# ---------------------------------------------------------------- AdaBoost

RENEW = 10  # rounds between two writings of the weighted rows


def adaboost_samme(recipe: Pipeline, train: DataFrame, test: DataFrame, key: str, truth: str,
                   levels: Sequence[str], rounds: int = 5, depth: int = 2) -> DataFrame:
    """SAMME boosting of shallow trees with row weights (Zhu et al. 2009).

    A round's rows are persisted with their weight and whether the tree missed
    them, by the pass that sums the error; the passes of the next tree read them
    from there. They lie on disk: two rounds' rows are held at once, and the tree keeps
    its own binned copy in memory. Every ``RENEW`` rounds they are written, which cuts the lineage.
    The test rows are read once, at the end, by all trees together."""
    prep = recipe.fit(train)
    tr = _ckpt(prep.transform(train).select("features", "label", F.lit(1.0).alias("w")))
    te = prep.transform(test).select(key, F.col(truth).alias("truth"), "features")
    K = len(levels)
    trees, held = [], None
    for r in range(rounds):
        # no raw prediction, no probability: a weight needs the class alone
        tree = DecisionTreeClassifier(maxDepth=depth, weightCol="w", labelCol="label", featuresCol="features", predictionCol="_p",
                                      rawPredictionCol="", probabilityCol="").fit(tr)
        miss = (F.col("_p") != F.col("label")).cast("double")
        scored = tree.transform(tr).select("features", "label", "w", miss.alias("_miss"))
        scored = _ckpt(scored) if (r + 1) % RENEW == 0 else scored.persist(StorageLevel.DISK_ONLY)
        err = scored.agg((F.sum(F.col("w") * F.col("_miss")) / F.sum("w")).alias("e")).first()["e"]
        if held is not None:
            held.unpersist()
        held = scored
        err = min(max(err, 1e-10), 1 - 1e-10)
        alpha = math.log((1 - err) / err) + math.log(K - 1)
        trees.append((alpha, tree))
        tr = scored.select("features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("_miss"))).alias("w"))
    if held is not None:
        held.unpersist()
    for i, (_, tree) in enumerate(trees):
        te = tree.setPredictionCol(f"_p{i}").transform(te)
    vnames = {lv: f"v{i}" for i, lv in enumerate(levels)}
    votes = []
    for c, name in enumerate(vnames.values()):
        total = F.lit(0.0)
        for i, (alpha, _) in enumerate(trees):
            total = total + F.when(F.col(f"_p{i}") == c, F.lit(alpha)).otherwise(0.0)
        votes.append(total.alias(name))
    return te.select(key, "truth", *votes).withColumn("pred", ME.argmax_level(vnames)).select(key, "truth", "pred")


def finalize_and_fit(recipe: Pipeline, make_estimator, grid: Sequence[Mapping], metrics: DataFrame, train: DataFrame,
                     metric: str = "accuracy") -> PipelineModel:
    """Refit on all training rows with the grid point that tuning chose."""
    best = select_best(metrics, metric).first()
    return fit(recipe, make_estimator(**grid[best["param_id"]]), train)


def mean_abs_shapley(phi: DataFrame) -> DataFrame:
    """Mean absolute Shapley value per feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


# ---------------------------------------------------------------- SMOTE (M9)

def smote_2d(df: DataFrame, label: str, x: str, y: str, key: str, k: int = 5, seed: int = 123) -> DataFrame:
    """Oversample every class up to the largest class (Chawla et al. 2002).

    New row = base + u * (neighbour - base), the neighbour one of the base's
    k nearest points of the same class (exact grid kNN), u and the neighbour
    choice from hashes of (id, copy, seed): reruns give the same rows. Output
    keeps the originals (synthetic = false, no copy number) and adds the new
    rows, known by the base row's id and a copy number. A missing label is no
    class and is refused."""
    from sitewise.functions.quantiles import ordered_prefix
    from sitewise.operators.spatial import knn_points

    out_label, out_x, out_y = label, x, y
    df = df.select(F.col(key), F.col(label).alias("_lbl"), F.col(x).alias("_px"), F.col(y).alias("_py"))
    label, x, y = "_lbl", "_px", "_py"
    if not df.where(F.col(label).isNull()).isEmpty():
        raise ValueError("SMOTE needs a label on every row")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    target = sizes.agg(F.max("n_c")).scalar()
    base = df.select(key, label, x, y).join(sizes, label)
    idx = ordered_prefix(base, key, [label]).withColumn("i", F.col("_cum") - 1).drop("_cum", "_n")
    need = target - F.col("n_c")
    n_copies = F.when(F.col("i") < need, F.floor((need - 1 - F.col("i")) / F.col("n_c")) + 1).otherwise(F.lit(0))
    copies = idx.withColumn("nc", n_copies.cast("int")).where(F.col("nc") > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).drop("nc")
    pts = df.select(key, label, F.col(x).alias("x"), F.col(y).alias("y"))
    nn = knn_points(pts, [label], key, k)
    nn_xy = nn.join(pts.select(F.col(key).alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny")), "nbr_id")
    # A class of fewer than k + 1 points picks among the neighbours it has.
    nmax = nn.groupBy(label, key).agg(F.max("rank").alias("rmax"))
    pick = (F.pmod(F.xxhash64(key, "copy", F.lit(seed)), F.col("rmax")) + 1).cast("int")
    c = copies.join(nmax, [label, key], "left").withColumn("rank", pick)
    c = c.join(nn_xy.select(label, key, "rank", "nx", "ny"), [label, key, "rank"], "left")
    # A class of one row has no neighbour: its copies repeat it.
    c = c.withColumns({"nx": F.coalesce("nx", F.col(x)), "ny": F.coalesce("ny", F.col(y))})
    u = F.pmod(F.xxhash64(key, "copy", F.lit(seed + 1)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    synth = c.select(
        F.col(key), F.col("copy").cast("long").alias("copy"), label, (F.col(x) + u * (F.col("nx") - F.col(x))).alias(x),
        (F.col(y) + u * (F.col("ny") - F.col(y))).alias(y), F.lit(True).alias("synthetic"),
        F.col(key).alias("base_id"), F.col("nx"), F.col("ny"))
    orig = df.select(key, F.lit(None).cast("long").alias("copy"), label, x, y, F.lit(False).alias("synthetic"), F.col(key).alias("base_id"),
                     F.lit(None).cast("double").alias("nx"), F.lit(None).cast("double").alias("ny"))
    return orig.unionByName(synth).withColumnsRenamed({label: out_label, x: out_x, y: out_y})


# ---------------------------------------------------------------- interpretation

def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, truth: str,
                           levels: Sequence[str], seed: int = 123) -> DataFrame:
    """Accuracy drop when one feature's column is permuted (all features in one
    job). The permutation is a cyclic shift of a hash order computed with the
    two-level prefix sum, so no task holds the whole table."""
    from sitewise.functions.quantiles import row_index

    ix = row_index(df.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key]).drop("_h")
    n = F.lit(ix.count())
    # one join brings each row its donor; every feature then takes its turn
    donor = ix.select(((F.col("_pos") + 1) % n).alias("_pos"), F.struct(*[F.col(f) for f in features]).alias("_donor"))
    allv = ix.join(donor, "_pos").withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features])))
    allv = allv.withColumns({f: F.when(F.col("_feature") == f, F.col("_donor")[f]).otherwise(F.col(f)) for f in features}).drop("_donor")
    scored = model.transform(allv.drop("_pos"))
    pred = scored.withColumn("_pred_idx", F.col("prediction"))
    acc = pred.groupBy("_feature").agg(F.avg((F.col("_pred_idx") == F.col("label")).cast("double")).alias("acc"))
    base_acc = model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).scalar()
    return acc.select(F.col("_feature").alias("feature"), (base_acc - F.col("acc")).alias("importance"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def shapley_sampled(model: PipelineModel, explain: DataFrame, background: DataFrame, features: Sequence[str],
                    key: str, levels: Sequence[str], samples: int = 8, seed: int = 123) -> DataFrame:
    """Sampled Shapley values (Štrumbelj & Kononenko 2014) of the probability
    of each row's predicted class. Per (row, sample) a random feature order
    and a random background row; walking the order adds one feature of the
    row at a time, so the contributions of one sample add up exactly to
    f(row) - f(background). Output: key, feature, phi, plus f(x) and the
    mean f(background) of the sampled rows (``fx``, ``base``).

    Both ends of a walk are scored once per row, only the mixtures between them
    per sample. Each mixture's value counts for the feature added by it and
    against the one added next, so the sums need no ordered walk."""
    from sitewise.functions.quantiles import row_index

    def value(df: DataFrame) -> Column:
        """What the class is read from: probabilities, or the predicted class."""
        return vector_to_array(F.col("probability")) if "probability" in df.columns else F.array(F.col("prediction"))

    def of_class(v: Column, probabilities: bool) -> Column:
        return F.element_at(v, F.col("_cls") + 1) if probabilities else (v[0] == F.col("_cls")).cast("double")

    d = len(features)
    bg = row_index(background.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key])
    nb = bg.count()
    ends = model.transform(bg)
    probs = "probability" in ends.columns
    sources = slot_sources(model.stages[:-1], features)
    forest = None if sources is None or (sources < 0).any() else Forest.of(explain.sparkSession, model.stages[-1], len(sources))
    # a row is known by its codes where the model is a forest over slots of one feature each, else by its features
    known_z, known_x = [f"_z_{f}" for f in features], list(features)
    if forest is not None:
        known_z, known_x, vector = ["_z"], ["_x"], model.stages[-1].getFeaturesCol()
        shared = explain.sparkSession.sparkContext.broadcast(forest)
    # a repeated background row has one place; it counts as often as it is there
    if forest is None:
        ends = ends.select("_pos", *[F.col(f).alias(z) for f, z in zip(features, known_z)], value(ends).alias("_vz"))
    else:
        ends = with_codes(ends.select("_pos", vector, value(ends).alias("_vz")), vector, shared, len(sources), "_z")
    z = F.struct(*known_z, "_vz")
    zcols = ends.groupBy(F.col("_pos").alias("_bpos")).agg(F.count(F.lit(1)).alias("_nz"), F.first(z).alias("_first"))
    zcols = zcols.select("_bpos", "_nz", "_first.*")
    ends = model.transform(explain.where(F.col(key).isNotNull()))
    ends = ends.select(key, *(features if forest is None else [vector]), F.col("prediction").cast("int").alias("_cls"), value(ends).alias("_vx"))
    if forest is not None:
        ends = with_codes(ends, vector, shared, len(sources), "_x")
    ex = ends.select(key, *known_x, "_cls", of_class(F.col("_vx"), probs).alias("_fx")).dropDuplicates([key])
    s = ex.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    s = s.withColumn("_sid", F.col(key) * F.lit(1009) + F.col("_s")).drop("_s")
    s = s.withColumn("_bpos", F.pmod(F.xxhash64("_sid", F.lit(seed + 1)), F.lit(nb)))
    s = s.join(zcols, "_bpos").withColumn("_fz", of_class(F.col("_vz"), probs)).drop("_bpos", "_vz")
    # position of each feature in this sample's order
    h = {f: F.xxhash64("_sid", F.lit(j), F.lit(seed)) for j, f in enumerate(features)}
    place = {}
    for f in features:
        pos = sum(((h[g] < h[f]) | ((h[g] == h[f]) & F.lit(features.index(g) < features.index(f)))).cast("int")
                  for g in features if g != f)
        place[f"_p_{f}"] = pos if not isinstance(pos, int) else F.lit(pos)
    s = s.withColumns(place)
    if forest is not None:
        parts = [f"_phi_{f}" for f in features]
        sc = walk_parts(s.withColumns({p: F.col(p).cast("int") for p in place}), shared, sources, list(place), [key, "_fx", "_fz", "_nz"], parts)
        sums = sc.groupBy(key).agg(
            *[(F.sum(p) / F.lit(float(samples))).alias(p) for p in parts], F.avg("_fx").alias("fx"),
            (F.sum(F.col("_fz") * F.col("_nz")) / F.sum("_nz")).alias("base"))
    else:
        sums = _walked_rows(model, s, features, key, samples, list(place), lambda df: of_class(value(df), probs))
    phi = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_phi_{f}").alias("phi")) for f in features]))
    return sums.select(key, phi.alias("_phi"), "fx", "base").select(key, "_phi.feature", "_phi.phi", "fx", "base")


def _walked_rows(model: PipelineModel, s: DataFrame, features: Sequence[str], key: str, samples: int, place: Sequence[str],
                 of_row) -> DataFrame:
    """Sums of ``shapley_sampled`` for any model: every mixture is a row that it scores."""
    d = len(features)
    s = s.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(max(1, d - 1)))))
    mixed = s.select(key, "_cls", "_fx", "_fz", "_nz", "_t", *place,
                     *[F.when(F.col(f"_p_{f}") < F.col("_t"), F.col(f)).otherwise(F.col(f"_z_{f}")).alias(f) for f in features])
    scored = model.transform(mixed)
    sc = scored.select(key, "_fx", "_fz", "_nz", "_t", *place, of_row(scored).alias("_f"))
    first = F.col("_t") == 1  # the ends of a walk count once

    def share(f: str) -> Column:
        p = F.col(f"_p_{f}")
        part = F.when(p == F.col("_t") - 1, F.col("_f")).when(p == F.col("_t"), -F.col("_f")).otherwise(0.0)
        part = part - F.when(first & (p == 0), F.col("_fz")).otherwise(0.0)
        return part + F.when(first & (p == d - 1), F.col("_fx")).otherwise(0.0) if d > 1 else part

    return sc.groupBy(key).agg(
        *[(F.sum(share(f)) / F.lit(float(samples))).alias(f"_phi_{f}") for f in features],
        F.avg(F.when(first, F.col("_fx"))).alias("fx"),
        (F.sum(F.when(first, F.col("_fz") * F.col("_nz"))) / F.sum(F.when(first, F.col("_nz")))).alias("base"))
