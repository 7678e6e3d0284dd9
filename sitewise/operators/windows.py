"""Window operators (W1, W2, W6, M1): ranks, seeded samples, folds, splits.

Randomness is replaced by an md5 order of (id, seed): the same rows come
back on every rerun, whatever the partitioning, and DuckDB computes the same
order. Windows are keyed by a group (region, stratum); the exact variants
sort inside a group, the hash variants touch each row alone and never
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import checkpoint


def seeded_order(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random sort key."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_unit(id_col: str, seed: int) -> Column:
    """Pseudo-random number in [0, 1) from (id, seed), per row, no shuffle."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    return F.pmod(h, F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where a missing key matches a missing key, as the reference does."""
    keys = list(keys)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


# A per-group table of at most this many rows is sent to the tasks whole.
BROADCAST_ROWS = 10_000


def attach(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of few rows per group onto the rows of the groups, so that
    a hot group is not dealt to one task: the small table is written once and
    counted; up to BROADCAST_ROWS rows it is broadcast, beyond that the join
    shuffles and adaptive execution splits the hot keys."""
    groups = checkpoint(groups)
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    return null_safe_join(df, groups, keys, how)


def dense_rank_within(df: DataFrame, by: Sequence[str], order: str, out: str) -> DataFrame:
    """dense_rank of ``order`` inside each group; a missing value gets a missing rank.

    Ranks are computed on the distinct (group, value) pairs -- a small table
    -- and joined back, so a big group never sorts all of its rows."""
    by = list(by)
    levels = df.select(*by, order).distinct().where(F.col(order).isNotNull())
    ranked = levels.withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy(order)).cast("int"))
    return attach(df, ranked, [*by, order])


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, id_col: str, seed: int = 123) -> DataFrame:
    """n rows per group (all rows of smaller groups), seeded.

    ``row_number`` over (group, md5 key): Spark's window top-k pushdown keeps
    only n rows per group in each task before the shuffle sort."""
    w = Window.partitionBy(*by).orderBy(seeded_order(id_col, seed), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stratified_split(df: DataFrame, strata: str, id_col: str, prop: float = 0.8, seed: int = 123,
                     out: str = "split") -> DataFrame:
    """Exact stratified split: first floor(prop * n) rows of each stratum in
    md5 order go to 'train'. Rank positions come from the two-level prefix
    sum, so a big stratum is spread over many tasks."""
    from sitewise.functions.quantiles import ordered_prefix

    r = ordered_prefix(df.withColumn("_k", seeded_order(id_col, seed)), ["_k", id_col], [strata])
    return r.withColumn(out, F.when(F.col("_cum") <= F.floor(F.col("_n") * F.lit(prop)), "train").otherwise("test")).drop(
        "_k", "_cum", "_n"
    )


def vfold_assign(df: DataFrame, strata: str, id_col: str, v: int = 5, seed: int = 123, out: str = "fold") -> DataFrame:
    """Stratified folds: position within the stratum's md5 order, modulo v."""
    from sitewise.functions.quantiles import ordered_prefix

    r = ordered_prefix(df.withColumn("_k", seeded_order(id_col, seed)), ["_k", id_col], [strata])
    return r.withColumn(out, ((F.col("_cum") - 1) % v).cast("int")).drop("_k", "_cum", "_n")


def vfold_assign_hash(df: DataFrame, id_col: str, v: int = 5, seed: int = 123, out: str = "fold") -> DataFrame:
    """Scale variant: fold = hash(id, seed) mod v, no shuffle."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(v)).cast("int"))
