"""Sharding by a hierarchical weighted hash tree.

A row's key descends region, rack and shard. At each level every child makes
a weighted draw ``-ln(u(key, child)) / weight`` from a hash of the key and the
child's path, and the smallest draw wins, so a child receives keys in
proportion to its weight and a change of one weight moves keys only into or
out of that child: movement stays inside the subtrees whose weights change.

Growth is strict. A leaf carries a generation; at every level a child takes
part once per generation with the weight its leaves of that generation add.
A new shard is a new generation on an existing path, so its region, rack and
leaf gain one more draw and all others keep theirs: a key either stays where
it was or follows the new draw down to the new shard, never to an old one.

Defined cases: a null key is one key like any other; repeated rows share a
shard and get distinct slots; an empty table gives an empty table. Input
columns that clash with the output names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a shard are numbered inside sub-buckets of the shard, so no task
# numbers a whole shard: this many hex digits of a hash, 4,096 sub-buckets.
SUB_DIGITS = 3


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    generation: int = 0


def uniform_tree(regions: int, racks: int, shards: int, weight: float = 1.0) -> list[Leaf]:
    """Equal racks in equal regions; shards are numbered in path order."""
    return [
        Leaf(r, k, (r * racks + k) * shards + s, weight)
        for r in range(regions) for k in range(racks) for s in range(shards)
    ]


def grow(tree: list[Leaf], region: int, rack: int, shard: int, weight: float = 1.0) -> list[Leaf]:
    """One more shard below a region and rack, as a new generation."""
    if any(x.shard == shard for x in tree):
        raise ValueError(f"shard {shard} exists")
    return [*tree, Leaf(region, rack, shard, weight, 1 + max((x.generation for x in tree), default=-1))]


def _draw(key: Column, path: str, weight: float) -> Column:
    """Exponential draw of one child for a key: 52 hash bits as a uniform in (0, 1)."""
    digest = F.md5(F.concat(key, F.lit("|" + path)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, level: str, weights: dict[str, float]) -> Column:
    """The child with the smallest draw; ties go to the smaller name."""
    names = sorted(weights)
    if len(names) == 1:
        return F.lit(names[0])
    draws = [F.struct(_draw(key, f"{level}/{c}", weights[c]).alias("e"), F.lit(c).alias("c")) for c in names]
    return F.array_min(F.array(*draws))["c"]


def _sum(leaves, name) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in leaves:
        if x.weight <= 0:
            raise ValueError("weights must be positive")
        out[name(x)] = out.get(name(x), 0.0) + x.weight
    return out


def _region(x: Leaf) -> str:
    return f"{x.region}.{x.generation}"


def _rack(x: Leaf) -> str:
    return f"{_region(x)}/{x.rack}"


def assign(df: DataFrame, key: str, tree: list[Leaf], out: str = "shard") -> DataFrame:
    """Adds ``out``: the shard that the tree gives to each row's key."""
    if not tree:
        raise ValueError("the tree has no shard")
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    regions = _sum(tree, _region)
    r, c = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(r, _winner(k, "region", regions))

    def case(of, names, expr):
        e = None
        for n in names:
            e = (F.when if e is None else e.when)(of == F.lit(n), expr(n))
        return e

    df = df.withColumn(c, case(F.col(r), regions, lambda g: _winner(
        k, "rack", _sum([x for x in tree if _region(x) == g], _rack))))
    racks = _sum(tree, _rack)
    df = df.withColumn(out, case(F.col(c), racks, lambda g: _winner(
        k, "shard", _sum([x for x in tree if _rack(x) == g], lambda x: f"{_rack(x)}/{x.shard}"))))
    return df.withColumn(out, F.element_at(F.split(F.col(out), "/"), -1).cast("int")).drop(r, c)


def number_rows(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... without gaps inside each shard.

    Equal rows are counted first, ranked inside hashed sub-buckets of their
    shard, and written out again, so neither a hot shard nor a hot row needs a
    task of its own. Only the columns of ``df`` are moved; keep it narrow.
    """
    cols = df.columns
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    sub = F.substring(F.md5(row.cast("binary")), 1, SUB_DIGITS)
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_sub", sub)
    before = Window.partitionBy(shard, "_sub").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = df.groupBy(F.col(shard).alias("_s"), sub.alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    up = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(up), F.lit(0))).drop("_size")
    out = rows.join(sizes, rows[shard].eqNullSafe(sizes["_s"]) & (rows["_sub"] == sizes["_b"]), "left")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return out.select(*cols, "_before", "_offset", copy.alias("_copy")).select(
        *cols, (F.col("_offset") + F.col("_before") + F.col("_copy")).cast("long").alias(slot))


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """One row per document: its size (UTF-8 bytes plus 1; a null text has
    none), the CRC-32 of its text, shard, slot, and the shard after growth."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = assign(rows, "doc_id", tree, "shard")
    rows = assign(rows, "doc_id", grown, "grown_shard") if grown else rows.withColumn(
        "grown_shard", F.lit(None).cast("int"))
    rows = number_rows(rows.withColumn("law", F.lit("key")))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw_sql(path: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5(k || '|{path}'), 1, 13))::BIGINT + 0.5) / {1 << 52}.0) / {weight}"


def _shard_sql(region: int, rack: int) -> str:
    draws = ", ".join(_draw_sql(f"shard/{region}.0/{rack}/{(region * 2 + rack) * 4 + i}", 1.0) for i in range(4))
    return f"{(region * 2 + rack) * 4 - 1} + list_position([{draws}], list_min([{draws}]))"


def _rack_sql(region: int) -> str:
    return f"CASE WHEN {_draw_sql(f'rack/{region}.0/0', 4.0)} <= {_draw_sql(f'rack/{region}.0/1', 4.0)} THEN {_shard_sql(region, 0)} ELSE {_shard_sql(region, 1)} END"


# The query's tree written out: two regions of two racks of four shards, and
# shard 16 as a second generation below region 1. CRC-32 by its byte table.
ORACLE = f"""
WITH RECURSIVE step AS (
  SELECT n, 0 AS i, n AS v FROM (SELECT unnest(range(256))::BIGINT AS n)
  UNION ALL SELECT n, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM step WHERE i = 8),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null') AS k, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
c AS (
  SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a & 255, x) + 1)::INT])), 4294967295) AS text_crc32,
    {_draw_sql("region/0.0", 8.0)} AS r0, {_draw_sql("region/1.0", 8.0)} AS r1, {_draw_sql("region/1.1", 1.0)} AS r2 FROM d, tab),
s AS (
  SELECT doc_id, size, text_crc32, 'key' AS law, CAST(CASE WHEN r0 <= r1 THEN {_rack_sql(0)} ELSE {_rack_sql(1)} END AS INTEGER) AS shard, r0, r1, r2 FROM c),
g AS (SELECT doc_id, size, text_crc32, law, shard, CAST(CASE WHEN r2 < least(r0, r1) THEN 16 ELSE shard END AS INTEGER) AS grown_shard FROM s)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('|', doc_id, size, text_crc32, shard, grown_shard, law)), 1, {SUB_DIGITS}),
  doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot FROM g
"""
