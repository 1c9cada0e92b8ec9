"""Operator 12: centroid clustering in JVM expressions.

Vectors become arrays of integers, so distances and means are exact and the same on every run and
cluster size. An assignment is one projection: ``zip_with`` and ``aggregate`` give the squared distance
to each centroid, a literal array; ``array_min`` over (distance, number) takes the nearest, the
smaller number on ties. An update is one grouped aggregate of a sum a component: each task sends a row a
cluster, and the driver holds no more than the centroids. Nothing else is shuffled."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._spark import checkpoint

#: Components are clamped to this size, from which on the exact sums of 38 digits could not hold a distance.
LARGEST = 1 << 55
WIDE = "decimal(38,0)"


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors, each component x as floor(scale * x)."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * scale)))
    return vectors.filter((F.size(x) == dims) & fine).select(F.col(id_col).alias("id"), F.transform(x, whole).alias("v"))


def _distance(v: Column, centroid: list[int], wide: bool) -> Column:
    """The squared distance to a literal centroid; in decimals where longs could overflow."""
    kind, part = (WIDE, "decimal(19,0)") if wide else ("bigint", "bigint")
    squares = F.zip_with(v, F.array(*[F.lit(c).cast("bigint") for c in centroid]), lambda x, y: ((x - y).cast(part) * (x - y).cast(part)).cast(kind))
    return F.aggregate(squares, F.lit(0).cast(kind), lambda s, d: (s + d).cast(kind))


def _assigned(rows: DataFrame, centroids: list[list[int]], wide: bool) -> DataFrame:
    """(id, v, best.distance, best.cluster)"""
    each = [F.struct(_distance(F.col("v"), c, wide).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]
    return rows.select("id", "v", F.array_min(F.array(*each)).alias("best"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; a null vector goes.
    The centroids start as the k kept vectors of the smallest SHA-256 of "<seed>:<id>" (a null id counts
    as empty; equal hashes go by their components); where fewer vectors are kept, there are
    fewer. Copies of a vector may start several centroids: the smaller number takes the rows, the
    others stay empty and as they are. Each round assigns all vectors, then moves each centroid that
    has any to floor(sum / count) of every component; a last assignment gives the result. Repeated rows each
    get a row, whatever their ids. Sums and distances are longs where a measured bound proves that they fit,
    38-digit decimals otherwise (components beyond 2**55 count as 2**55); a distance or inertia that no long
    holds is null. An empty table, or one without a kept vector, gives an empty result. Other columns
    are not read, whatever their names."""
    rows = integers(vectors, id_col, vector_col, dims, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    n, widest = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if not n:
        empty = rows.select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
        return empty.filter(F.lit(False))
    wide = dims * (2 * (widest or 0)) ** 2 >= 1 << 63 or n * (widest or 0) >= 1 << 63
    centroids = [list(r["v"]) for r in rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    total = lambda i: F.sum(F.get("v", F.lit(i)).cast(WIDE if wide else "bigint")).alias(f"s{i}")
    for _ in range(rounds):
        for r in _assigned(rows, centroids, wide).groupBy("best.cluster").agg(F.count(F.lit(1)).alias("n"), *[total(i) for i in range(dims)]).collect():
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    last = checkpoint(_assigned(rows, centroids, wide).select("id", "best.cluster", "best.distance"))
    inertia = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE)).alias("s")).collect()}
    held = lambda x: x if -(1 << 63) <= x < 1 << 63 else None
    per = F.array(*[F.struct(F.lit(held(inertia.get(j, 0))).cast("bigint").alias("s"), F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()).alias("h")) for j, c in enumerate(centroids)])
    own = F.get(per, F.col("cluster"))
    return last.select("id", "cluster", F.col("distance").try_cast("bigint").alias("distance"), own["s"].alias("cluster_inertia"), F.lit(held(sum(inertia.values()))).cast("bigint").alias("inertia"), own["h"].alias("centroid_sha256"))
