"""Operator 11: centroid clustering of quantised vectors, each distinct vector once.

Components become integers, and equal vectors become one row with a multiplicity. Lloyd's
rounds run over the distinct vectors: tasks assign their rows by matrix products and return
integer sums weighted by multiplicity, one row for each of their clusters, and Spark adds
these up. Assignments of distinct vectors are then joined back to the ids by a digest of the
vector; the rows of very frequent vectors are dealt out by a salt. All arithmetic is on
integers, so results do not depend on partitioning. The driver holds the centroids alone.

Edge cases: null vectors and vectors of another length, or with a null, NaN or infinite
component, are left out; repeated rows are vectors of their own, with one result each; of
centroids at one distance the first is taken; of rows tied for the last start (one id twice) the
smaller vector is taken, rows without an id start no cluster before all others do; an empty
table, or one without a vector to keep, gives an empty result; with fewer than k vectors there
are fewer clusters; columns of other names play no part. Quantised components beyond 2^26
are an error, as squared distances would leave the range of a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components may be this large: squared distances of 64 of them stay below 2^61.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(key, q): floor(scale * component) of the vectors with dims finite components."""
    whole = (F.size(column) == dims) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    kept = vectors.where(whole).select(F.col(key).alias("id"), scaled.alias("q"))
    beyond = F.exists("q", lambda x: F.abs(x) > LARGEST)
    fits = F.when(beyond, F.raise_error(F.lit(f"a quantised component is beyond {LARGEST}"))).otherwise(F.transform("q", lambda x: x.cast("int")))
    return kept.select(F.col("id").alias(key), fits.cast("array<int>").alias("q"))


def digest(q: Column) -> Column:
    """SHA-256 of a vector's components, as bytes."""
    return F.unhex(F.sha2(F.array_join(q, ","), 256))


def starts(rows: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``, as the rows of a matrix."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).asc_nulls_last()
    return np.array([r.q for r in rows.orderBy(order, "q").limit(k).select("q").collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, exactly: products of doubles where all sums are below 2^53, else of integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if x.shape[1] * 4 * most * most < 1 << 52 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    at = d.argmin(1)
    return at.astype(np.int32), d[np.arange(len(at)), at].astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; a cluster without vectors keeps its own."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                x, m = matrix(b["q"]), b["m"].to_numpy()
                cluster, _ = nearest(x, centroids)
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                held = cluster[order][first]
                total[held] += np.add.reduceat((x * m[:, None])[order], first)
                n[held] += np.add.reduceat(m[order], first)
        held = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(held.astype(np.int32)), "n": pa.array(n[held]), "s": pa.array(list(total[held]), pa.list_(pa.int64()))})

    parts = distinct.select("q", "m").mapInArrow(sums, "cluster int, n long, s array<long>")
    flat = parts.select("cluster", "n", F.posexplode("s").alias("j", "s"))
    out = centroids.copy()
    for r in flat.groupBy("cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.j] = r.s // r.n
    return out


def clustered(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """((key, cluster, distance) of every vector kept, the same of distinct vectors with multiplicities m, the centroids by number)."""
    rows = quantised(vectors, key, column, dims, scale)
    distinct = cut(rows.groupBy("q").agg(F.count("*").alias("m")))
    centroids = starts(rows, key, k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance = nearest(matrix(b["q"]), centroids)
                yield pa.record_batch({"digest": b["digest"], "m": b["m"], "cluster": pa.array(cluster), "distance": pa.array(distance)})

    assigned = cut(distinct.select(digest(F.col("q")).alias("digest"), "q", "m").mapInArrow(assign, "digest binary, m long, cluster int, distance long"))
    back = join_groups(rows.select(key, digest(F.col("q")).alias("digest")), assigned, "digest", "m")
    return back.select(key, "cluster", "distance"), assigned, centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back, assigned, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # at most k rows
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("m")).alias("cluster_inertia")).collect()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in inertia), names[r.cluster]) for r in inertia]
    each = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return back.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, m.c,
    list_sum([(v.q[j] - m.q[j]) * (v.q[j] - m.q[j]) FOR j IN range(1, {DIMS + 1})])::BIGINT AS d FROM kept v, c{r} m) GROUP BY id)"""  # noqa: E731
    move = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS q
    FROM (SELECT a.c, j, sum(v.q[j])::BIGINT AS s, count(*) AS n FROM kept v JOIN a{r} a USING (id), range(1, {DIMS + 1}) AS r(j) GROUP BY a.c, j) GROUP BY c) n USING (c))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [floor(CAST(x AS DOUBLE) * {SCALE})::BIGINT FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMS}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, q) - 1)::INT AS c, q FROM (SELECT q, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, q LIMIT {CLUSTERS})),
{steps},
{near(ROUNDS)}
SELECT vec_id, a.c AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} a USING (id) JOIN c{ROUNDS} m ON m.c = a.c"""


OP11_SQL = _sql()
