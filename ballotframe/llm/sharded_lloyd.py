"""Lloyd's clustering sharded by dimension, in exact integers.

Components are turned into integers. Vectors are dealt to row blocks, and each row block is cut into column blocks; a record
is one matrix of integers, (row block, shard) -> rows x columns. A round has two parts:

* Assignment: a column block's task needs only its shard's slice of the centroids; it gives the exact squared distances over
  its own columns, a matrix of rows x centroids. ``reduceByKey`` on the row block adds the column blocks (before the shuffle
  too, where they are in one partition) and the least of each row is its cluster; the smaller number wins among equals.
* Update: the clusters of a row block go back to its column blocks; each shard sums its own columns by cluster, partial sums
  first in each task, and replaces its slice of the centroids by the sums divided by the counts, rounded down.

Matrices are kept in a table bucketed by row block, so only distances and clusters are shuffled in a round, not vectors. What
reaches the driver is the centroids: clusters x dimensions, parameters both. Clusters go back to the blocks from a stored
table, so lost executors cost a round at most.

Vectors take part that have exactly ``dims`` components, none null or not finite, all less than ``limit`` in absolute value:
beyond that squared distances do not fit into 64 bits. Rows with a null id take part with an empty id in the order of
the first centroids. Repeated rows are vectors each; ties in that order go to the smaller vector. With fewer vectors than
clusters there are as many centroids as vectors; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored


@dataclass(frozen=True)
class LloydParams:
    """``shards``: column blocks; ``block_rows``: rows of a row block at most; ``scale``: of components before rounding down."""

    clusters: int = 8
    rounds: int = 10
    dims: int = 64
    shards: int = 4
    block_rows: int = 2_048
    scale: int = 1024
    seed: int = 3
    limit: float = float(1 << 17)


def usable(vectors: DataFrame, p: LloydParams) -> DataFrame:
    """(vec_id, v): vectors that take part, as integers."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == p.dims)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < p.limit) & ~F.isnan(x)))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * p.scale).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, p: LloydParams) -> np.ndarray:
    """The vectors whose hashed ids are least, in that order."""
    key = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(p.clusters).collect()
    return np.array([r.v for r in least], np.int64).reshape(len(least), p.dims)


def columns_of(p: LloydParams) -> list[slice]:
    """The columns of each shard."""
    edges = [p.dims * k // p.shards for k in range(p.shards + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def blocks(rows: DataFrame, p: LloydParams) -> tuple[DataFrame, DataFrame]:
    """(row_block, shard, n, x): the column blocks; (row_block, ids): the ids of each row block's rows.

    A row block is a run of rows of one input partition, so a hot id needs no care.
    """
    shards = columns_of(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, p.block_rows):
                part = batch.slice(a, p.block_rows)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, p.dims).astype("<i8")
                ids = part.column("vec_id").to_pylist()
                for k, columns in enumerate(shards):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([k], pa.int32()), pa.array([len(x)], pa.int32()),
                         pa.array([np.ascontiguousarray(x[:, columns]).tobytes()], pa.binary()),
                         pa.array([ids if k == 0 else None], pa.list_(pa.int64()))],
                        names=["row_block", "shard", "n", "x", "ids"],
                    )
                block += 1

    cut = stored(rows.mapInArrow(run, "row_block long, shard int, n int, x binary, ids array<long>"))
    return cut.drop("ids"), cut.where("shard = 0").select("row_block", "ids")


def bucketed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` as a table bucketed by row block, so that joins on it move only the other side."""
    name = f"column_blocks_{uuid.uuid4().hex}"
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(count, "row_block").write.bucketBy(count, "row_block").format("parquet").saveAsTable(name)
    return spark.table(name)


def partial_distances(x: bytes, n: int, slice_of: np.ndarray) -> np.ndarray:
    """Exact squared distances over one column block, rows x centroids."""
    matrix = np.frombuffer(x, "<i8").reshape(n, -1)
    out = np.empty((n, len(slice_of)), np.int64)
    for k, centroid in enumerate(slice_of):
        away = matrix - centroid
        out[:, k] = np.einsum("ij,ij->i", away, away)
    return out


def assign(cut: DataFrame, centroids: np.ndarray, p: LloydParams) -> DataFrame:
    """(row_block, cluster, distance): the nearest centroid of each row, as one array for each row block; stored."""
    slices = [centroids[:, c] for c in columns_of(p)]

    def part(row) -> tuple[int, np.ndarray]:
        return row.row_block, partial_distances(row.x, row.n, slices[row.shard])

    def nearest(total: np.ndarray) -> tuple[list[int], list[int]]:
        cluster = total.argmin(1)
        return cluster.tolist(), total[np.arange(len(total)), cluster].tolist()

    summed = cut.rdd.map(part).reduceByKey(lambda a, b: a + b)
    found = summed.map(lambda kv: (kv[0], *nearest(kv[1])))
    return stored(cut.sparkSession.createDataFrame(found, "row_block long, cluster array<int>, distance array<long>"))


def update(cut: DataFrame, assigned: DataFrame, centroids: np.ndarray, p: LloydParams) -> np.ndarray:
    """The next centroids: each shard's slice from the sums of its own columns."""
    shards, k = columns_of(p), len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((k, c.stop - c.start), object) for s, c in enumerate(shards)}
        count = {s: np.zeros(k, np.int64) for s in sums}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "n", "x", "cluster"))
            for s, n, x, cluster in zip(*columns, strict=True):
                matrix, hit = np.frombuffer(x, "<i8").reshape(n, -1), np.array(cluster)
                count[s] += np.bincount(hit, minlength=k)
                for c in np.unique(hit):
                    sums[s][c] += matrix[hit == c].sum(0)
        for s in sums:
            rows = [(s, c, d, int(count[s][c]), str(sums[s][c][d])) for c in range(k) if count[s][c] for d in range(sums[s].shape[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*rows, strict=True)], names=["shard", "cluster", "at", "n", "total"])

    pairs = cut.join(assigned.select("row_block", "cluster"), "row_block").select("shard", "n", "x", "cluster")
    partial = pairs.mapInArrow(add, "shard long, cluster long, at long, n long, total string")
    whole = partial.groupBy("shard", "cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for row in whole.collect():  # clusters x dimensions rows
        out[row.cluster, shards[row.shard].start + row.at] = int(row.total) // row.n
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def lloyd(vectors: DataFrame, params: LloydParams | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, and the last centroids."""
    p = params or LloydParams()
    spark = vectors.sparkSession
    rows = usable(vectors, p)
    centroids = first_centroids(rows, p)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    cut, members = blocks(rows, p)
    cut = bucketed(cut, spark)
    for _ in range(p.rounds):
        moved = update(cut, assign(cut, centroids, p), centroids, p)
        if (moved == centroids).all():
            break  # further rounds would change nothing
        centroids = moved
    pairs = members.join(assign(cut, centroids, p), "row_block")
    each = pairs.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r"))
    return each.select(F.col("r.ids").alias("vec_id"), "r.cluster", "r.distance"), centroids


def cluster_report(vectors: DataFrame, params: LloydParams | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    found, centroids = lloyd(vectors, params)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # a row for each cluster
    names = [(k, digest(c)) for k, c in enumerate(centroids)]
    names = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(sums.join(F.broadcast(names), "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(p: LloydParams) -> str:
    """The rounds written out, one after another, for a database with the same table."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {p.dims}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {int(p.limit)})) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT sha256('{p.seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {p.clusters})
)"""]
    nearest = """
a{k} AS MATERIALIZED (
  SELECT r, vec_id, v, cluster, distance FROM (
    SELECT r, vec_id, kept.v, cluster, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM kept, c{k} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
)"""
    for k in range(p.rounds):
        parts.append(nearest.format(k=k))
        parts.append(f"""
s{k + 1} AS (
  SELECT cluster, pos, sum(x) AS total, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{k}) GROUP BY cluster, pos
), c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{k + 1} GROUP BY cluster) m USING (cluster)
)""")
    parts.append(nearest.format(k=p.rounds))
    return ",".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{p.rounds} a JOIN c{p.rounds} c USING (cluster)
"""


ORACLE = oracle(LloydParams())
