"""Centroid clustering in integers, with centroids filtered by rotated coordinates.

The principal axes of all vectors give a rotation; a vector is stored with its ``lead`` leading rotated
coordinates and the norm of what they leave out.  The distance in the leading coordinates plus the squared
difference of the residual norms is a lower bound of a squared distance, so a centroid whose bound exceeds an exact distance
already known is out; what survives is compared in integers.  A round shuffles one row per task and
centroid; the centroids, ``k`` vectors, are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import materialize

DIM = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1"
LEAD = 16  # rotated coordinates that are stored
REACH = 1 << 26  # largest integer component; what lies beyond counts as this, so that distances fit
LONGEST = (1 << 63) - 1


def is_finite(embedding: Column, dim: int | None = None) -> Column:
    """Whether a vector is not null and holds only finite numbers, and ``dim`` of them if given."""
    e = embedding.cast("array<double>")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(e) == dim) if dim is not None else fine, F.lit(False))


def whole_numbers(embedding: Column, scale: int, reach: int) -> Column:
    """floor(scale * x) of every component, x as double, held within ``reach``."""
    cut = lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(reach))), F.lit(float(-reach)))).cast("int")
    return F.transform(embedding.cast("array<double>"), cut)


def matrix(column, dim: int, kind=np.int64) -> np.ndarray:
    """Rows of an Arrow list column whose lists have ``dim`` numbers each."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), dim)


def principal_axes(rows: DataFrame) -> np.ndarray:
    """Principal axes of the ``q`` of all rows as columns, the widest first."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    few = rows.select("q").limit(2).collect()
    dim = len(few[0][0])
    if len(few) < 2:
        return np.eye(dim)  # one vector has no axes
    model = PCA(k=dim, inputCol="v", outputCol="w").fit(rows.select(array_to_vector(F.col("q").cast("array<double>")).alias("v")))
    return model.pc.toArray()


def split(q: np.ndarray, axes: np.ndarray, lead: int):
    """Leading rotated coordinates and the norm of the others."""
    turned = q @ axes
    return turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray):
    """(centroid, squared distance, compared): the nearest centroid of each row, ties to the smaller number.

    ``compared`` counts the exact distances that were taken.
    """
    c_lead, c_rest = split(centroids.astype(float), axes, lead.shape[1])
    x2, c2 = (lead ** 2).sum(1) + rest ** 2, (c_lead ** 2).sum(1) + c_rest ** 2
    low = (lead ** 2).sum(1)[:, None] + (c_lead ** 2).sum(1) - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    low -= 1e-9 * (x2[:, None] + c2 + 1)  # rounding of the bound
    best = low.argmin(1)
    distance = ((q - centroids[best]) ** 2).sum(1)
    compared = len(q)
    guess = best.copy()
    for c in range(len(centroids)):
        at = np.nonzero((low[:, c] <= distance) & (guess != c))[0]
        exact = ((q[at] - centroids[c]) ** 2).sum(1)
        compared += len(at)
        won = (exact < distance[at]) | (exact == distance[at]) & (c < best[at])
        best[at[won]], distance[at[won]] = c, exact[won]
    return best, distance, compared


def _rotated(rows: DataFrame, axes: np.ndarray, lead: int, id_type: str) -> DataFrame:
    dim = len(axes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            front, rest = split(matrix(batch.column(1), dim, float), axes, lead)
            offsets = pa.array(np.arange(len(rest) + 1, dtype=np.int32) * front.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(front.reshape(-1))), pa.array(rest)], names=["vec_id", "q", "lead", "rest"])

    return rows.mapInArrow(run, f"vec_id {id_type}, q array<int>, lead array<double>, rest double")


def _batches(batches, axes: np.ndarray, lead: int, centroids: np.ndarray):
    for batch in batches:
        q = matrix(batch.column(1), len(axes))
        yield batch, q, *nearest(q, matrix(batch.column(2), lead, float), np.asarray(batch.column(3)), centroids, axes)[:2]


def _moved(rows: DataFrame, axes: np.ndarray, lead: int, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors; those without vectors stay."""
    k, dim = centroids.shape

    def run(batches):
        import pyarrow as pa

        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, q, best, _ in _batches(batches, axes, lead, centroids):
            for c in np.unique(best).tolist():
                total[c] += q[best == c].sum(0)
            count += np.bincount(best, minlength=k)
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.mapInArrow(run, "cluster int, n bigint, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    new = centroids.copy()
    for c, at, total, n in parts.groupBy("cluster", "at").agg(F.sum("part"), F.sum("n")).collect():  # k times dim rows
        new[c, at] = total // n
    return new


def cluster(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, lead: int = LEAD) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Those are the rows of ``vectors`` whose embedding has exactly ``dim`` finite components; the others are left
    out.  Zero vectors, null ids and repeated rows take part, each row for itself; a null id counts as the empty text
    in the order of first centroids, whose ties go to the smaller vector.  Fewer than ``k`` vectors give fewer centroids, none an empty
    result.  Components beyond 2^26 after scaling count as 2^26; sums beyond a long count as the largest long.
    Other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.filter(is_finite(F.col("embedding"), dim)).select("vec_id", whole_numbers(F.col("embedding"), scale, REACH).alias("q"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = np.array([r[0] for r in rows.select("q", key.alias("key")).orderBy("key", "q").limit(k).collect()], np.int64)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    axes, lead = principal_axes(rows), min(lead, dim)
    held = materialize(_rotated(rows, axes, lead, id_type), "rotated")
    for _ in range(rounds):
        centroids = _moved(held, axes, lead, centroids)

    def run(batches):
        import pyarrow as pa

        for batch, _, best, distance in _batches(batches, axes, lead, centroids):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    given = materialize(held.mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint"), "assigned")
    sums = {r[0]: int(r[1]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = min(sum(sums.values()), LONGEST)
    facts = spark.createDataFrame([(c, min(s, LONGEST), inertia, digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return given.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per centroid


def _sql() -> str:
    steps = [f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT r, unnest(range(1, {DIM + 1})) AS j, unnest(q) AS x FROM kept),
seeds AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, {DIM + 1})) AS j, unnest(q) AS x FROM seeds WHERE c < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
d{i} AS (SELECT v.r, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS d FROM v JOIN c{i} AS k USING (j) GROUP BY v.r, k.c),
a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT k.c, k.j, coalesce((s - ((s % n) + n) % n) // n, k.x) AS x FROM c{i} AS k LEFT JOIN m{i} USING (c, j))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c) AS h USING (c)
"""


SQL = _sql()
