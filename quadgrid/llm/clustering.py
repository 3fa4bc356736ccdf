"""Centroid clustering with an incremental distance matrix.

Each vector keeps its exact integer dot products with all centroids. When centroids move, only
their components that changed are multiplied with the vectors' and added to the stored products;
squared distances follow from the products and two norms, and the nearest centroid is found anew.
Cluster sums are kept the same way: vectors that changed their cluster are added to the one and
taken from the other. A round is one pass that writes the next generation of the table (vector,
norm, products, cluster) to the shared folder, and one that sums what moved; lineage ends at each
generation, and the one before the last is deleted. The driver holds centroids and sums only
(k x 64 integers); nothing is shuffled but those sums.

Defined results: vectors that are null, of another length, or with a null or non-finite component
are left out; an empty table gives an empty result; with fewer vectors than centroids all are
starts; equal vectors, and rows sharing a vec_id, are clustered alike; a null vec_id is hashed as
an empty one; equal start hashes go by their components; equal distances go to the smaller number,
and a centroid without vectors stays where it is. Other columns don't matter. Components must
be below 2^27 after scaling, so that every distance fits a long; others are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, remove, table, written

DIM, K, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
LIMIT = 1 << 27
_STATE = "vec_id bigint, x array<int>, norm bigint, dots array<bigint>, cluster int, was int, distance bigint"


def integer_vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with `dim` finite components."""
    whole = (F.size("embedding") == dim) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    scaled = F.transform(
        "embedding",
        lambda v: F.when(F.abs(v.cast("double")) < LIMIT / scale, F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling"))).cast("int"),
    )
    return embeddings.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("x"))


def starts(vectors: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in the order of these."""
    place = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(place, "x").limit(k).collect()  # k vectors
    return np.array([r["x"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def move(state: DataFrame, moved: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """The next generation: products follow the centroids' changed components, clusters the distances."""
    k, dim = centroids.shape
    squares = (centroids * centroids).sum(1)
    changed = [(c, np.flatnonzero(moved[c])) for c in range(k) if moved[c].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, xs, norm, dots, was = batch.columns
            x, dots, norm = _matrix(xs, dim), _matrix(dots, k).copy(), norm.to_numpy()
            for c, at in changed:
                dots[:, c] += x[:, at].astype(np.int64) @ moved[c, at]
            far = norm[:, None] - 2 * dots + squares
            cluster = far.argmin(1)  # the first of equal ones
            near = far[np.arange(len(far)), cluster]
            yield pa.RecordBatch.from_arrays([ids, xs, pa.array(norm), _lists(dots, pa.int64()), pa.array(cluster.astype(np.int32)), was, pa.array(near)], names=["vec_id", "x", "norm", "dots", "cluster", "was", "distance"])

    return arrow_map(state.select("vec_id", "x", "norm", "dots", F.col("cluster").alias("was")), run, _STATE)


def sums_of_moves(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """How the clusters' counts and component sums changed: what came less what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, dim + 1), np.int64)  # the last row stands for no cluster, the last column counts
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.int64)
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            to, frm = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for c in range(k):
                total[c] += x[to == c].sum(0) - x[frm == c].sum(0)
        at = np.argwhere(total[:k])
        yield pa.RecordBatch.from_pydict({"c": pa.array(at[:, 0].astype(np.int32)), "i": pa.array(at[:, 1].astype(np.int32)), "s": pa.array(total[at[:, 0], at[:, 1]])})

    parts = arrow_map(state.where("cluster <> was").select("x", "cluster", "was"), run, "c int, i int, s bigint")
    out = np.zeros((k, dim + 1), np.int64)
    for r in parts.groupBy("c", "i").agg(F.sum("s").alias("s")).collect():  # at most k x (dim + 1) sums
        out[r["c"], r["i"]] = r["s"]
    return out[:, dim], out[:, :dim]


@dataclass
class Clusters:
    assigned: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> Clusters:
    """Lloyd's rounds in integers over vectors (vec_id, x), then one more assignment."""
    spark = vectors.sparkSession
    k, dim = centroids.shape
    norm = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v.cast("bigint"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), k)
    state = vectors.select("vec_id", "x", norm.alias("norm"), zeros.alias("dots"), F.lit(-1).alias("cluster"))
    counts, sums, before, folder = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros_like(centroids), None
    for i in range(rounds + 1):
        if i and not (centroids - before).any():
            break  # nothing moves any more: further rounds would repeat this one
        path, state = written(move(state, centroids - before, centroids), f"clusters-{i}")
        if folder:
            remove(spark, folder)
        folder, before = path, centroids
        if i < rounds:
            n, s = sums_of_moves(state, k, dim)
            counts, sums = counts + n, sums + s
            centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    return Clusters(state.select("vec_id", "cluster", "distance"), before)


def with_figures(found: Clusters) -> DataFrame:
    """The assignment with each cluster's and the whole inertia and the digest of its centroid."""
    k = len(found.centroids)
    per = {r["cluster"]: r["s"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    own = [F.lit(per.get(c, 0)).cast("bigint") for c in range(k)]
    digest = [F.sha2(F.lit(",".join(map(str, c))), 256) for c in found.centroids.tolist()]
    return found.assigned.select(
        "vec_id", "cluster", "distance", pick(own).alias("cluster_inertia"), F.lit(sum(per.values())).cast("bigint").alias("inertia"), pick(digest).alias("centroid_sha256")
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    first = starts(vectors)
    if not len(first):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return with_figures(cluster(vectors, first))


def _sql() -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, [cast(floor({SCALE} * cast(e AS DOUBLE)) AS BIGINT) for e in embedding] AS x FROM embeddings
            WHERE len(embedding) = {DIM} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {DIM})""",
        f"cells AS MATERIALIZED (SELECT vec_id, unnest(range({DIM})) AS i, unnest(x) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT k, unnest(range({DIM})) AS i, unnest(x) AS c
            FROM (SELECT x, row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS k FROM kept) WHERE k < {K})""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, k := k)) AS best
            FROM (SELECT vec_id, k, cast(sum((x - c) * (x - c)) AS BIGINT) AS d FROM cells JOIN c{r} USING (i) GROUP BY 1, 2) GROUP BY 1)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.k, o.i, coalesce((n.s - (n.s % n.n + n.n) % n.n) // n.n, o.c) AS c
                FROM c{r} o LEFT JOIN (SELECT best.k AS k, i, cast(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN cells USING (vec_id) GROUP BY 1, 2) n ON n.k = o.k AND n.i = o.i)""")
    return (
        "WITH " + ",\n".join(steps) + f""", digest AS (SELECT k, sha256(string_agg(cast(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k)
        SELECT vec_id, cast(best.k AS INTEGER) AS cluster, best.d AS distance, cast(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
            cast(sum(best.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN digest ON digest.k = best.k"""
    )


QUERIES = {"op11_clusters": op11_clusters}
SQL = {"op11_clusters": _sql()}
