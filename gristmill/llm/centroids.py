"""Centroid clustering with column expressions (operator 12).

Vectors are whole numbers.  A round is one pass: zip_with and aggregate give
the squared distance to each centroid of a literal array, array_min of
(distance, number) structs picks the nearest, and column sums of each cluster,
combined before they are shuffled, give the next centroids.  Only the
centroids, k times d numbers, come to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import _text as T

#: Components are held within these bounds, so that a squared distance of some hundred components fits a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dimension: int, scale: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component x, as double, of the vectors with exactly dimension finite components.

    Vectors that are null, of another length, or have a null or non-finite
    component are left out.  Components beyond 2**27 either way count as that.
    """
    x = F.col(vector).cast("array<double>")
    good = (F.size(x) == dimension) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    bound = F.lit(float(LARGEST))
    whole = F.transform(x, lambda e: F.least(F.greatest(F.floor(F.least(F.greatest(e * scale, -bound), bound)), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(whole: DataFrame, k: int, salt: str) -> list[tuple[int, ...]]:
    """The k vectors with the smallest sha256 of salt and vec_id, in that order; equal ids by their components, a null id as no digits."""
    by = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [tuple(r["v"]) for r in whole.orderBy(by, "v").limit(k).select("v").collect()]


def nearest(v: str | Column, centroids: Sequence[Sequence[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid by squared Euclidean distance; of equal ones the smallest number."""
    v = F.col(v) if isinstance(v, str) else v
    literal = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")

    def measured(c: Column, i: Column) -> Column:
        squares = F.zip_with(v, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"), i.alias("cluster"))

    return F.array_min(F.transform(literal, measured))


def next_centroids(whole: DataFrame, centroids: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
    """Each centroid's floor of its vectors' mean; one without vectors stays."""
    d = len(centroids[0])
    assigned = whole.select(nearest("v", centroids)["cluster"].alias("cluster"), "v")
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(d)])
    out = [tuple(c) for c in centroids]
    for r in sums.collect():  # k rows
        out[r["cluster"]] = tuple(r[f"s{i}"] // r["n"] for i in range(d))
    return out


def fit(whole: DataFrame, k: int, rounds: int, salt: str) -> list[tuple[int, ...]]:
    """The centroids after so many rounds; fewer than k where there are fewer vectors, none for an empty table."""
    centroids = first_centroids(whole, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(whole, centroids)
    return centroids


def assigned(whole: DataFrame, centroids: Sequence[Sequence[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of each row of whole_vectors()."""
    best = whole.select("vec_id", nearest("v", centroids).alias("best"))
    return best.select("vec_id", F.col("best.cluster").cast("int").alias("cluster"), F.col("best.distance").alias("distance"))


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, salt: str = "2:", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector; see whole_vectors for those left out.

    inertia sums the squared distances over all kept vectors, cluster_inertia
    over the vector's cluster (null where a sum passes a long).
    centroid_sha256 is of the cluster's final centroid, components in decimal
    with commas between.  Repeated rows and ids stay apart; with no kept vector
    the result is empty; other columns are ignored.

    The whole numbers are written once to the shared folder and read in each
    round, so that rounds cost a scan and nothing is computed twice.
    """
    spark = vectors.sparkSession
    T.checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/centroids-{uuid.uuid4().hex}"
    whole_vectors(vectors, dimension, scale, vector).write.parquet(f"{folder}/whole")
    whole = spark.read.parquet(f"{folder}/whole")
    centroids = fit(whole, k, rounds, salt)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    assigned(whole, centroids).write.parquet(f"{folder}/assigned")
    rows = spark.read.parquet(f"{folder}/assigned")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda s: int(s) if s < 1 << 63 else None
    total = fits(sum(sums.values()))
    table = [(i, fits(sums.get(i, 0)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(clusters), "cluster").withColumn("inertia", F.lit(total).cast("long"))  # k rows are broadcast
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
