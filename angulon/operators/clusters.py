"""Conformations: peptide units in a common frame, k-means, medoids and sub-clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles


def canonize(atoms: list[Column], c: Column, n: Column, ca: Column) -> list[Column]:
    """Places relative to a peptide bond: origin at C, x towards N of the next residue, z along (C - N) x (CA - N), with CA
    of the next residue."""
    x = angles.unit(angles.minus(n, c))
    z = angles.unit(angles.cross(angles.minus(c, n), angles.minus(ca, n)))
    y = angles.cross(z, x)
    return [F.array(*[angles.dot(angles.minus(a, c), axis) for axis in (x, y, z)]) for a in atoms]


def kmeans_medoids(df: DataFrame, key: str, columns: list[str], k: int, sample: int = 100_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Each row's cluster and distance to its centre, and each cluster's size and medoid (the member nearest the centre).

    The centres are fitted on at most ``sample`` rows, lowest hash first; every row is assigned.
    """
    rows = df.select(key, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows.orderBy(F.xxhash64(key), key).limit(sample))
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    place = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("cluster") + 1)
    gap = F.zip_with(vector_to_array("features"), place, lambda a, b: (a - b) * (a - b))
    done = model.transform(rows).select(key, "cluster", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)).alias("distance"))
    return done, done.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("distance", key))[key].alias("medoid"))


def nested_kmeans(df: DataFrame, key: str, columns: list[str], cluster: str, k: int, rounds: int = 20, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Lloyd's k-means within every cluster at once: each row's sub-cluster and distance, and the centres.

    The rounds are jobs over all rows; what the driver holds is k centres for each cluster. The first centre of a cluster
    is its member with the least hash, each next one its member furthest from those so far (ties: least key), so all
    start on members. Rounds end when no centre moves by more than the tolerance. A centre that nothing is nearest to
    stays. Rows with nulls in the columns belong to none. ``df`` is read once for each centre and round: store it first.
    """
    rows = df.where(F.col(cluster).isNotNull()).select(key, F.col(cluster).alias("cluster"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull()))
    spark = df.sparkSession
    kind = rows.schema["cluster"].dataType.simpleString()

    def nearest(centres: dict) -> DataFrame:
        """Each row with the least (distance, sub) of its cluster's centres."""
        table = spark.createDataFrame([(c, [[float(x) for x in p] for p in points]) for c, points in centres.items()], f"cluster {kind}, centres array<array<double>>")
        gap = lambda p: F.aggregate(F.zip_with("v", p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        each = F.transform("centres", lambda p, i: F.struct(gap(p).alias("d2"), i.alias("sub")))
        return rows.join(F.broadcast(table), "cluster").withColumn("near", F.array_min(each))

    first = rows.groupBy("cluster").agg(F.min(F.struct(F.xxhash64(key), key, "v"))["v"].alias("v")).collect()  # one row a cluster
    centres = {r.cluster: [r.v] for r in first}
    for _ in range(k - 1):
        far = nearest(centres).where("near.d2 > 0").groupBy("cluster").agg(F.min(F.struct(-F.col("near.d2"), F.col(key), F.col("v")))["v"].alias("v"))
        for r in far.collect():
            centres[r.cluster].append(r.v)
    for _ in range(rounds):
        sums = nearest(centres).groupBy("cluster", "near.sub").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(len(columns))]).alias("v"))
        moved = 0.0
        for r in sums.collect():  # k rows a cluster at most
            moved = max([moved, *(abs(a - b) for a, b in zip(centres[r.cluster][r.sub], r.v, strict=True))])
            centres[r.cluster][r.sub] = r.v
        if moved <= tolerance:
            break
    done = nearest(centres).select(key, "cluster", F.col("near.sub").alias("sub"), F.sqrt("near.d2").alias("distance"))
    places = spark.createDataFrame([(c, i, [float(x) for x in p]) for c, points in centres.items() for i, p in enumerate(points)], f"cluster {kind}, sub int, centre array<double>")
    return done, places


def sub_clusters(df: DataFrame, assigned: DataFrame, key: str, columns: list[str], k: int, attributes: list[str] | None = None) -> DataFrame:
    """The table of representatives: of each cluster (assigned: key, cluster) its k sub-clusters by nested k-means, those
    with a share below 0.5 / k of their cluster left out: cluster, sub, n, frequency, medoid (the member nearest the
    centre; ties: least key), and the medoid's attributes."""
    done, _ = nested_kmeans(df.join(assigned.select(key, "cluster"), key), key, columns, "cluster", k)
    every = done.groupBy("cluster", "sub").agg(F.count("*").alias("n"), F.min(F.struct("distance", key))[key].alias("medoid"))
    size = every.groupBy("cluster").agg(F.sum("n").alias("total"))
    every = every.join(size, "cluster").withColumn("frequency", F.col("n") / F.col("total"))
    every = every.where(F.col("frequency") >= 0.5 / k).drop("total")
    if not attributes:
        return every
    return every.join(df.select(F.col(key).alias("medoid"), *attributes), "medoid").select(*every.columns, *attributes)
