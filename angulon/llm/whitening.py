"""Whitened embeddings, whose covariances come from variances alone (polarisation).

Entries c become integers x = floor(1024 c) + 100000. For each dimension i and each pair of dimensions i < j the exact
integer sums of (n x_i - S_i)^2 and of (n (x_i + x_j) - S_i - S_j)^2 over all vectors are aggregated; half the
difference of the pair's sum and the two dimensions' sums is n^2 times the sum of centred products, hence each
covariance, rounded once. Tasks add up chunks of rows in 64-bit integers, split into limbs of LIMB bits where a square
could pass them, and send one row for each pair and limb; Spark adds these up. What reaches the driver is bounded by
the square of the dimension, never by the rows; the matrix is decomposed there by eigh.

Vectors that are null or hold null or non-finite entries are left out, as are those of another length than most
vectors have (of equally frequent lengths the longest counts). Entries beyond +-2**18 count as that, so that sums stay
exact for 2**31 vectors. Rows may repeat: each counts. Eigenvalues of equal size keep the order that eigh gives them;
each component's entry of the largest size is positive, the first of equal ones. A component without variance (equal
vectors, or fewer of them than dimensions) has whitened 0 and explained 0 and is not part of the identity's error. No
vector left gives no rows. A deviation that no 64-bit integer holds is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import releasing, scratch

SCALE, SHIFT, MOST, LIMB, ROWS, COMPONENTS = 1024, 100_000, 1 << 18, 26, 1024, 8
#: Eigenvalues below so much of the trace are none: that is what rounding leaves of 0.
NOTHING = 1e-13


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def integers(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """key and x (array of long) of the vectors that remain, and their length (0: none remain)."""
    good = df.select(key, F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & _finite(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first().m
    d = most.d if most else 0
    x = lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST))) * SCALE).cast("bigint") + SHIFT
    return good.where(F.size("v") == d).select(key, F.transform("v", x).alias("x")), d


def totals(xs: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension."""
    sums = {r.i: r for r in xs.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()}  # d rows
    return sums[0].n, [int(sums[i].s) for i in range(d)]


def squares(y: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Exact sums over rows of the squares of each column and of each sum of two columns, as {(i, shift): values of i with
    i.. d-1}; at (i, i) the square of the column itself. Sums are to be taken times 2**shift and added."""
    d, out = y.shape[1], {}

    def add(i: int, shift: int, values: np.ndarray) -> None:
        for s, v in ((shift, values & ((1 << 32) - 1)), (shift + 32, values >> 32)):
            out[i, s] = out[i, s] + v if (i, s) in out else v

    for lo in range(0, len(y), ROWS):
        part = y[lo : lo + ROWS]
        wide = part.size and 2 * int(np.abs(part).max()) >= 1 << LIMB
        for i in range(d):
            z = part[:, i:] + part[:, i : i + 1]
            z[:, 0] = part[:, i]
            if not wide:
                add(i, 0, (z * z).sum(axis=0))
                continue
            limbs = [z & ((1 << LIMB) - 1), (z >> LIMB) & ((1 << LIMB) - 1), z >> (2 * LIMB)]
            for a in range(3):
                for b in range(a, 3):
                    add(i, LIMB * (a + b) + (a != b), (limbs[a] * limbs[b]).sum(axis=0))
    return out


def _centred(b: pa.RecordBatch, d: int, n: int, sums: np.ndarray) -> np.ndarray:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return x * n - sums


def covariance(xs: DataFrame, d: int, n: int, sums: list[int]) -> list[list[int]]:
    """n^3 times the covariance (divisor n) of each two dimensions, exact."""
    s = np.array(sums, np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, v in squares(_centred(b, d, n, s)).items():
                total[k] = total[k] + v if k in total else v
        for (i, shift), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, i)), pa.array(np.arange(i, d)), pa.array(np.full(d - i, shift)), pa.array(v)], ["i", "j", "shift", "s"])

    parts = xs.select("x").mapInArrow(releasing(summed), "i bigint, j bigint, shift bigint, s bigint")
    of = [[0] * d for _ in range(d)]
    for r in parts.groupBy("i", "j", "shift").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # d * d times the limbs
        of[r.i][r.j] += int(r.s) << r.shift
    out = [[0] * d for _ in range(d)]
    for i in range(d):
        out[i][i] = of[i][i]
        for j in range(i + 1, d):
            out[i][j] = out[j][i] = (of[i][j] - of[i][i] - of[j][j]) // 2
    return out


def components(cov: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns) and eigenvalues by falling eigenvalue, and the trace."""
    v = np.array([[c / n**3 for c in row] for row in cov])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    sign = np.sign(w[np.abs(w).argmax(axis=0), np.arange(len(e))])
    return w * sign, e, float(np.trace(v))


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """One row for each vector that remains and each of its first ``most`` components: key, component, n, deviation,
    whitened, explained, identity_error."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    xs, d = integers(df, vector, key)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    n, sums = totals(xs, d)
    w, e, trace = components(covariance(xs, d, n, sums), n)
    k = min(d, most)
    live = e[:k] > NOTHING * max(trace, 1e-300)
    axes = np.where(live, w[:, :k] / np.sqrt(np.where(live, e[:k], 1.0)), 0.0)
    s = np.array(sums, np.int64)
    (at,) = scratch([key], "row")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _centred(b, d, n, s)
            wide = len(y) and d * int(np.abs(y).max()) ** 2 >= 1 << 63
            dev = [v if v < 1 << 63 else None for v in (sum(c * c for c in row) for row in y.tolist())] if wide else (y * y).sum(axis=1)
            out = (y / n) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(dev, pa.int64()), lists], [key, "deviation", at])

    rows = xs.mapInArrow(releasing(projected), f"`{key}` {kind}, deviation bigint, {at} array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k) if live[i] and live[j]]
    error = 0.0
    if pairs:  # covariances of the values as they are returned, centred by Spark's own aggregate
        got = rows.agg(*[F.covar_pop(F.col(at)[i], F.col(at)[j]).alias(f"c{p}") for p, (i, j) in enumerate(pairs)]).first()
        error = max(abs(got[p] - (i == j)) for p, (i, j) in enumerate(pairs))
    shares = F.array(*[F.lit(float(e[i] / trace) if live[i] else 0.0) for i in range(k)])
    out = rows.select(key, "deviation", F.posexplode(at).alias("component", "whitened"))
    out = out.select(key, (F.col("component") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", shares[F.col("component")].alias("explained"), F.lit(float(error)).alias("identity_error"))
    return out.select(key, *names)
