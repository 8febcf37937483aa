"""False-discovery control and significance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles


def bh(df: DataFrame, p: str, q: float, by: list[str]) -> DataFrame:
    """Adds threshold (the greatest i*q/m with the i-th p-value no greater; 0 without one or for m < 2) and significant.

    Groups (``by``, not null) may be of any size: equal p-values are counted first, and their ranks are summed up in
    blocks of the p-values' range.
    """
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_c")).withColumn("_b", F.floor(F.col("_p") * 4096))
    sizes = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_b", before.alias("_before"), F.sum("_s").over(group).alias("_m"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_p"))
    lines = counts.withColumn("_upto", upto).join(sizes, [*by, "_b"]).withColumn("_line", (F.col("_before") + F.col("_upto")) * F.lit(q) / F.col("_m"))
    least = lines.where("_m >= 2 AND _p <= _line").groupBy(*by).agg(F.max("_line").alias("threshold"))
    return df.join(least, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).withColumn("significant", F.col(p) <= F.col("threshold")).select(*df.columns, "threshold", "significant")


def significance_table(pairs: DataFrame, members: DataFrame, q: float = 0.05) -> DataFrame:
    """Compared subgroups with sizes, centroids and their distance, p, statistic and decision.

    pairs: condition, s1, s2, pval, ddist. members: condition, subgroup, phi, psi.
    """
    centres = members.groupBy("condition", "subgroup").agg(F.count("*").alias("n"), angles.circ_mean("phi").alias("phi"), angles.circ_mean("psi").alias("psi"))
    side = lambda k: centres.select("condition", F.col("subgroup").alias(f"s{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "phi", "psi")])
    both = pairs.join(side(1), ["condition", "s1"]).join(side(2), ["condition", "s2"])
    both = both.withColumn("d12", angles.torus_distance("phi1", "psi1", "phi2", "psi2"))
    done = bh(both, "pval", q, ["condition"])
    group = Window.partitionBy("condition")
    return done.withColumns({"n_tests": F.count("*").over(group), "n_rejected": F.count_if("significant").over(group)})


def combine_results(tables: dict[str, DataFrame], threshold: float) -> DataFrame:
    """Result tables of several datasets below one p threshold, with the dataset's name."""
    out = None
    for name, t in tables.items():
        t = t.where(F.col("pval") <= threshold).withColumn("dataset", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def split_names(df: DataFrame, column: str, k: int) -> DataFrame:
    """Tuple names split into column.1, column.2, ..."""
    parts = F.split(F.col(column), "_")
    return df.select("*", *[F.get(parts, F.lit(i)).alias(f"{column}.{i + 1}") for i in range(k)])


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose whole name fits the pattern."""
    return df.where(F.col(column).rlike(f"^(?:{pattern})$"))


def result_set(a: DataFrame, b: DataFrame, key: list[str], how: str) -> DataFrame:
    """Rows of two result sets with the columns of ``a``: ``union`` (of ``b`` those whose key ``a`` lacks), ``intersection``
    (of ``a`` those whose key ``b`` has) or ``subtraction`` (of ``a`` those whose key ``b`` lacks). Keys are null-safe."""
    side = lambda df: df.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    if how == "union":
        return a.unionByName(b.join(side(a), same, "left_anti").select(*a.columns))
    return a.join(side(b), same, {"intersection": "left_semi", "subtraction": "left_anti"}[how])
