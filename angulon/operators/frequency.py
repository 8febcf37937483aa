"""Densities over fixed bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def binned_density(df: DataFrame, column: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """by, bin (from 1), n, p and cdf of the values within [low, high]; the last bin holds the upper end."""
    at = F.least(F.floor((F.col(column) - low) * (bins / (high - low))) + 1, F.lit(bins)).cast("int")
    n = df.where(F.col(column).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    return n.select(*by, "bin", "n", (F.col("n") / total).alias("p"), (upto / total).alias("cdf"))
