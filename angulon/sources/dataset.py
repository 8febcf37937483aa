"""Datasets on storage: residue files, structure metadata, FASTA; tables written and materialised."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RESIDUES = T.StructType(
    [T.StructField(n, t()) for n, t in (("unp_id", T.StringType), ("pdb_idx", T.IntegerType), ("unp_idx", T.IntegerType), ("res_name", T.StringType), ("res_icode", T.StringType), ("res_hflag", T.StringType), ("rel_loc", T.DoubleType), ("codon", T.StringType), ("codon_score", T.DoubleType), ("codon_opts", T.StringType), ("secondary", T.StringType), ("phi", T.DoubleType), ("psi", T.DoubleType), ("omega", T.DoubleType), ("bfactor", T.DoubleType))]
)


def id_of_file(name: Column) -> Column:
    """``1ABC:A`` for a file named ``1ABC_A-anything.csv``."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]+?)(?:-[^/]*)?\.[^./]+$", 1), "_", ":")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_residues(spark: SparkSession, path: str, schema: T.StructType = RESIDUES) -> DataFrame:
    """Residue files of a folder, with struct_id from the file's name and pos, the row's place in its file.

    All files have the schema's columns; files with others are read apart and joined by ``union_normalized``. Row order
    within a file is the order of the chain; a chain's file is small and lies in one read partition.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    df = nan_to_null(df.withColumns({"struct_id": id_of_file(F.col("_metadata.file_path")), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}))
    pos = F.row_number().over(Window.partitionBy("struct_id").orderBy("_block", "_at")) - 1
    return df.withColumn("pos", pos).drop("_block", "_at")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residues, structures and meta of a dataset folder."""
    structs = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/meta-structs_all.csv")
    return read_residues(spark, f"{path}/data-precs"), structs, spark.read.option("multiLine", True).json(f"{path}/meta.json")


def one_structure(residues: DataFrame, struct_id: str) -> DataFrame:
    return residues.where(F.col("struct_id") == struct_id)


def union_normalized(*dfs: DataFrame) -> DataFrame:
    """All rows; columns by the place where they are first met in any of the tables, missing ones null."""
    place: dict[str, tuple[int, int]] = {}
    for k, df in enumerate(dfs):
        for i, c in enumerate(df.columns):
            place.setdefault(c, (i, k))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return out.select(*sorted(place, key=place.__getitem__))


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, digits: int = 3, kind: str = "csv") -> None:
    """CSV with fixed decimals and empty text for missing values, or Parquet."""
    out = rounded(df, digits)
    if kind == "parquet":
        out.write.mode("overwrite").parquet(path)
        return
    text = [F.concat_ws(";", F.transform(c, lambda x: x.cast("string"))).alias(c) if t.startswith("array") else F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
    text = [F.when(F.col(c).isNotNull(), e).alias(c) for (c, _), e in zip(out.dtypes, text, strict=True)]
    out.select(*text).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def materialize(spark: SparkSession, folder: str, name: str, args: dict, make: Callable[[], DataFrame], ignore: tuple[str, ...] = ()) -> DataFrame:
    """The result of ``make``, stored under the name and a digest of its arguments, and read from there when it is there."""
    key = hashlib.sha256(json.dumps({k: v for k, v in args.items() if k not in ignore}, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description and sequence of the records of FASTA files; a record begins at a line that begins with ``>``."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    name = F.split_part(head, F.lit(" "), F.lit(1))
    ident = F.when(name.contains("|"), F.split_part(name, F.lit("|"), F.lit(2))).otherwise(name)
    seq = F.regexp_replace("value", r"^[^\n]*\n?", "")
    rest = F.regexp_replace(head, r"^\S+\s*", "")
    return rows.select(F.trim(ident).alias("id"), F.trim(rest).alias("description"), F.regexp_replace(seq, r"\s", "").alias("sequence"))


#: What a column of a wide table holds, by the first of these parts that its name has.
ROLES = (("phis", "array<double>"), ("psis", "array<double>"), ("contexts", "array<int>"), ("idxs", "array<int>"), ("res_ids", "array<string>"), ("codons", "array<string>"), ("phi", "double"), ("psi", "double"), ("norm", "double"))


def role(name: str) -> str:
    """The type of a column of a wide table by its name; text where no part says otherwise."""
    return next((kind for part, kind in ROLES if part in name), "string")


def typed_wide(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of text cast to the types; arrays are split on semicolons."""

    def cast(c: str) -> Column:
        kind = types[c]
        if not kind.startswith("array<"):
            return F.col(c).cast(kind).alias(c)
        return F.when(F.col(c) != "", F.transform(F.split(F.col(c), ";"), lambda x: F.nullif(x, F.lit("")).cast(kind[6:-1]))).alias(c)

    return df.select(*map(cast, df.columns))


def read_wide(spark: SparkSession, path: str, columns: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A wide CSV table, its columns typed by their names (``role``) or by ``types``, read once and only as far as wanted.

    The header alone is read to know the columns; a wanted or typed column that it lacks is an error. Missing values and
    empty lists are null.
    """
    names = spark.read.option("header", True).csv(path).columns
    wanted = columns if columns is not None else names
    unknown = [c for c in [*wanted, *(types or {})] if c not in names]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}; there are {', '.join(names)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    text = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path).select(*wanted)
    return typed_wide(text, {c: (types or {}).get(c) or role(c) for c in wanted})


def apply_per_structure(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's function of each structure's pandas frame."""
    return df.groupBy("struct_id").applyInPandas(fn, schema)
