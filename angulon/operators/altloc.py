"""Alternate locations, torsions and B-factors from atom rows (struct_id, pos, atom, altloc, xyz, b)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles


def _distance(a: Column, b: Column) -> Column:
    d = angles.minus(a, b)
    return F.sqrt(angles.dot(d, d))


def ca_distances(atoms: DataFrame) -> DataFrame:
    """Distances between the C-alpha places of each two alternate locations a < b of a residue, raw and over the root of
    the product of their location deviations."""
    ca = atoms.where("atom = 'CA' AND altloc IS NOT NULL").select("struct_id", "pos", "altloc", "xyz", angles.location_sigma("b").alias("s"))
    other = ca.toDF("struct_id", "pos", "altloc2", "xyz2", "s2")
    both = ca.join(other, ["struct_id", "pos"]).where("altloc < altloc2").withColumn("dist", _distance(F.col("xyz"), F.col("xyz2")))
    return both.select("struct_id", "pos", F.concat("altloc", "altloc2").alias("pair"), "dist", (F.col("dist") / F.nullif(F.sqrt(F.col("s") * F.col("s2")), F.lit(0.0))).alias("dist_norm"))


def peptide_bonds(atoms: DataFrame) -> DataFrame:
    """Lengths of the bonds C(i)-N(i+1) for every combination of their alternate locations (~ where there is none)."""
    pick = lambda name, tag, shift: atoms.where(F.col("atom") == name).select("struct_id", (F.col("pos") + shift).alias("pos"), F.coalesce("altloc", F.lit("~")).alias(f"alt_{tag}"), F.col("xyz").alias(tag))
    both = pick("C", "c", 0).join(pick("N", "n", -1), ["struct_id", "pos"])
    return both.select("struct_id", "pos", F.concat("alt_c", "alt_n").alias("pair"), _distance(F.col("c"), F.col("n")).alias("length"))


def relabel(atoms: DataFrame) -> DataFrame:
    """Alternate locations renamed A, B, C... within a residue in the order of first appearance (row order: serial)."""
    key = ["struct_id", "pos"]
    first = F.min("serial").over(Window.partitionBy(*key, "altloc"))
    df = atoms.withColumn("_first", F.when(F.col("altloc").isNotNull(), first))
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("_first").asc_nulls_last()))
    return df.withColumn("altloc", F.when(F.col("_first").isNotNull(), F.chr(rank + 64))).drop("_first")


def backbone_map(atoms: DataFrame, names=("N", "CA", "C", "O")) -> DataFrame:
    """Per residue a map from atom name (with the alternate location, if any) to its place."""
    df = atoms.where(F.col("atom").isin(*names))
    name = F.concat_ws("_", "atom", "altloc")
    return df.groupBy("struct_id", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("name"), "xyz")))).alias("backbone"))


def torsions(atoms: DataFrame) -> DataFrame:
    """phi, psi and omega (degrees) per residue of single-location chains: phi from C(i-1), psi from N(i+1), omega from
    CA(i-1); null without that neighbour."""
    place = lambda a: F.max(F.when(F.col("atom") == a, F.col("xyz")))
    res = atoms.where("altloc IS NULL").groupBy("struct_id", "pos").agg(place("N").alias("n"), place("CA").alias("ca"), place("C").alias("c"))
    order = Window.partitionBy("struct_id").orderBy("pos")
    before, after = F.lag("pos").over(order) == F.col("pos") - 1, F.lead("pos").over(order) == F.col("pos") + 1
    res = res.withColumns({"c0": F.when(before, F.lag("c").over(order)), "ca0": F.when(before, F.lag("ca").over(order)), "n1": F.when(after, F.lead("n").over(order))})
    t = lambda *p: F.degrees(angles.dihedral(*map(F.col, p)))
    return res.select("struct_id", "pos", t("c0", "n", "ca", "c").alias("phi"), t("n", "ca", "c", "n1").alias("psi"), t("ca0", "c0", "n", "ca").alias("omega"))


def residue_bfactor(atoms: DataFrame) -> DataFrame:
    """Mean B over N, CA and C, and the deviation of location that it stands for."""
    b = atoms.where(F.col("atom").isin("N", "CA", "C")).groupBy("struct_id", "pos").agg(F.avg("b").alias("bfactor"))
    return b.withColumn("sigma", F.when(F.col("bfactor") >= 0, F.sqrt(F.col("bfactor") / (8 * pi * pi))))
