"""Structure metadata: nested records flattened, cross references, predicates, selection and rejection of structures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPARE = {
    "greater": lambda c, v: c > v,
    "less": lambda c, v: c < v,
    "greater_or_equal": lambda c, v: c >= v,
    "less_or_equal": lambda c, v: c <= v,
    "equals": lambda c, v: c == v,
    "exact_match": lambda c, v: c == v,
    "in": lambda c, v: c.isin(list(v)),
    "exists": lambda c, v: c.isNotNull(),
    "contains_phrase": lambda c, v: F.lower(c).contains(v.lower()),
    "contains_words": lambda c, v: reduce(Column.__or__, [F.array_contains(F.split(F.lower(c), r"\W+"), w) for w in v.lower().split()]),
}


def where(column: str, operator: str, value=None, negate: bool = False) -> Column:
    """An attribute's predicate; a missing attribute fits none, negated or not."""
    test = COMPARE[operator](F.col(column), value)
    return ~test if negate else test


def all_of(*predicates: Column) -> Column:
    return reduce(Column.__and__, predicates)


def any_of(*predicates: Column) -> Column:
    return reduce(Column.__or__, predicates)


def expression_system(name: str) -> Column:
    return where("src_org", "equals", name)


def resolution_at_most(x: float) -> Column:
    return where("resolution", "less_or_equal", x)


def r_free_at_most(x: float) -> Column:
    return where("r_free", "less_or_equal", x)


def chains_at_most(n: int) -> Column:
    return where("n_chains", "less_or_equal", n)


def taxonomy(tax_id: int) -> Column:
    return where("tax_id", "equals", tax_id)


def deposited(first: str, last: str) -> Column:
    return F.col("deposition_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def full_text(df: DataFrame, phrase: str) -> DataFrame:
    """Rows any of whose text columns holds the phrase."""
    text = [c for c, t in df.dtypes if t == "string"]
    return df.where(F.lower(F.concat_ws("\x1f", *text)).contains(phrase.lower()))


def search(df: DataFrame, predicate: Column, key: str | list[str]) -> DataFrame:
    """Distinct keys (entry, entity or chain) of the rows that fit."""
    return df.where(predicate).select(*([key] if isinstance(key, str) else key)).distinct()


def chains_to_collect(meta: DataFrame, level: str = "chain", single_per_entity: bool = False) -> DataFrame:
    """Chains with exactly one protein id: all (level chain), or the first of each entity or of each entry.

    single_per_entity: of level chain, too, the first of each entity.

    meta: entry_id, entity_id, chain_id, unp_ids (array).
    """
    df = meta.where(F.size("unp_ids") == 1).withColumn("unp_id", F.col("unp_ids")[0]).drop("unp_ids")
    if level not in ("chain", "entity", "entry"):
        raise ValueError(level)
    by = ["entry_id"] if level == "entry" else ["entry_id", "entity_id"] if single_per_entity or level == "entity" else None
    if by:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("entity_id", "chain_id"))).where("_r = 1").drop("_r")
    return df


def first_structures(df: DataFrame, n: int, key: str = "struct_id") -> DataFrame:
    """The rows of the first n structures by id."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def single_protein(ids: Column, strict: bool = True) -> Column:
    """The protein id of a chain: strict: null if it has several; else the first."""
    return F.when(F.size(ids) == 1, ids[0]) if strict else F.get(ids, F.lit(0))


def rejection_report(df: DataFrame, filters: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows with rejected_by (the last filter that rejects), and counts per filter, of distinct rejected rows and of all.

    filters: name and what is kept, in order; a missing value is rejected.
    """
    bad = [(n, ~F.coalesce(keep, F.lit(False))) for n, keep in filters]
    by = reduce(lambda w, x: w.when(x[1], x[0]), reversed(bad), F)
    tagged = df.withColumn("rejected_by", by)
    row = df.agg(*[F.count_if(b).alias(n) for n, b in bad], F.count_if(any_of(*[b for _, b in bad])).alias("rejected"), F.count("*").alias("total"))
    names = [*[n for n, _ in bad], "rejected", "total"]
    counts = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
    return tagged, counts


def pick_reference(structs: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Per protein the structure of the best resolution among those whose length is near the protein's, with the size and
    median resolution of all its structures; largest groups first."""
    ratio = F.col("seq_len") / F.col("unp_len")
    best = F.min(F.when(ratio.between(low, high) & F.col("resolution").isNotNull(), F.struct("resolution", "struct_id")))
    g = structs.groupBy("unp_id").agg(best.alias("best"), F.count("*").alias("group_size"), F.median("resolution").alias("group_median"))
    g = g.where("best IS NOT NULL").select("unp_id", F.col("best.struct_id").alias("ref_id"), F.col("best.resolution").alias("ref_resolution"), "group_size", "group_median")
    return g.orderBy(F.desc("group_size"), "group_median", "unp_id")


def with_resolution(residues: DataFrame, structs: DataFrame, key: str = "struct_id") -> DataFrame:
    """Residues with their structure's resolution; Spark broadcasts the metadata if it is small."""
    return residues.join(structs.select(key, "resolution"), key)


def flatten_structures(raw: DataFrame) -> DataFrame:
    """One row per chain of nested entry records.

    raw: entry_id, title, refine (array of resolution, r_free), em_resolution, date, entities (array of entity_id,
    src_gen, src_nat, host (organism names), chains (array of chain_id, auth_id, regions (array of unp_id, beg, len))).
    """
    e = raw.select("entry_id", "title", F.coalesce(F.get("refine", F.lit(0))["resolution"], F.col("em_resolution")).alias("resolution"), F.get("refine", F.lit(0))["r_free"].alias("r_free"), F.to_date(F.substring("date", 1, 10)).alias("deposition_date"), F.explode("entities").alias("e"))
    e = e.select("*", F.coalesce("e.src_gen", "e.src_nat", "e.host").alias("src_org"), F.col("e.entity_id").alias("entity_id"), F.explode("e.chains").alias("c"))
    return e.select("entry_id", "title", "resolution", "r_free", "deposition_date", "entity_id", "src_org", F.col("c.chain_id").alias("chain_id"), F.col("c.auth_id").alias("auth_id"), F.array_distinct(F.transform("c.regions", lambda r: r["unp_id"])).alias("unp_ids"))


def chain_uniprot_map(raw: DataFrame) -> DataFrame:
    """Aligned regions (first and last position) of each chain and protein, under both of the chain's ids."""
    c = raw.select("entry_id", F.explode("entities").alias("e")).select("entry_id", F.explode("e.chains").alias("c"))
    c = c.select("entry_id", F.array_distinct(F.array("c.chain_id", "c.auth_id")).alias("ids"), F.explode("c.regions").alias("r"))
    c = c.select("entry_id", F.explode("ids").alias("chain_id"), F.col("r.unp_id").alias("unp_id"), F.col("r.beg").alias("beg"), (F.col("r.beg") + F.col("r.len") - 1).alias("end")).where("chain_id IS NOT NULL")
    return c.groupBy("entry_id", "chain_id", "unp_id").agg(F.array_sort(F.collect_set(F.struct("beg", "end"))).alias("regions"))


def ena_xrefs(refs: DataFrame, molecule: str = "mrna") -> DataFrame:
    """unp_id, ena_id of EMBL lines (unp_id, db, ids (array), molecule): ids longer than three characters."""
    df = refs.where((F.col("db") == "EMBL") & F.lower("molecule").contains(molecule.lower()))
    return df.select("unp_id", F.explode("ids").alias("ena_id")).where(F.length("ena_id") > 3).distinct()


def pdb_xrefs(refs: DataFrame) -> DataFrame:
    """unp_id, pdb_id, chain, length, resolution of X-ray PDB lines, chains as in ``L/H=10-22, L=40-90``.

    A chain's length is the sum of end - start over its ranges (one short for each, as published tables have it).
    """
    x = refs.where((F.col("db") == "PDB") & F.upper("method").contains("X-RAY"))
    x = x.select("unp_id", "pdb_id", "resolution", F.explode(F.split("chains", r",\s*")).alias("part"))
    ends = F.regexp_extract("part", r"=(\d+)-(\d+)", 2).cast("int") - F.regexp_extract("part", r"=(\d+)-(\d+)", 1).cast("int")
    x = x.where(F.col("part").rlike(r"=\d+-\d+")).select("unp_id", "pdb_id", "resolution", F.explode(F.split(F.split_part("part", F.lit("="), F.lit(1)), "/")).alias("chain"), ends.alias("n"))
    return x.groupBy("unp_id", "pdb_id", "resolution", "chain").agg(F.sum("n").alias("length"))
