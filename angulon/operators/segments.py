"""Runs, unmodelled segments, their contexts, and windows along chains. Chains are (struct_id, pos) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STANDARD = [*"ACDEFGHIKLMNPQRSTVWY"]


def _along():
    """Each chain by position."""
    return Window.partitionBy("struct_id").orderBy("pos")


def _whole():
    return Window.partitionBy("struct_id")


def _run_number(value: Column) -> Column:
    """Number of the run of equal values a row is in; needs a second window over the flag, hence two steps."""
    return F.when(value.eqNullSafe(F.lag(value).over(_along())), 0).otherwise(1)


def runs(df: DataFrame, column: str) -> DataFrame:
    """struct_id, start, value and length of the runs of equal values by position."""
    df = df.withColumn("_f", _run_number(F.col(column))).withColumn("_run", F.sum("_f").over(_along()))
    return df.groupBy("struct_id", "_run").agg(F.min("pos").alias("start"), F.first(column).alias("value"), F.count("*").alias("length")).drop("_run")


def run_length_hist(df: DataFrame, column: str, value) -> DataFrame:
    """How many runs of ``value`` have each length; length 0 counts the rows outside of such runs."""
    own = runs(df, column).where(F.col("value").eqNullSafe(F.lit(value))).groupBy("length").agg(F.count("*").alias("n"))
    rest = df.agg(F.count_if(~F.col(column).eqNullSafe(F.lit(value))).alias("n")).select(F.lit(0).cast("bigint").alias("length"), "n")
    return rest.union(own)


def zero_runs(df: DataFrame, column: str = "contact_count", min_len: int = 2) -> DataFrame:
    """Stretches of zeros with their sequence, first position and the chain's length."""
    df = df.withColumn("_z", F.col(column) == 0).withColumn("_n", F.count("*").over(_whole()))
    df = df.withColumn("_f", _run_number(F.col("_z"))).withColumn("_run", F.sum("_f").over(_along())).where("_z")
    g = df.groupBy("struct_id", "_run").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "res_name"))), lambda x: x["res_name"]), "").alias("seq"), F.max("_n").alias("chain_length"))
    return g.where(F.col("length") >= min_len).drop("_run")


def segments(df: DataFrame) -> DataFrame:
    """Maximal runs of unmodelled residues (res_icode set): number, start, length, sequence and type.

    nterm begins at the chain's first residue that is no ligand, else cterm ends at the last such, else inter.
    """
    real = F.when(F.col("res_hflag").isNull(), F.col("pos"))
    df = df.withColumns({"_first": F.min(real).over(_whole()), "_last": F.max(real).over(_whole()), "_u": F.col("res_icode").isNotNull()})
    df = df.withColumn("_f", _run_number(F.col("_u"))).withColumn("_run", F.sum("_f").over(_along())).where("_u")
    g = df.groupBy("struct_id", "_run").agg(
        F.min("pos").alias("seg_start"),
        F.count("*").cast("int").alias("seg_len"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "res_name"))), lambda x: x["res_name"]), "").alias("seg_seq"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    kind = F.when(F.col("seg_start") == F.col("_first"), "nterm").when(F.col("seg_start") + F.col("seg_len") - 1 == F.col("_last"), "cterm").otherwise("inter")
    number = F.row_number().over(Window.partitionBy("struct_id").orderBy("seg_start")) - 1
    return g.select("struct_id", number.alias("seg_idx"), "seg_start", "seg_len", "seg_seq", kind.alias("seg_type"))


def segment_context(df: DataFrame, segs: DataFrame, length: int, column: str) -> DataFrame:
    """Per segment the values at -length..-1 before it (m1, m2, ...) and +1..+length after it (p1, ...); null off the ends."""
    off = F.explode(F.sequence(F.lit(1), F.lit(length)))
    want = segs.select("struct_id", "seg_idx", "seg_start", "seg_len", off.alias("k"))
    want = want.select("struct_id", "seg_idx", F.explode(F.array(F.struct((-F.col("k")).alias("off"), (F.col("seg_start") - F.col("k")).alias("pos")), F.struct(F.col("k").alias("off"), (F.col("seg_start") + F.col("seg_len") - 1 + F.col("k")).alias("pos")))).alias("x"))
    want = want.select("struct_id", "seg_idx", "x.*")
    got = want.join(df.select("struct_id", "pos", F.col(column).alias("v")), ["struct_id", "pos"], "left")
    name = lambda k: f"m{-k}" if k < 0 else f"p{k}"
    offs = [*range(-length, 0), *range(1, length + 1)]
    return got.groupBy("struct_id", "seg_idx").agg(*[F.max(F.when(F.col("off") == k, F.col("v"))).alias(name(k)) for k in offs])


def bfactor_ratios(df: DataFrame, length: int) -> DataFrame:
    """b[i]/b[i+1] and b[i]/b[i-1] with missing values as the chain's maximum, and ctx: the forward ratio within
    ``length`` before a segment, the backward one within it after one, the lesser where both, null inside."""
    df = df.withColumn("_b", F.coalesce("bfactor", F.max("bfactor").over(_whole())))
    df = df.withColumns({"fwd": F.col("_b") / F.nullif(F.lead("_b").over(_along()), F.lit(0.0)), "bwd": F.col("_b") / F.nullif(F.lag("_b").over(_along()), F.lit(0.0))})
    inside = F.col("res_icode").isNotNull()
    seen = F.when(inside, F.col("pos"))
    df = df.withColumn("_before", F.last(seen, ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_after", F.first(seen, ignorenulls=True).over(_along().rowsBetween(0, Window.unboundedFollowing)))
    to_next, from_last = F.col("_after") - F.col("pos") <= length, F.col("pos") - F.col("_before") <= length
    ctx = F.when(inside, F.lit(None)).when(to_next & from_last, F.least("fwd", "bwd")).when(to_next, F.col("fwd")).when(from_last, F.col("bwd"))
    return df.select("struct_id", "pos", "fwd", "bwd", ctx.alias("ctx"))


def ecdf(df: DataFrame, column: str, by: list[str], out: str = "ecdf") -> DataFrame:
    """Adds the share of the group's non-null values that are no greater; null for null. Nulls form a partition of their own."""
    there = F.col(column).isNotNull()
    return df.withColumn(out, F.when(there, F.cume_dist().over(Window.partitionBy(*by, there).orderBy(column))))


def ecdf_at(samples: DataFrame, queries: DataFrame, column: str, by: list[str], out: str = "ecdf") -> DataFrame:
    """The samples' ECDF at other values: both kinds are merged in order, and the samples so far counted."""
    both = samples.where(F.col(column).isNotNull()).select(*by, column, F.lit(1).alias("_s")).unionByName(queries.select(*by, column, F.lit(0).alias("_s")))
    upto = F.sum("_s").over(Window.partitionBy(*by).orderBy(F.col(column)).rangeBetween(Window.unboundedPreceding, 0))
    every = F.sum("_s").over(Window.partitionBy(*by))
    return both.withColumn(out, F.when(F.col(column).isNotNull(), upto / F.nullif(every, F.lit(0)))).where("_s = 0").drop("_s")


def sequence_gaps(df: DataFrame) -> DataFrame:
    """Runs of unknown residues (X), and the chain's first and last positions."""
    ends = df.groupBy("struct_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return runs(df, "res_name").where("value = 'X'").drop("value").join(ends, "struct_id")


def unmodelled_counts(df: DataFrame) -> DataFrame:
    """Per chain: unmodelled residues before the first modelled one, between, and after the last."""
    made, gone = F.col("res_icode").isNull(), F.col("res_icode").isNotNull()
    first, last = F.min(F.when(made, F.col("pos"))).over(_whole()), F.max(F.when(made, F.col("pos"))).over(_whole())
    df = df.withColumns({"_first": first, "_last": last})
    return df.groupBy("struct_id").agg(
        F.count_if(gone & (F.col("pos") < F.col("_first"))).alias("n_nterm"),
        F.count_if(gone & (F.col("pos") > F.col("_first")) & (F.col("pos") < F.col("_last"))).alias("n_inter"),
        F.count_if(gone & (F.col("pos") > F.col("_last"))).alias("n_cterm"),
    )


def altloc_counts(df: DataFrame, column: str = "num_altlocs") -> DataFrame:
    """Per chain the positions with more than one location, and all locations beyond the first."""
    n = F.coalesce(column, F.lit(0))
    return df.groupBy("struct_id").agg(F.count_if(n > 1).alias("n_altloc_positions"), F.sum(F.greatest(n - 1, F.lit(0))).cast("bigint").alias("n_altlocs"))


def relative_location(df: DataFrame) -> DataFrame:
    """Adds rel_loc: a residue's place in its chain, from 1/n to 1."""
    return df.withColumn("rel_loc", F.row_number().over(_along()) / F.count("*").over(_whole()))


def canonical_fill(canonical: DataFrame, modelled: DataFrame) -> DataFrame:
    """Canonical positions (struct_id, pos, res_name) with the residues modelled there (seq_idx). Unmodelled ones take the
    sequence index before them (a leading run: the first one less 1) and a counter within their run as res_icode."""
    df = canonical.join(modelled.select("struct_id", "pos", F.col("seq_idx").alias("_s")), ["struct_id", "pos"], "left")
    df = df.withColumn("_run", F.sum(F.when(F.col("_s").isNotNull(), 1).otherwise(0)).over(_along()))
    before = F.last("_s", ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("_s").over(_whole()) - 1
    count = F.row_number().over(Window.partitionBy("struct_id", "_run").orderBy("pos")) - F.when(F.col("_run") > 0, 2).otherwise(1)
    return df.select("struct_id", "pos", "res_name", F.coalesce(before, first).alias("seq_idx"), F.when(F.col("_s").isNull(), F.format_string("U_%04d", count)).alias("res_icode"))


def aa_counts(df: DataFrame, standard: list[str] = STANDARD) -> DataFrame:
    """Counts of single residues and of pairs adjacent after non-standard ones are dropped."""
    df = df.where(F.col("res_name").isin(standard)).withColumn("_n", F.lead("res_name").over(_along()))
    both = df.select(F.explode(F.array_compact(F.array("res_name", F.when(F.col("_n").isNotNull(), F.concat("res_name", "_n"))))).alias("aa"))
    return both.groupBy("aa").agg(F.count("*").alias("n"))


def frequencies(counts: DataFrame) -> DataFrame:
    """Shares among the singles and among the pairs."""
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(F.length("aa"))))


def propensity_single(df: DataFrame, segs: DataFrame) -> DataFrame:
    """Per residue: count and share within segments, share overall, and their ratio."""
    inside = segs.select(F.explode(F.split("seg_seq", "")).alias("aa")).where("aa <> ''").groupBy("aa").agg(F.count("*").alias("seg_n"))
    inside = inside.withColumn("seg_freq", F.col("seg_n") / F.sum("seg_n").over(Window.partitionBy(F.lit(1))))
    base = frequencies(aa_counts(df)).where(F.length("aa") == 1)
    return base.join(inside, "aa").select("aa", "n", "freq", "seg_n", "seg_freq", (F.col("seg_freq") / F.col("freq")).alias("propensity"))


def propensity_pairs(df: DataFrame, segs: DataFrame, offsets=(0, 1), alphabet: list[str] = STANDARD) -> DataFrame:
    """Per pair of residues, side (pre, post) and offset: count, share, ratio to the share of all adjacent pairs.

    pre: the residues at -offset-2, -offset-1 before a segment; post: at +offset+1, +offset+2 after. Pairs of the whole
    alphabet are listed, with 0 where none was seen.
    """
    ctx = segment_context(df, segs, max(offsets) + 2, "res_name")
    parts = [F.struct(F.lit(o).alias("off"), F.lit(side).alias("side"), F.concat(a, b).alias("aa")) for o in offsets for side, a, b in (("pre", f"m{o + 2}", f"m{o + 1}"), ("post", f"p{o + 1}", f"p{o + 2}"))]
    seen = ctx.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("aa IS NOT NULL").groupBy("off", "side", "aa").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    letters = spark.createDataFrame([(a,) for a in alphabet], "a string")
    grid = letters.crossJoin(letters.withColumnRenamed("a", "b")).select(F.concat("a", "b").alias("aa"))
    keys = spark.createDataFrame([(o, s) for o in offsets for s in ("pre", "post")], "off int, side string")
    base = frequencies(aa_counts(df, alphabet)).where(F.length("aa") == 2).select("aa", F.col("freq").alias("base"))
    grid = keys.crossJoin(grid).join(base, "aa", "left").join(seen, ["off", "side", "aa"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    share = F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("off", "side")), F.lit(0))
    return grid.select("off", "side", "aa", "n", share.alias("freq"), (share / F.col("base")).alias("propensity"))


def _window_residue(df: DataFrame, standard: list[str]) -> Column:
    """Whether a residue may be in a window of contacts."""
    good = F.col("res_name").isin(standard) & F.col("res_hflag").isNull() & F.col("res_icode").isNull()
    for c in ("contact_ooc", "contact_non_aa"):
        good = good & (F.coalesce(c, F.lit(0)) == 0) if c in df.columns else good
    return good


def contact_windows(df: DataFrame, context: int = 2, smax: float | None = None, standard: list[str] = STANDARD) -> DataFrame:
    """Windows of 2 central residues and ``context`` on each side that are consecutive, standard, no ligands and without
    gaps; smax bounds the central residues' contact_smax (no contacts: 0).

    Where the table has them: no residue has contacts out of its chain (contact_ooc) or with what is no amino acid
    (contact_non_aa), and the central codons are unambiguous (codon_score 1).
    """
    w = 2 * context + 2
    span = _along().rowsBetween(0, w - 1)
    good = _window_residue(df, standard)
    centre = _along().rowsBetween(context, context + 1)
    if "codon_score" in df.columns:
        df = df.withColumn("_score", F.min(F.coalesce("codon_score", F.lit(0.0))).over(centre))
    df = df.withColumns({"_n": F.count("*").over(span), "_ok": F.min(good).over(span), "_span": F.max("pos").over(span) - F.col("pos"), "smax": F.coalesce(F.max(F.coalesce("contact_smax", F.lit(0))).over(centre), F.lit(0))})
    df = df.withColumn("seq", F.array_join(F.collect_list("res_name").over(span), ""))
    df = df.where((F.col("_n") == w) & F.col("_ok") & (F.col("_span") == w - 1))
    if "_score" in df.columns:
        df = df.where("_score = 1")
    if smax is not None:
        df = df.where(F.col("smax") <= smax)
    return df.select("struct_id", F.col("pos").alias("start"), "seq", "smax")


def contact_window_sweep(df: DataFrame, contexts: list[int], bounds: list[float], standard: list[str] = STANDARD) -> DataFrame:
    """Number of ``contact_windows`` for each context and bound, in one pass for any number of them.

    The good residues fall into runs of consecutive positions. A pair of central residues has every context up to the
    lesser of what its run holds on either side; pairs are counted by that context and by bound, and the counts, at most
    one row for each context, are summed up over the contexts they allow.
    """
    cells = df.where(_window_residue(df, standard)).withColumn("_run", F.col("pos") - F.row_number().over(_along()))
    run = Window.partitionBy("struct_id", "_run")
    next_one = run.orderBy("pos")
    smax = F.coalesce("contact_smax", F.lit(0))
    cells = cells.withColumns({"_first": F.min("pos").over(run), "_last": F.max("pos").over(run), "_smax": F.greatest(smax, F.lead(smax).over(next_one))})
    if "codon_score" in df.columns:
        score = F.coalesce("codon_score", F.lit(0.0))
        cells = cells.withColumn("_score", F.least(score, F.lead(score).over(next_one)))
    pairs = cells.where(F.col("pos") < F.col("_last"))
    pairs = pairs.where("_score = 1") if "codon_score" in df.columns else pairs
    most = F.least(F.col("pos") - F.col("_first"), F.col("_last") - F.col("pos") - 1, F.lit(max(contexts)))
    counts = pairs.groupBy(most.alias("most")).agg(*[F.count_if(F.col("_smax") <= b).alias(f"b{k}") for k, b in enumerate(bounds)])
    allowed = F.filter(F.array(*map(F.lit, contexts)), lambda c: c <= F.col("most"))
    counts = counts.select(F.explode(allowed).alias("context"), *[f"b{k}" for k in range(len(bounds))]).groupBy("context").agg(*[F.sum(f"b{k}").alias(f"b{k}") for k in range(len(bounds))])
    each = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]))
    return counts.select("context", each.alias("x")).select("context", "x.*")


def neighbourhood_filter(df: DataFrame, margin: int, columns: list[str]) -> DataFrame:
    """Rows whose neighbours up to margin on both sides are there, contiguous (pos) and complete in the columns."""
    span = _along().rowsBetween(-margin, margin)
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    df = df.withColumns({"_n": F.count("*").over(span), "_w": F.min(whole).over(span), "_d": F.max("pos").over(span) - F.min("pos").over(span)})
    return df.where((F.col("_n") == 2 * margin + 1) & F.col("_w") & (F.col("_d") == 2 * margin)).drop("_n", "_w", "_d")


def same_ss_pairs(df: DataFrame) -> DataFrame:
    """Adds pair_ss: the structure class that a residue and the one before share, else null."""
    return df.withColumn("pair_ss", F.when(F.lag("secondary").over(_along()) == F.col("secondary"), F.col("secondary")))


def his_tags(segs: DataFrame, tag: str = "HHHHHH") -> DataFrame:
    """Terminal segments that hold a tag, of six histidines unless another is given."""
    return segs.where(F.col("seg_seq").contains(tag) & (F.col("seg_type") != "inter"))


def labelled_filters(segs: DataFrame) -> DataFrame:
    """Count and share kept of the filters any, any>1, inter and inter>1."""
    inter, more = F.col("seg_type") == "inter", F.col("seg_len") > 1
    labels = F.array_compact(F.array(F.lit("any"), F.when(more, "any>1"), F.when(inter, "inter"), F.when(inter & more, "inter>1")))
    every = F.max("n").over(Window.partitionBy(F.lit(1)))
    return segs.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("dropped_percent", 100.0 * (1 - F.col("n") / every))


def short_structures(segs: DataFrame, structs: DataFrame, most: int = 400, lengths: tuple[int, int] = (5, 15)) -> DataFrame:
    """Segments of a length in range within short structures, with the structure's columns, ordered."""
    one = structs.dropDuplicates(["struct_id"])
    df = segs.join(one, "struct_id", "left").where((F.col("seq_len") < most) & F.col("seg_len").between(*lengths))
    return df.orderBy("seq_len", "struct_id", "seg_idx")
