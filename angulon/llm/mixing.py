"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p**a / sum(p**a). The exponent a, between 0 and 1, is found by
bisection: the largest whose weights have at least ``evenness`` times the entropy of equal weights, then raised, if
need be, to the least at which no source is repeated more than ``repeats`` times within the budget. Each job
evaluates the inner points of STEPS halvings at once; only sums over sources reach the driver.

A source's budget is its weight times ``budget`` tokens (default: all tokens). Whole passes over the source come
first; for the rest, the documents of the last pass are ordered by a hash that differs from pass to pass, whose leading
bits number the blocks of the permutation, and are taken as long as they fit: the cut is found block by block, by the
sums of the blocks' tokens, then within one block of one block, so that no source is ever ordered as a whole.

Tokens are runs of characters other than white space. Null sources are a source of their own; a source without tokens
has weight 0 and its documents, null or empty texts, are taken once. Rows with equal id and text share their hash and
are taken together, as often as each fits. Texts may be of any length; extra columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import scratch, stored

STEPS, ROUNDS, SMALL = 6, 5, 10_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: sum of p**a, and sum of p**a * ln p."""
    of = [x for a in exponents for x in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")))]
    row = shares.agg(*of).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]


def entropy(a: float, z: float, weighted: float) -> float:
    return math.log(z) - a * weighted / z


def solve_exponent(shares: DataFrame, evenness: float, repeats: float, budget_share: float) -> float:
    """shares: p, positive, of each source. budget_share: the budget as a multiple of all tokens."""
    n, least = shares.agg(F.count("*"), F.min("p")).first()
    if n < 2:
        return 1.0

    def bisect(holds) -> tuple[float, float]:
        """The last point where it holds from 0 on, and the next."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            inner = [lo + (hi - lo) * i / (1 << STEPS) for i in range((1 << STEPS) + 1)]
            true = [holds(a, *s) for a, s in zip(inner, _sums(shares, inner), strict=True)]
            last = max([i for i in range(len(inner)) if all(true[: i + 1])], default=-1)
            if last == len(inner) - 1:
                return hi, hi
            lo, hi = inner[max(last, 0)], inner[max(last, 0) + 1]
        return lo, hi

    even = bisect(lambda a, z, w: entropy(a, z, w) >= evenness * math.log(n) - 1e-12)[0]
    fits = bisect(lambda a, z, w: budget_share * least ** (a - 1) / z > repeats + 1e-9)
    one = budget_share / 1.0 > repeats + 1e-9  # even the plain shares repeat too often: nothing is closer to the limit
    first = _sums(shares, [0.0])[0]
    needed = 0.0 if budget_share * least**-1.0 / first[0] <= repeats + 1e-9 else 1.0 if one else fits[1]
    return max(even, needed)


def plan(docs: DataFrame, evenness: float = 0.95, repeats: float = 4.0, budget: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Per source its weight, budget, passes (whole) and cut (of the last pass); and the documents' keys they came from."""
    rows = stored(docs.select("source", "doc_id", F.xxhash64("text").alias("t"), token_count(F.col("text")).alias("n_tokens")), "mixing")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = stored(sources.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1)))), "sources")
    live = shares.where("p > 0")
    a = solve_exponent(live, evenness, repeats, budget / total) if total else 1.0
    z = live.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    shares = shares.withColumn("weight", F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(0.0)).withColumn("exponent", F.lit(a))
    shares = shares.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("bigint"))
    shares = shares.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int"))
    shares = stored(shares.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0)), "weights")
    keyed = joined(rows, shares.select("source", "passes", "rest")).withColumn("u", turn(F.col("passes") + 1, seed))
    cut = shares.select("source", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("from"))
    for bits in (50, 40):  # 1024 blocks, then 1024 within the one that holds the cut
        here = joined(keyed, cut.select("source", "left", "from")).where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("from") + F.lit(1 << (bits + 10))))
        blocks = here.groupBy("source", "left", F.shiftright("u", bits).alias("block")).agg(F.sum("n_tokens").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.col("left"))
        cut = blocks.groupBy("source").agg(F.max(F.struct("block", (F.col("left") - F.col("before")).alias("left"))).alias("x"))
        cut = stored(cut.select("source", F.col("x.left").alias("left"), F.shiftleft("x.block", bits).alias("from")), "cuts")
    here = joined(keyed, cut).where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("from") + F.lit(1 << 40)))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("u").rangeBetween(Window.unboundedPreceding, 0))
    first = here.withColumn("upto", upto).withColumn("bad", F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.when(F.col("bad"), F.col("u"))).alias("stop"), F.max("from").alias("from"))
    ends = first.select("source", F.coalesce("stop", F.col("from") + F.lit(1 << 40)).alias("cut"))
    null_safe = shares["source"].eqNullSafe(ends["source"])
    done = shares.join(ends, null_safe, "left").select(shares["*"], F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"))
    return stored(done, "plan"), rows


def turn(epoch: Column, seed: int, t: str = "t") -> Column:
    """A document's place in the permutation of a pass: 60 bits. t: the column of the text's hash."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), "source", "doc_id", t).bitwiseAND(F.lit((1 << 60) - 1))


def joined(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source; the sources' table is broadcast only if it is counted to be small."""
    table = by_source.withColumnRenamed("source", "_source")
    if table.limit(SMALL + 1).count() <= SMALL:
        table = F.broadcast(table)
    return rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def copies(passes: Column, cut: Column, seed: int, t: str = "t") -> Column:
    """How often a row (with columns source, doc_id and the text's hash) is taken."""
    return passes + F.when(turn(passes + 1, seed, t) < cut, 1).otherwise(0)


def realised(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """One row for each time a document is taken: doc_id, source, n_tokens, weight, epoch, block (of its epoch's permutation)."""
    table, rows = plan(docs, seed=seed, **how)
    rows = joined(rows, table.select("source", "weight", "passes", "cut"))
    rows = rows.withColumn("epoch", F.explode(F.when(copies(F.col("passes"), F.col("cut"), seed) > 0, F.sequence(F.lit(1), copies(F.col("passes"), F.col("cut"), seed)))))
    return rows.select("doc_id", "source", "n_tokens", "weight", "epoch", F.shiftright(turn(F.col("epoch"), seed), 50).cast("int").alias("block"))


def mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, more), each as often as its source's budget takes it."""
    table, _ = plan(docs.select("doc_id", "text", "source"), seed=seed, **how)
    names = docs.columns
    hashed, passes, cut, times, copy, source = scratch(names, "hashed", "passes", "cut", "times", "copy", "source_of")
    table = table.select(F.col("source").alias(source), F.col("passes").alias(passes), F.col("cut").alias(cut))
    if table.limit(SMALL + 1).count() <= SMALL:
        table = F.broadcast(table)
    rows = docs.withColumn(hashed, F.xxhash64("text")).join(table, F.col("source").eqNullSafe(F.col(source)))
    rows = rows.withColumn(times, copies(F.col(passes), F.col(cut), seed, hashed)).where(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
