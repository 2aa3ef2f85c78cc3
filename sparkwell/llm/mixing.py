"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share s of all tokens becomes the weight s**a / sum(s**a). The exponent a in [0, 1] is bisected to meet a
target: an entropy of the weights (nats), or a limit on how often the most repeated source is seen. Each bisection
job settles five binary digits of a at once on the table of source totals.

The weights are realised as budgeted block permutations. A source with quota q and t tokens is repeated q div t times
in full, and once more for the remaining q mod t tokens: its documents fall into blocks by hash (BLOCKS of them, or one
for each BLOCK_ROWS documents where that is more), the blocks are permuted by a hash of source, epoch and seed, whole blocks are taken until the budget cuts one, and inside that
one block documents are taken in hash order. So a source of any size needs a window over its blocks and one over about
BLOCK_ROWS of its documents, never over all of them. The decision is a few constants for each source; texts are
not shuffled.

Without a budget, it is the smallest one that repeats every source at least once: no document is lost.

Defined results: a null source is a source of its own; a null or blank text counts one token (its end); repeated rows
are drawn together, each counted; rows without a doc_id are told apart by their text; extra columns are kept, but those named epoch,
weight, n_tokens, block or block_key are replaced and names that begin with two underscores are reserved; an empty
table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, stored

BLOCKS = 1024
BLOCK_ROWS = 100_000
STEPS = 32
OWN = ("n_tokens", "epoch", "weight", "block", "block_key")


def token_count(text: str = "text") -> Column:
    """Words and one end."""
    return (F.coalesce(F.regexp_count(F.col(text), F.lit("\\S+")), F.lit(0)) + 1).cast("long")


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def bisect_exponent(totals: DataFrame, budget: int | None, entropy: float | None, most_repeats: float | None) -> tuple[float, float, int]:
    """(exponent, sum of share**exponent, budget) for totals (key, tokens).

    Entropy falls and, for sources below the largest, repetition falls as the exponent rises; so the smallest
    exponent in [0, 1] at which entropy <= target, or repeats <= limit, is found. 1 if none meets it.
    """
    t = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("top")).first()
    total, top = t["all"] or 0, t["top"] or 0
    if not total:
        return 1.0, 1.0, 0
    share = F.col("tokens") / F.lit(total)

    def measured(grid: list[float]) -> list[tuple[float, float, float]]:
        g = totals.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).withColumn("w", F.pow(share, F.col("a")))
        r = g.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log(share)).alias("l"), F.max(F.col("w") / F.col("tokens")).alias("m")).collect()
        out = []
        for x in sorted(r, key=lambda x: x["a"]):  # at most STEPS + 1 rows
            b = budget if budget is not None else top * x["z"] / (top / total) ** x["a"]
            out.append((x["a"], math.log(x["z"]) - x["a"] * x["l"] / x["z"], b * x["m"] / x["z"]))
        return out

    def meets(h: float, r: float) -> bool:
        return h <= entropy if entropy is not None else r <= most_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(6):
        grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        met = [a for a, h, r in measured(grid) if meets(h, r)]
        high = min(met, default=1.0)
        if high == low or not met:
            break
        low = max(x for x in grid if x < high)
    z = totals.agg(F.sum(F.pow(share, F.lit(high))).alias("z")).first()["z"]
    return high, z, budget if budget is not None else math.ceil(top * z / (top / total) ** high)


def mixture(spark: SparkSession, docs: DataFrame, budget: int | None = None, entropy: float | None = None, most_repeats: float | None = 2.0, seed: int = 0, source: str = "source", id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """The drawn rows: docs' columns with n_tokens, epoch, weight, block and block_key; and the settled parameters.

    Order by (epoch, block_key) to read the blocks as permuted.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.xxhash64(F.col(text)).cast("string")))
    slim = kept(docs.select(named.alias("id"), _key(source).alias("key"), token_count(text).alias("n")))
    totals = kept(slim.groupBy("key").agg(F.sum("n").alias("tokens"), F.greatest(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("long").alias("blocks")))
    a, z, budget = bisect_exponent(totals, budget, entropy, most_repeats)
    total = totals.agg(F.sum("tokens")).first()[0] or 1
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(a)) / F.lit(z)
    # the nudge keeps a quota that is a whole number of tokens from falling below it by rounding
    quota = F.floor(F.lit(float(budget)) * weight * F.lit(1 + 1e-9)).cast("long")
    sources = totals.count()
    plan = totals.select("key", "tokens", "blocks", weight.alias("weight"), quota.alias("quota"))
    plan = plan.select("key", "blocks", "weight", F.expr("quota div tokens").alias("full"), (F.col("quota") % F.col("tokens")).alias("rest"))
    plan = stored(plan, "plan", sources)

    def doc_key(epoch: Column, i: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, i)

    def block(epoch: Column, i: Column, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + 1), epoch, i), blocks).cast("int")

    def block_key(epoch: Column, b: Column, key: Column) -> Column:
        return F.xxhash64(F.lit(seed + 2), epoch, key, b)

    full = F.col("full")
    drawn = slim.join(plan, "key").where("rest > 0").withColumn("block", block(full, F.col("id"), F.col("blocks")))
    sums = drawn.groupBy("key", "full", "rest", "block").agg(F.sum("n").alias("n")).withColumn("bk", block_key(full, F.col("block"), F.col("key")))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("bk", "block"))
    # the block that the budget cuts: the first whose running sum passes the rest
    cutting = sums.withColumn("upto", upto).where("upto > rest and upto - n <= rest").select("key", F.col("bk").alias("cut"), "block", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    cutting = stored(cutting, "cutting", sources)
    inside = drawn.join(cutting, ["key", "block"]).withColumn("dk", doc_key(full, F.col("id")))
    ends = F.sum("n").over(Window.partitionBy("key").orderBy("dk").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", ends).where(F.col("upto") <= F.col("left")).groupBy("key").agg(F.max("dk").alias("last"))
    rules = plan.join(cutting.select("key", "cut"), "key", "left").join(last, "key", "left")
    rules = rules.select("weight", *(F.col(c).alias(f"__{c}") for c in ("key", "full", "rest", "cut", "last", "blocks")))
    rules = stored(rules, "rules", sources)
    slim.unpersist()
    totals.unpersist()

    keep = [c for c in docs.columns if c not in OWN]
    d = docs.select(*keep, token_count(text).alias("n_tokens"), _key(source).alias("__key"), named.alias("__id"))
    d = d.join(rules, "__key")
    full = F.col("__full")
    b = block(full, F.col("__id"), F.col("__blocks"))
    k = block_key(full, b, F.col("__key"))
    more = (F.col("__rest") > 0) & ((k < F.col("__cut")) | ((k == F.col("__cut")) & (doc_key(full, F.col("__id")) <= F.col("__last"))))
    copies = full + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    d = d.withColumn("__copies", copies).where("__copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    d = d.withColumn("block", block(F.col("epoch"), F.col("__id"), F.col("__blocks")))
    d = d.withColumn("block_key", block_key(F.col("epoch"), F.col("block"), F.col("__key")))
    return d.select(*keep, *OWN), {"exponent": a, "budget": budget}
