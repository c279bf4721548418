"""Mixing sources to target weights by Poisson replication, all in DataFrame operations.

A source's mean repetition rate is its target weight times the corpus mass over the source's mass (in
characters). A document's number of copies is the inverse of the Poisson distribution with that
mean at a uniform number from a hash of the seed and its id; it is exploded by this count, and all
copies are shuffled globally by another hash. So results don't depend on partitions or retries.

The distribution function is summed in log space, one term after another. Below a mean of LARGE it is a table of its source, of LARGE + REACH * sqrt(LARGE) + 25 numbers at most. From there on
each document sums it by itself, from REACH standard deviations below the mean on, where Stirling's series gives the first term; that takes less work
than its copies do.

Weights default to tempered shares mass**ALPHA. Given ones are a map from source to weight; sources that it lacks get
weight 0 and vanish. Weights are normalised over the sources that occur.

Defined results: null is a source of its own; a null text has no mass, so its source's rate follows the rest, and a source
without any mass is left out; equal rows draw equal counts; a null id draws as the text 'null'; texts of any length count whole and pass as they are; an empty table stays empty. Added columns: n_copies,
copy (from 1), rate, shuffle_key; columns of these names are replaced, all others pass, whatever their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ALPHA = 0.7
LARGE, REACH = 400, 12
#: Copies of a document that one array of the explosion holds.
BLOCK = 65536


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source_, mass, rate_, first_, log_first_, steps_, cdf_): the mean number of copies; the count at which the sum starts, the logarithm of its probability, and
    the number of terms that follow; the distribution function at 0, 1, 2, ... of means below LARGE."""
    mass = common.checkpoint(docs.groupBy(F.col(source_col).alias("source_")).agg(F.sum(F.length(text_col)).alias("mass")).where("mass > 0"))
    if weights is None:
        weight = F.pow(F.col("mass").cast("double"), F.lit(ALPHA))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source_").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    weighted = mass.withColumn("weight", weight)
    total = weighted.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = weighted.crossJoin(F.broadcast(total)).selectExpr("source_", "mass", "(weight / all_weight) * (all_mass / mass) AS rate_").where("rate_ > 0")
    start = rate.selectExpr("*", f"if(rate_ < {LARGE}, 0L, floor(rate_ - {REACH} * sqrt(rate_))) AS first_")
    factorial = "first_ * ln(first_) - first_ + 0.5D * ln(2 * pi() * first_) + 1 / (12D * first_) - 1 / (360D * pow(first_, 3)) + 1 / (1260D * pow(first_, 5))"
    summed = start.selectExpr(
        "*", f"if(first_ = 0, -rate_, first_ * ln(rate_) - rate_ - ({factorial})) AS log_first_", f"cast(ceil(rate_ - first_ + {REACH} * sqrt(rate_)) AS int) + 24 AS steps_"
    )
    table = """aggregate(sequence(1, steps_), array(struct(-rate_ AS log_p, exp(-rate_) AS total)), (done, k) -> concat(done, array(struct(
        element_at(done, -1).log_p + ln(rate_ / k) AS log_p, element_at(done, -1).total + exp(element_at(done, -1).log_p + ln(rate_ / k)) AS total)))).total"""
    return common.checkpoint(summed.withColumn("cdf_", F.expr(f"if(first_ = 0, {table}, null)")))


def inverse(u: str, rate: str = "rate_", first: str = "first_", log_first: str = "log_first_", steps: str = "steps_", cdf: str | None = None) -> str:
    """SQL: the smallest count whose distribution function, of the columns of rates(), exceeds u."""
    alone = f"""aggregate(sequence(0, {steps}), struct({log_first} AS log_p, 0D AS total, {first} AS n),
        (s, i) -> struct(s.log_p + ln({rate} / ({first} + i + 1)) AS log_p, s.total + exp(s.log_p) AS total, s.n + if(s.total + exp(s.log_p) <= {u}, 1L, 0L) AS n),
        s -> cast(s.n AS int))"""
    return alone if cdf is None else f"if({cdf} IS NULL, {alone}, size(filter({cdf}, x -> x <= {u})))"


def uniform(*parts) -> F.Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *(p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Every document once per copy, with n_copies, copy, rate and shuffle_key, in the global order of shuffle_key."""
    docs = docs.drop("n_copies", "copy", "rate", "shuffle_key")
    lookup = rates(docs, weights, source_col, text_col).select("source_", "rate_", "first_", "log_first_", "steps_", "cdf_")
    drawn, block, key, *fresh = common.free_names(docs, "u_", "block_", *lookup.columns)
    lookup = lookup.toDF(key, *fresh)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    joined = common.join_lookup(docs, lookup, docs[source_col].eqNullSafe(lookup[key]), F.xxhash64(docs[id_col], docs[text_col]), "inner")
    counted = joined.withColumn(drawn, uniform(seed, name)).withColumns({"n_copies": F.expr(inverse(drawn, *fresh)), "rate": F.col(fresh[0])})
    # in blocks, so that no array is longer than one, however large the count
    blocks = counted.where("n_copies > 0").withColumn(block, F.explode(F.expr(f"sequence(0, (n_copies - 1) div {BLOCK})")))
    copies = blocks.withColumn("copy", F.explode(F.expr(f"sequence(cast({block} * {BLOCK} + 1 AS int), cast(least(n_copies, ({block} + 1) * {BLOCK}) AS int))")))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("copy").cast("string"))))
    # the key is uniform, so equal ranges of its first 32 bits are equal shares: no sample of the copies is drawn to find ranges
    n = common.partitions(docs.sparkSession)
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / F.lit(float(1 << 32))).cast("int")
    return keyed.drop(key, drawn, block, *fresh).repartitionById(n, part).sortWithinPartitions("shuffle_key", id_col)
