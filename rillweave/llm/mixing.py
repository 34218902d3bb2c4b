"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each document gets a uniform number from a hash of seed and id; inverting the
Poisson distribution whose mean is its source's target repetition rate gives
its number of copies. The copies are then dealt out by a hash of seed, id and
copy number, which is a global shuffle that any run repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: Hex digits of the digest that make the uniform number: 48 bits, exact in a double.
_DIGITS = 12


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1), the same for the same seed and keys on any engine with SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return (F.conv(F.substring(F.sha2(text, 256), 1, _DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**_DIGITS))


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """mix_source, rate and cdf: P(X <= k) for k = 0, 1, ... as an array long enough that what lies beyond is under 1e-14. Sources without a rate have no row."""
    rate, k = F.col("rate"), F.col("k").cast("double")
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    upto = Window.partitionBy("mix_source", "rate").orderBy("k")
    each = rates.where(rate > 0).select("mix_source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    log_fact = F.sum(F.when(k > 0, F.log(k)).otherwise(F.lit(0.0))).over(upto)
    each = each.withColumn("p", F.exp(k * F.log(rate) - rate - log_fact)).withColumn("cdf", F.sum("p").over(upto))
    return each.groupBy("mix_source", "rate").agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, text_col: str, total_bytes: float | None, temperature: float) -> DataFrame:
    """One row per source: mix_source, rate and its Poisson cdf."""
    size = F.sum(F.octet_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).cast("double")
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("mix_source")).agg(size.alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source") == name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(F.lit(0.0)))
    sums = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    target = F.lit(float(total_bytes)) if total_bytes is not None else F.col("all_bytes")
    rate = F.when((F.col("bytes") > 0) & (F.col("all_weight") > 0), target * (F.col("weight") / F.col("all_weight")) / F.col("bytes")).otherwise(F.lit(0.0))
    # sums has one row: this is a scalar joined to the sources, not a pairing of rows.
    return poisson_cdf(sizes.join(F.broadcast(sums)).select("mix_source", rate.alias("rate")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_bytes: float | None = None, temperature: float = 0.5, seed: int = 17) -> DataFrame:
    """docs with each row repeated by its Poisson count, globally shuffled, plus copy_no (from 1), n_copies and shuffle_key.

    weights: target share of bytes for each source; sources not named get
    nothing. None weighs each source by its bytes to the power `temperature`
    (1 keeps the proportions, 0 makes sources equal). total_bytes: expected
    size of the result, that of the input when None. A source without bytes
    has no rate and gives no rows. Null is a source of its own under
    temperature weights; a null id is hashed as the empty string, and rows
    with the same id get the same count. The three added columns replace
    input columns of those names; other columns of the input may have any name.
    """
    # Written first, so that its size is known when the join is planned.
    rates = cut(source_rates(docs, weights, source_col, text_col, total_bytes, temperature), "rates")
    body = docs.drop("copy_no", "n_copies", "shuffle_key")
    mix_source, cdf = unused(docs, "mix_source"), unused(docs, "cdf")
    rates = rates.select(F.col("mix_source").alias(mix_source), F.col("cdf").alias(cdf))
    # Rates have a row per source; the optimizer broadcasts them only if their size allows, and splits a hot source otherwise.
    joined = body.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(mix_source)))
    chance = hash_uniform(seed, F.col(f"`{id_col}`"))
    counted = joined.withColumn("n_copies", F.size(F.filter(cdf, lambda p: p < chance))).where("n_copies > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}+"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col("copy_no").cast("string")), 256), 1, _DIGITS), 16, 10).cast("long")
    dealt = copies.withColumn("shuffle_key", key).select(*(F.col(f"`{c}`") for c in body.columns), "copy_no", "n_copies", "shuffle_key")
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
