"""Mixing sources to target weights by Poisson replication.

The size of a source is the number of characters of all its texts. A source whose share
should be w gets the mean repetition rate w * total / size. Each document draws its number
of copies from the Poisson distribution with that mean, by inverting the cumulative
distribution at a uniform number hashed from seed and id; so the draw is the same on every
run and machine, and needs no state. A mean above PART is split into equal parts below it,
whose draws add up (a sum of Poisson variables is one), so no term underflows. Each
document is exploded by its count, and the copies are dealt by a hash of seed, id and copy
number and sorted by it: a global shuffle in which a hot source spreads evenly. The task that
a row comes from has a part in where it goes, so rows that share an id, or have none, are
spread too.

Without given weights a source's weight is its size to the power TEMPERATURE. Given weights
are scaled to sum to one over the sources that occur; a source that is not named gets none.

Null sources form one source. A null text counts no characters. Rows with the same id draw
the same count. A source of size zero has rate one, as its rows cannot change any share.
Extra columns are kept; the three added columns get the names given to `replicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let, settled

SEED = 17
TEMPERATURE = 0.5
PART = 8.0
#: With a mean of at most PART the chance of more is below 2**-90.
TERMS = 64
#: Rates of so many sources are sent to all executors; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, weight, rate) of each source, from all documents."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0)).cast("long").alias("size"))
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(float(temperature)))).otherwise(0.0)
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
        raw = F.when(F.col("size") > 0, raw).otherwise(0.0)
    sizes = settled(sizes.withColumn("raw", raw))
    whole = sizes.agg(F.sum("size").alias("size"), F.sum("raw").alias("raw")).first()
    weight = F.col("raw") / F.lit(whole["raw"]) if whole["raw"] else F.lit(0.0)
    rate = F.when(F.col("size") > 0, weight * F.lit(whole["size"]) / F.col("size")).otherwise(1.0)
    return sizes.select("source", "size", weight.alias("weight"), rate.alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k below TERMS."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["all"]


def _draw(doc_id: Column, parts: Column, curve: Column, seed: int) -> Column:
    def one(j: Column) -> Column:
        return let(uniform(F.lit(seed), doc_id, j), lambda u: F.size(F.filter(curve, lambda c: c <= u)))

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, j: acc + one(j))


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = SEED,
    temperature: float = TEMPERATURE,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    copy_col: str = "copy",
    key_col: str = "shuffle_key",
) -> DataFrame:
    """The rows of `docs` as often as drawn, globally shuffled, with copy number (from 1) and key.

    Rows come in the order of the key inside each partition, and the partition is a hash
    of the key and of the task a row comes from, so files read one after the other are in
    random order.
    """
    if {copy_col, key_col} & set(docs.columns):
        raise ValueError(f"the input already has a column {copy_col} or {key_col}; choose other names")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))
    table = settled(rates(docs, weights, temperature, source_col, text_col))
    curves = table.filter("rate > 0").select(F.col("source").alias("__source"), parts.alias("__parts"), "rate").select("__source", "__parts", _cumulative(F.col("rate") / F.col("__parts")).alias("__curve"))
    if table.count() <= BROADCAST_SOURCES:
        curves = F.broadcast(curves)
    drawn = docs.join(curves, docs[source_col].eqNullSafe(curves["__source"]))
    count = _draw(F.col(id_col), F.col("__parts"), F.col("__curve"), seed)
    counted = drawn.withColumn("__n", count).filter("__n > 0")
    copies = counted.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__n"))).alias(copy_col))
    digest = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy_col)))
    keyed = copies.withColumn(key_col, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    return keyed.withColumn("__from", F.spark_partition_id()).repartition(key_col, "__from").drop("__from").sortWithinPartitions(key_col)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`replicate` without the added columns."""
    copy, key = "__copy", "__shuffle_key"
    return replicate(docs, copy_col=copy, key_col=key, **options).select(*docs.columns)
