"""Values at exact ranks in many groups, by histograms that are refined.

Equal values are counted first, so ties and hot values are one row each. A pass cuts what is
left of each wanted rank's range into BUCKETS of equal width and keeps the one that the rank
falls into, with its true least and greatest value; once at most FEW distinct values are left
they are ranked. Nothing is sorted as a whole, and a group's values are spread over tasks by a
salt, however many rows the group has. A pass narrows a range by BUCKETS times, so a handful
do for values of like size; ranges of many orders of magnitude take more.

Nulls have no rank. NaN comes last, as Spark orders it; a null group is a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.tables import settled

BUCKETS = 1024
FEW = 4096
SALTS = 16
_MOST = 1.7976931348623157e308


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """Least and greatest value have a bucket of their own, so every pass leaves something out."""
    a, b = (F.greatest(F.least(x.cast("double"), F.lit(_MOST)), F.lit(-_MOST)) for x in (lo, hi))
    place = F.floor(F.try_divide(v.cast("double") / 2 - a / 2, b / 2 - a / 2) * BUCKETS)
    inner = F.greatest(F.lit(1), F.least(F.lit(BUCKETS - 2), F.coalesce(place, F.lit(1))))
    return F.when(v == lo, 0).when(v == hi, BUCKETS - 1).otherwise(inner).cast("int")


def at_ranks(rows: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, n, rank, value): the values at `ranks`, which make a place from 0 of a group's number n of values."""
    by, groups = list(by), [f"__g{k}" for k in range(len(by))]
    named = rows.filter(F.col(column).isNotNull()).select(*[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], F.col(column).alias("v"))
    values = settled(named.groupBy(*groups, "v").agg(F.count("*").alias("c")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))))
    sizes = values.groupBy(*groups).agg(F.sum("c").alias("n"), F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("rank")) for name, place in ranks.items()]))
    kept = [*groups, "name", "n", "rank"]
    wanted = settled(sizes.select(*groups, "n", "held", "lo", "hi", F.lit(0).cast("long").alias("before"), each.alias("r")).select(*kept[:-3], "r.name", "n", "r.rank", "held", "lo", "hi", "before"))

    def inside(some: DataFrame) -> DataFrame:
        dealt = some.select(*[F.col(g).alias(f"{g}_") for g in groups], *kept[-3:], "lo", "hi", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt_"))
        same = F.col("salt") == F.col("salt_")
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
        return values.join(dealt, same & F.col("v").between(F.col("lo"), F.col("hi")))

    done = None
    while True:
        few = wanted.filter(F.col("held") <= FEW)
        done = few if done is None else done.unionByName(few)
        wide = wanted.filter(F.col("held") > FEW)
        if wide.isEmpty():
            break
        cut = inside(wide).groupBy(*kept, "before", _bucket(F.col("v"), F.col("lo"), F.col("hi")).alias("b"))
        counts = cut.agg(F.sum("c").alias("c"), F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        wanted = settled(_holding(counts, [*groups, "name"], "b").select(*kept, "held", "lo", "hi", "before"))
    found = _holding(inside(done), [*groups, "name"], "v")
    return found.select(*[F.col(g).alias(b) for b, g in zip(by, groups, strict=True)], "name", "n", "rank", F.col("v").alias("value"))


def _holding(counts: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows that the ranks fall into; `before` is then what lies before them. Each key has at most FEW or BUCKETS rows."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    return placed.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, value): interpolated percentiles, from the two values around each place."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in shares.items():
        ranks[f"{name}<"] = lambda n, p=p: F.floor((n - 1) * p)
        ranks[f"{name}>"] = lambda n, p=p: F.ceil((n - 1) * p)
    found = at_ranks(rows, column, ranks, by)
    name = F.expr("substring(name, 1, length(name) - 1)")
    share = F.coalesce(*[F.when(name == k, F.lit(float(p))) for k, p in shares.items()])
    side = lambda s: F.max(F.when(F.col("name").endswith(s), F.struct("value", "rank")))
    both = found.groupBy(*by, name.alias("of")).agg(side("<").alias("a"), side(">").alias("b"), F.max((F.col("n") - 1) * share).alias("at"))
    between = (F.col("b.rank") - F.col("at")) * F.col("a.value") + (F.col("at") - F.col("a.rank")) * F.col("b.value")
    return both.select(*by, F.col("of").alias("name"), F.when(F.col("a.value") == F.col("b.value"), F.col("a.value").cast("double")).otherwise(between).alias("value"))
