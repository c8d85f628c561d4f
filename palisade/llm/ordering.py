"""Places and running totals in a total order, without one task that sees all rows.

Rows are dealt into ranges of the order, sorted inside each and written. What lies before a
range comes from one row for each range, or for each group in a range, so no window spans
the table. Equal rows, however many, are dealt over several ranges by the task they come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import settled

_PART_BITS = 33  # of monotonically_increasing_id: below are the rows of a partition


def _ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    dealt = rows.withColumn("__task", F.spark_partition_id())
    by = [F.col(c).asc_nulls_first() for c in (*order, "__task")]
    kept = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("__task")
    at = F.monotonically_increasing_id()
    return settled(kept.withColumn("__at", at)).withColumn("__part", F.shiftright("__at", _PART_BITS))


def _before(value: Column, within: Sequence[str]) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, name: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Adds the place (from 0) of each row in `order`, nulls first, in its group of `within`; and `<name>_of`, the size of the group.

    A group may hold any share of the rows: its ranges are counted apart.
    """
    ranged = _ranged(rows, [*within, *order])
    runs = ranged.groupBy("__part", *within).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = runs.withColumn("__before", _before(F.col("__n"), within)).withColumn("__of", F.sum("__n").over(Window.partitionBy(*within)))
    keys = {c: f"__{c}" for c in ("__part", *within)}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]  # null is a group
    found = ranged.join(before.withColumnsRenamed(keys), same)
    place = (F.col("__at") - F.col("__from") + F.col("__before")).cast("long")
    return found.select(*rows.columns, place.alias(name), F.col("__of").cast("long").alias(f"{name}_of"))


def running_total(rows: DataFrame, name: str, value: str, order: Sequence[str]) -> DataFrame:
    """Adds the sum of `value` over all rows that come before in `order`."""
    ranged = _ranged(rows, order)
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = sums.select("__part", _before(F.col("__sum"), ()).alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as ranges, whatever the table holds
    found = ranged.withColumn("__inside", inside).join(F.broadcast(before), "__part")
    return found.select(*rows.columns, (F.col("__inside") + F.col("__before")).alias(name))
