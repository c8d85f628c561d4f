"""Counting dominating rows by divide and conquer on slot ranks.

A row is above another if its slot is smaller or equal and its level strictly larger. Rows
are first summed into cells of one slot and one level, so copies and hot cells are combined
before anything is shuffled. The slots in use are ranked; the ranks are the leaves of a
binary tree. Each recursion level is one shuffle of the cells by node of that tree: both
halves of a node are merged in the order of levels, and each cell of the right half gains
the suffix sum of the left half over strictly larger levels. A last shuffle by leaf adds
those of the same slot. Every pair of ranks is parted at just one node, so gains add up to
the exact counts.

A node near the root has most cells. So that it isn't one task, levels are cut once for all
into at most CHUNKS chunks of about equal numbers of cells; a task merges one chunk of a
node, and what the chunks above hold of the node's left half comes from their totals, at most CHUNKS
small rows for a node. Neither the driver nor a broadcast gets anything that
grows with the input: joins with ranks, chunks and totals are merge joins.

Counts return to the rows by a join on the cell. Cells with more than one in HOT_CELLS of all
rows, at most HOT_CELLS of them, are broadcast for that; other rows are shuffled to their
cells, and rows that have no cell or found a hot one are dealt evenly.

Defined results: a row with a null slot or level is above none, and its counts are null; a
total that is not a number has no level, and one beyond the range of a long has the nearest;
a null sale_id stands for one row. Repeated rows count each for itself. An empty table gives
an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from palisade.llm.common import release, settled
from palisade.llm.ordering import placed, running_total

#: Tasks that share the merge of one node; half of them, 64, are in work at once on 64 cores.
CHUNKS = 128
HOT_CELLS = 1000
#: Recursion levels between two tables that cut the lineage.
CUT_EVERY = 4

_WHOLE = float(2**53)


def slot_of(when: Column, zoned: bool = False) -> Column:
    """Whole hours since 1970. A time without a zone is taken as UTC, whatever the session's zone."""
    if zoned:
        return F.floor(F.unix_seconds(when) / 3600).cast("long")
    return (F.unix_date(F.to_date(when)).cast("long") * 24 + F.hour(when)).cast("long")


def level_of(total: Column) -> Column:
    cents = 100 * total + F.lit(0.5)
    # beyond 2**53 every double is whole already
    whole = F.when(F.abs(cents) < _WHOLE, F.floor(cents).cast("double")).otherwise(cents)
    return F.when(~F.isnan(total), F.floor(whole / 100).cast("long"))


def points(sales: DataFrame, id_col: str = "sale_id", time_col: str = "sold_at", total_col: str = "total") -> DataFrame:
    """(sale_id, slot, level, weight) of every sale."""
    zoned = isinstance(sales.schema[time_col].dataType, TimestampType)
    text = F.col(id_col).cast("long").cast("string").cast("binary")
    weight = F.coalesce(1 + F.crc32(text) % 2, F.lit(1)).cast("long")
    return sales.select(F.col(id_col).alias("sale_id"), slot_of(F.col(time_col), zoned).alias("slot"), level_of(F.col(total_col)).alias("level"), weight.alias("weight"))


def _chunks(cells: DataFrame, chunks: int) -> DataFrame:
    """(level, chunk): chunks of neighbouring levels with about as many cells each."""
    sizes = cells.groupBy("level").agg(F.count("*").alias("cells"))
    mass = running_total(sizes, "before", "cells", ["level"])
    n = cells.count()
    return mass.select("level", F.floor(F.col("before") * chunks / max(n, 1)).cast("int").alias("chunk"))


def _gains(state: DataFrame, base: DataFrame, node: Column, gives: Column, takes: Column) -> DataFrame:
    """One recursion level: what each taking cell gains from the giving cells of its node with larger levels."""
    given = lambda c: F.when(gives, F.col(c)).otherwise(F.lit(0))
    totals = base.groupBy(node.alias("node"), "chunk").agg(F.sum(given("n")).alias("n"), F.sum(given("w")).alias("w"))
    above = Window.partitionBy("node").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("node", "chunk", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in ("n", "w")])
    # larger levels first; those as large as the row's own are left out
    larger = Window.partitionBy("node", "chunk").orderBy(F.col("down")).rangeBetween(Window.unboundedPreceding, -1)
    merged = state.withColumn("node", node).withColumn("down", -F.col("level"))
    merged = merged.select("*", *[F.coalesce(F.sum(given(c)).over(larger), F.lit(0)).alias(f"here_{c}") for c in ("n", "w")])
    joined = merged.join(carried.hint("merge"), ["node", "chunk"])
    gained = [(F.col(f"gain_{c}") + F.when(takes, F.col(f"here_{c}") + F.col(f"above_{c}")).otherwise(F.lit(0))).alias(f"gain_{c}") for c in ("n", "w")]
    return joined.select("rank", "slot", "level", "chunk", "n", "w", *gained)


def count_cells(cells: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """(slot, level, n, gain_n, gain_w) of cells (slot, level, n, w), one row for each pair of slot and level."""
    spark = cells.sparkSession
    ranks = placed(cells.select("slot").distinct(), "rank", ["slot"]).select("slot", "rank")
    ranked = cells.join(ranks.hint("merge"), "slot").join(_chunks(cells, chunks).hint("merge"), "level")
    base = settled(ranked.select("rank", "slot", "level", "chunk", "n", "w"))
    last = base.agg(F.max("rank")).first()[0]
    state = base.withColumn("gain_n", F.lit(0).cast("long")).withColumn("gain_w", F.lit(0).cast("long"))
    everyone = F.lit(True)
    state = _gains(state, base, F.col("rank"), everyone, everyone)
    for k in range(int(last or 0).bit_length()):
        right = F.shiftright("rank", k) % 2 == 1
        state = _gains(state, base, F.shiftright("rank", k + 1), ~right, right)
        if k % CUT_EVERY == CUT_EVERY - 1:
            state = settled(state)
            release(spark)
    return settled(state.select("slot", "level", "n", "gain_n", "gain_w"))


def count_above(sales: DataFrame, id_col: str = "sale_id", time_col: str = "sold_at", total_col: str = "total", chunks: int = CHUNKS) -> DataFrame:
    """(sale_id, slot, level, n_sales, n_rows): how many sales are above each, and how many rows those stand for."""
    rows = points(sales, id_col, time_col, total_col)
    whole = rows.filter("slot is not null and level is not null")
    cells = settled(whole.groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("weight").alias("w")))
    counted = count_cells(cells, chunks)

    n_all = counted.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_CELLS > n_all
    named = counted.select("slot", "level", "n", F.col("gain_n").alias("n_sales"), F.col("gain_w").alias("n_rows"))
    hot = named.filter(is_hot).select("slot", "level", F.col("n_sales").alias("hot_sales"), F.col("n_rows").alias("hot_rows"))
    rest = named.filter(~is_hot).select("slot", "level", F.lit(0).cast("long").alias("apart"), "n_sales", "n_rows")
    found = rows.select("sale_id", "slot", "level").join(F.broadcast(hot), ["slot", "level"], "left")
    done = F.col("slot").isNull() | F.col("level").isNull() | F.col("hot_sales").isNotNull()
    found = found.withColumn("apart", F.when(done, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    out = found.join(rest.hint("merge"), ["slot", "level", "apart"], "left")
    return out.select("sale_id", "slot", "level", F.coalesce("hot_sales", "n_sales").alias("n_sales"), F.coalesce("hot_rows", "n_rows").alias("n_rows"))
