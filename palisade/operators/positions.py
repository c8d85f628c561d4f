"""Phrases of any length by the positions of their words, from an index that is written once.

A phrase is looked for at its rarest word: where that stands, the phrase would begin so many
words before. The other words are then looked up by word and chunk, keys of which none has
many rows, and the phrase is there if each stands at its place. Texts are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import lexical


def positions(chunks: DataFrame, seg: int = 0) -> DataFrame:
    """(term, chunk_id, email_id, seg, at): the places of each word in each chunk, each part of the chunks sorted by word.

    Places are gathered inside their chunk's row; texts are all that is shuffled.
    """
    rows = lexical.dealt(chunks.select("chunk_id", "email_id", "text")).select("chunk_id", "email_id", F.inline(T.places(T.terms(F.col("text")))))
    return rows.select("term", "chunk_id", "email_id", F.lit(seg).cast("long").alias("seg"), "at").sortWithinPartitions("term", "chunk_id")


def phrases_in(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, chunk_id, email_id) of the chunks of positions(...) that have the words of phrases(key, terms) one after the other.

    Keys are distinct. A phrase without words is nowhere.
    """
    words = phrases.filter(F.size("terms") > 0).select("key", F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term"))
    sent = F.broadcast if words.limit(lexical.FEW_ASKED + 1).count() <= lexical.FEW_ASKED else lambda rows: rows
    # only words that are asked for are counted and joined
    mine = index.join(sent(words.select("term").distinct()), "term", "left_semi")
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("key").orderBy(F.coalesce("df", F.lit(0)), "i")
    counted = words.join(df, "term", "left").withColumn("nth", F.row_number().over(rarest))
    heads = counted.filter("nth = 1").select("key", "n", F.col("i").alias("head"), "term")
    starts = mine.join(sent(heads), "term").select("key", "n", "chunk_id", "email_id", F.explode(F.transform("at", lambda p: p - F.col("head"))).alias("start")).filter("start >= 0")
    where = ["key", "n", "chunk_id", "email_id"]

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        """Those of some(where..., start), a row for each word of `others` that stands at its place."""
        looked = some.join(sent(others.select("key", "i", "term")), "key")
        return looked.join(mine.select("term", "chunk_id", "at"), ["term", "chunk_id"]).filter(F.expr("array_contains(at, start + i)")).select(*where, "start")

    # few places have the two rarest words, so the others are looked up for those only
    pairs = met(starts.filter("n > 1"), counted.filter("nth = 2"))
    whole = met(pairs.filter("n > 2"), counted.filter("nth > 2")).groupBy(*where, "start").agg(F.count("*").alias("there")).filter("there = n - 2")
    found = [starts.filter("n = 1"), pairs.filter("n = 2"), whole]
    return reduce(DataFrame.union, [rows.select("key", "chunk_id", "email_id") for rows in found]).distinct()
