"""Retrieval for a table of questions: what a single question does, keyed by question_id.

The number of jobs follows from the lists and hops, not from the questions. Rights are those
of each question's own tokens, applied to rows before they are counted or scored. Steps that
several later ones read are written once by `settle`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.operators import acl as A

Settle = Callable[[DataFrame], DataFrame]
#: A name of an entity has so many words at most.
NAME_WORDS = 4


def best(rows: DataFrame, limit: int, score: str = "score", then: str = "chunk_id") -> DataFrame:
    """The first `limit` rows of each question, with their rank; Spark pushes the limit below the shuffle."""
    order = Window.partitionBy("question_id").orderBy(F.desc(score), then)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def seeds(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question_id, place, entity_id): entities named in questions(question_id, question), in order, each once.

    Every run of up to four words is looked up by one join with aliases(alias, entity_id); of
    the names found in a question the longest at each place is taken from left to right, which
    one expression does over the question's own few finds.
    """
    words = F.transform(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9&.@\-]+"), F.lit(0)), lambda t: F.btrim(t, F.lit(".")))
    tokens = questions.select("question_id", words.alias("w"))
    at = tokens.select("question_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).filter(F.size("w") > 0)
    run = lambda n: F.when(F.col("i") + n - 1 <= F.size("w"), F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", F.col("i"), n), " ").alias("alias")))
    runs = at.select("question_id", "i", F.explode(F.array_compact(F.array(*[run(n) for n in range(1, NAME_WORDS + 1)]))).alias("r")).select("question_id", "i", "r.n", "r.alias")
    longest = runs.join(aliases, "alias").groupBy("question_id", "i").agg(F.max(F.struct("n", "entity_id")).alias("m"))
    named = longest.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("i", "m.n", "m.entity_id"))).alias("found"))

    def take(state: Column, x: Column) -> Column:
        free = x["i"] >= state["next"]
        out = F.when(free, F.concat(state["out"], F.array(x["entity_id"]))).otherwise(state["out"])
        return F.struct(F.when(free, x["i"] + x["n"]).otherwise(state["next"]).alias("next"), out.alias("out"))

    start = F.struct(F.lit(0).alias("next"), F.slice(F.transform("found", lambda x: x["entity_id"]), 1, 0).alias("out"))
    chosen = F.aggregate("found", start, take, lambda s: F.array_distinct(s["out"]))
    return named.select("question_id", F.posexplode(chosen).alias("place", "entity_id"))


def expand(
    start: DataFrame,
    adjacent: DataFrame,
    mentions: DataFrame,
    weights: DataFrame,
    owners: DataFrame,
    questions: DataFrame,
    access: DataFrame,
    hops: int = 2,
    width: int = fixed.GRAPH_FRONTIER,
    limit: int = 50,
    settle: Settle = lambda rows: rows,
) -> DataFrame:
    """(question_id, chunk_id, score, rank) around start(question_id, node), as `graph.expand` for each question.

    Frontier, visited nodes and the limit on new ones are kept for each question as tables.
    adjacent(a, b, chunk_id) is the stored adjacency, owners(chunk_id, email_id) the mail of a
    chunk. Only edges at a frontier are read and held against the rights of its question.
    """
    allowed = lambda rows: A.allowed(rows.join(owners, "chunk_id"), questions, access).drop("email_id")
    known = settle(start.select("question_id", "node").distinct().withColumn("w", F.lit(1.0)))
    frontier, lent = known, None
    for hop in range(1, hops + 1):
        at = frontier.select("question_id", F.col("node").alias("a"))
        touched = settle(allowed(adjacent.join(at, "a").select("question_id", "b", "chunk_id")))
        part = touched.select("question_id", "chunk_id", F.lit(0.5 / hop).alias("score"))
        lent = part if lent is None else lent.unionByName(part)
        new = touched.join(known.select("question_id", F.col("node").alias("b")), ["question_id", "b"], "left_anti")
        counts = new.groupBy("question_id", "b").agg(F.count("*").alias("n"))
        scored = counts.join(weights.withColumnRenamed("entity_id", "b"), "b", "left").select("question_id", "b", F.round(F.col("n") * F.coalesce("idf", F.lit(1.0)), 6).alias("s"))
        frontier = settle(best(scored, width, "s", "b").select("question_id", F.col("b").alias("node")))
        known = known.unionByName(frontier.withColumn("w", F.lit(1.0 / (1 + hop))))
    named = allowed(mentions.join(known.withColumnRenamed("node", "entity_id"), "entity_id")).join(weights, "entity_id", "left")
    own = named.select("question_id", "chunk_id", (F.col("w") * F.coalesce("idf", F.lit(1.0))).alias("score"))
    total = own.unionByName(lent).groupBy("question_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return best(total, limit)


def rerank(pool: DataFrame, scorer: Callable[[str], Callable[[pd.Series], pd.Series]], limit: int) -> DataFrame:
    """pool(question_id, question, text, ...) with the scorer's score in place of `score`, the best of each question."""
    kind = pool.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = pd.Series(0.0, index=batch.index)
            for question, part in batch.groupby("question"):
                score[part.index] = scorer(question)(part["text"])
            yield batch.assign(score=score)

    return best(pool.mapInPandas(run, kind), limit)
