"""Rank fusion, candidate pools and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed


def ranked(rows: DataFrame, name: str, score_col: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, list, rank) of one result list; lists are short, bounded by their limit."""
    w = Window.orderBy(F.desc(score_col), id_col)
    return rows.select(F.col(id_col).alias("chunk_id"), F.lit(name).alias("list"), F.row_number().over(w).alias("rank"))


def rrf(lists: dict[str, DataFrame], digits: int = 9, by: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(*by, score, sources) by reciprocal rank fusion; sources maps a list's name to the rank.

    Parts are added in the order of the names given, so that sums are the same everywhere.
    """
    every = None
    for name, rows in lists.items():
        part = rows.select(*by, F.lit(name).alias("list"), "rank")
        every = part if every is None else every.unionByName(part)
    ranks = every.groupBy(*by).agg(*[F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"r_{name}") for name in lists])
    total, entries = F.lit(0.0), []
    for name in lists:
        r = F.col(f"r_{name}")
        total = total + F.when(r.isNotNull(), F.lit(fixed.RRF_WEIGHTS.get(name, 1.0)) / (fixed.RRF_K + r)).otherwise(0.0)
        entries.append(F.when(r.isNotNull(), F.struct(F.lit(name).alias("k"), r.cast("double").alias("v"))))
    sources = F.map_from_entries(F.array_compact(F.array(*entries)))
    return ranks.select(*by, F.round(total, digits).alias("score"), sources.alias("sources"))


def pool_size(top_k: int, reranked: bool) -> int:
    return max(3 * top_k, 20) if reranked else top_k


def candidates(fused: DataFrame, top_k: int, reranked: bool) -> DataFrame:
    size = pool_size(top_k, reranked)
    return fused.orderBy(F.desc("score"), "chunk_id").limit(size)


def overlap_scorer(question: str) -> Callable[[pd.Series], pd.Series]:
    """A lexical stand-in for a cross-encoder: shared words over the root of the text's words."""
    asked = set(question.lower().split())

    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(asked & set(t.lower().split())) / (1 + len(t.split())) ** 0.5)

    return score


def rerank(pool: DataFrame, scorer: Callable[[pd.Series], pd.Series], top_k: int, text_col: str = "text") -> DataFrame:
    """Replace the score by the scorer's, best first."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield scorer(batch)

    return pool.withColumn("score", run(F.col(text_col))).orderBy(F.desc("score"), "chunk_id").limit(top_k)
