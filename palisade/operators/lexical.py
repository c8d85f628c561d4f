"""BM25 over an inverted index, with statistics of the whole corpus and an access filter below the sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import text as T
from palisade.operators.acl import WILDCARD


#: Words that one task of an index build sorts.
TASK_WORDS = 2_000_000


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, email_id, term, tf, dl): the index. Words are counted inside their chunk's row, so nothing is shuffled."""
    words = chunks.select("chunk_id", "email_id", T.terms(F.col("text")).alias("w"))
    return words.select("chunk_id", "email_id", F.size("w").alias("dl"), F.inline(T.tallies(F.col("w")))).select("chunk_id", "email_id", "dl", "term", F.col("tf").cast("long").alias("tf"))


def idf(n_chunks: Column, df: Column) -> Column:
    raw = F.ln((n_chunks - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, fixed.BM25_LEAST_IDF).otherwise(raw)


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    k, b = fixed.BM25_K1, fixed.BM25_B
    return tf * (k + 1) / (tf + k * (1 - b + b * dl / avgdl))


def dealt(chunks: DataFrame, total: int | None = None) -> DataFrame:
    """Chunks dealt by id into parts of about TASK_WORDS words; texts are all that an index build shuffles.

    total: how many words there are; without it they are counted in a pass of its own.
    """
    if total is None:
        total = chunks.agg(F.sum(F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")))).first()[0]
    return chunks.repartition(max(1, -(-(total or 0) // TASK_WORDS)), "chunk_id")


def sorted_postings(chunks: DataFrame, total: int | None = None) -> DataFrame:
    """`postings` of each part of the corpus sorted by term, so a reader of a few terms touches few row groups of each."""
    return postings(dealt(chunks, total)).sortWithinPartitions("term", "chunk_id")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row (n, avgdl): how many chunks there are, and their mean length in words."""
    return chunks.select(F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def total_words(stats: DataFrame) -> int:
    """Words of all chunks, of `statistics`."""
    row = stats.first()
    return round((row["n"] or 0) * (row["avgdl"] or 0))


def search(chunks: DataFrame, readable: DataFrame | None, terms: list[str], limit: int = 50, digits: int = 6) -> DataFrame:
    """(chunk_id, score) of the best chunks for a few terms, without an index.

    Statistics cover all chunks, whoever asks; rows that may not be read are left out before
    anything is scored. One pass counts words and finds the chunks that have a term; they are
    bounded by nothing but the terms, so they are dealt with as `search_index` deals with
    the postings of an index, in one more pass over the chunks that have one.
    """
    wanted = "|".join(sorted(set(terms)))
    if not wanted:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    lower = F.lower("text")
    hits = F.regexp_extract_all(lower, F.lit(rf"(?<![a-z0-9])(?:{wanted})(?![a-z0-9])"), F.lit(0))
    some = chunks.filter(lower.rlike(wanted)).select("chunk_id", "email_id", F.regexp_count(lower, F.lit("[a-z0-9]+")).alias("dl"), F.explode(hits).alias("term"))
    index = some.groupBy("chunk_id", "email_id", "dl", "term").agg(F.count("*").alias("tf"))
    return search_index(index, statistics(chunks), readable, terms, limit, digits)


def search_index(index: DataFrame, stats: DataFrame, readable: DataFrame | None, terms: list[str], limit: int = 50, digits: int = 6) -> DataFrame:
    """(chunk_id, score) of the best chunks for a few terms, from stored postings.

    The filter on terms reaches the scan. How many chunks have a term is counted before the
    access join, which lies below the scores; the counts are one row for each term.
    """
    mine = index.filter(F.col("term").isin(*sorted(set(terms))))
    row = stats.first()
    df = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.count("*").alias("df")).collect()}  # as many rows as terms
    if not df:
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    weights = F.create_map(*[x for t, n in sorted(df.items()) for x in (F.lit(t), idf(F.lit(float(row["n"])), F.lit(float(n))))])
    if readable is not None:
        mine = mine.join(readable, "chunk_id", "left_semi")
    part = weights[F.col("term")] * weight(F.col("tf").cast("double"), F.col("dl"), F.lit(row["avgdl"]))
    # summed in the order of terms, whatever order rows come in
    parts = F.transform(F.array_sort(F.collect_list(F.struct("term", part.alias("s")))), lambda x: x["s"])
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return mine.groupBy("chunk_id").agg(F.round(total, digits).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


#: Rows (question, term) up to which questions travel to the postings, and not postings to the questions.
FEW_ASKED = 500_000


def asking(questions: DataFrame, df: DataFrame, weight_of: Callable[[Column], Column]) -> DataFrame:
    """(question_id, asker, term, idf) of questions(question_id, tokens, terms) and df(term, df); askers with like tokens are one."""
    each = questions.select("question_id", F.array_sort("tokens").alias("asker"), F.explode("terms").alias("term"))
    return each.join(df, "term").select("question_id", "asker", "term", weight_of(F.col("df")).alias("idf"))


def score_many(hits: DataFrame, asked: DataFrame, access: DataFrame | None, weight_of: Callable[[Column, Column], Column], limit: int) -> DataFrame:
    """(question_id, chunk_id, score, rank): the best `limit` of hits(term, chunk_id, email_id, tf, dl) for each question of `asking`.

    Hits are shuffled once, by mail, and meet the rights there; only then do they meet the
    questions, and each mail's chunks are scored and ranked where they are. What is shuffled
    besides is each task's best. The wildcard reads everything.
    """
    seen = asked.select("asker").distinct().withColumn("all", F.array_contains("asker", WILDCARD) | F.lit(access is None))
    few = asked.limit(FEW_ASKED + 1).count() <= FEW_ASKED
    sent = F.broadcast if few else lambda rows: rows
    by_mail = hits.repartition("email_id")
    parts = []
    if access is not None:
        rights = seen.filter(~F.col("all")).select("asker", F.explode("asker").alias("principal")).join(access, "principal").select("email_id", "asker").distinct()
        parts.append(by_mail.join(rights, "email_id").join(sent(asked), ["term", "asker"]))
    if access is None or not seen.filter("all").isEmpty():
        every = asked.join(sent(seen.filter("all").select("asker")), "asker", "left_semi")
        parts.append(by_mail.join(sent(every), "term"))
    ranked = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    scored = None
    for part in parts:
        total = part.groupBy("email_id", "question_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * weight_of(F.col("tf"), F.col("dl"))), 6).alias("score"))
        mine = total.select("question_id", "chunk_id", "score")
        scored = mine if scored is None else scored.unionByName(mine)
    return scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= limit)


def search_many(index: DataFrame, stats: DataFrame, questions: DataFrame, access: DataFrame | None, limit: int = 50) -> DataFrame:
    """(question_id, chunk_id, score, rank) for many questions(question_id, terms, tokens) at once.

    Terms join the index; access(email_id, principal) keeps what each question's tokens
    may read. The rank limit is pushed below the shuffle by Spark (window group limit).
    """
    mine = index.join(questions.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    row = stats.first()
    asked = asking(questions, mine.groupBy("term").agg(F.count("*").alias("df")), lambda df: idf(F.lit(float(row["n"])), df.cast("double")))
    return score_many(mine.select("term", "chunk_id", "email_id", "tf", "dl"), asked, access, lambda tf, dl: weight(tf.cast("double"), dl, F.lit(row["avgdl"])), limit)
