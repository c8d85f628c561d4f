"""Model choice, cost, and the extractive answerer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import text as T


def features(question: Column, n_threads: Column, n_emails: Column, n_graph: Column) -> dict[str, Column]:
    words = F.size(F.array_remove(F.split(F.trim(F.regexp_replace(question, r"\s+", " ")), " "), ""))
    cues = F.regexp_count(question, F.lit(rf"(?i)\b(?:{fixed.REASONING_CUES})\b"))
    cut = lambda x, most: F.least(x / most, F.lit(1.0))
    return {
        "length": cut(words, 30.0),
        "reasoning_cues": cut(cues, 2.0),
        "spread": cut(F.greatest(n_threads - 1, F.lit(0)), 5.0),
        "multi_email": cut(F.greatest(n_emails - 2, F.lit(0)), 6.0),
        "graph": cut(n_graph, 4.0),
    }


def route(rows: DataFrame, small: str = "small", large: str = "large", threshold: float = fixed.ROUTER_THRESHOLD) -> DataFrame:
    """Adds difficulty, model and reason to rows(question, n_threads, n_emails, n_graph)."""
    parts = features(F.col("question"), F.col("n_threads"), F.col("n_emails"), F.col("n_graph"))
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + fixed.ROUTER_WEIGHTS[name] * value
    ranked = F.array_sort(F.array(*[F.struct((-fixed.ROUTER_WEIGHTS[n] * v).alias("w"), F.lit(i).alias("i"), F.format_string(f"{n}=%.2f", v).alias("s")) for i, (n, v) in enumerate(parts.items())]))
    why = F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["s"]), ", ")
    hard = total >= threshold
    sign = F.when(hard, F.lit("≥")).otherwise("<")
    return rows.withColumns({
        **parts,
        "difficulty": F.round(total, 6),
        "model": F.when(hard, large).otherwise(small),
        "reason": F.concat(F.format_string("difficulty %.2f ", total), sign, F.lit(f" {threshold} ("), why, F.lit(")")),
    })


def cost(input_tokens: Column, output_tokens: Column, cached_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars from prices per million tokens."""
    return (input_tokens * price_in + cached_tokens * price_in * fixed.CACHE_READ_SHARE + output_tokens * price_out) / 1e6


def with_cost(rows: DataFrame, prices: dict[str, tuple[float, float]], default: str) -> DataFrame:
    """Adds cost_usd to rows(model, input_tokens, output_tokens, cached_tokens); unknown models cost what `default` does."""
    price_in, price_out = F.lit(prices[default][0]), F.lit(prices[default][1])
    for name, (a, b) in prices.items():
        price_in = F.when(F.col("model") == name, a).otherwise(price_in)
        price_out = F.when(F.col("model") == name, b).otherwise(price_out)
    return rows.withColumn("cost_usd", F.round(cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), price_in, price_out), 6))


def extract_answers(context: DataFrame, question: Column) -> DataFrame:
    """(question_id, answer): the two sentences that share most words with the question.

    context(question_id, n, text): numbered chunks with a header line. Without a sentence
    that shares enough, the answer is the fixed refusal.
    """
    stop = F.array(*map(F.lit, fixed.ANSWERER_STOP_WORDS))
    asked = F.array_except(T.terms(question), stop)
    body = F.regexp_replace("text", r"^[^\n]*\n", "")
    rows = context.select("question_id", "n", asked.alias("q"), F.posexplode(T.sentences(body)).alias("pos", "s"))
    words = F.array_distinct(T.terms(F.col("s")))
    overlap = F.size(F.array_intersect("q", words))
    enough = F.least(F.greatest(F.lit(2), F.ceil(0.3 * F.size("q"))), F.size("q"))
    scored = rows.withColumn("score", F.when(overlap >= enough, F.round(overlap / (1 + F.sqrt(F.size(words).cast("double"))), 9)))
    w = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("score"), "n", "pos")
    best = scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    said = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("rank", F.concat(T.strip(F.col("s")), F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("t")))))
    joined = F.array_join(F.transform(said, lambda x: x["t"]), " ")
    return best.groupBy("question_id").agg(F.when(F.size(said) > 0, joined).otherwise(fixed.NOT_FOUND).alias("answer"))


def prompt_context(ranked: DataFrame) -> DataFrame:
    """(question_id, context): numbered blocks in the order of n."""
    block = F.concat(F.lit('<email n="'), F.col("n").cast("string"), F.lit('">\n'), F.col("text"), F.lit("\n</email>"))
    return ranked.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))
