"""Ranking quality, ablations, red-team targets and leak tallies, workloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import text as T
from palisade.operators import positions
from palisade.operators.acl import WILDCARD


#: Rows of results and relevant documents that one task of `rank_metrics` has, about.
PART_ROWS = 250_000


def rank_metrics(results: DataFrame, relevant: DataFrame, k: int, runs: DataFrame | None = None) -> DataFrame:
    """(config, question_id, recall, hit, mrr, ndcg) at k, for every question of every run.

    results(config, question_id, doc, rank), relevant(question_id, doc), runs(config,
    question_id): what was asked; without it every question of either table under every
    config that has results. Only the first place of a repeated result counts. A
    question without results, or without relevant documents, scores zero. Neither table need be distinct.
    """
    asked = results if runs is None else runs
    each = {r["config"]: r["count"] for r in asked.groupBy("config").count().collect()}  # a few ways to retrieve
    configs = sorted(each)
    if not configs:
        return results.sparkSession.createDataFrame([], f"config string, question_id {results.schema['question_id'].dataType.simpleString()}, recall double, hit double, mrr double, ndcg double")
    doc = results.schema["doc"].dataType
    empty = lambda kind: F.lit(None).cast(kind)
    rows = results.select("question_id", F.lit("got").alias("kind"), "config", "doc", "rank")
    rows = rows.unionByName(relevant.select("question_id", F.lit("rel").alias("kind"), empty("string").alias("config"), F.col("doc").cast(doc).alias("doc"), empty("int").alias("rank")))
    if runs is not None:
        rows = rows.unionByName(runs.select("question_id", F.lit("run").alias("kind"), "config", empty(doc).alias("doc"), empty("int").alias("rank")))
    # all that follows is by question and more, so this is the only shuffle; more rows make more parts, not larger ones
    many = sum(each.values()) + relevant.count() + (0 if runs is None else results.count())
    rows = rows.repartition(max(1, -(-many // PART_ROWS)), "question_id")
    first = rows.groupBy("question_id", "kind", "config", "doc").agg(F.min("rank").alias("rank"))
    of_doc = Window.partitionBy("question_id", "doc")
    place = Window.partitionBy("question_id", "kind", "config").orderBy("rank", "doc")
    marked = first.withColumn("rel", F.max((F.col("kind") == "rel").cast("int")).over(of_doc) == 1).withColumn("place", F.row_number().over(place))
    got, near = F.col("kind") == "got", F.col("place") <= k
    one = lambda i, c: [
        F.max((F.col("kind") == "run") & (F.col("config") == c)).alias(f"run{i}"),
        F.sum((got & F.col("rel") & near & (F.col("config") == c)).cast("double")).alias(f"hits{i}"),
        F.min(F.when(got & F.col("rel") & (F.col("config") == c), F.col("place"))).alias(f"first{i}"),
        F.sum(F.when(got & F.col("rel") & near & (F.col("config") == c), 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias(f"dcg{i}"),
    ]
    per = marked.groupBy("question_id").agg(F.sum((F.col("kind") == "rel").cast("int")).alias("n"), *[x for i, c in enumerate(configs) for x in one(i, c)])
    by_config = F.array(*[F.struct(F.lit(c).alias("config"), *[F.col(f"{name}{i}").alias(name) for name in ("run", "hits", "first", "dcg")]) for i, c in enumerate(configs)])
    joined = per.select("question_id", "n", F.inline(by_config))
    if runs is not None:
        joined = joined.filter("run")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    some = F.col("n") > 0
    return joined.select(
        "config",
        "question_id",
        F.round(F.when(some, F.col("hits") / F.col("n")).otherwise(0.0), 6).alias("recall"),
        F.when(some & (F.col("hits") > 0), 1.0).otherwise(0.0).alias("hit"),
        F.round(F.when(some & F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0), 6).alias("mrr"),
        F.round(F.when(some, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def ablation(scores: DataFrame, bucket: Column) -> DataFrame:
    """Means by config for every bucket and for all questions, in one pass over grouping sets."""
    means = [F.round(F.avg(m), 6).alias(m) for m in ("recall", "hit", "mrr", "ndcg")]
    rows = scores.withColumn("bucket", bucket).rollup("config", "bucket").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *means)
    return rows.filter("level < 3").select("config", F.when(F.col("level") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), "n", "recall", "hit", "mrr", "ndcg")


def draw(rows: DataFrame, key: Column, seed: int, limit: int) -> DataFrame:
    """A repeatable sample: the first by a hash of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(limit)


def targets(emails: DataFrame, acl: DataFrame, low: int = 2, high: int = 4, min_words: int = 25) -> DataFrame:
    """(email_id, n_readers) of mails few can read, long enough and with a subject."""
    sizes = acl.groupBy("email_id").agg(F.count("*").alias("n_readers")).filter(F.col("n_readers").between(low, high))
    long = F.size(F.array_remove(F.split(F.regexp_replace("body", r"\s+", " "), " "), "")) >= min_words
    return emails.filter(long & (F.col("subject") != "")).join(sizes, "email_id").select("email_id", "n_readers")


def attackers(chosen: DataFrame, acl: DataFrame, owners: DataFrame, seed: int = 7) -> DataFrame:
    """(email_id, attacker): a mailbox owner who may not read the mail, picked by hash.

    owners(principal) lie on a ring, one row for each mailbox. A mail starts at a hashed place
    and takes the next owner without a right. Of one more owners than it has readers one has
    none, so no more are looked at. Mails without any right have attackers too.
    """
    ring = owners.select("principal").distinct().select(F.col("principal").alias("attacker"), (F.row_number().over(Window.orderBy("principal")) - 1).alias("place"))
    n = ring.count()
    if not n:
        return chosen.select("email_id", F.lit("").alias("attacker")).limit(0)
    mails = chosen.select("email_id").distinct()
    readers = acl.join(mails, "email_id", "left_semi").groupBy("email_id").agg(F.collect_set("principal").alias("readers"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("email_id"))), 1, 8), 16, 10).cast("long")
    each = mails.join(readers, "email_id", "left").withColumn("readers", F.coalesce("readers", F.array().cast("array<string>")))
    looked = each.select("email_id", "readers", start.alias("s"), F.explode(F.sequence(F.lit(0), F.least(F.size("readers"), F.lit(n - 1)))).alias("i"))
    met = looked.withColumn("place", ((F.col("s") + F.col("i")) % n).cast("int")).join(ring, "place")
    return met.filter(~F.array_contains("readers", F.col("attacker"))).groupBy("email_id").agg(F.min_by("attacker", "i").alias("attacker"))


def probes(chosen: DataFrame) -> DataFrame:
    """(email_id, kind, question): three ways to ask for a mail; chosen(email_id, subject, sender, body)."""
    words = F.array_remove(F.split(F.regexp_replace("body", r"\s+", " "), " "), "")
    given = {"{subject}": F.col("subject"), "{who}": T.person_label(F.col("sender")), "{opening}": F.array_join(F.slice(words, 1, 14), " ")}

    def filled(template: str) -> Column:
        parts = [given.get(x, F.lit(x)) for x in re.split(r"(\{[a-z]+\})", template) if x]
        return F.concat(*parts)

    kinds = [F.struct(F.lit(kind).alias("kind"), filled(template).alias("question")) for kind, template in fixed.PROBES.items()]
    return chosen.select("email_id", F.inline(F.array(*kinds)))


def _hashed_runs(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, h) of runs of `size` words, by hashes of hashes of words."""

    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))
        return F.when(F.size(words) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(T.terms(F.col("text")), lambda w: F.xxhash64(w))
    return rows.select(key, F.explode(F.transform(F.array(hashed), runs)[0]).alias("h"))


def _runs(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.select(key, F.explode(F.array_distinct(T.shingles(T.terms(F.col("text")), size))).alias("g"))


def leaked_runs(answers: DataFrame, secrets: DataFrame, size: int = 8) -> DataFrame:
    """(answer_id, secret_id, n): runs of `size` words that an answer has from a text it should not know.

    Hashes of runs find the answers and secrets that have anything in common; only their runs
    are spelled out and joined. A run common to very many is dealt anew by the adaptive skew join.
    """
    mine, theirs = _hashed_runs(answers, "answer_id", size), _hashed_runs(secrets, "secret_id", size)
    some = answers.join(mine.join(theirs.select("h").distinct(), "h", "left_semi").select("answer_id").distinct(), "answer_id", "left_semi")
    met = _runs(some, "answer_id", size).join(_runs(secrets, "secret_id", size), "g")
    return met.groupBy("answer_id", "secret_id").agg(F.count("*").alias("n"))


def readable_phrases(phrases: DataFrame, chunks: DataFrame, acl: DataFrame, size: int = 8) -> DataFrame:
    """Those of phrases(key, tokens, g) that some chunk has which one of `tokens` may read; g has `size` words."""
    wanted = phrases.select("g").distinct()
    hashed = lambda g: F.xxhash64(*[F.xxhash64(F.split(g, " ")[k]) for k in range(size)])
    marked = _hashed_runs(chunks, "chunk_id", size).join(wanted.select(hashed(F.col("g")).alias("h")).distinct(), "h", "left_semi").select("chunk_id").distinct()
    have = _runs(chunks.join(marked, "chunk_id", "left_semi"), "chunk_id", size).join(wanted, "g", "left_semi").join(chunks.select("chunk_id", "email_id"), "chunk_id")
    return known_phrases(phrases, have, acl)


def readable_by_positions(phrases: DataFrame, index: DataFrame, acl: DataFrame) -> DataFrame:
    """As `readable_phrases`, for phrases of any length, from an index of positions: the texts are not read."""
    wanted = phrases.select(F.col("g").alias("key"), F.split("g", " ").alias("terms")).distinct()
    return known_phrases(phrases, positions.phrases_in(index, wanted).withColumnRenamed("key", "g"), acl)


def known_phrases(phrases: DataFrame, have: DataFrame, acl: DataFrame) -> DataFrame:
    """(key, g) of phrases(key, tokens, g) that one of have(g, email_id) has in a mail that one of `tokens` may read."""
    may = have.join(acl, "email_id").select("g", "principal").distinct()
    each = phrases.select("key", "g", F.explode("tokens").alias("principal"))
    everything = phrases.filter(F.array_contains("tokens", WILDCARD)).join(have.select("g").distinct(), "g", "left_semi").select("key", "g")
    return each.join(may, ["g", "principal"], "left_semi").select("key", "g").union(everything).distinct()


def content_leaks(answers: DataFrame, secrets: DataFrame, chunks: DataFrame, acl: DataFrame, size: int = 8) -> DataFrame:
    """(answer_id) of answers(answer_id, email_id, tokens, text) with a run of the mail that they may read nowhere else.

    secrets(email_id, text) are the mails, chunks(chunk_id, email_id, text) the corpus.
    """
    said = answers.select("answer_id", "email_id", "tokens", F.explode(F.array_distinct(T.shingles(T.terms(F.col("text")), size))).alias("g"))
    lifted = said.join(_runs(secrets, "email_id", size), ["email_id", "g"], "left_semi").withColumnRenamed("answer_id", "key")
    return lifted.join(readable_phrases(lifted.select("key", "tokens", "g"), chunks, acl, size), ["key", "g"], "left_anti").select(F.col("key").alias("answer_id")).distinct()


def leak_tallies(events: DataFrame) -> DataFrame:
    """Per config: leaks in context, from the cache and in content, and the share of rightful readers served."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return events.groupBy("config").agg(F.count("*").alias("n"), total("context_leak"), total("cache_leak"), total("content_leak"), F.round(F.avg(F.when(F.col("is_second_reader"), F.col("served").cast("double"))), 3).alias("served_rate"))


def cache_tallies(runs: DataFrame, baseline: str) -> DataFrame:
    """Per config: hit rate, share of the large model, cost, and savings against the baseline."""
    per = runs.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.col("large").cast("double")), 6).alias("large_share"), F.round(F.sum("cost_usd"), 6).alias("cost"))
    base = F.max(F.when(F.col("config") == baseline, F.col("cost"))).over(Window.partitionBy())  # a row for each config
    return per.withColumn("savings", F.when(base > 0, F.round(1 - F.col("cost") / base, 6)))


def quality_means(judged: DataFrame) -> DataFrame:
    names = ("faithfulness", "relevance", "correct", "large", "cost_usd")
    return judged.groupBy("generation").agg(*[F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in names])


def workload(emails: DataFrame, acl: DataFrame, low: int = 3, high: int = 12, readers: int = 4, templates: int = 4) -> DataFrame:
    """(email_id, reader, i, template): up to four readers of each shared mail ask about it."""
    shared = acl.groupBy("email_id").agg(F.array_sort(F.collect_set("principal")).alias("p")).filter(F.size("p").between(low, high))
    rows = shared.join(emails.select("email_id"), "email_id", "left_semi")
    return rows.select("email_id", F.posexplode(F.slice("p", 1, readers)).alias("i", "reader")).withColumn("template", F.col("i") % templates)


def shared_entities(mentions: DataFrame, entities: DataFrame, chunks: DataFrame, low: int = 2, high: int = 30) -> DataFrame:
    """(entity_id, n_emails) of things, not people, that a few mails mention."""
    rows = mentions.join(entities.filter("type <> 'person'"), "entity_id").join(chunks.select("chunk_id", "email_id"), "chunk_id")
    return rows.groupBy("entity_id").agg(F.count_distinct("email_id").alias("n_emails")).filter(F.col("n_emails").between(low, high))


def hop_pairs(members: DataFrame) -> DataFrame:
    """(entity_id, a, b) of mails that share an entity but no thread; members(entity_id, email_id, thread).

    Entities have been kept to a few mails each, so pairs are formed in one array per entity.
    """
    lists = members.distinct().groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("email_id", "thread"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda b: b["thread"] != a["thread"]), lambda b: F.struct(a["email_id"].alias("a"), b["email_id"].alias("b")))))
    return lists.select("entity_id", F.inline(pairs))


def question_sentences(emails: DataFrame, low: int = 8, high: int = 30, phrase: int = 8, seed: int = 3) -> DataFrame:
    """(email_id, phrase): the opening of one sentence of each mail, picked by hash."""
    each = emails.select("email_id", F.posexplode(T.sentences(F.col("body"))).alias("pos", "s"))
    words = F.array_remove(F.split(F.regexp_replace("s", r"\s+", " "), " "), "")
    fit = each.withColumn("w", words).filter(F.size("w").between(low, high))
    key = F.struct(F.md5(F.concat_ws(":", F.lit(seed), "email_id", "pos")).alias("h"), "pos")
    return fit.groupBy("email_id").agg(F.min_by(F.array_join(F.slice("w", 1, phrase), " "), key).alias("phrase"))
