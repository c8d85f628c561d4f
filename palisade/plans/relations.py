"""Mail-like relations derived from the driver's tables, for Spark and as SQL.

The tables hold no mails, so senders, recipients, dates and rights follow from ids by
arithmetic. Both forms state the same formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.acl import Grant, Group
from palisade.sources.tables import spread

GROUPS = [
    Group("fr", "French mail", frozenset({"u1", "u2"}), (Grant(folders=("*/fr",)),)),
    Group("src0", "", frozenset({"u3"}), (Grant(mailboxes=("src0",), exclude_folders=("*/de",)),)),
    Group("nobody", "", frozenset(), ()),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def user(formula: str) -> F.Column:
    return F.expr(f"concat('u', cast({formula} as string))")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prefix = F.expr("case when doc_id % 8 = 2 then 'fw: re: ' when doc_id % 4 = 1 then 'Re: ' else '' end")
    words = F.array_remove(F.split("text", "[ \\n\\t\\r]+"), "")
    return docs.select(
        F.col("doc_id").alias("email_id"),
        F.concat(F.lit("m"), F.md5("text")).alias("message_id"),
        F.date_format(F.expr("date_add(date'2001-01-01', cast(doc_id % 365 as int))"), "yyyy-MM-dd").alias("date"),
        user("doc_id % 40").alias("sender"),
        F.array(user("(doc_id * 7 + 3) % 40"), user("(doc_id * 11 + 5) % 40")).alias("to"),
        user("doc_id % 8").alias("owner"),
        F.concat(prefix, F.array_join(F.slice(words, 1, 5), " ")).alias("subject"),
        F.col("source").alias("mailbox"),
        F.concat_ws("/", "source", "lang").alias("folder"),
        F.col("text").alias("body"),
    )


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.array("sender", F.col("to")[0], F.col("to")[1], "owner")
    rows = emails(spark, sf_dir).select("email_id", F.explode(F.array_distinct(people)).alias("p"))
    return rows.select("email_id", F.concat(F.lit("user:"), "p").alias("principal"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return lines.filter("trim(line) <> ''").select(F.expr("doc_id * 10000 + ord").alias("chunk_id"), F.col("doc_id").alias("email_id"), "ord", F.trim("line").alias("text"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        user("user_id % 40").alias("principal"),
        F.array(k, k + 1, k + 2).alias("retrieved"),
        F.when(kind == "view", "hit").when(kind == "error", "bypass").otherwise("miss").alias("cache_status"),
        F.when(kind == "purchase", "large").when(kind == "signup", F.lit(None)).otherwise("small").alias("model"),
        F.col("value").alias("latency_ms"),
        (10 * k).alias("input_tokens"),
        k.alias("output_tokens"),
        ((10 * k * 3.0 + k * 15.0) / 1e6).alias("cost_usd"),
        F.when(kind == "error", F.array(F.lit("CACHE_ACL_BLOCKED"))).otherwise(F.array().cast("array<string>")).alias("security_events"),
        k.alias("entry_id"),
    )


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, chunk_id): customers c... and suppliers s... that meet in an order."""
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    return pairs.select(F.expr("concat('c', o_custkey)").alias("src"), F.expr("concat('s', l_suppkey)").alias("dst"), F.col("o_orderkey").alias("chunk_id"))


def trade_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    heads = table(spark, sf_dir, "orders").select(F.expr("concat('c', o_custkey)").alias("entity_id"), F.col("o_orderkey").alias("chunk_id"))
    named = lines.select(F.explode(F.array(F.expr("concat('s', l_suppkey)"), F.expr("concat('p', l_partkey)"))).alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    return heads.unionByName(named).distinct()


def trade_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers of the nations below 15."""
    some = table(spark, sf_dir, "customer").filter("c_nationkey < 15").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(some, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("chunk_id"))


EMAILS = r"""emails AS (
  SELECT doc_id AS email_id, 'm' || md5(text) AS message_id, strftime(DATE '2001-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date,
         'u' || (doc_id % 40) AS sender, ['u' || ((doc_id * 7 + 3) % 40), 'u' || ((doc_id * 11 + 5) % 40)] AS "to", 'u' || (doc_id % 8) AS owner,
         CASE WHEN doc_id % 8 = 2 THEN 'fw: re: ' WHEN doc_id % 4 = 1 THEN 'Re: ' ELSE '' END
           || array_to_string(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '')[1:5], ' ') AS subject,
         source AS mailbox, source || '/' || lang AS folder, text AS body
  FROM documents)"""
ACL = """acl AS (SELECT DISTINCT email_id, 'user:' || p AS principal FROM (SELECT email_id, unnest([sender, "to"[1], "to"[2], owner]) AS p FROM emails))"""
CHUNKS = r"""chunks AS (
  SELECT doc_id * 10000 + ord AS chunk_id, doc_id AS email_id, ord, trim(line) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)
  WHERE trim(line) <> '')"""
AUDIT = """audit AS (
  SELECT event_id AS id, ts, 'u' || (user_id % 40) AS principal, [k, k + 1, k + 2] AS retrieved,
         CASE event_type WHEN 'view' THEN 'hit' WHEN 'error' THEN 'bypass' ELSE 'miss' END AS cache_status,
         CASE event_type WHEN 'purchase' THEN 'large' WHEN 'signup' THEN NULL ELSE 'small' END AS model,
         value AS latency_ms, 10 * k AS input_tokens, k AS output_tokens, (10 * k * 3.0::DOUBLE + k * 15.0::DOUBLE) / 1e6 AS cost_usd,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n_events, k AS entry_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
TRADE = """edges AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, o_orderkey AS chunk_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
mentions AS (SELECT 'c' || o_custkey AS entity_id, o_orderkey AS chunk_id FROM orders
             UNION SELECT 's' || l_suppkey, l_orderkey FROM lineitem UNION SELECT 'p' || l_partkey, l_orderkey FROM lineitem),
readable AS (SELECT o_orderkey AS chunk_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15))"""
