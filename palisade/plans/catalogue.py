"""All registered queries of the retrieval engine with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import text as T
from palisade.operators import acl as A
from palisade.operators import audit, blockmax, cache, chunking, evals, fuse, graph, ingest, lexical, positions, routing, vector
from palisade.plans import relations as R
from palisade.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The principal and the words of the registered queries.
ME = A.Principal("u7", frozenset({"fr"}))
TERMS = ["erand", "token", "tion", "le", "thing", "with", "from", "shing"]
QUERY_VECTOR = 7
NEAR = 0.2


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_TOKENS = ", ".join(f"'{t}'" for t in ME.tokens)
_MINE = f"readable AS (SELECT chunk_id FROM chunks WHERE email_id IN (SELECT email_id FROM acl WHERE principal IN ({_TOKENS})))"


def _corpus(spark: SparkSession, sf_dir: str, who: A.Principal = ME) -> A.SecureCorpus:
    return A.SecureCorpus(R.chunks(spark, sf_dir), R.acl(spark, sf_dir), who)


# access


@query(_with(R.EMAILS, R.ACL, R.CHUNKS, _MINE) + "SELECT chunk_id FROM readable")
def readable_chunks(spark, sf_dir):
    return _corpus(spark, sf_dir).readable()


@query(_with(R.EMAILS, R.ACL, R.CHUNKS, _MINE) + "SELECT chunk_id FROM (SELECT doc_id * 10000 AS chunk_id FROM documents UNION SELECT 999999999999) WHERE chunk_id NOT IN (SELECT chunk_id FROM readable)")
def guard_unreadable(spark, sf_dir):
    ids = R.table(spark, sf_dir, "documents").select(F.expr("doc_id * 10000").alias("chunk_id")).union(spark.range(999999999999, 1000000000000).toDF("chunk_id"))
    return _corpus(spark, sf_dir).unreadable(ids)


@query(_with(R.EMAILS, R.ACL) + "SELECT email_id, principal FROM acl")
def acl_derive(spark, sf_dir):
    rows = R.emails(spark, sf_dir).select(F.col("email_id").alias("id"), "sender", F.struct(F.col("to"), F.array().cast("array<string>").alias("cc"), F.array().cast("array<string>").alias("bcc")).alias("recipients"), F.array("owner").alias("owners"))
    return A.derive(rows)


_GRANTS = """granted AS (SELECT email_id, 'group:fr' AS principal FROM emails WHERE folder GLOB '*/fr'
  UNION ALL SELECT email_id, 'group:src0' FROM emails WHERE mailbox = 'src0' AND NOT folder GLOB '*/de')"""


def _granted(spark, sf_dir):
    return R.emails(spark, sf_dir).select("email_id", F.array("folder").alias("folders"), F.concat(F.array("sender"), "to").alias("people"))


@query(_with(R.EMAILS, R.ACL, _GRANTS) + "SELECT email_id, principal FROM acl UNION SELECT email_id, principal FROM granted")
def group_sync(spark, sf_dir):
    stale = R.acl(spark, sf_dir).limit(1).select("email_id", F.lit("group:gone").alias("principal"))
    return A.sync(R.acl(spark, sf_dir).unionByName(stale), _granted(spark, sf_dir), R.GROUPS)


@query(_with(R.EMAILS, _GRANTS) + "SELECT g.name, CAST(count(granted.email_id) AS BIGINT) AS n FROM (VALUES ('fr'), ('src0'), ('nobody')) AS g(name) LEFT JOIN granted ON principal = 'group:' || g.name GROUP BY g.name")
def grant_counts(spark, sf_dir):
    return A.grant_counts(_granted(spark, sf_dir), R.GROUPS)


@query(
    _with(R.EMAILS, R.ACL, _GRANTS, "every AS (SELECT * FROM acl UNION SELECT * FROM granted)")
    + f"""SELECT email_id, array_to_string(list_sort(list(principal)), ',') AS acl,
    coalesce(array_to_string(list_sort(list(principal) FILTER (principal IN ({_TOKENS}))), ','), '') AS matched,
    coalesce(array_to_string(list_transform(list_sort(list(principal) FILTER (principal IN ({_TOKENS}))), lambda t:
      CASE WHEN t LIKE 'user:%' THEN substr(t, 6) || ' is the sender, a recipient, or a mailbox owner of this email' ELSE 'member of group ''' || substr(t, 7) || ''' (French mail)' END), ';'), '') AS reasons,
    count(*) FILTER (principal IN ({_TOKENS})) > 0 AS readable FROM every GROUP BY email_id"""
)
def acl_explain(spark, sf_dir):
    table = A.sync(R.acl(spark, sf_dir), _granted(spark, sf_dir), R.GROUPS)
    rows = A.explain(table, ME, R.GROUPS)
    return rows.select("email_id", F.array_join("acl", ",").alias("acl"), F.array_join("matched", ",").alias("matched"), F.array_join("reasons", ";").alias("reasons"), "readable")


@query(_with(R.EMAILS, R.ACL) + "SELECT substr(principal, 6) AS user, CAST(count(*) AS BIGINT) AS n FROM acl WHERE principal LIKE 'user:%' GROUP BY principal ORDER BY n DESC, principal LIMIT 25")
def top_principals(spark, sf_dir):
    return A.top_principals(R.acl(spark, sf_dir))


@query(_with(R.EMAILS) + "SELECT DISTINCT owner FROM emails")
def mailbox_owners(spark, sf_dir):
    return R.emails(spark, sf_dir).select("owner").distinct().orderBy("owner")


@query(_with(R.EMAILS, R.CHUNKS) + "SELECT chunk_id, email_id, ord, sender, date FROM chunks JOIN emails USING (email_id) WHERE chunk_id IN (SELECT chunk_id FROM chunks UNION ALL SELECT 999999999999)")
def get_chunks(spark, sf_dir):
    ids = R.chunks(spark, sf_dir).select("chunk_id").union(spark.range(999999999999, 1000000000000).toDF("chunk_id"))
    return A.get_chunks(R.chunks(spark, sf_dir), R.emails(spark, sf_dir), ids).select("chunk_id", "email_id", "ord", "sender", "date")


@query(_with(R.CHUNKS) + "SELECT count(*) AS n_chunks, count(DISTINCT email_id) AS n_emails FROM chunks")
def corpus_counts(spark, sf_dir):
    return R.chunks(spark, sf_dir).agg(F.count("*").alias("n_chunks"), F.count_distinct("email_id").alias("n_emails"))


@query(_with(R.EMAILS) + "SELECT email_id, message_id, subject FROM emails WHERE email_id = 5 OR message_id IN (SELECT message_id FROM emails WHERE email_id IN (1, 2, 3))")
def point_lookup(spark, sf_dir):
    rows = R.emails(spark, sf_dir)
    ids = rows.filter(F.col("email_id").isin(1, 2, 3)).select("message_id")
    return rows.filter("email_id = 5").unionByName(rows.join(ids, "message_id", "left_semi").filter("email_id <> 5").select(rows.columns)).select("email_id", "message_id", "subject")


# lexical, vector, fusion

_POSTINGS = """postings AS (SELECT chunk_id, email_id, term, count(*) AS tf FROM (SELECT chunk_id, email_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks) GROUP BY ALL),
doc_len AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc_len),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""
_WEIGHT = """(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"""
_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _bm25(where: str) -> str:
    return f"SELECT p.chunk_id, round(sum({_WEIGHT}), 6) AS score FROM postings p JOIN df USING (term) JOIN doc_len d ON d.chunk_id = p.chunk_id, corpus WHERE term IN ({_TERM_LIST}) {where} GROUP BY p.chunk_id ORDER BY score DESC, p.chunk_id LIMIT 20"


def _indexed(spark, sf_dir, name: str, build) -> DataFrame:
    """A table that is made of all documents once, as an ingest would, and read by every question."""
    return tables.indexed(spark, f"{sf_dir}/documents.parquet", name, build)


def _stored_chunks(spark, sf_dir) -> DataFrame:
    return _indexed(spark, sf_dir, "chunks", lambda: R.chunks(spark, sf_dir))


def _postings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths; words are counted once for both."""
    lengths = _indexed(spark, sf_dir, "lengths", lambda: lexical.statistics(_stored_chunks(spark, sf_dir)))
    build = lambda: lexical.sorted_postings(_stored_chunks(spark, sf_dir), lexical.total_words(lengths))
    return _indexed(spark, sf_dir, "postings", build), lengths


def _best_by_words(spark, sf_dir, limit: int) -> DataFrame:
    index, lengths = _postings(spark, sf_dir)
    readable = A.SecureCorpus(_stored_chunks(spark, sf_dir), R.acl(spark, sf_dir), ME).readable()
    return lexical.search_index(index, lengths, readable, TERMS, limit)


def builds(spark, sf_dir) -> dict[str, Callable[[], object]]:
    """What makes each index that queries read, to be timed apart from them."""
    return {
        "chunks": lambda: _stored_chunks(spark, sf_dir),
        "postings": lambda: _best_by_words(spark, sf_dir, 1),
        "blocks": lambda: _blocks(spark, sf_dir),
        "positions": lambda: _indexed(spark, sf_dir, "positions", lambda: positions.positions(_stored_chunks(spark, sf_dir))),
    }


@query(_with(R.CHUNKS, _POSTINGS) + _bm25(""))
def bm25_topk(spark, sf_dir):
    return lexical.search(R.chunks(spark, sf_dir), None, TERMS, 20)


@query(_with(R.EMAILS, R.ACL, R.CHUNKS, _MINE, _POSTINGS) + _bm25("AND p.chunk_id IN (SELECT chunk_id FROM readable)"))
def bm25_acl_topk(spark, sf_dir):
    return _best_by_words(spark, sf_dir, 20)


_ASKED = """asked AS (SELECT item_id AS question_id, 'user:u' || (item_id % 40) AS token, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark)"""


@query(
    _with(R.EMAILS, R.ACL, R.CHUNKS, _POSTINGS, _ASKED)
    + f"""SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT question_id, p.chunk_id, round(sum({_WEIGHT}), 6) AS score FROM asked JOIN postings p USING (term) JOIN df USING (term) JOIN doc_len d ON d.chunk_id = p.chunk_id, corpus
      WHERE EXISTS (SELECT 1 FROM acl WHERE acl.email_id = p.email_id AND acl.principal = asked.token) GROUP BY ALL)) WHERE rank <= 5"""
)
def bm25_batch(spark, sf_dir):
    asked = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array(F.expr("concat('user:u', item_id % 40)")).alias("tokens"), F.array_distinct(T.terms(F.col("text"))).alias("terms"))
    index, lengths = _postings(spark, sf_dir)
    return lexical.search_many(index, lengths, asked, R.acl(spark, sf_dir), 5).select("question_id", "chunk_id", "score", "rank")


def _blocks(spark, sf_dir) -> blockmax.Index:
    stored = lambda: _stored_chunks(spark, sf_dir)
    parts = {"blocks": lambda: blockmax.blocks(stored()), "terms": lambda: blockmax.terms_of(made[0]), "lengths": lambda: blockmax.length_counts(stored())}
    made: list[DataFrame] = []
    for name, build in parts.items():
        made.append(_indexed(spark, sf_dir, f"blockmax-{name}", build))
    return blockmax.Index(*made)


@query(_with(R.EMAILS, R.ACL, R.CHUNKS, _MINE, _POSTINGS) + _bm25("AND p.chunk_id IN (SELECT chunk_id FROM readable)"))
def bm25_blockmax(spark, sf_dir):
    readable = A.SecureCorpus(_stored_chunks(spark, sf_dir), R.acl(spark, sf_dir), ME).readable()
    return blockmax.search(_blocks(spark, sf_dir), readable, TERMS, 20)


@query(ORACLE_SQL["bm25_batch"])
def bm25_blockmax_batch(spark, sf_dir):
    asked = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array(F.expr("concat('user:u', item_id % 40)")).alias("tokens"), F.array_distinct(T.terms(F.col("text"))).alias("terms"))
    return blockmax.search_many(_blocks(spark, sf_dir), asked, R.acl(spark, sf_dir), 5).select("question_id", "chunk_id", "score", "rank")


_LEFT = [R.CHUNKS.replace("chunks AS", "whole AS", 1), "chunks AS (SELECT * FROM whole WHERE chunk_id % 50 <> 49)"]


@query(_with(R.EMAILS, R.ACL, *_LEFT, _MINE, _POSTINGS) + _bm25("AND p.chunk_id IN (SELECT chunk_id FROM readable)"))
def bm25_segments(spark, sf_dir):
    """A corpus that was filled in two goes, of which chunks were removed since."""

    def fill(store: tables.Store) -> None:
        chunks, late = R.chunks(spark, sf_dir), F.col("email_id") % 10 == 3
        store.add_chunks(chunks.filter(~late))
        store.add_chunks(chunks.filter(late))
        store.remove_chunks(chunks.filter("chunk_id % 50 = 49"))

    # searched by words only, so no vectors and no places are made of it
    store = tables.kept_store(spark, f"{sf_dir}/documents.parquet", "segments", fill, parts=("blocks",))
    readable = A.SecureCorpus(store.read("chunks"), R.acl(spark, sf_dir), ME).readable()
    return blockmax.search(store.index(), readable, TERMS, 20)


@query("""SELECT doc_id, array_to_string(list_distinct_ordered, ' ') AS terms FROM (SELECT doc_id, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered
  FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([%s], w)) AS ws FROM documents))""".replace("%s", _quoted(fixed.QUERY_STOP_WORDS)))
def query_terms(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def _query_vector(spark, sf_dir) -> list[float]:
    row = R.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()
    return list(row[0])


_SIMS = f"""q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
sims AS (SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS sim FROM embeddings, q)"""


@query(_with(_SIMS) + "SELECT vec_id, sim FROM sims ORDER BY sim DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return vector.top_k(R.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20)


_MY_MAIL = f"mine AS (SELECT DISTINCT email_id FROM acl WHERE principal IN ({_TOKENS}))"


@query(_with(R.EMAILS, R.ACL, _MY_MAIL, _SIMS) + "SELECT vec_id, sim FROM sims WHERE vec_id IN (SELECT email_id FROM mine) ORDER BY sim DESC, vec_id LIMIT 20")
def vector_acl_topk(spark, sf_dir):
    allowed = R.acl(spark, sf_dir).filter(F.col("principal").isin(ME.tokens)).select(F.col("email_id").alias("vec_id"))
    return vector.top_k(R.table(spark, sf_dir, "embeddings").join(allowed, "vec_id", "left_semi"), _query_vector(spark, sf_dir), 20)


@query(
    _with(R.EMAILS, R.ACL)
    + """SELECT question_id, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS question_id, e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS sim
      FROM embeddings q JOIN acl ON acl.principal = 'user:u' || (q.vec_id % 40) JOIN embeddings e ON e.vec_id = acl.email_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""
)
def vector_batch(spark, sf_dir):
    rows = R.table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.array(F.expr("concat('user:u', vec_id % 40)")).alias("tokens"), "embedding")
    guarded = vector.with_readers(rows.select("vec_id", "embedding"), R.acl(spark, sf_dir), asked, "vec_id")
    return vector.top_k_many(guarded, asked, 5, "vec_id").select("question_id", "vec_id", "sim", "rank")


def _lists(spark, sf_dir) -> dict[str, DataFrame]:
    texts = fuse.ranked(_best_by_words(spark, sf_dir, 20), "bm25")
    vectors = vector_acl_topk(spark, sf_dir).select(F.expr("vec_id * 10000").alias("chunk_id"), "sim")
    return {"bm25": texts, "vector": fuse.ranked(vectors, "vector", "sim")}


_FUSED = f"""b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM ({_bm25("AND p.chunk_id IN (SELECT chunk_id FROM readable)")})),
v AS (SELECT vec_id * 10000 AS chunk_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS r FROM (SELECT * FROM sims WHERE vec_id IN (SELECT email_id FROM mine) ORDER BY sim DESC, vec_id LIMIT 20)),
fused AS (SELECT coalesce(b.chunk_id, v.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + b.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 9) AS score, b.r AS bm25_rank, v.r AS vector_rank
          FROM b FULL JOIN v ON b.chunk_id = v.chunk_id)"""
_ALL_LISTS = _with(R.EMAILS, R.ACL, R.CHUNKS, _MINE, _MY_MAIL, _POSTINGS, _SIMS, _FUSED)


@query(_ALL_LISTS + "SELECT chunk_id, score, bm25_rank, vector_rank FROM fused")
def rrf_fuse(spark, sf_dir):
    rows = fuse.rrf(_lists(spark, sf_dir))
    return rows.select("chunk_id", "score", F.col("sources")["bm25"].cast("long").alias("bm25_rank"), F.col("sources")["vector"].cast("long").alias("vector_rank"))


@query(_ALL_LISTS + "SELECT f.chunk_id, score, email_id FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 8) f JOIN chunks USING (chunk_id)")
def hybrid_retrieve(spark, sf_dir):
    best = fuse.candidates(fuse.rrf(_lists(spark, sf_dir)), 8, reranked=False)
    mine = A.SecureCorpus(_stored_chunks(spark, sf_dir), R.acl(spark, sf_dir), ME).chunks()
    return best.join(mine, "chunk_id").select("chunk_id", "score", "email_id")


_RERANKED = "the thing from tion with token"


@query(
    _with(R.EMAILS, R.ACL, R.CHUNKS, _MINE, _POSTINGS, f"pool AS ({_bm25('AND p.chunk_id IN (SELECT chunk_id FROM readable)').replace('LIMIT 20', 'LIMIT 24')})")
    + rf"""SELECT chunk_id, round(len(list_intersect(string_split('{_RERANKED}', ' '), list_distinct(ws))) / sqrt((1 + len(ws))::DOUBLE), 9) AS score
    FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM pool JOIN chunks USING (chunk_id)) ORDER BY score DESC, chunk_id LIMIT 8"""
)
def rerank(spark, sf_dir):
    pool = _best_by_words(spark, sf_dir, 24).join(_stored_chunks(spark, sf_dir), "chunk_id")
    return fuse.rerank(pool.select("chunk_id", "score", "text"), fuse.overlap_scorer(_RERANKED), 8).select("chunk_id", F.round("score", 9).alias("score"))


@query()
def hash_embed(spark, sf_dir):
    rows = vector.table(R.chunks(spark, sf_dir), vector.HashEmbedder())
    return rows.select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("square"))


@query(
    """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark),
    f AS (SELECT item_id, unnest(ws) AS f FROM w UNION ALL SELECT item_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])) FROM w)
    SELECT item_id, CAST(('0x' || substr(md5(f), 1, 8)) AS BIGINT) % 512 AS bucket, CAST(sum(CASE WHEN CAST(('0x' || substr(md5(f), 9, 1)) AS BIGINT) >= 8 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM f GROUP BY ALL"""
)
def hash_embed_md5(spark, sf_dir):
    return vector.embed_md5(R.table(spark, sf_dir, "benchmark"), "item_id", "text")


# graph


@query(_with(R.TRADE) + "SELECT entity_id, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY entity_id")
def graph_mentions(spark, sf_dir):
    return R.trade_mentions(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(_with(R.EMAILS) + """SELECT sender AS src, unnest("to") AS dst, email_id * 10000 AS chunk_id FROM emails""")
def graph_edges_emailed(spark, sf_dir):
    return R.emails(spark, sf_dir).select(F.col("sender").alias("src"), F.explode("to").alias("dst"), F.expr("email_id * 10000").alias("chunk_id"))


@query(
    """WITH m AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS o FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, l_partkey) AS n FROM m QUALIFY n <= 10)
    SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.n < b.n"""
)
def graph_co_mentions(spark, sf_dir):
    members = R.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("o"))
    return graph.co_members(members, "l_orderkey", "l_partkey", "o")


@query(_with(R.TRADE) + "SELECT entity_id, round(ln(1 + (SELECT CAST(count(*) AS DOUBLE) FROM orders) / (1 + count(*))), 9) AS idf FROM mentions GROUP BY entity_id")
def graph_idf(spark, sf_dir):
    return graph.idf(R.trade_mentions(spark, sf_dir), R.table(spark, sf_dir, "orders").count())


_IDF = "idf AS (SELECT entity_id, round(ln(1 + (SELECT CAST(count(*) AS DOUBLE) FROM orders) / (1 + count(*))), 9) AS idf FROM mentions GROUP BY entity_id)"
_ADJACENT = "adj AS (SELECT src AS a, dst AS b, chunk_id FROM edges WHERE chunk_id IN (SELECT chunk_id FROM readable) UNION ALL SELECT dst, src, chunk_id FROM edges WHERE chunk_id IN (SELECT chunk_id FROM readable))"


@query(
    _with(
        R.TRADE, _IDF, _ADJACENT, "w0 AS (SELECT unnest(['c1', 's3']) AS node, 1.0::DOUBLE AS w)",
        "t1 AS (SELECT b, chunk_id FROM adj JOIN w0 ON a = node)",
        "f1 AS (SELECT b AS node, 0.5::DOUBLE AS w FROM (SELECT b, round(count(*) * coalesce(any_value(idf), 1), 6) AS s FROM t1 LEFT JOIN idf ON b = entity_id WHERE b NOT IN (SELECT node FROM w0) GROUP BY b ORDER BY s DESC, b LIMIT 25))",
        "w1 AS (SELECT * FROM w0 UNION ALL SELECT * FROM f1)",
        "t2 AS (SELECT b, chunk_id FROM adj JOIN f1 ON a = node)",
        "f2 AS (SELECT b AS node, 1.0::DOUBLE / 3 AS w FROM (SELECT b, round(count(*) * coalesce(any_value(idf), 1), 6) AS s FROM t2 LEFT JOIN idf ON b = entity_id WHERE b NOT IN (SELECT node FROM w1) GROUP BY b ORDER BY s DESC, b LIMIT 25))",
        "w2 AS (SELECT * FROM w1 UNION ALL SELECT * FROM f2)",
        "parts AS (SELECT chunk_id, w * coalesce(idf, 1) AS s FROM mentions m JOIN w2 ON m.entity_id = node LEFT JOIN idf ON m.entity_id = idf.entity_id WHERE chunk_id IN (SELECT chunk_id FROM readable) UNION ALL SELECT chunk_id, 0.5 FROM t1 UNION ALL SELECT chunk_id, 0.25 FROM t2)",
    )
    + "SELECT chunk_id, round(sum(s), 6) AS score FROM parts GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 50"
)
def graph_bfs_2hop(spark, sf_dir):
    lines = f"{sf_dir}/lineitem.parquet"
    edges = R.trade_edges(spark, sf_dir)
    adjacent = tables.indexed(spark, lines, "adjacency", lambda: graph.adjacency(edges))
    mentions = tables.indexed(spark, lines, "mentions", lambda: R.trade_mentions(spark, sf_dir))
    weights = tables.indexed(spark, lines, "idf", lambda: graph.idf(mentions, R.table(spark, sf_dir, "orders").count()))
    start = spark.createDataFrame([("c1",), ("s3",)], "node string")
    return graph.expand(start, edges, mentions, weights, readable=R.trade_readable(spark, sf_dir), adjacent=adjacent)


@query(
    """WITH e AS (SELECT p_partkey AS entity_id, lower(p_name) AS name, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'person' ELSE 'org' END AS type FROM part),
    a AS (SELECT entity_id, unnest(CASE WHEN type = 'person' AND len(string_split(lower(label), ' ')) >= 2 THEN [name, lower(label), string_split(lower(label), ' ')[1] || ' ' || string_split(lower(label), ' ')[-1], string_split(lower(label), ' ')[-1]] ELSE [name, lower(label)] END) AS alias FROM e)
    SELECT alias, min(entity_id) AS entity_id FROM a WHERE length(alias) >= 3 AND NOT list_contains([%s], alias) GROUP BY alias""".replace("%s", _quoted(fixed.COMMON_WORDS))
)
def alias_index(spark, sf_dir):
    entities = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.lower("p_name").alias("name"), F.col("p_name").alias("label"), F.expr("case when p_partkey % 2 = 0 then 'person' else 'org' end").alias("type"))
    return graph.aliases(entities)


#: Acronyms between signs that are no letters, digits or underscores in any script. Signs are doubled, so that two names can share one.
_ACRONYMS = r"""unnest(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_&])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][A-Z&]{1,6}[A-Z0-9])(?:$|[^\p{L}\p{N}_])', 1)) AS label"""
_NO_NAMES = ", ".join(f"'{w}'" for w in fixed.STOP_ACRONYMS)
_COMMON = _quoted(fixed.COMMON_WORDS)


@query(
    _with(
        R.CHUNKS,
        f"a AS (SELECT DISTINCT chunk_id, lower(label) AS name FROM (SELECT chunk_id, {_ACRONYMS} FROM chunks) WHERE NOT list_contains([{_NO_NAMES}], label))",
        "df AS (SELECT name, count(*) AS df FROM a GROUP BY name)",
        r"w AS (SELECT DISTINCT chunk_id, w AS name FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM chunks) WHERE regexp_full_match(w, '[a-z]{2,}'))",
        "lower_df AS (SELECT name, count(*) AS lower_df FROM w GROUP BY name)",
    )
    + f"SELECT name, CAST(df AS BIGINT) AS df FROM df LEFT JOIN lower_df USING (name) WHERE df BETWEEN 2 AND greatest(3, CAST(floor((SELECT count(*) FROM chunks) * 0.05) AS BIGINT)) AND NOT list_contains([{_COMMON}], name) AND NOT coalesce(lower_df, 0) >= greatest(3, df // 2)"
)
def doc_frequency_keep(spark, sf_dir):
    chunks = R.chunks(spark, sf_dir)
    each = chunks.select(F.explode(F.array_distinct(F.transform(graph.acronyms(F.col("text")), lambda a: F.lower(a)))).alias("name"))
    most = max(3, int(chunks.count() * 0.05))
    return graph.keep_frequent(each.groupBy("name").agg(F.count("*").alias("df")), graph.lower_words(chunks), 2, most)


_NAMED = f"a AS (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, {_ACRONYMS} FROM documents) WHERE NOT list_contains([{_NO_NAMES}], label))"


@query(_with(_NAMED) + "SELECT label, CASE WHEN length(label) >= 3 THEN 'project' ELSE 'other' END AS type, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY label")
def entity_extract_acronym(spark, sf_dir):
    each = R.table(spark, sf_dir, "documents").select("doc_id", F.explode(graph.acronyms(F.col("text"))).alias("label"))
    return each.groupBy("label", graph.acronym_type(F.col("label")).alias("type")).agg(F.count("*").alias("n"))


@query(_with(_NAMED) + "SELECT CASE WHEN length(label) >= 3 THEN 'project' ELSE 'other' END AS type, CAST(count(DISTINCT lower(label)) AS BIGINT) AS n FROM a GROUP BY 1")
def entity_type_counts(spark, sf_dir):
    each = R.table(spark, sf_dir, "documents").select(F.explode(graph.acronyms(F.col("text"))).alias("label"))
    entities = each.select(F.lower("label").alias("name"), graph.acronym_type(F.col("label")).alias("type")).distinct()
    return graph.type_counts(entities)


@query(_with(_NAMED, "e AS (SELECT lower(label) AS name, min(label) AS label, min(doc_id) AS entity_id FROM a GROUP BY 1 ORDER BY min(doc_id), 1 LIMIT 5)") + "SELECT label FROM e")
def graph_describe(spark, sf_dir):
    each = R.table(spark, sf_dir, "documents").select("doc_id", F.explode(graph.acronyms(F.col("text"))).alias("label"))
    entities = each.groupBy(F.lower("label").alias("name")).agg(F.min("label").alias("label"), F.min("doc_id").alias("first"))
    entities = entities.select(F.concat_ws(":", F.lpad(F.col("first").cast("string"), 12, "0"), "name").alias("entity_id"), "label")
    asked = [r["entity_id"] for r in entities.orderBy("entity_id").limit(5).collect()]
    return spark.createDataFrame([(x,) for x in graph.describe(asked, entities)], "label string")


@query()
def graph_build(spark, sf_dir):
    rows = R.emails(spark, sf_dir).select(F.col("email_id").alias("id"), F.concat("sender", F.lit("@example.com")).alias("sender"), F.struct(F.transform("to", lambda p: F.concat(p, F.lit("@example.com"))).alias("to"), F.array().cast("array<string>").alias("cc")).alias("recipients"))
    # names are looked for below a chunk's header line
    made = graph.build(R.chunks(spark, sf_dir).withColumn("text", F.concat(F.lit("header\n"), "text")), rows)
    return made["entities"].agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "n").unionByName(made["mentions"].agg(F.count("*").alias("n")).select(F.lit("mentions").alias("what"), "n")).unionByName(made["edges"].groupBy(F.col("rel").alias("what")).agg(F.count("*").alias("n")))


# ingest


@query("SELECT md5(text) AS content_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, array_to_string(list_sort(list(DISTINCT 'u' || (doc_id % 8))), ',') AS owners, array_to_string(list_sort(list(DISTINCT source || '/' || lang)), ',') AS folders FROM documents GROUP BY md5(text)")
def dedup_merge(spark, sf_dir):
    rows = R.table(spark, sf_dir, "documents").select(F.md5("text").alias("content_key"), "doc_id", "source", R.user("doc_id % 8").alias("owner"), F.concat_ws("/", "source", "lang").alias("folder"), F.col("doc_id").alias("ingest_ord"))
    merged = ingest.merge_copies(rows)
    return merged.select("content_key", "doc_id", "source", F.array_join("owners", ",").alias("owners"), F.array_join("folders", ",").alias("folders"))


@query(
    _with(
        R.EMAILS,
        r"p AS (SELECT email_id, date, unnest(string_split(body, chr(10))) AS p, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM emails)",
        r"k AS (SELECT *, lower(regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS key FROM p)",
        "f AS (SELECT key FROM k WHERE len(list_filter(string_split(key, ' '), lambda x: x <> '')) >= 6 GROUP BY key HAVING count(DISTINCT email_id) >= 20)",
        "r AS (SELECT k.*, f.key IS NOT NULL AND row_number() OVER (PARTITION BY k.key ORDER BY date, email_id, pos) > 1 AS gone FROM k LEFT JOIN f ON k.key = f.key)",
    )
    + r"SELECT email_id, md5(regexp_replace(coalesce(string_agg(p, chr(10) ORDER BY pos) FILTER (NOT gone), ''), '^\s+|\s+$', '', 'g')) AS body_md5, CAST(count(*) FILTER (gone) AS BIGINT) AS removed FROM r GROUP BY email_id"
)
def boilerplate_strip(spark, sf_dir):
    rows = ingest.strip_boilerplate(R.emails(spark, sf_dir), separator="\n", joiner="\n", min_words=6)
    return rows.select("email_id", F.md5("body").alias("body_md5"), "removed")


@query(_with(R.EMAILS) + "SELECT email_id, sha1(sender || chr(0) || date || chr(0) || subject || chr(0) || body || chr(0)) AS content_key FROM emails")
def content_key(spark, sf_dir):
    return R.emails(spark, sf_dir).select("email_id", T.content_key(F.col("sender"), F.col("date"), F.col("subject"), F.col("body")).alias("content_key"))


@query(
    _with(R.EMAILS)
    + r"SELECT email_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(subject)), '^(re:\s*)+', ''), '^(fw:\s*)+', ''), '^(fwd:\s*)+', ''), '^(re :\s*)+', ''), '^(fw :\s*)+', '') AS thread_key, regexp_replace(lower(subject), '^((re|fw|fwd)\s*:\s*)+', '') AS bare FROM emails"
)
def thread_key(spark, sf_dir):
    return R.emails(spark, sf_dir).select("email_id", T.thread_key(F.col("subject")).alias("thread_key"), T.bare_subject(F.col("subject")).alias("bare"))


@query(_with(R.EMAILS) + """SELECT email_id, 'From: ' || sender || ' | To: ' || array_to_string("to"[1:4], ', ') || ' | Date: ' || date[1:10] || ' | Subject: ' || CASE WHEN subject = '' THEN '(no subject)' ELSE subject END AS header FROM emails""")
def chunk_header(spark, sf_dir):
    return R.emails(spark, sf_dir).select("email_id", T.header(F.col("sender"), F.col("to"), F.col("date"), F.col("subject")).alias("header"))


#: What Unicode calls white space, for SQL; inside a class.
_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(
    rf"""WITH raw AS (SELECT doc_id, replace(text, chr(10), chr(10) || CASE WHEN doc_id % 3 = 0 THEN '> ' ELSE '' END) || CASE doc_id % 5 WHEN 0 THEN chr(10) || '-----Original Message-----' || chr(10) || 'old' WHEN 1 THEN chr(10) || 'On Mon, Vince wrote:' || chr(10) || 'old'
      WHEN 2 THEN chr(10) || '____________' || chr(10) || 'old' WHEN 3 THEN chr(10) || 'From: a' || chr(10) || 'Sent: b' ELSE chr(10) || '----- Forwarded by Vince -----' || chr(10) || 'kept' END AS b FROM documents),
    c AS (SELECT doc_id, regexp_replace(b, '(?s)\n[{_SPACE}]*(?:-----Original Message-----|On Mon, Vince wrote:|____________|From: a\nSent: ).*', CASE WHEN doc_id % 5 = 4 THEN '' ELSE chr(10) END) AS b FROM raw),
    l AS (SELECT doc_id, array_to_string(list_filter(string_split(b, chr(10)), lambda x: NOT regexp_matches(x, '^[{_SPACE}]*>')), chr(10)) AS b FROM c),
    f AS (SELECT doc_id, replace(b, '----- Forwarded by Vince -----', '{fixed.FORWARDED}') AS b FROM l)
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(b, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS body_md5 FROM f"""
)
def body_clean(spark, sf_dir):
    raw = F.expr(
        r"concat(replace(text, '\n', concat('\n', case when doc_id % 3 = 0 then '> ' else '' end)), case doc_id % 5 when 0 then '\n-----Original Message-----\nold' when 1 then '\nOn Mon, Vince wrote:\nold' "
        r"when 2 then '\n____________\nold' when 3 then '\nFrom: a\nSent: b' else '\n----- Forwarded by Vince -----\nkept' end)"
    )
    return R.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.body(raw)).alias("body_md5"))


@query("SELECT c_custkey, lower(trim(c_name)) || '@x.com' AS address FROM customer")
def address_normalise(spark, sf_dir):
    messy = F.concat(F.lit(" <"), "c_name", F.lit("@X.com> "))
    return R.table(spark, sf_dir, "customer").select("c_custkey", T.address(messy).alias("address"))


@query("SELECT s_suppkey, array_to_string(list_transform(list_filter(string_split_regex(lower(s_name), '[._\\-#]+'), lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]+$')), lambda p: upper(p[1]) || p[2:]), ' ') AS label FROM supplier")
def person_label(spark, sf_dir):
    return R.table(spark, sf_dir, "supplier").select("s_suppkey", T.person_label(F.translate(F.lower("s_name"), "#", "_")).alias("label"))


@query(
    """WITH owners AS (SELECT * FROM (VALUES (0, 'smith-j', 'john.smith@home'), (1, 'smith-k', 'k.smith@home'), (2, 'jones-p', 'p.jones@home')) AS o(ord, mailbox, owner)),
    addr AS (SELECT DISTINCT chr(97 + CAST(c_custkey % 26 AS INTEGER)) || ['', 'a', 'x.', 'yz_'][1 + c_nationkey % 4] || ['smith', 'jones', 'brown'][1 + CAST(c_custkey % 3 AS INTEGER)] || '@x.com' AS addr FROM customer)
    SELECT addr, arg_min(owner, ord) AS owner FROM addr JOIN owners ON regexp_matches(addr, '^' || string_split(mailbox, '-')[2][1] || '[a-z]*[._]?' || string_split(mailbox, '-')[1] || '@') GROUP BY addr"""
)
def alias_regex_join(spark, sf_dir):
    owners = spark.createDataFrame([(0, "smith-j", "john.smith@home"), (1, "smith-k", "k.smith@home"), (2, "jones-p", "p.jones@home")], "ord int, mailbox string, owner string")
    made = F.expr("concat(chr(97 + c_custkey % 26), element_at(array('', 'a', 'x.', 'yz_'), 1 + c_nationkey % 4), element_at(array('smith', 'jones', 'brown'), cast(1 + c_custkey % 3 as int)), '@x.com')")
    return ingest.match_aliases(R.table(spark, sf_dir, "customer").select(made.alias("addr")).distinct(), owners)


@query(_with(R.EMAILS, "alias AS (SELECT 'u' || x AS addr, 'u' || (x % 8) AS owner FROM range(0, 16) AS t(x))") + """SELECT email_id, array_to_string(list_transform(list_filter([[1, 0], [2, 0]], lambda z: z[1] = 1 OR n[1] <> n[2]), lambda z: n[z[1]]), ',') AS people FROM (SELECT email_id, [coalesce(a.owner, "to"[1]), coalesce(b.owner, "to"[2])] AS n FROM emails LEFT JOIN alias a ON a.addr = "to"[1] LEFT JOIN alias b ON b.addr = "to"[2])""")
def canonicalise(spark, sf_dir):
    aliases = spark.range(16).select(F.expr("concat('u', id)").alias("addr"), F.expr("concat('u', id % 8)").alias("owner"))
    rows = ingest.canonical(R.emails(spark, sf_dir).select("email_id", F.col("to").alias("people")), aliases)
    return rows.select("email_id", F.array_join("people", ",").alias("people"))


@query(_with(R.EMAILS) + "SELECT email_id, CASE WHEN email_id % 9 = 0 OR row_number() OVER (PARTITION BY CASE WHEN email_id % 9 = 0 THEN '' ELSE message_id END ORDER BY email_id) > 1 THEN md5(body) || '@palisade.local' ELSE message_id END AS message_id FROM emails")
def message_id_synthesis(spark, sf_dir):
    rows = R.emails(spark, sf_dir).select("email_id", F.expr("case when email_id % 9 = 0 then '' else message_id end").alias("message_id"), F.md5("body").alias("content_key"))
    return ingest.message_ids(rows, order="email_id").select("email_id", "message_id")


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_SPACE}]+'), lambda w: w <> '')"


def _folded(pieces: str, step: str) -> str:
    """A fold over a list of word lists: {out, held} with what is held at the end put out too. Elements and the result of a fold have one type."""
    empty = "{'out': CAST([] AS VARCHAR[][]), 'held': CAST([] AS VARCHAR[]), 's': CAST([] AS VARCHAR[])}"
    each = f"list_transform({pieces}, lambda s: {{'out': CAST([] AS VARCHAR[][]), 'held': CAST([] AS VARCHAR[]), 's': s}})"
    return f"list_transform([list_reduce({each}, lambda a, x: {step}, {empty})], lambda r: list_concat(r.out, CASE WHEN len(r.held) > 0 THEN [r.held] ELSE [] END))[1]"


def _state(out: str, held: str) -> str:
    return f"{{'out': {out}, 'held': {held}, 's': CAST([] AS VARCHAR[])}}"


_M, _O = chunking.MAX_WORDS, chunking.OVERLAP
_SENTENCE_STEP = (
    f"CASE WHEN len(x.s) > {_M} THEN "
    + _state(f"list_concat(a.out, CASE WHEN len(a.held) > 0 THEN [a.held] ELSE [] END, list_transform(range(1, len(x.s) + 1, {_M}), lambda i: x.s[i:i + {_M - 1}]))", "CAST([] AS VARCHAR[])")
    + f" WHEN len(a.held) + len(x.s) > {_M} THEN " + _state("list_append(a.out, a.held)", "x.s")
    + " ELSE " + _state("a.out", "list_concat(a.held, x.s)") + " END"
)
_PIECE_STEP = (
    f"CASE WHEN len(a.held) > 0 AND len(a.held) + len(x.s) > {_M} THEN "
    + _state("list_append(a.out, a.held)", f"list_concat(a.held[greatest(1, len(a.held) - {_O - 1}):], x.s)")
    + " ELSE " + _state("a.out", "list_concat(a.held, x.s)") + " END"
)


@query(
    _with(
        R.EMAILS,
        f"p AS (SELECT email_id, list_filter(regexp_split_to_array(body, '\\n[{_SPACE}]*\\n'), lambda p: regexp_matches(p, '[^{_SPACE}]')) AS ps FROM emails)",
        f"s AS (SELECT email_id, flatten(list_transform(ps, lambda p: CASE WHEN len({_words_sql('p')}) <= {_M} THEN [{_words_sql('p')}] ELSE "
        + _folded(f"list_transform(string_split(regexp_replace(p, '([.!?])[{_SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda t: {_words_sql('t')})", _SENTENCE_STEP)
        + " END)) AS pieces FROM p)",
        "k AS (SELECT email_id, " + _folded("pieces", _PIECE_STEP) + " AS chunks FROM s)",
        """h AS (SELECT email_id, length('From: ' || sender || ' | To: ' || array_to_string("to"[1:4], ', ') || ' | Date: ' || date[1:10] || ' | Subject: ' || CASE WHEN subject = '' THEN '(no subject)' ELSE subject END) AS n FROM emails)""",
    )
    + """SELECT email_id, CAST(i - 1 AS INTEGER) AS ord, CAST(n + CASE WHEN len(chunks) = 0 THEN 0 ELSE 1 + length(array_to_string(chunks[i], ' ')) END AS INTEGER) AS n_chars
    FROM (SELECT email_id, n, chunks, unnest(range(1, greatest(len(chunks), 1) + 1)) AS i FROM k JOIN h USING (email_id))"""
)
def chunk_pack(spark, sf_dir):
    rows = R.emails(spark, sf_dir).select(F.col("email_id").alias("id"), "sender", F.struct("to").alias("recipients"), "date", "subject", "body")
    return chunking.chunk(rows).select("email_id", "ord", F.length("text").alias("n_chars"))


@query(_with(R.EMAILS) + "SELECT email_id, length(body) AS n FROM emails WHERE length(body) BETWEEN 300 AND 6000")
def length_between(spark, sf_dir):
    return R.emails(spark, sf_dir).select("email_id", F.length("body").cast("long").alias("n")).filter(F.col("n").between(300, 6000))


# shingles, sentences, leaks

_GRAMS = """SELECT DISTINCT {id}, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT {id}, ws, unnest(range(1, len(ws) - 6)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM {table}) WHERE len(ws) >= 8)"""


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM ({_GRAMS.format(id='doc_id', table='documents')}) GROUP BY doc_id")
def shingles8(spark, sf_dir):
    grams = T.shingles(T.terms(F.col("text")), 8)
    return R.table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(grams)).cast("long").alias("n")).filter("n > 0")


@query(f"SELECT doc_id AS answer_id, item_id AS secret_id, CAST(count(*) AS BIGINT) AS n FROM ({_GRAMS.format(id='doc_id', table='documents')}) JOIN ({_GRAMS.format(id='item_id', table='benchmark')}) USING (g) GROUP BY ALL")
def leak_phrases(spark, sf_dir):
    return evals.leaked_runs(R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), "text"), R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("secret_id"), "text"))


@query(r"SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS BIGINT) AS n FROM documents")
def sentences(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT doc_id, substr(regexp_replace(text, '^[^\n]*\n', ''), 1, 280) AS snippet, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def snippet(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(n, range(1, len(n) + 1)), lambda z: list_position(n, z[1]) = z[2]), lambda z: z[1]), ',') AS cited FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all('see [' || (doc_id % 7) || '] and [' || (doc_id % 5) || '][' || (doc_id % 7) || '] or [12]', '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 5) AS n FROM documents)""")
def citations_parse(spark, sf_dir):
    answer = F.expr("concat('see [', doc_id % 7, '] and [', doc_id % 5, '][', doc_id % 7, '] or [12]')")
    return R.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.citations(answer, F.lit(5)).cast("array<string>"), ",").alias("cited"))


# cache


def _entries(spark, sf_dir):
    sims = vector.similarities(R.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    base = R.table(spark, sf_dir, "embeddings").select("vec_id", F.expr("concat('u', label)").alias("owner")).join(sims, "vec_id")
    mine = R.acl(spark, sf_dir).filter(F.col("principal").isin(ME.tokens)).select("email_id").distinct().withColumn("ok", F.lit(1))
    joined = base.join(mine, F.col("vec_id") == F.col("email_id"), "left")
    return joined.select(F.col("vec_id").alias("entry_id"), "owner", F.col("vec_id").cast("double").alias("created_at"), "sim", F.expr("case when vec_id % 10 = 0 then 0 else 1 end").alias("n_sources"), F.expr("case when vec_id % 10 = 0 or ok = 1 then 0 else 1 end").alias("n_unreadable"), F.expr("case when vec_id % 3 = 0 then 0.0D else 1.0D end").alias("coverage"))


def _cache(spark, sf_dir, mode):
    return cache.lookup(cache.statuses(_entries(spark, sf_dir), mode, "u7", 400.0, NEAR, 390.0))


def _cache_sql(case: str) -> str:
    return (
        _with(
            R.EMAILS, R.ACL, _MY_MAIL, _SIMS,
            f"e AS (SELECT vec_id, sim, CASE WHEN 400 - vec_id > 390 THEN 'expired' {case} ELSE 'hit' END AS status FROM (SELECT *, 'u' || label AS owner, vec_id % 10 = 0 AS bare, vec_id IN (SELECT email_id FROM mine) AS ok FROM sims WHERE sim >= {NEAR}))",
            "r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rn FROM e)",
            "h AS (SELECT coalesce(min(rn) FILTER (status = 'hit'), 1000000000) AS rn FROM r)",
        )
        + "SELECT (SELECT vec_id FROM r WHERE r.rn = (SELECT rn FROM h)) AS entry_id, CAST(count(*) FILTER (status = 'acl' AND r.rn < h.rn) AS BIGINT) AS blocked_acl, CAST(count(*) FILTER (status = 'scope' AND r.rn < h.rn) AS BIGINT) AS blocked_scope FROM r, h"
    )


@query(_cache_sql(""))
def cache_lookup_global(spark, sf_dir):
    return _cache(spark, sf_dir, "global")


@query(_cache_sql("WHEN owner <> 'u7' THEN 'other_owner'"))
def cache_lookup_per_user(spark, sf_dir):
    return _cache(spark, sf_dir, "per_user")


@query(_cache_sql("WHEN bare AND owner <> 'u7' THEN 'no_source' WHEN NOT bare AND NOT ok THEN 'acl' WHEN NOT bare AND vec_id % 3 = 0 THEN 'scope'"))
def cache_lookup_acl_aware(spark, sf_dir):
    return _cache(spark, sf_dir, "acl_aware")


def _asked_entries(spark, sf_dir, mode):
    """Every fiftieth vector as a question of a user, all of them as stored answers."""
    rows = R.table(spark, sf_dir, "embeddings")
    entries = rows.select(F.col("vec_id").alias("entry_id"), F.expr("concat('u', label)").alias("owner"), F.col("vec_id").cast("double").alias("created_at"), "embedding")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), R.user("vec_id % 40").alias("user"), F.array(F.concat(F.lit("user:"), R.user("vec_id % 40"))).alias("tokens"), "embedding")
    sources = entries.filter("entry_id % 10 <> 0").select("entry_id", F.col("entry_id").alias("email_id"))
    contexts = entries.select("entry_id", F.explode(F.expr("array(entry_id, entry_id div 2 * 2)")).alias("email_id"))
    first = asked.select("question_id", F.explode(F.expr("array(question_id, question_id + 2)")).alias("email_id")).withColumn("rank", F.col("email_id") - F.col("question_id"))
    return cache.lookup_many(entries, asked, sources, contexts, first, R.acl(spark, sf_dir), mode, 400.0, NEAR, 390.0, 0.5, k=2)


def _many_sql(case: str) -> str:
    return (
        _with(
            R.EMAILS, R.ACL,
            "pairs AS (SELECT q.vec_id AS question_id, 'u' || (q.vec_id % 40) AS asker, e.vec_id AS entry_id, 'u' || e.label AS owner, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)",
            f"near AS (SELECT p.*, a.email_id IS NOT NULL AS ok, entry_id % 10 = 0 AS bare, ((question_id IN (entry_id, entry_id // 2 * 2))::INT + ((question_id + 2) IN (entry_id, entry_id // 2 * 2))::INT) / 2.0 AS share FROM pairs p LEFT JOIN acl a ON a.email_id = entry_id AND a.principal = 'user:' || asker WHERE sim >= {NEAR})",
            f"e AS (SELECT *, CASE WHEN 400 - entry_id > 390 THEN 'expired' {case} ELSE 'hit' END AS status FROM near)",
            "r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, entry_id) AS rn FROM e)",
            "h AS (SELECT question_id, min(rn) AS rn FROM r WHERE status = 'hit' GROUP BY question_id)",
        )
        + "SELECT q.vec_id AS question_id, max(r.entry_id) FILTER (r.rn = h.rn) AS entry_id, CAST(count(*) FILTER (status = 'acl' AND (h.rn IS NULL OR r.rn < h.rn)) AS BIGINT) AS blocked_acl, CAST(count(*) FILTER (status = 'scope' AND (h.rn IS NULL OR r.rn < h.rn)) AS BIGINT) AS blocked_scope FROM embeddings q LEFT JOIN r ON r.question_id = q.vec_id LEFT JOIN h ON h.question_id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id"
    )


@query(_many_sql("WHEN owner <> asker THEN 'other_owner'"))
def cache_lookup_many_per_user(spark, sf_dir):
    return _asked_entries(spark, sf_dir, "per_user")


@query(_many_sql("WHEN bare AND owner <> asker THEN 'no_source' WHEN NOT bare AND NOT ok THEN 'acl' WHEN NOT bare AND share < 0.5 THEN 'scope'"))
def cache_lookup_many_acl_aware(spark, sf_dir):
    return _asked_entries(spark, sf_dir, "acl_aware")


@query(
    _with(R.CHUNKS, "got AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id % 97, chunk_id) AS rank FROM chunks)", "top AS (SELECT email_id FROM got JOIN chunks USING (chunk_id) GROUP BY email_id ORDER BY min(rank) LIMIT 3)", "ctx AS (SELECT chunk_id % 50 AS entry_id, email_id FROM chunks)")
    + "SELECT entry_id, count(DISTINCT email_id) FILTER (email_id IN (SELECT email_id FROM top)) / 3.0::DOUBLE AS coverage FROM ctx GROUP BY entry_id"
)
def cache_coverage(spark, sf_dir):
    chunks = R.chunks(spark, sf_dir)
    # only the order of ranks counts, so no window over all chunks numbers them
    got = chunks.select("chunk_id", F.struct(F.expr("chunk_id % 97").alias("k"), "chunk_id").alias("rank"))
    return cache.coverage(chunks.select(F.expr("chunk_id % 50").alias("entry_id"), "chunk_id"), got, chunks.select("chunk_id", "email_id"), 3)


@query(_with(R.AUDIT) + "SELECT entry_id, CAST(count(*) AS BIGINT) AS hits FROM audit WHERE cache_status = 'hit' GROUP BY entry_id")
def cache_hits(spark, sf_dir):
    return cache.hit_counts(R.audit(spark, sf_dir))


_TOKEN = cache.TOKEN.replace("'", "''")
_PLAIN = "replace(lower(regexp_replace({x}, '^[.,''-]+|[.,''-]+$', '', 'g')), ',', '')"
_FORMS = f"list_concat(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: {_PLAIN.format(x='x')}), regexp_extract_all(lower(text), '[a-z0-9]+'))"
_FOURS = f"""SELECT DISTINCT doc_id, id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, id, ws, unnest(range(1, len(ws) - 2)) AS i FROM
  (SELECT doc_id, id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{_COMMON}], w)) AS ws FROM {{table}}) WHERE len(ws) >= 4)"""


@query(
    _with(
        "d AS (SELECT doc_id, coalesce(text, '') AS answer FROM documents)",
        "c AS (SELECT doc_id, doc_id * 10000 + i - 1 AS id, i, trim(line) AS text FROM (SELECT doc_id, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM d) WHERE trim(line) <> '')",
        "ends AS (SELECT doc_id, min(id) AS cited, max(id) AS asked FROM c GROUP BY doc_id)",
        f"forms AS (SELECT DISTINCT doc_id, id, unnest({_FORMS}) AS t FROM c)",
        f"sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(answer, '{cache.CITATION}', ' ', 'g'), '([.!?:\\n])[{_SPACE}]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM d)",
        f"telling AS (SELECT DISTINCT doc_id, unnest(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: regexp_matches(z[1], '[0-9]|^[A-Z]{{2,}}$') OR (z[2] > 1 AND regexp_matches(z[1], '^[A-Z]'))), lambda z: {_PLAIN.format(x='z[1]')})) AS t FROM (SELECT doc_id, regexp_extract_all(s, '{_TOKEN}') AS ws FROM sentences))",
        f"novel AS (SELECT doc_id, t FROM telling WHERE t <> '' AND NOT list_contains([{_COMMON}, {', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in fixed.ANSWER_STOP_WORDS)}], t) AND (doc_id, t) NOT IN (SELECT doc_id, t FROM forms JOIN ends USING (doc_id) WHERE id IN (cited, asked)))",
        "whole AS (SELECT doc_id, doc_id AS id, regexp_replace(answer, '" + cache.CITATION + "', ' ', 'g') AS text FROM d)",
        f"said AS ({_FOURS.format(table='whole')})",
        f"fours AS ({_FOURS.format(table='c')})",
        "runs AS (SELECT doc_id, g FROM said WHERE (doc_id, g) NOT IN (SELECT doc_id, g FROM fours JOIN ends USING (doc_id) WHERE id = cited))",
        "deps AS (SELECT doc_id, cited AS id FROM ends UNION SELECT doc_id, id FROM forms JOIN novel USING (doc_id, t) UNION SELECT doc_id, id FROM fours JOIN runs USING (doc_id, g))",
    )
    + "SELECT d.doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS deps FROM d LEFT JOIN deps ON deps.doc_id = d.doc_id GROUP BY d.doc_id"
)
def answer_dependencies(spark, sf_dir):
    # the answer is the whole text and the context all its lines; the first is cited, the last asks
    docs = R.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("answer"))
    lines = F.transform(F.split("answer", "\n"), lambda line, k: F.struct((F.col("doc_id") * 10000 + k).alias("id"), F.trim(line).alias("text")))
    rows = docs.withColumn("context", F.filter(lines, lambda c: c["text"] != ""))
    rows = rows.withColumn("cited", F.slice("context.id", 1, 1)).withColumn("question", F.coalesce(F.try_element_at("context", F.lit(-1))["text"], F.lit("")))
    return cache.dependencies(rows).select("doc_id", F.array_join(F.col("deps").cast("array<string>"), ",").alias("deps"))


# routing and answers

_CUES = fixed.REASONING_CUES
_ROUTES = rf"""r AS (SELECT item_id, text AS question, item_id % 9 AS n_threads, item_id % 11 AS n_emails, item_id % 6 AS n_graph FROM benchmark),
f AS (SELECT item_id, least(len(list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '')) / 30.0::DOUBLE, 1) AS length, least(len(regexp_extract_all(question, '(?i)\b(?:{_CUES})\b')) / 2.0::DOUBLE, 1) AS reasoning_cues,
      least(greatest(n_threads - 1, 0) / 5.0::DOUBLE, 1) AS spread, least(greatest(n_emails - 2, 0) / 6.0::DOUBLE, 1) AS multi_email, least(n_graph / 4.0::DOUBLE, 1) AS graph FROM r)"""


@query(_with(_ROUTES) + "SELECT item_id, length, reasoning_cues, spread, multi_email, graph, array_to_string(list_transform(list_sort([(-0.15 * length, 0, 'length=' || format('{:.2f}', length)), (-0.40 * reasoning_cues, 1, 'reasoning_cues=' || format('{:.2f}', reasoning_cues)), (-0.20 * spread, 2, 'spread=' || format('{:.2f}', spread)), (-0.10 * multi_email, 3, 'multi_email=' || format('{:.2f}', multi_email)), (-0.15 * graph, 4, 'graph=' || format('{:.2f}', graph))])[1:2], lambda x: x[3]), ', ') AS reason, round(0.15 * length + 0.40 * reasoning_cues + 0.20 * spread + 0.10 * multi_email + 0.15 * graph, 6) AS difficulty, CASE WHEN round(0.15 * length + 0.40 * reasoning_cues + 0.20 * spread + 0.10 * multi_email + 0.15 * graph, 6) >= 0.5 THEN 'large' ELSE 'small' END AS model FROM f")
def router_features(spark, sf_dir):
    rows = R.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.expr("item_id % 9").alias("n_threads"), F.expr("item_id % 11").alias("n_emails"), F.expr("item_id % 6").alias("n_graph"))
    reason = F.regexp_extract("reason", r"\((.*)\)", 1).alias("reason")
    return routing.route(rows).select("item_id", "length", "reasoning_cues", "spread", "multi_email", "graph", reason, "difficulty", "model")


@query(_with(R.AUDIT) + "SELECT id, round((input_tokens * CASE model WHEN 'small' THEN 1.0::DOUBLE ELSE 5.0 END + output_tokens * CASE model WHEN 'small' THEN 1.0::DOUBLE ELSE 5.0 END * 0.1 + output_tokens * CASE model WHEN 'small' THEN 5.0::DOUBLE ELSE 25.0 END) / 1e6, 6) AS cost_usd FROM audit")
def cost_usd(spark, sf_dir):
    rows = R.audit(spark, sf_dir).select("id", "model", "input_tokens", "output_tokens", F.col("output_tokens").alias("cached_tokens"))
    return routing.with_cost(rows, {"small": (1.0, 5.0), "large": (5.0, 25.0)}, "large").select("id", "cost_usd")


_ANSWERER_STOP = ", ".join(f"'{w}'" for w in fixed.ANSWERER_STOP_WORDS)
_QUESTION = "of the thing and tion with erand"


@query(
    rf"""WITH q AS (SELECT list_filter(list_distinct(regexp_extract_all('{_QUESTION}', '[a-z0-9]+')), lambda w: NOT list_contains([{_ANSWERER_STOP}], w)) AS q),
    s AS (SELECT doc_id // 5 AS question_id, doc_id % 5 + 1 AS n, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^[^\n]*\n', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)),
    w AS (SELECT s.*, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')) AS ws, q FROM s, q),
    o AS (SELECT *, len(list_intersect(q, ws)) AS o FROM w),
    c AS (SELECT *, CASE WHEN o >= least(greatest(2, ceil(0.3 * len(q))), len(q)) THEN round(o / (1 + sqrt(len(ws)::DOUBLE)), 9) END AS score FROM o),
    b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC NULLS LAST, n, pos) AS rank FROM c QUALIFY rank <= 2)
    SELECT question_id, coalesce(string_agg(regexp_replace(s, '^\s+|\s+$', '', 'g') || ' [' || n || ']', ' ' ORDER BY rank) FILTER (score IS NOT NULL), '{fixed.NOT_FOUND.replace("'", "''")}') AS answer FROM b GROUP BY question_id"""
)
def extractive_answer(spark, sf_dir):
    context = R.table(spark, sf_dir, "documents").select(F.expr("doc_id div 5").alias("question_id"), F.expr("doc_id % 5 + 1").alias("n"), "text")
    return routing.extract_answers(context, F.lit(_QUESTION))


@query("""SELECT doc_id // 5 AS question_id, string_agg('<email n="' || (doc_id % 5 + 1) || '">' || chr(10) || text || chr(10) || '</email>', chr(10) ORDER BY doc_id) AS context FROM documents GROUP BY doc_id // 5""")
def prompt_context(spark, sf_dir):
    rows = R.table(spark, sf_dir, "documents").select(F.expr("doc_id div 5").alias("question_id"), F.expr("doc_id % 5 + 1").alias("n"), "text")
    return routing.prompt_context(rows)


# audit


@query(_with(R.AUDIT) + "SELECT count(*) AS queries, round(avg(CASE WHEN cache_status = 'hit' THEN 1.0::DOUBLE ELSE 0 END), 3) AS hit_rate, round(sum(cost_usd), 4) AS total_cost, round(avg(cost_usd), 6) AS avg_cost, round(quantile_cont(latency_ms, 0.5), 1) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 1) AS p95_ms, CAST(sum(n_events) AS BIGINT) AS security_events FROM audit")
def audit_metrics(spark, sf_dir):
    return audit.metrics(R.audit(spark, sf_dir))


@query(_with(R.AUDIT) + "SELECT coalesce(model, 'none') AS model, CAST(count(*) AS BIGINT) AS n FROM audit GROUP BY 1")
def audit_model_mix(spark, sf_dir):
    return audit.model_mix(R.audit(spark, sf_dir))


@query(_with(R.AUDIT) + "SELECT id, principal, cache_status FROM audit WHERE principal = 'u7' ORDER BY id DESC LIMIT 50")
def audit_recent(spark, sf_dir):
    return audit.recent(R.audit(spark, sf_dir), "u7").select("id", "principal", "cache_status")


@query(_with(R.AUDIT) + "SELECT id, principal FROM audit WHERE list_contains(retrieved, 42)")
def who_accessed(spark, sf_dir):
    return audit.who_accessed(R.audit(spark, sf_dir), 42).select("id", "principal")


@query(_with(R.AUDIT) + "SELECT c AS chunk_id, principal, CAST(count(*) AS BIGINT) AS n FROM (SELECT principal, unnest(retrieved) AS c FROM audit) GROUP BY ALL")
def access_counts(spark, sf_dir):
    return audit.accesses(R.audit(spark, sf_dir))


@query(_with(R.AUDIT, "o AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms, id) - 1 AS i, count(*) OVER () AS n FROM audit)") + "SELECT 'median' AS name, median(v) AS value FROM o UNION ALL SELECT 'p95', quantile_cont(v, 0.95) FROM o UNION ALL SELECT 'nearest_p95', v FROM o WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT) UNION ALL SELECT 'upper_median', v FROM o WHERE i = n // 2")
def percentile_variants(spark, sf_dir):
    log = R.audit(spark, sf_dir)
    return audit.percentiles(log).select(F.inline(F.expr("array(struct('median' as name, median as value), struct('p95' as name, p95 as value))"))).unionByName(audit.nearest_ranks(log))


@query(
    _with(R.AUDIT, "o AS (SELECT principal, latency_ms AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY principal) AS n FROM audit WHERE latency_ms IS NOT NULL WINDOW w AS (PARTITION BY principal ORDER BY latency_ms, id))")
    + "SELECT principal, name, round(value, 6) AS value FROM (SELECT principal, 'median' AS name, quantile_cont(v, 0.5) AS value FROM o GROUP BY principal UNION ALL SELECT principal, 'p95', quantile_cont(v, 0.95) FROM o GROUP BY principal UNION ALL SELECT principal, 'nearest_p95', v FROM o WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT) UNION ALL SELECT principal, 'upper_median', v FROM o WHERE i = n // 2)"
)
def percentiles_by_principal(spark, sf_dir):
    return audit.percentiles_by(R.audit(spark, sf_dir), ["principal"]).withColumn("value", F.round("value", 6))


# evaluation

_RANKED = """results AS (SELECT CASE l_linenumber % 2 WHEN 0 THEN 'a' ELSE 'b' END AS config, l_orderkey AS question_id, l_partkey % 20 AS doc, l_linenumber AS rank FROM lineitem),
relevant AS (SELECT DISTINCT o_orderkey AS question_id, (o_orderkey * 7 + j) % 20 AS doc FROM orders, range(0, 4) AS t(j)),
firsts AS (SELECT config, question_id, doc, min(rank) AS rank FROM results GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY config, question_id ORDER BY rank, doc) AS place FROM firsts),
marked AS (SELECT p.*, r.doc IS NOT NULL AS rel FROM placed p LEFT JOIN relevant r ON p.question_id = r.question_id AND p.doc = r.doc),
sizes AS (SELECT question_id, count(*) AS n FROM relevant GROUP BY question_id),
per AS (SELECT config, question_id, sum(CASE WHEN rel AND place <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS hits, min(place) FILTER (rel) AS first, coalesce(sum(1 / log2(place + 1)) FILTER (rel AND place <= 3), 0) AS dcg FROM marked GROUP BY config, question_id),
metrics AS (SELECT config, question_id, round(coalesce(hits, 0) / n, 6) AS recall, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, 1 + least(n, 3)), lambda i: 1 / log2(i + 1))), 6) AS ndcg
  FROM (SELECT question_id FROM relevant UNION SELECT question_id FROM results) q CROSS JOIN (SELECT DISTINCT config FROM results) LEFT JOIN sizes s USING (question_id) LEFT JOIN per USING (config, question_id))"""


def _rank_metrics(spark, sf_dir):
    lines, orders = R.table(spark, sf_dir, "lineitem"), R.table(spark, sf_dir, "orders")
    results = lines.select(F.expr("case l_linenumber % 2 when 0 then 'a' else 'b' end").alias("config"), F.col("l_orderkey").alias("question_id"), F.expr("l_partkey % 20").alias("doc"), F.col("l_linenumber").alias("rank"))
    relevant = orders.select(F.col("o_orderkey").alias("question_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("question_id", F.expr("(question_id * 7 + j) % 20").alias("doc"))
    return evals.rank_metrics(results, relevant, 3)


@query(_with(_RANKED) + "SELECT config, question_id, recall, hit, mrr, ndcg FROM metrics")
def rank_metrics(spark, sf_dir):
    return _rank_metrics(spark, sf_dir)


@query(_with(_RANKED) + "SELECT config, CASE WHEN grouping(b) = 1 THEN 'all' ELSE b END AS bucket, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT *, CASE WHEN question_id % 3 = 0 THEN 'multi-hop' ELSE 'single-hop' END AS b FROM metrics) GROUP BY GROUPING SETS ((config), (config, b))")
def ablation_rollup(spark, sf_dir):
    return evals.ablation(_rank_metrics(spark, sf_dir), F.expr("case when question_id % 3 = 0 then 'multi-hop' else 'single-hop' end"))


@query(_with(R.EMAILS, R.ACL) + r"SELECT e.email_id, CAST(n AS BIGINT) AS n_readers FROM emails e JOIN (SELECT email_id, count(*) AS n FROM acl GROUP BY email_id HAVING n BETWEEN 2 AND 4) USING (email_id) WHERE len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) >= 25 AND subject <> '' ORDER BY md5('7:' || e.email_id), e.email_id LIMIT 100")
def redteam_targets(spark, sf_dir):
    return evals.draw(evals.targets(R.emails(spark, sf_dir), R.acl(spark, sf_dir)), F.col("email_id"), 7, 100)


@query(
    _with(
        R.EMAILS, R.ACL,
        "owners AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT 'user:' || owner AS p FROM emails))",
        "o AS (SELECT e.email_id, p, (place - CAST('0x' || substr(md5('7:' || e.email_id), 1, 8) AS BIGINT) % n + n) % n AS i FROM emails e, owners WHERE NOT EXISTS (SELECT 1 FROM acl WHERE acl.email_id = e.email_id AND principal = p))",
    )
    + "SELECT email_id, arg_min(p, i) AS attacker FROM o GROUP BY email_id"
)
def redteam_attackers(spark, sf_dir):
    mails = R.emails(spark, sf_dir)
    return evals.attackers(mails, R.acl(spark, sf_dir), mails.select(F.concat(F.lit("user:"), "owner").alias("principal")))


_PROBE_SQL = " ".join(
    f"WHEN '{kind}' THEN " + "replace(replace(replace('" + template + "', '{who}', who), '{opening}', opening), '{subject}', subject)" for kind, template in fixed.PROBES.items()
)


@query(
    _with(R.EMAILS, r"m AS (SELECT email_id, subject, upper(sender[1]) || sender[2:] AS who, array_to_string(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')[1:14], ' ') AS opening FROM emails)")
    + f"SELECT email_id, kind, CASE kind {_PROBE_SQL} END AS question FROM m, (VALUES ('exact'), ('paraphrase'), ('injection')) AS k(kind)"
)
def redteam_probes(spark, sf_dir):
    return evals.probes(R.emails(spark, sf_dir))


_PHRASES = "phrases AS (SELECT item_id AS key, 'user:u' || (item_id % 40) AS token, g FROM (" + _GRAMS.format(id="item_id", table="benchmark") + "))"


@query(_with(R.EMAILS, R.ACL, R.CHUNKS, _PHRASES, "have AS (" + _GRAMS.format(id="chunk_id", table="chunks") + ")") + "SELECT DISTINCT key, g FROM phrases JOIN have USING (g) JOIN chunks USING (chunk_id) JOIN acl ON acl.email_id = chunks.email_id AND principal = token")
def phrase_readable(spark, sf_dir):
    items = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.array(F.expr("concat('user:u', item_id % 40)")).alias("tokens"), F.explode(F.array_distinct(T.shingles(T.terms(F.col("text")), 8))).alias("g"))
    return evals.readable_phrases(items, R.chunks(spark, sf_dir), R.acl(spark, sf_dir))


@query(ORACLE_SQL["phrase_readable"])
def phrase_positions(spark, sf_dir):
    items = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.array(F.expr("concat('user:u', item_id % 40)")).alias("tokens"), F.explode(F.array_distinct(T.shingles(T.terms(F.col("text")), 8))).alias("g"))
    index = _indexed(spark, sf_dir, "positions", lambda: positions.positions(_stored_chunks(spark, sf_dir)))
    return evals.readable_by_positions(items, index, R.acl(spark, sf_dir))


@query(_with(R.EMAILS) + "SELECT email_id, 'From: ' || sender || chr(10) || 'Date: ' || date[1:10] || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body[1:3000] AS text FROM emails")
def mail_prompt(spark, sf_dir):
    return R.emails(spark, sf_dir).select("email_id", T.mail_prompt(F.col("sender"), F.col("date"), F.col("subject"), F.col("body")).alias("text"))


@query(_with(R.EMAILS) + "SELECT email_id, date, row_number() OVER (ORDER BY date, email_id) AS place FROM emails ORDER BY date, email_id LIMIT 100")
def mails_by_date(spark, sf_dir):
    return ingest.first_mails(R.emails(spark, sf_dir), 100, "date", "email_id").select("email_id", "date", "place")


#: Retrieval without rights, then the cache's modes; each mail's stored answer is asked for by a rightful reader and by someone else.
CONFIGS = {"unfiltered": "off", "off": "off", "global": "global", "per_user": "per_user", "acl_aware": "acl_aware"}
LARGE_FROM = 300


def _outcomes(spark, sf_dir):
    """(config, email_id, kind, may, hit, leaks, tokens): what each of two askers gets for each mail, by the rights and the cache's own rules."""
    mails, rights = R.emails(spark, sf_dir), R.acl(spark, sf_dir)
    askers = F.array(F.struct(F.lit("second").alias("kind"), F.col("to")[0].alias("asker")), F.struct(F.lit("other").alias("kind"), R.user("(doc_id * 13 + 1) % 40").alias("asker")))
    mails = mails.withColumnRenamed("email_id", "doc_id")
    asks = mails.select(F.col("doc_id").alias("entry_id"), F.col("sender").alias("owner"), F.md5("body").alias("h"), T.token_estimate(F.col("body")).alias("tokens"), F.inline(askers))
    may = rights.select(F.col("email_id").alias("entry_id"), F.expr("substring(principal, 6)").alias("asker"), F.lit(True).alias("may")).distinct()
    same = rights.join(mails.select(F.col("doc_id").alias("email_id"), F.md5("body").alias("h")), "email_id").select(F.expr("substring(principal, 6)").alias("asker"), "h", F.lit(True).alias("known")).distinct()
    asks = asks.join(may, ["entry_id", "asker"], "left").join(same, ["asker", "h"], "left")
    asks = tables.settled(asks.withColumns({"may": F.coalesce("may", F.lit(False)), "known": F.coalesce("known", F.lit(False))}))
    stored = asks.withColumns({"created_at": F.lit(0.0), "sim": F.lit(1.0), "n_sources": F.lit(1), "n_unreadable": (~F.col("may")).cast("int"), "coverage": F.lit(1.0)})
    out = None
    for config, mode in CONFIGS.items():
        served = cache.statuses(stored, mode, F.col("asker"), 1.0, by=["kind"]).filter("status = 'hit'").select("entry_id", "kind", F.lit(True).alias("hit"))
        met = asks.join(served, ["entry_id", "kind"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        rows = met.select(
            F.lit(config).alias("config"), F.col("entry_id").alias("email_id"), "kind", "tokens", "hit",
            (F.lit(config == "unfiltered") & ~F.col("may")).alias("context_leak"),
            (F.col("hit") & ~F.col("may")).alias("cache_leak"),
            (F.col("hit") & ~F.col("may") & ~F.col("known")).alias("content_leak"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_OUTCOMES = """asks AS (SELECT email_id, sender, md5(body) AS h, CAST(greatest(1, length(body) // 4) AS INTEGER) AS tokens, "to"[1] AS asker, 'second' AS kind FROM emails
  UNION ALL SELECT email_id, sender, md5(body), CAST(greatest(1, length(body) // 4) AS INTEGER), 'u' || ((email_id * 13 + 1) % 40), 'other' FROM emails),
knows AS (SELECT DISTINCT principal, md5(body) AS h FROM acl JOIN emails USING (email_id)),
judged AS (SELECT a.*, EXISTS (SELECT 1 FROM acl WHERE acl.email_id = a.email_id AND acl.principal = 'user:' || asker) AS may, EXISTS (SELECT 1 FROM knows k WHERE k.h = a.h AND k.principal = 'user:' || asker) AS known FROM asks a),
outcomes AS (SELECT config, j.*, CASE config WHEN 'global' THEN true WHEN 'per_user' THEN asker = sender WHEN 'acl_aware' THEN may ELSE false END AS hit FROM judged j, (SELECT unnest(['unfiltered', 'off', 'global', 'per_user', 'acl_aware']) AS config))"""


@query(_with(R.EMAILS, R.ACL, _OUTCOMES) + "SELECT config, count(*) AS n, count(*) FILTER (config = 'unfiltered' AND NOT may) AS context_leak, count(*) FILTER (hit AND NOT may) AS cache_leak, count(*) FILTER (hit AND NOT may AND NOT known) AS content_leak, round(avg(hit::INT::DOUBLE) FILTER (kind = 'second'), 3) AS served_rate FROM outcomes GROUP BY config")
def leak_tallies(spark, sf_dir):
    return evals.leak_tallies(_outcomes(spark, sf_dir).withColumns({"is_second_reader": F.col("kind") == "second", "served": F.col("hit")}))


@query(
    _with(
        R.EMAILS, R.ACL, _OUTCOMES,
        f"c AS (SELECT config, hit, NOT hit AND tokens >= {LARGE_FROM} AS large, CASE WHEN hit THEN 0 ELSE round((tokens * CASE WHEN tokens >= {LARGE_FROM} THEN 5.0::DOUBLE ELSE 1.0 END + 100 * CASE WHEN tokens >= {LARGE_FROM} THEN 25.0::DOUBLE ELSE 5.0 END) / 1e6, 6) END AS cost FROM outcomes)",
        "p AS (SELECT config, count(*) AS n, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(large::INT::DOUBLE), 6) AS large_share, round(sum(cost), 6) AS cost FROM c GROUP BY config)",
    )
    + "SELECT *, round(1 - cost / (SELECT cost FROM p WHERE config = 'off'), 6) AS savings FROM p"
)
def cache_bench(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).withColumns({"model": F.when(F.col("tokens") >= LARGE_FROM, "large").otherwise("small"), "input_tokens": F.col("tokens"), "output_tokens": F.lit(100), "cached_tokens": F.lit(0)})
    priced = routing.with_cost(rows, {"small": (1.0, 5.0), "large": (5.0, 25.0)}, "large")
    runs = priced.select("config", "hit", (~F.col("hit") & (F.col("model") == "large")).alias("large"), F.when(F.col("hit"), 0.0).otherwise(F.col("cost_usd")).alias("cost_usd"))
    return evals.cache_tallies(runs, "off")


@query("SELECT event_type AS generation, round(avg(value), 6) AS faithfulness, round(avg(user_id), 6) AS relevance, round(avg((user_id % 2)::DOUBLE), 6) AS correct, round(avg((user_id % 3 = 0)::INT::DOUBLE), 6) AS large, round(avg(value / 100), 6) AS cost_usd FROM events GROUP BY event_type")
def answer_quality(spark, sf_dir):
    rows = R.table(spark, sf_dir, "events").selectExpr("event_type as generation", "value as faithfulness", "user_id as relevance", "user_id % 2 as correct", "user_id % 3 = 0 as large", "value / 100 as cost_usd")
    return evals.quality_means(rows)


@query(_with(R.EMAILS, R.ACL, "s AS (SELECT email_id, list_sort(list(principal)) AS p FROM acl GROUP BY email_id HAVING count(*) BETWEEN 3 AND 12)") + "SELECT email_id, CAST(i - 1 AS INTEGER) AS i, p[i] AS reader, CAST((i - 1) % 4 AS INTEGER) AS template FROM (SELECT email_id, p, unnest(range(1, 1 + least(len(p), 4))) AS i FROM s)")
def workload(spark, sf_dir):
    return evals.workload(R.emails(spark, sf_dir), R.acl(spark, sf_dir))


@query("SELECT 'p' || l_partkey AS entity_id, CAST(count(DISTINCT l_orderkey // 4) AS BIGINT) AS n_emails FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey // 4) BETWEEN 2 AND 30")
def shared_entities(spark, sf_dir):
    lines = R.table(spark, sf_dir, "lineitem")
    mentions = lines.select(F.expr("concat('p', l_partkey)").alias("entity_id"), F.col("l_orderkey").alias("chunk_id")).distinct()
    entities = mentions.select("entity_id").distinct().withColumn("type", F.lit("project"))
    chunks = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.expr("o_orderkey div 4").alias("email_id"))
    return evals.shared_entities(mentions, entities, chunks)


@query("WITH m AS (SELECT DISTINCT l_partkey, l_orderkey, l_orderkey % 3 AS t FROM lineitem), k AS (SELECT l_partkey FROM m GROUP BY l_partkey HAVING count(*) BETWEEN 2 AND 30) SELECT a.l_partkey AS entity_id, a.l_orderkey AS a, b.l_orderkey AS b FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey AND a.t <> b.t WHERE a.l_partkey IN (SELECT l_partkey FROM k)")
def multi_hop_pairs(spark, sf_dir):
    members = R.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("email_id"), F.expr("l_orderkey % 3").alias("thread")).distinct()
    few = members.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n between 2 and 30")
    return evals.hop_pairs(members.join(few, "entity_id", "left_semi"))


@query(
    r"""WITH s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)),
    w AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS ws FROM s)
    SELECT doc_id AS email_id, arg_min(array_to_string(ws[1:8], ' '), md5('3:' || doc_id || ':' || pos)) AS phrase FROM w WHERE len(ws) BETWEEN 8 AND 30 GROUP BY doc_id"""
)
def question_sentences(spark, sf_dir):
    return evals.question_sentences(R.emails(spark, sf_dir))
