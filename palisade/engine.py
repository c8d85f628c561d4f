"""Asking questions over a corpus one principal at a time, with a shared answer cache and an audit log.

An engine holds DataFrames, of a store or given: chunks, rights, postings, vectors, the graph.
What a corpus has one of (statistics, vectors, idf, aliases) is made once and written, not
worked out for each question. A question runs as a few Spark jobs whose results are bounded
(the best chunks, one cache decision), and the answer is put together on the driver.
Replays (`palisade.replays`) are loops over questions, as each may leave an answer that
serves the next.
"""

from __future__ import annotations

import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import text as T
from palisade.models import ANSWERING, Model, Offline, Prompt, Reply, estimate
from palisade.operators import acl as A
from palisade.operators import audit, batch, blockmax, cache, fuse, graph, lexical, routing, vector
from palisade.operators.acl import Principal, SecureCorpus
from palisade.sources.files import Directory, Settings
from palisade.sources.tables import Store, delete, settled, shared_dir

#: (question, numbered context) -> answer with [n] citations
Answerer = Callable[[str, list[tuple[int, str]]], str]

#: Principals whose readable chunks are kept as a table between questions.
KEPT_PRINCIPALS = 256


@dataclass
class Answer:
    question: str
    text: str
    cache_status: str
    model: str = "none"
    reason: str = ""
    retrieved: list[int] = field(default_factory=list)
    cited: list[int] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    input_tokens: int = 0
    output_tokens: int = 0
    cost_usd: float = 0.0
    latency_ms: float = 0.0

    def to_dict(self) -> dict:
        out = {**self.__dict__, "answer": self.text, "cost_usd": round(self.cost_usd, 6), "latency_ms": round(self.latency_ms, 1)}
        del out["text"]
        return out


class _Plain:
    """A model around a plain function of question and context."""

    def __init__(self, answer: Answerer):
        self.answer = answer

    def complete(self, system: str, prompt: Prompt, model: str) -> Reply:
        said = self.answer(prompt.question, prompt.context)
        return Reply(said, model, estimate(system + prompt.text()), estimate(said))

    def complete_json(self, system: str, prompt: str, model: str, schema: dict) -> tuple[dict, Reply]:
        raise NotImplementedError("a plain answerer fills no schemas")


class Answers:
    """Stored answers: entries in memory until `save`, which appends them to a table.

    An entry keeps its question's vector, whose answer it is, what the answer hangs on
    (sources) and what the model was shown (context; the sources where that is not known).
    """

    KIND = "entry_id long, created_at double, owner string, question string, embedding array<float>, answer string, model string, cited array<long>, source_chunks array<long>, context_chunks array<long>"

    def __init__(self, spark: SparkSession, mode: str = "acl_aware", threshold: float = fixed.CACHE_THRESHOLD, ttl: float = fixed.CACHE_TTL_SECONDS, min_coverage: float = 1.0, coverage_k: int = 1, store: Store | None = None):
        if mode not in cache.MODES:
            raise ValueError(f"mode must be one of {cache.MODES}")
        self.spark, self.mode, self.threshold, self.ttl, self.min_coverage, self.coverage_k = spark, mode, threshold, ttl, min_coverage, coverage_k
        self.saved_in, self.fresh, self.hits = store, [], []
        self.load()

    def load(self) -> None:
        """The answers of the store's table; entries that were not saved are dropped."""
        there = self.saved_in is not None and self.saved_in.has("cache_entries")
        self.saved = self.saved_in.read("cache_entries") if there else None
        self.fresh = []
        self.count = self.saved.count() if there else 0
        self.last = self.saved.agg(F.max("entry_id")).first()[0] or 0 if there else 0

    def save(self) -> None:
        if self.saved_in is not None and self.fresh:
            self.saved_in.append("cache_entries", self.spark.createDataFrame(self.fresh, self.KIND))
            self.load()

    def clear(self) -> None:
        if self.saved_in is not None:
            self.saved_in.drop("cache_entries")
        self.load()

    def __len__(self) -> int:
        return self.count + len(self.fresh)

    def table(self) -> DataFrame:
        new = self.spark.createDataFrame(self.fresh, self.KIND)
        rows = new if self.saved is None else self.saved.unionByName(new)
        return rows.withColumn("context_chunks", F.coalesce("context_chunks", "source_chunks"))

    def add(self, question: str, query: list[float], owner: str, answer: Answer, sources: list[int], context: list[int] | None = None) -> None:
        if self.mode != "off":
            self.last += 1
            self.fresh.append((self.last, time.time(), owner, question, [float(x) for x in query], answer.text, answer.model, answer.cited, sources, context))

    def lookup(self, query: list[float], who: Principal, corpus: SecureCorpus, retrieved: list[tuple[int, int]]) -> tuple[dict | None, int, int]:
        """(entry or none, entries turned away for rights, for scope); retrieved are (chunk_id, email_id), best first.

        All in one job: of the entries near enough the sources are held against what `who` may
        read, and the first mails retrieved against what the entry's model was shown.
        """
        if self.mode == "off" or not len(self):
            return None, 0, 0
        top = list(dict.fromkeys(mail for _, mail in retrieved))[: self.coverage_k]
        table = self.table()
        near = table.join(vector.similarities(table, query, "entry_id", digits=None).filter(F.col("sim") >= self.threshold), "entry_id")
        kept = near.select("entry_id", "owner", "created_at", "sim", F.size("source_chunks").alias("n_sources"))
        if self.mode == "acl_aware":
            sources = near.select("entry_id", F.explode("source_chunks").alias("chunk_id"))
            bad = sources.groupBy("entry_id").agg(F.lit(0).alias("n_unreadable")).limit(0) if who.is_auditor else sources.join(corpus.readable(), "chunk_id", "left_anti").groupBy("entry_id").agg(F.count("*").alias("n_unreadable"))
            kept = kept.join(bad, "entry_id", "left")
            if top:
                shown = near.select("entry_id", F.explode("context_chunks").alias("chunk_id")).join(corpus.all_chunks.select("chunk_id", "email_id"), "chunk_id")
                share = shown.filter(F.col("email_id").isin(top)).groupBy("entry_id").agg((F.count_distinct("email_id") / len(top)).alias("coverage"))
                kept = kept.join(share, "entry_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
            else:
                kept = kept.withColumn("coverage", F.lit(1.0))
        else:
            kept = kept.withColumns({"n_unreadable": F.lit(0), "coverage": F.lit(1.0)})
        judged = cache.statuses(kept.withColumn("n_unreadable", F.coalesce("n_unreadable", F.lit(0))), self.mode, who.user, time.time(), self.threshold, self.ttl, self.min_coverage)
        row = cache.lookup(judged).first()
        if row["entry_id"] is None:
            return None, row["blocked_acl"], row["blocked_scope"]
        self.hits.append((row["entry_id"], time.time()))
        return table.filter(F.col("entry_id") == row["entry_id"]).first().asDict(), row["blocked_acl"], row["blocked_scope"]

    def lookup_many(self, questions: DataFrame, retrieved: DataFrame, chunks: DataFrame, acl: DataFrame) -> DataFrame:
        """(question_id, entry_id, blocked_acl, blocked_scope): what `lookup` gives for each of questions(question_id, user, tokens, embedding).

        retrieved(question_id, chunk_id, rank) is what `retrieve_many` finds. The number of jobs
        does not grow with questions or entries; hits are not counted here.
        """
        table, owners = self.table(), chunks.select("chunk_id", "email_id")
        mails = lambda ids: table.select("entry_id", F.explode(ids).alias("chunk_id")).join(owners, "chunk_id", "left").select("entry_id", "email_id")
        first = retrieved.select("question_id", "chunk_id", "rank").join(owners, "chunk_id")
        return cache.lookup_many(table, questions, mails("source_chunks"), mails("context_chunks"), first, acl, self.mode, time.time(), self.threshold, self.ttl, self.min_coverage, self.coverage_k, digits=12)

    def hit_counts(self) -> DataFrame:
        """(entry_id, hits) of this engine's answers."""
        return self.spark.createDataFrame(self.hits, "entry_id long, at double").groupBy("entry_id").agg(F.count("*").alias("hits"))


class Engine:
    """chunks(chunk_id, email_id, text), acl(email_id, principal), subjects(email_id, subject); the rest is optional."""

    def __init__(
        self,
        spark: SparkSession,
        chunks: DataFrame,
        acl: DataFrame,
        subjects: DataFrame,
        settings: Settings | None = None,
        directory: Directory | None = None,
        answerer: Answerer | Model | None = None,
        prices: dict[str, tuple[float, float]] | None = None,
        known: dict[str, DataFrame] | None = None,
        embedder: vector.Embedder | None = None,
        index: dict[str, DataFrame] | None = None,
        scorer: Callable[[str], Callable] = fuse.overlap_scorer,
        store: Store | None = None,
    ):
        self.spark, self.chunks, self.acl, self.subjects = spark, chunks, acl, subjects
        self.settings, self.directory = settings or Settings(), directory or Directory()
        self.model: Model = answerer if hasattr(answerer, "complete") else _Plain(answerer) if answerer else Offline(spark)
        self.prices = prices or {self.settings.small_model: (1.0, 5.0), self.settings.large_model: (5.0, 25.0)}
        self.known, self.embedder, self.scorer, self.store, self.log = known, embedder or vector.HashEmbedder(), scorer, store, []
        self.index, self.words = dict(index or {}), None  # words: the store's blocks of postings
        self.answers = self._answers()
        self._readable: OrderedDict[tuple, tuple[int, DataFrame, str]] = OrderedDict()

    @classmethod
    def of_store(cls, store: Store, settings: Settings | None = None, embedder: vector.Embedder | None = None, **options) -> Engine:
        """An engine over stored tables; vectors of another embedder are refused."""
        model = embedder or vector.HashEmbedder()
        index = {"lengths": store.read("lengths"), "vectors": store.vectors(model)}
        known = {n: store.read(n) for n in ("entities", "mentions", "edges")} if store.has("entities") else None
        subjects = store.read("emails").select(F.col("id").alias("email_id") if "id" in store.read("emails").columns else "email_id", "subject")
        engine = cls(store.spark, store.read("chunks"), store.read("acl"), subjects, settings, known=known, embedder=model, index=index, store=store, **options)
        engine.words = store.index()
        return engine

    def _answers(self) -> Answers:
        s = self.settings
        return Answers(self.spark, s.cache_mode, s.cache_threshold, s.cache_ttl_seconds, store=self.store)

    # what a corpus has one of

    def _part(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.index:
            path = f"{shared_dir(self.spark)}/engine-{name}-{uuid.uuid4().hex}"
            build().write.parquet(path)
            self.index[name] = self.spark.read.parquet(path)
        return self.index[name]

    def vectors(self) -> DataFrame:
        return self._part("vectors", lambda: vector.table(self.chunks, self.embedder)).select("chunk_id", "embedding")

    @cached_property
    def n_chunks(self) -> int:
        return self._part("lengths", lambda: lexical.statistics(self.chunks)).first()["n"]

    def best_by_words(self, terms: list[str], readable: DataFrame, limit: int) -> DataFrame:
        if self.words is not None:
            return blockmax.search(self.words, readable, terms, limit)
        index = self._part("postings", lambda: lexical.sorted_postings(self.chunks))
        return lexical.search_index(index, self._part("lengths", lambda: lexical.statistics(self.chunks)), readable, terms, limit)

    def idf(self) -> DataFrame:
        return self._part("idf", lambda: graph.idf(self.known["mentions"], self.n_chunks))

    def aliases(self) -> DataFrame:
        return self._part("aliases", lambda: graph.aliases(self.known["entities"]))

    # principals

    def principal(self, user: str) -> Principal:
        return Principal.of(user, self.directory.groups_of(user))

    def principals(self) -> DataFrame:
        return self.acl.filter(F.col("principal").startswith("user:")).select(F.substring("principal", 6, 2**20).alias("user")).distinct()

    def corpus(self, who: Principal) -> SecureCorpus:
        """What `who` may read; the rows' ids are kept as a table for the last KEPT_PRINCIPALS, until rights change."""
        whole = SecureCorpus(self.chunks, self.acl, who)
        if who.is_auditor or self.store is None:
            return whole
        key, version = tuple(who.tokens), self.store.version()
        if key in self._readable and self._readable[key][0] != version:
            delete(self._readable.pop(key)[2])
        if key not in self._readable:
            path = f"{shared_dir(self.spark)}/readable-{uuid.uuid4().hex}"
            whole.readable().write.parquet(path)
            self._readable[key] = (version, self.spark.read.parquet(path), path)
            if len(self._readable) > KEPT_PRINCIPALS:
                delete(self._readable.popitem(last=False)[1][2])
        self._readable.move_to_end(key)
        return SecureCorpus(self.chunks, self.acl, who, self._readable[key][1])

    def unreadable(self, who: Principal, ids: list[int]) -> set[int]:
        """From the table of rights itself, whatever is kept."""
        if not ids:
            return set()
        rows = self.spark.createDataFrame([(i,) for i in ids], "chunk_id long")
        return {r["chunk_id"] for r in SecureCorpus(self.chunks, self.acl, who).unreadable(rows).collect()}

    # questions

    def terms(self, question: str) -> list[str]:
        return self.spark.createDataFrame([(question,)], "q string").select(T.query_terms(F.col("q")).alias("t")).first()["t"]

    def seeds(self, question: str) -> list:
        return graph.seeds(question, self.aliases()) if self.known is not None else []

    def describe(self, question: str) -> list[str]:
        """The names of the entities that a question is about, in its order."""
        return graph.describe(self.seeds(question), self.known["entities"]) if self.known is not None else []

    def retrieve(self, question: str, who: Principal, settings: Settings | None = None) -> list[tuple[int, int, str, bool]]:
        """(chunk_id, email_id, text, from the graph) of the best chunks that `who` may read, best first."""
        s, corpus = settings or self.settings, self.corpus(who)
        lists: dict[str, DataFrame] = {}
        terms = self.terms(question) if s.retrieval_mode in ("hybrid", "bm25") else []
        if terms:
            lists["bm25"] = fuse.ranked(self.best_by_words(terms, corpus.readable(), s.candidate_k), "bm25")
        if s.retrieval_mode in ("hybrid", "vector"):
            best = vector.top_k(corpus.only(self.vectors()), self.embedder.query(question).tolist(), s.candidate_k, "chunk_id")
            lists["vector"] = fuse.ranked(best, "vector", "sim")
        seeds = self.seeds(question) if s.use_graph else []
        if seeds:
            start = self.spark.createDataFrame([(x,) for x in seeds], "node string")
            lists["graph"] = fuse.ranked(graph.expand(start, self.known["edges"], self.known["mentions"], self.idf(), limit=s.candidate_k, readable=corpus.readable(), adjacent=self.adjacent()), "graph")
        if not lists:
            return []
        pool = fuse.candidates(fuse.rrf(lists), s.top_k, s.use_reranker)
        rows = pool.join(corpus.chunks(), "chunk_id")
        if s.use_reranker:
            rows = fuse.rerank(rows, self.scorer(question), s.top_k)
        found = rows.orderBy(F.desc("score"), "chunk_id").select("chunk_id", "email_id", "text", F.map_contains_key("sources", "graph").alias("g")).collect()
        return [tuple(r) for r in found]

    def word_index(self) -> blockmax.Index:
        """The blocks of postings: the store's, or made of the chunks once."""
        if self.words is None:
            parts = {"blocks": blockmax.blocks, "term_counts": blockmax.term_counts, "length_counts": blockmax.length_counts}
            self.words = blockmax.Index(*[self._part(name, lambda f=f: f(self.chunks)) for name, f in parts.items()])
        return self.words

    def adjacent(self) -> DataFrame:
        return self._part("adjacency", lambda: graph.adjacency(self.known["edges"]))

    def retrieve_many(self, questions: DataFrame, settings: Settings | None = None) -> DataFrame:
        """(question_id, chunk_id, email_id, text, from_graph, rank) for questions(question_id, question, principal).

        The rows of `retrieve` for each question, in a number of jobs that doesn't grow with
        the questions. Their principals, few of them, are resolved on the driver.
        """
        s, spark = settings or self.settings, self.spark
        users = [(r["principal"], self.principal(r["principal"]).tokens) for r in questions.select("principal").distinct().collect()]
        tokens = spark.createDataFrame(users, "principal string, tokens array<string>")
        asked = settled(questions.select("question_id", "question", "principal").join(F.broadcast(tokens), "principal").withColumn("terms", T.query_terms(F.col("question"))))
        owners, lists = self.chunks.select("chunk_id", "email_id"), {}
        if s.retrieval_mode in ("hybrid", "bm25"):
            lists["bm25"] = blockmax.search_many(self.word_index(), asked, self.acl, s.candidate_k)
        if s.retrieval_mode in ("hybrid", "vector"):
            guarded = vector.with_readers(self.vectors().join(owners, "chunk_id"), self.acl, asked)
            lists["vector"] = vector.top_k_many(guarded, vector.embed_questions(asked, self.embedder), s.candidate_k)
        if s.use_graph and self.known is not None:
            start = batch.seeds(asked, self.aliases()).select("question_id", F.col("entity_id").alias("node"))
            lists["graph"] = batch.expand(start, self.adjacent(), self.known["mentions"], self.idf(), owners, asked, self.acl, limit=s.candidate_k, settle=settled)
        fused = fuse.rrf(lists, by=("question_id", "chunk_id"))
        pool = batch.best(fused, fuse.pool_size(s.top_k, s.use_reranker)).drop("rank")
        # the guard of `retrieve`: texts are read through the rights once more
        rows = A.allowed(pool.join(self.chunks.select("chunk_id", "email_id", "text"), "chunk_id"), asked, self.acl)
        rows = rows.join(asked.select("question_id", "question"), "question_id").withColumn("from_graph", F.map_contains_key("sources", "graph")).drop("sources")
        rows = batch.rerank(rows, self.scorer, s.top_k) if s.use_reranker else batch.best(rows, s.top_k)
        return rows.select("question_id", "chunk_id", "email_id", "text", "from_graph", "rank")

    def ask(self, question: str, user: str, model: str | None = None) -> Answer:
        began, who = time.perf_counter(), self.principal(user)
        context = self.retrieve(question, who)
        events, leaked = [], self.unreadable(who, [c[0] for c in context])
        if leaked:  # every list is filtered already; a row here would be a fault
            events.append(f"ACL_GUARD_BLOCKED chunks={sorted(leaked)}")
            context = [c for c in context if c[0] not in leaked]
        query = self.embedder.query(question).tolist()
        entry, blocked, _ = self.answers.lookup(query, who, self.corpus(who), [(c[0], c[1]) for c in context])
        if blocked:
            events.append(f"CACHE_ACL_BLOCKED entries={blocked}")
        if entry is not None:
            shown = self.unreadable(who, entry["source_chunks"])
            if shown:
                events.append(f"CACHE_LEAK served_unreadable_chunks={sorted(shown)} owner={entry['owner']}")
            answer = Answer(question, entry["answer"], "hit", entry["model"], f"cache entry {entry['entry_id']}", entry["source_chunks"], entry["cited"], events)
        elif not context:
            answer = Answer(question, fixed.NOT_FOUND, "bypass", reason="no readable context", events=events)
        else:
            answer = self._generate(question, context, model, events)
            if self.answers.mode != "off":
                self.answers.add(question, query, who.user, answer, self._sources(question, answer, context), [c[0] for c in context])
        answer.latency_ms = (time.perf_counter() - began) * 1000
        self.log.append((len(self.log) + 1, who.user, sorted(who.groups), answer))
        return answer

    def _generate(self, question: str, context: list, model: str | None, events: list[str]) -> Answer:
        s = self.settings
        emails = list(dict.fromkeys(c[1] for c in context))
        chosen, reason = model, "forced"
        if not model:
            ids = self.spark.createDataFrame([(e,) for e in emails], "email_id long")
            threads = self.subjects.join(F.broadcast(ids), "email_id", "left_semi").select(T.bare_subject(F.col("subject")).alias("t")).distinct().count()
            facts = self.spark.createDataFrame([(question, threads, len(emails), sum(c[3] for c in context))], "question string, n_threads int, n_emails int, n_graph int")
            routed = routing.route(facts, s.small_model, s.large_model, s.router_threshold).first()
            chosen, reason = routed["model"], routed["reason"]
        reply = self.model.complete(ANSWERING, Prompt(question, [(n, c[2]) for n, c in enumerate(context, 1)]), chosen)
        marks = list(dict.fromkeys(int(x) for x in re.findall(r"\[(\d{1,9})\]", reply.text)))
        cited = [context[n - 1][0] for n in marks if 1 <= n <= len(context)]
        cost = reply.cost(self.prices, s.large_model)
        return Answer(question, reply.text, "miss", reply.model, reason, [c[0] for c in context], cited, events, reply.input_tokens, reply.output_tokens, cost)

    def _sources(self, question: str, answer: Answer, context: list) -> list[int]:
        """What an answer hangs on; without a citation it hangs on nothing and is never shared."""
        if not answer.cited or self.settings.cache_provenance == "context":
            return [c[0] for c in context] if answer.cited else []
        row = self.spark.createDataFrame([(answer.text, question, [(c[0], c[2]) for c in context], answer.cited)], "answer string, question string, context array<struct<id: long, text: string>>, cited array<long>")
        return cache.dependencies(row).first()["deps"]

    # the log

    AUDIT = "id long, principal string, principal_groups array<string>, question string, retrieved array<long>, cited array<long>, cache_status string, model string, reason string, input_tokens long, output_tokens long, cost_usd double, latency_ms double, security_events array<string>"

    def audit(self) -> DataFrame:
        rows = [(i, who, groups, a.question, a.retrieved, a.cited, a.cache_status, a.model, a.reason, a.input_tokens, a.output_tokens, a.cost_usd, a.latency_ms, a.events) for i, who, groups, a in self.log]
        return self.spark.createDataFrame(rows, self.AUDIT)

    def write_audit(self) -> None:
        """Append the log to the store's table and begin anew."""
        audit.append(self.store.at("audit_log"), self.audit())
        self.log = []

    def with_settings(self, **values: object) -> Engine:
        """The same corpus and index, an empty cache and log, and other settings."""
        made = Engine.__new__(Engine)
        made.__dict__.update({k: v for k, v in self.__dict__.items()})
        made.settings, made.log, made.store = replace(self.settings, **values), [], None
        made.answers = made._answers()
        return made

    def with_mode(self, mode: str) -> Engine:
        return self.with_settings(cache_mode=mode)
