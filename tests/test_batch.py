"""Retrieval for tables of questions against the same for each question alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.engine import Engine
from palisade.operators import acl as A
from palisade.operators import batch, graph
from palisade.sources.files import Directory, Settings
from palisade.sources.tables import settled

WORDS = [f"word{i}" for i in range(40)]
NAMES = ["enron", "enron corp", "enron corp europe", "j. skilling", "raptor", "raptor two", "a&b", "x.com", "new york power", "power", "york"]


def test_seeds_of_many_questions(spark):
    """As `graph.seeds` for each of thousands of questions, overlapping and nested names included."""
    rng = np.random.default_rng(3)
    parts = [w for n in NAMES for w in n.split()] + ["the", "of", "Enron.", "...", "Raptor,", "POWER", "new"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(10_000)] + ["", "???", "enron corp europe raptor two power"]
    known = spark.createDataFrame([(n, f"e{i % 8}") for i, n in enumerate(NAMES)], "alias string, entity_id string").cache()
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    got = {}
    for r in batch.seeds(questions, known).orderBy("question_id", "place").collect():
        got.setdefault(r["question_id"], []).append(r["entity_id"])

    class Known:  # the alias table of `graph.seeds`, answered without Spark
        table = {r["alias"]: r["entity_id"] for r in known.collect()}

        def filter(self, condition):
            return self

        def collect(self):
            return [{"alias": a, "entity_id": e} for a, e in self.table.items()]

    for i, text in enumerate(texts):
        assert got.get(i, []) == graph.seeds(text, Known()), text


@pytest.fixture(scope="module")
def engine(spark):
    rng = np.random.default_rng(11)
    chunks, mentions, edges = [], set(), set()
    for i in range(160):
        words = list(rng.choice(WORDS, rng.integers(4, 30)))
        chunks.append((i * 3, i // 2, i % 2, " ".join(words)))
        found = ["e0"] * (i % 2) + [f"e{int(k)}" for k in rng.integers(1, 30, 3)]  # e0 is a hub
        mentions |= {(e, i * 3) for e in found}
        edges |= {(a, b, "co_mentioned", i * 3) for a in found for b in found if a < b}
    acl = [(m, f"user:u{k}") for m in range(80) for k in range(4) if (m * (k + 2)) % 3 == 0] + [(m, "group:desk") for m in range(0, 80, 7)]
    entities = spark.createDataFrame([(f"e{k}", f"word{k}", f"Word{k}", "project") for k in range(30)], "entity_id string, name string, label string, type string")
    known = {
        "entities": entities.cache(),
        "mentions": spark.createDataFrame(sorted(mentions), "entity_id string, chunk_id long").cache(),
        "edges": spark.createDataFrame(sorted(edges), "src string, dst string, rel string, chunk_id long").cache(),
    }
    subjects = spark.createDataFrame([(m, f"s{m}") for m in range(80)], "email_id long, subject string")
    desk = Directory(groups=[A.Group("desk", members=frozenset({"u1"}))])
    return Engine(
        spark,
        spark.createDataFrame(chunks, "chunk_id long, email_id long, ord int, text string").cache(),
        spark.createDataFrame(acl, "email_id long, principal string").cache(),
        subjects,
        Settings(top_k=4, candidate_k=12),
        directory=desk,
        known=known,
    )


ASKED = [(0, "what about word0 and word3", "u0"), (1, "word1 word2 word7", "u1"), (2, "word5", "nobody"), (3, "word9 word0", "auditor"), (4, "zebra", "u2"), (5, "word0 word0 word31", "u3")]


def test_expand_for_many_questions(spark, engine):
    questions = spark.createDataFrame([(i, q, engine.principal(u).tokens) for i, q, u in ASKED], "question_id long, question string, tokens array<string>")
    start = batch.seeds(questions, engine.aliases()).select("question_id", F.col("entity_id").alias("node"))
    owners = engine.chunks.select("chunk_id", "email_id")
    adjacent = engine.adjacent()
    got = batch.expand(start, adjacent, engine.known["mentions"], engine.idf(), owners, questions, engine.acl, width=3, limit=9, settle=settled).collect()
    found = 0
    for i, q, u in ASKED:
        seeds = graph.seeds(q, engine.aliases())
        first = spark.createDataFrame([(x,) for x in seeds], "node string")
        readable = engine.corpus(engine.principal(u)).readable()
        want = graph.expand(first, engine.known["edges"], engine.known["mentions"], engine.idf(), width=3, limit=9, readable=readable).collect() if seeds else []
        mine = sorted((r for r in got if r["question_id"] == i), key=lambda r: r["rank"])
        assert [(r["chunk_id"], r["score"]) for r in mine] == [tuple(r) for r in want], q
        found += len(want)
    assert found > 20


@pytest.mark.parametrize("mode,use_graph,reranked", [("bm25", False, False), ("hybrid", False, False), ("hybrid", True, True)])
def test_retrieve_many_is_retrieve_for_each(spark, engine, mode, use_graph, reranked):
    settings = engine.settings.with_overrides(retrieval_mode=mode, use_graph=use_graph, use_reranker=reranked)
    questions = spark.createDataFrame(ASKED, "question_id long, question string, principal string")
    got = engine.retrieve_many(questions, settings).collect()
    for i, q, u in ASKED:
        mine = sorted((r for r in got if r["question_id"] == i), key=lambda r: r["rank"])
        assert [(r["chunk_id"], r["email_id"], r["text"], r["from_graph"]) for r in mine] == engine.retrieve(q, engine.principal(u), settings), q


def test_the_number_of_jobs_does_not_grow_with_questions(spark, engine):
    settings = engine.settings.with_overrides(retrieval_mode="bm25", use_graph=False, use_reranker=False)
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (2, 40):
        spark.sparkContext.setJobGroup(f"many-{n}", "")
        rows = [(i, f"word{i % 30} word{i % 7}", f"u{i % 4}") for i in range(n)]
        engine.retrieve_many(spark.createDataFrame(rows, "question_id long, question string, principal string"), settings).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"many-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 2, counts
