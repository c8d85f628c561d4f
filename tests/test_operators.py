import math
import sqlite3

from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import acl as A
from palisade.operators import cache, evals, fuse, graph, lexical, routing, vector
from palisade.streaming import audit_stream


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "chunk_id long, rank int")
    best = fuse.candidates(fuse.rrf({"a": a, "b": b}), 1, reranked=False).first()
    assert best["chunk_id"] == 2 and best["sources"] == {"a": 2.0, "b": 1.0}


def test_bm25_equals_sqlite(spark):
    texts = ["alpha beta gamma", "beta beta delta", "gamma delta", "epsilon zeta eta theta", "alpha zeta"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, tokenize='unicode61')")
    con.executemany("insert into f(rowid, text) values (?, ?)", enumerate(texts))
    want = {i: round(-s, 6) for i, s in con.execute("select rowid, bm25(f) from f where f match '\"alpha\" OR \"beta\"'")}
    chunks = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, email_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in lexical.search(chunks, None, ["alpha", "beta"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)
    assert lexical.search(chunks, None, []).count() == 0


def test_rank_metrics(spark):
    results = spark.createDataFrame([("x", "q", d, i + 1) for i, d in enumerate("abc")], "config string, question_id string, doc string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z")], "question_id string, doc string")
    row = evals.rank_metrics(results, relevant, 2).first()
    assert (row["recall"], row["hit"], row["mrr"]) == (0.5, 1.0, 0.5)
    none = evals.rank_metrics(results, relevant.limit(0), 2).first()
    assert (none["recall"], none["ndcg"]) == (0.0, 0.0)


def test_hashed_vectors():
    a, b, c = (vector.hashed(t) for t in ("raptor hedge unwind", "unwind the raptor hedge", "lunch at noon"))
    assert float(a @ b) > float(a @ c) and not vector.hashed("").any()


def test_vector_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector.top_k(none, [1.0, 0.0], 3).count() == 0


def test_dependencies(spark):
    context = [(1, "From: a\nThe plan is fine."), (2, "From: b\nThe price is 40 million."), (3, "From: c\nNothing here.")]
    rows = [("The plan costs 40 million [1].", "What does the plan cost?", context, [1]), ("The plan is fine [1].", "Is the plan fine?", context, [1])]
    df = spark.createDataFrame(rows, "answer string, question string, context array<struct<id: long, text: string>>, cited array<long>")
    assert [r["deps"] for r in cache.dependencies(df).orderBy("answer").collect()] == [[1, 2], [1]]
    told = spark.createDataFrame([("We met Bob at IBM on 5 May.",)], "t string").select(cache.telling_terms(F.col("t"))).first()[0]
    assert set(told) == {"bob", "ibm", "5", "may"}


def test_cache_modes(spark):
    rows = [(1, "u1", 0.0, 0.99, 1, 1, 1.0), (2, "u2", 0.0, 0.98, 1, 0, 0.0), (3, "u2", 0.0, 0.97, 1, 0, 1.0), (4, "u1", 0.0, 0.5, 1, 0, 1.0)]
    entries = spark.createDataFrame(rows, "entry_id long, owner string, created_at double, sim double, n_sources int, n_unreadable int, coverage double")
    found = {m: tuple(cache.lookup(cache.statuses(entries, m, "u2", 10.0)).first()) for m in cache.MODES}
    assert found == {"off": (None, 0, 0), "global": (1, 0, 0), "per_user": (2, 0, 0), "acl_aware": (3, 1, 1)}


def test_router(spark):
    rows = spark.createDataFrame([("What did Vince say?", 1, 1, 0), ("Compare why and how the strategy changed over time", 6, 8, 4)], "question string, n_threads int, n_emails int, n_graph int")
    assert [r["model"] for r in routing.route(rows).orderBy("n_threads").collect()] == ["small", "large"]


def test_extractive_answer_and_refusal(spark):
    rows = spark.createDataFrame([(1, 1, "From: x\nThe raptor hedge ends on Friday. Lunch is at noon.")], "question_id long, n int, text string")
    assert routing.extract_answers(rows, F.lit("When does the raptor hedge end?")).first()["answer"] == "The raptor hedge ends on Friday. [1]"
    assert routing.extract_answers(rows, F.lit("zebra giraffe lion")).first()["answer"].startswith("I couldn't find")


def test_seeds(spark):
    known = graph.aliases(spark.createDataFrame([(1, "jeff.skilling@enron.com", "Jeff Skilling", "person"), (2, "raptor", "Raptor", "project")], "entity_id int, name string, label string, type string"))
    assert graph.seeds("What did Skilling say about Raptor?", known) == [1, 2]
    assert graph.seeds("jeff skilling skilling", known) == [1]
    assert graph.seeds("", known) == []


def test_expansion_stays_readable(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "d", 3)], "src string, dst string, chunk_id long")
    mentions = edges.selectExpr("src entity_id", "chunk_id").union(edges.selectExpr("dst", "chunk_id"))
    readable = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    keep = lambda df: df.join(readable, "chunk_id", "left_semi")
    start = spark.createDataFrame([("a",)], "node string")
    got = graph.expand(start, keep(edges), keep(mentions), graph.idf(mentions, 3))
    assert {r["chunk_id"] for r in got.collect()} == {1, 2}
    assert graph.expand(start.limit(0), keep(edges), keep(mentions), graph.idf(mentions, 3)).count() == 0


def test_entities(spark):
    text = "Subject: x\nWe met with Acme Energy and LJM. Then Vince Kaminski joined Project Raptor. Please Call Bob."
    got = {(e["label"], e["type"]) for e in spark.createDataFrame([(text,)], "t string").select(graph.text_entities(F.col("t"))).first()[0]}
    assert ("Acme Energy", "org") in got and ("LJM", "project") in got and ("Raptor", "project") in got and ("Vince Kaminski", "person_or_org") in got


def test_thread_keys(spark):
    rows = spark.createDataFrame([("Re: re: Fw: x",), ("FW: Re: x",), ("x",)], "s string")
    assert [tuple(r) for r in rows.select(T.thread_key(F.col("s")), T.bare_subject(F.col("s"))).collect()] == [("x", "x"), ("re: x", "x"), ("x", "x")]


def test_globs():
    import re

    assert re.match(T.glob("*/fr"), "a/b/fr") and not re.match(T.glob("*/fr"), "a/fr/x")
    assert re.match(T.glob("a?[bc]"), "axb") and not re.match(T.glob("a?[!bc]"), "axb")


def test_acl_version_and_explain(spark):
    assert A.next_version(spark.createDataFrame([], "version long")).first()["version"] == 1
    acl = spark.createDataFrame([(1, "user:a"), (1, "group:g"), (2, "user:b")], "email_id long, principal string")
    rows = {r["email_id"]: r for r in A.explain(acl, A.Principal("a", frozenset({"g"})), [A.Group("g", "Desk")]).collect()}
    assert rows[1]["readable"] and not rows[2]["readable"] and "member of group 'g' (Desk)" in rows[1]["reasons"]


def test_streamed_metrics(spark, sf, tmp_path):
    from palisade.plans import relations

    log = relations.audit(spark, sf).select("ts", "cache_status")
    log.write.parquet(str(tmp_path / "log"))
    stream = audit_stream.windowed(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("audit_windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("audit_windows").agg(F.sum("queries")).first()[0] == log.count()


def _needed(answer, question, context, cited):
    """Chunks that an answer hangs on, by plain sets."""
    import re

    from palisade.functions import fixed

    tokens = lambda t: re.findall(cache.TOKEN, t)
    bare = lambda t: re.sub("^[.,'-]+|[.,'-]+$", "", t).lower().replace(",", "")
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda t: {tuple(w) for ws in [[w for w in words(t) if w not in fixed.COMMON_WORDS]] for w in zip(*(ws[k:] for k in range(4)), strict=False)}
    forms = lambda t: {bare(x) for x in tokens(t)} | set(words(t))
    said = re.sub(cache.CITATION, " ", answer)
    telling = set()
    for sentence in re.split(r"(?<=[.!?:\n])\s+", said):
        for place, t in enumerate(tokens(sentence)):
            if any(c.isdigit() for c in t) or re.fullmatch("[A-Z]{2,}", t) or (place and "A" <= t[0] <= "Z"):
                telling.add(bare(t))
    telling -= {*fixed.COMMON_WORDS, *fixed.ANSWER_STOP_WORDS, ""}
    shown = "\n".join(t for i, t in context if i in cited)
    novel, runs = telling - forms(question) - forms(shown), grams(said) - grams(shown)
    return [i for i, t in context if i in cited or novel & forms(t) or runs & grams(t)]


def test_answer_dependencies_of_whole_texts(spark, sf):
    from palisade.plans.catalogue import QUERIES

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = r["text"] or ""
        context = [(r["doc_id"] * 10000 + k, line.strip(" ")) for k, line in enumerate(text.split("\n")) if line.strip(" ")]
        deps = _needed(text, context[-1][1] if context else "", context, {i for i, _ in context[:1]})
        want[r["doc_id"]] = ",".join(map(str, deps))
    got = {r["doc_id"]: r["deps"] for r in QUERIES["answer_dependencies"](spark, sf).collect()}
    assert got == want


def test_every_chunk_is_embedded(spark, sf):
    from palisade.plans.catalogue import QUERIES, R

    got = [r["chunk_id"] for r in QUERIES["hash_embed"](spark, sf).select("chunk_id").collect()]
    assert sorted(got) == sorted(r["chunk_id"] for r in R.chunks(spark, sf).select("chunk_id").collect())


def test_embeddings_by_brute_force(spark, sf):
    import hashlib
    import re

    from palisade.plans.catalogue import R

    def brute(text):
        words = re.findall("[a-z0-9]+", text.lower())
        out = [0.0] * 512
        for f in words + ["_".join(p) for p in zip(words, words[1:], strict=False)]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
            out[h % 512] += 1 if h >= 2**63 else -1
        length = sum(x * x for x in out) ** 0.5
        return [x / length if length else 0.0 for x in out]

    for r in vector.embed(R.chunks(spark, sf).orderBy("chunk_id").limit(60)).collect():
        assert max(abs(a - b) for a, b in zip(brute(r["text"]), r["embedding"], strict=True)) < 1e-6


def test_transformer_embedder(spark):
    import numpy as np

    def load():
        def encode(texts):
            mask = np.array([[1, 1, len(t) > 3] for t in texts], float)
            return np.array([[[len(t), 1.0], [0.0, 2.0], [4.0, 4.0]] for t in texts]), mask

        return encode

    mean, first = vector.TransformerEmbedder("mini", 2, load, batch=1), vector.TransformerEmbedder("BGE-mini", 2, load)
    unit = lambda *v: np.array(v) / np.linalg.norm(v)
    assert np.allclose(mean.passages(["ab", "abcd"]), [unit(1.0, 1.5), unit(8 / 3, 7 / 3)])
    assert np.allclose(first.query("x"), unit(len(vector.QUERY_PREFIXES["bge"]) + 1, 1.0)) and mean.passages([]).shape == (0, 2)
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "chunk_id long, text string")
    assert {r["model"] for r in vector.table(rows, mean).collect()} == {"mini"}


def test_metrics_of_unanswered_questions(spark):
    results = spark.createDataFrame([("a", 1, 10, 1)], "config string, question_id long, doc long, rank int")
    relevant = spark.createDataFrame([(1, 10), (2, 11)], "question_id long, doc long")
    got = {(r["config"], r["question_id"]): (r["recall"], r["hit"], r["mrr"], r["ndcg"]) for r in evals.rank_metrics(results, relevant, 5).collect()}
    assert got == {("a", 1): (1.0, 1.0, 1.0, 1.0), ("a", 2): (0.0, 0.0, 0.0, 0.0)}
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "config string, question_id long")
    assert {(r["config"], r["question_id"], r["recall"]) for r in evals.rank_metrics(results, relevant, 5, runs).collect()} == {("a", 1, 1.0), ("b", 2, 0.0), ("b", 3, 0.0)}
    assert evals.rank_metrics(results.limit(0), relevant, 5).count() == 0


def test_attackers(spark):
    owners = spark.createDataFrame([(f"user:o{i}",) for i in range(5)], "principal string")
    acl = spark.createDataFrame([(1, f"user:o{i}") for i in range(4)] + [(2, f"user:o{i}") for i in range(5)] + [(4, "user:x")], "email_id long, principal string")
    got = {r["email_id"]: r["attacker"] for r in evals.attackers(spark.createDataFrame([(1,), (2,), (3,), (4,)], "email_id long"), acl, owners).collect()}
    assert got[1] == "user:o4" and 2 not in got and set(got) == {1, 3, 4}
    assert evals.attackers(acl, acl, owners.limit(0)).count() == 0


def test_content_leaks(spark):
    words = "one two three four five six seven eight nine ten"
    answers = spark.createDataFrame([("a", 1, ["user:x"], f"He said {words}."), ("b", 1, ["user:y"], words), ("c", 1, ["*"], words), ("d", 1, ["user:x"], "nothing")], "answer_id string, email_id long, tokens array<string>, text string")
    secrets = spark.createDataFrame([(1, words)], "email_id long, text string")
    chunks = spark.createDataFrame([(1, 1, words), (2, 2, f"again {words}")], "chunk_id long, email_id long, text string")
    acl = spark.createDataFrame([(1, "user:z"), (2, "user:y")], "email_id long, principal string")
    assert [r["answer_id"] for r in evals.content_leaks(answers, secrets, chunks, acl).collect()] == ["a"]


def test_graph_by_brute_force(spark):
    """Entities, mentions and edges of a small corpus, by plain loops."""
    texts = ["H\nAcme Energy met LJM and Vince Kaminski.", "H\nThen LJM saw Project Raptor.", "H\nOnly Acme Energy and LJM. About Raptor, Project Raptor."] + ["H\nnothing here"] * 57
    chunks = spark.createDataFrame([(10 * i + 1, i, 0, t) for i, t in enumerate(texts)], "chunk_id long, email_id long, ord int, text string")
    mails = spark.createDataFrame([(i, f"s{i % 2}@x.com", (["b@x.com", "s1@x.com"], [])) for i in range(len(texts))], "id long, sender string, recipients struct<to: array<string>, cc: array<string>>")
    made = graph.build(chunks, mails)
    names = {r["name"]: r["type"] for r in made["entities"].collect()}
    assert names == {"s0@x.com": "person", "s1@x.com": "person", "b@x.com": "person", "acme energy": "org", "ljm": "project", "raptor": "project", "project raptor": "person_or_org"}
    ids = {r["entity_id"]: r["name"] for r in made["entities"].collect()}
    found = {0: ["acme energy", "ljm"], 1: ["ljm", "raptor", "project raptor"], 2: ["acme energy", "ljm", "raptor", "project raptor"]}
    want = {(n, 10 * i + 1) for i in range(len(texts)) for n in [f"s{i % 2}@x.com", "b@x.com", "s1@x.com", *found.get(i, [])]}
    assert {(ids[r["entity_id"]], r["chunk_id"]) for r in made["mentions"].collect()} == want
    edges = sorted((ids[r["src"]], ids[r["dst"]], r["rel"], r["chunk_id"]) for r in made["edges"].collect())
    mailed = [(f"s{i % 2}@x.com", to, "emailed", 10 * i + 1) for i in range(len(texts)) for to in ("b@x.com", "s1@x.com")]
    pairs = [(a, b, "co_mentioned", 10 * i + 1) for i, more in found.items() for ms in [[f"s{i % 2}@x.com", *more]] for k, a in enumerate(ms) for b in ms[k + 1 :]]
    assert [e for e in edges if e[2] == "emailed"] == sorted(mailed)
    assert [(frozenset(e[:2]), e[3]) for e in edges if e[2] != "emailed"].__len__() == len(pairs)
    assert {(frozenset(e[:2]), e[3]) for e in edges if e[2] != "emailed"} == {(frozenset(p[:2]), p[3]) for p in pairs}
    seeds = graph.seeds("What of LJM and Raptor?", graph.aliases(made["entities"]))
    assert graph.describe(seeds, made["entities"]) == ["LJM", "Raptor"] and graph.describe([], made["entities"]) == []


def test_unicode_names_and_bodies(spark):
    rows = spark.createDataFrame([("xÉABC DEF_ LJM\u00a0GHI Q&A AT&T_ AB",)], "t string")
    assert sorted(rows.select(graph.acronyms(F.col("t"))).first()[0]) == ["GHI", "LJM", "Q&A"]
    bodies = spark.createDataFrame([("\u00a0a b\u2003\n\u00a0> quoted\nc\n\u00a0-----Original Message-----\nold",)], "t string")
    assert bodies.select(T.body(F.col("t"))).first()[0] == "a b\u2003\nc"
