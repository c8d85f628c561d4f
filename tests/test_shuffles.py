"""Index builds shuffle texts, not postings; many questions meet postings where their mails are."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import blockmax, evals, lexical, positions, vector

CHUNK = "chunk_id long, email_id long, ord int, text string"


def exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_tallies_and_places_of_a_row(spark):
    rows = spark.createDataFrame([("b a b, B c",), ("",), ("--",), (None,)], "text string")
    got = rows.select(T.tallies(T.terms(F.col("text"))).alias("t"), T.places(T.terms(F.col("text"))).alias("p")).collect()
    assert [tuple(x) for x in got[0]["t"]] == [("a", 1), ("b", 3), ("c", 1)]
    assert [tuple(x) for x in got[0]["p"]] == [("a", [1]), ("b", [0, 2, 3]), ("c", [4])]
    assert all(not r["t"] and not r["p"] for r in got[1:])


def chunks(spark):
    return spark.createDataFrame([(i, i // 2, 0, f"the w{i % 7} the w{i % 3} x{i}") for i in range(200)], CHUNK)


def test_postings_and_positions_are_made_without_shuffling_them(spark):
    assert exchanges(lexical.postings(chunks(spark))) == 0
    assert exchanges(lexical.sorted_postings(chunks(spark))) == 1
    assert exchanges(positions.positions(chunks(spark))) == 1


def test_blocks_are_made_where_their_texts_are(spark):
    assert exchanges(blockmax.blocks(chunks(spark), size=16)) == 1


def asked(spark):
    rows = [(1, ["user:u1", "user:u2"], ["the", "w1"]), (2, ["user:u1"], ["x5", "w2"]), (3, ["*"], ["the", "w1"]), (4, [], ["the"])]
    return spark.createDataFrame(rows, "question_id long, tokens array<string>, terms array<string>")


def test_two_tokens_that_may_read_a_mail_count_its_words_once(spark):
    rows = chunks(spark)
    acl = spark.createDataFrame([(i, p) for i in range(90) for p in ("user:u1", "user:u2")], "email_id long, principal string")
    stats = lexical.statistics(rows)
    got = lexical.search_many(lexical.postings(rows), stats, asked(spark), acl, 3).orderBy("question_id", "rank").collect()
    readable = rows.filter("email_id < 90").select("chunk_id")
    for q, terms, mine in ((1, ["the", "w1"], readable), (2, ["x5", "w2"], readable), (3, ["the", "w1"], None)):
        want = lexical.search_index(lexical.postings(rows), stats, mine, terms, 3).collect()
        assert [(r["chunk_id"], r["score"]) for r in got if r["question_id"] == q] == [tuple(r) for r in want]
    assert not [r for r in got if r["question_id"] == 4]


def test_block_search_for_many_gives_each_chunk_once(spark):
    rows = chunks(spark)
    acl = spark.createDataFrame([(i, "user:u1") for i in range(100)], "email_id long, principal string")
    want = lexical.search_many(lexical.postings(rows), lexical.statistics(rows), asked(spark), acl, 5).select("question_id", "chunk_id", "score", "rank")
    got = blockmax.search_many(blockmax.Index.of(rows, size=8), asked(spark), acl, 5, first=2).select("question_id", "chunk_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_more_rows_make_more_parts_of_rank_metrics(spark, monkeypatch):
    results = spark.createDataFrame([("a", q, q % 5, 1) for q in range(100)], "config string, question_id long, doc long, rank int")
    relevant = spark.createDataFrame([(q, d) for q in range(100) for d in (q % 5, q % 5, 7)], "question_id long, doc long")
    want = sorted(map(tuple, evals.rank_metrics(results, relevant.distinct(), 3).collect()))
    monkeypatch.setattr(evals, "PART_ROWS", 50)
    got = evals.rank_metrics(results, relevant, 3)
    assert "hashpartitioning(question_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 8)" in plan
    assert sorted(map(tuple, got.collect())) == want


def test_questions_leave_a_similarity_join_in_small_batches():
    part = pd.DataFrame({"question_id": range(500), "embedding": [[1.0, 0.0]] * 500})
    rows, c = np.nonzero(np.ones((500, 64), bool))
    out = list(vector.slices()(part, rows, c))
    assert max(map(len, out)) <= vector.SLICE and sum(map(len, out)) == 500 * 64
    assert {(q, k) for o in out for q, k in zip(o["question_id"], o["c"])} == {(q, k) for q in range(500) for k in range(64)}


def test_products_in_strips_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 8)), rng.normal(size=(301, 8))
    i, j, sims = vector.products(0.5, 6)(a, b)
    whole = np.round(b @ a.T, 6)
    assert set(zip(j, i)) == set(zip(*np.nonzero(whole >= 0.5))) and np.allclose(sims, whole[j, i], atol=2e-6)
    assert len(vector.products(0.5, 6)(a, b[:0])[0]) == 0
