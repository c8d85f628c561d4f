"""Blocks of postings, positions and segments: the same rows as plain search, of which less is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import blockmax, evals, lexical, positions, vector
from palisade.sources.snapshots import Conflict, Log
from palisade.sources.tables import Store

CHUNK, ACL = "chunk_id long, email_id long, ord int, text string", "email_id long, principal string"


def corpus(spark, n, seed=0, start=0):
    """Chunks of very unequal length with a common word in most, and rights of five people."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(start, start + n):
        size = int(rng.integers(2, 60))
        words = [f"w{int(k)}" for k in rng.zipf(1.4, size) % 400]
        words += ["the"] * int(rng.integers(0, 4)) + ["rare"] * (3 if i % 97 == 5 else 0)
        rng.shuffle(words)
        rows.append((i * 7, i // 3, i % 3, " ".join(words)))
    acl = [(i, f"user:u{i % 5}") for i in range(start // 3, (start + n) // 3 + 1)]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(acl, ACL)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A corpus with its index in blocks of few chunks, written as an ingest would."""
    chunks, acl = corpus(spark, 900)
    path = str(tmp_path_factory.mktemp("index"))
    made = blockmax.Index.of(chunks, size=16)
    for name in ("blocks", "terms", "lengths"):
        getattr(made, name).write.parquet(f"{path}/{name}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return chunks, acl, blockmax.Index(read("blocks"), read("terms"), read("lengths"))


def plain(chunks, readable, terms, limit):
    return [tuple(r) for r in lexical.search_index(lexical.postings(chunks), lexical.statistics(chunks), readable, terms, limit).collect()]


@pytest.mark.parametrize("terms", [["the"], ["rare", "the"], ["w1", "w2", "w7", "the"], ["w399"], ["nowhere"], [], ["w3", "w3"]])
def test_blocks_give_the_rows_of_plain_search(small, terms):
    chunks, acl, index = small
    limit = 1 if len(terms) == 2 else 10
    mine = chunks.join(acl.filter("principal = 'user:u2'"), "email_id", "left_semi").select("chunk_id")
    assert [tuple(r) for r in blockmax.search(index, mine, terms, limit).collect()] == plain(chunks, mine, terms, limit)
    assert [tuple(r) for r in blockmax.search(index, None, terms, limit).collect()] == plain(chunks, None, terms, limit)


def test_most_blocks_of_a_common_word_are_skipped(small):
    _, _, index = small
    search = blockmax.Search(index, None, ["the", "rare"], limit=5, first=3)
    every = search.bounds.agg(F.count("*"), F.sum("blocks")).first()
    common = index.blocks.filter("term = 'the'").agg(F.count("*"), F.sum("n")).first()
    assert common[0] > 40 and common[1] > 500  # the word has a long list
    needed = len(search.near[0]) + search.rest.count()
    assert needed <= every[0] / 4 and search.threshold is not None
    # no skipped range could have had a chunk among the best
    skipped = search.bounds.join(search.rest.select("seg", "range"), ["seg", "range"], "left_anti").filter(~blockmax._one_of(search.near[0]))
    best = index.blocks.join(skipped, ["seg", "range"], "left_semi").filter("term in ('the', 'rare')")
    scores = search._scored(best).agg(F.max("score")).first()[0]
    assert scores < search.threshold


def test_fronts_bound_every_posting_whatever_the_mean_length(small):
    _, _, index = small
    for avgdl in (1.0, 20.0, 500.0):
        w = lambda tf, dl: lexical.weight(tf.cast("double"), dl, F.lit(avgdl))  # noqa: B023, E731
        top = F.array_max(F.transform("front", lambda f: w(f["tf"], f["dl"])))
        over = index.blocks.select(top.alias("top"), F.inline("rows")).filter(w(F.col("tf"), F.col("dl")) > F.col("top"))
        assert over.count() == 0


def test_many_questions_at_once(spark, small):
    chunks, acl, index = small
    asked = [(i, [f"w{i}", "the", f"w{3 * i}"], [f"user:u{i % 5}", "user:u0"]) for i in range(25)] + [(90, ["nowhere"], ["user:u1"]), (91, [], ["user:u1"]), (92, ["the"], ["user:none"])]
    questions = spark.createDataFrame([(i, list(dict.fromkeys(t)), p) for i, t, p in asked], "question_id long, terms array<string>, tokens array<string>")
    plain_many = lexical.search_many(lexical.postings(chunks), lexical.statistics(chunks), questions, acl, 4)
    columns = ["question_id", "chunk_id", "score", "rank"]
    want = sorted(map(tuple, plain_many.select(columns).collect()))
    assert sorted(map(tuple, blockmax.search_many(index, questions, acl, 4, first=2).select(columns).collect())) == want and len(want) > 80


@pytest.mark.parametrize("size", [1, 3, 8])
def test_phrases_by_position(spark, small, size):
    chunks, acl, _ = small
    texts = [r["text"].split() for r in chunks.limit(40).collect()]
    grams = sorted({" ".join(t[k : k + size]) for t in texts for k in range(0, max(0, len(t) - size + 1), 9)})[:60]
    grams += ["the " * size, " ".join(["w1"] * size), " ".join(f"absent{k}" for k in range(size))]
    phrases = spark.createDataFrame([(i, [f"user:u{i % 5}"], " ".join(g.split())) for i, g in enumerate(grams)], "key long, tokens array<string>, g string")
    index = positions.positions(chunks)
    want = evals.readable_phrases(phrases, chunks, acl, size)
    got = evals.readable_by_positions(phrases, index, acl)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = {r["chunk_id"]: f" {' '.join(T_words(r['text']))} " for r in chunks.collect()}
    found = {(r["key"], r["chunk_id"]) for r in positions.phrases_in(index, phrases.select("key", F.split("g", " ").alias("terms"))).collect()}
    assert found == {(r["key"], c) for r in phrases.collect() for c, t in held.items() if f" {r['g']} " in t}


def T_words(text):
    import re

    return re.findall("[a-z0-9]+", text.lower())


def counting(where):
    """An embedder that leaves how many texts it was given in files. A local class, so workers get it by value."""

    class Counting(vector.HashEmbedder):
        def passages(self, texts):
            import uuid

            with open(f"{where}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(texts)))
            return vector.HashEmbedder.passages(self, texts)

        def count(self):
            files = list(where.iterdir())
            n = sum(int(f.read_text()) for f in files)
            for f in files:
                f.unlink()
            return n

    return Counting(64)


def rows(df):
    return sorted(map(tuple, df.collect()))


def same_corpus(spark, store, chunks, embedder, terms=("the", "w1", "rare")):
    """All that is read of the store equals what a rebuilt one holds."""
    assert rows(store.read("chunks").select("chunk_id", "email_id", "ord", "text")) == rows(chunks)
    columns = ["chunk_id", "email_id", "term", "tf", "dl"]
    assert rows(store.read("postings").select(columns)) == rows(lexical.postings(chunks).select(columns))
    n, avgdl = store.read("lengths").first()
    want = lexical.statistics(chunks).first()
    assert (n, avgdl) == (want["n"], pytest.approx(want["avgdl"], rel=1e-12))
    df = {r["term"]: r["df"] for r in store.index().terms.groupBy("term").agg(F.sum("df").alias("df")).collect() if r["df"]}
    assert df == {r["term"]: r["count"] for r in lexical.postings(chunks).groupBy("term").count().collect()}
    assert [tuple(r) for r in blockmax.search(store.index(), None, list(terms), 7).collect()] == plain(chunks, None, list(terms), 7)
    assert rows(store.vectors(embedder).select("chunk_id")) == rows(chunks.select("chunk_id"))
    assert rows(store.read("positions").groupBy("term").count()) == rows(lexical.postings(chunks).groupBy("term").count())


def test_segments_equal_a_rebuilt_corpus(spark, tmp_path):
    """Adding a little reads and embeds a little; removed chunks are gone, may come back, and compaction changes nothing."""
    (tmp_path / "seen").mkdir()
    embedder = counting(tmp_path / "seen")
    chunks, acl = corpus(spark, 300)
    mails = chunks.select("email_id").distinct()
    store = Store(spark, str(tmp_path / "corpus"))
    store.ingest(mails, acl, chunks, embedder)
    assert embedder.count() == 300
    more, _ = corpus(spark, 6, seed=1, start=600)
    before = store.snapshot().tables
    store.add_chunks(more, embedder)
    assert embedder.count() == 6
    after = store.snapshot().tables
    for name in ("chunks", "blocks", "terms", "sizes", "positions", "vectors"):
        assert after[name][:-1] == before[name]  # nothing there was written anew
        added = spark.read.parquet(f"{store.path}/{after[name][-1]}")
        assert added.count() <= 6 * 70
    both = chunks.unionByName(more)
    same_corpus(spark, store, both, embedder)

    gone = chunks.filter("chunk_id % 5 = 0").select("chunk_id")
    store.remove_chunks(gone.unionByName(spark.createDataFrame([(-1,)], "chunk_id long")))
    store.remove_chunks(gone)  # once more: nothing is left to remove
    left = both.join(gone, "chunk_id", "left_anti").select("chunk_id", "email_id", "ord", "text")
    same_corpus(spark, store, left, embedder)
    assert embedder.count() == 0

    again = chunks.filter("chunk_id % 35 = 0").withColumn("text", F.concat("text", F.lit(" rare again")))
    store.add_chunks(again, embedder)
    assert embedder.count() == again.count()
    now = left.unionByName(again)
    same_corpus(spark, store, now, embedder, terms=("again", "the"))
    store.compact()
    assert embedder.count() == 0 and not store.has("removed") and len(store.snapshot().tables["blocks"]) == 1
    same_corpus(spark, store, now, embedder, terms=("again", "the"))


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A driver that ends between the steps of a change leaves the corpus as it was."""
    chunks, acl = corpus(spark, 30)
    store = Store(spark, str(tmp_path / "corpus"))
    store.ingest(chunks.select("email_id").distinct(), acl, chunks)
    was, n = store.snapshot(), store.read("acl").count()

    class Killed(BaseException):
        pass

    def dies(*_):
        raise Killed

    for step in ("_publish", "commit"):
        with monkeypatch.context() as m:
            m.setattr(Log, step, dies)
            with pytest.raises(Killed):
                store.ingest(chunks.select("email_id").distinct(), acl.limit(3), chunks.limit(5))
        fresh = Store(spark, store.path)
        assert fresh.snapshot() == was and fresh.read("acl").count() == n and fresh.read("chunks").count() == 30
    # a change that fails halfway takes its own files along
    with pytest.raises(ValueError, match="halfway"), store.change() as change:
        change.write("acl", acl.limit(1))
        raise ValueError("halfway")
    assert store.snapshot() == was and Store(spark, store.path).read("acl").count() == n


def test_readers_keep_their_snapshot(spark, tmp_path):
    chunks, acl = corpus(spark, 30)
    store = Store(spark, str(tmp_path / "corpus"))
    store.ingest(chunks.select("email_id").distinct(), acl, chunks)
    held, open_rows = store.held(), store.read("acl")
    n = open_rows.count()
    store.write("acl", acl.limit(2))
    store.remove_chunks(chunks.limit(10))
    assert held.read("acl").count() == n == open_rows.count() and held.read("chunks").count() == 30
    assert store.read("acl").count() == 2 and store.read("chunks").count() == 20
    with pytest.raises(Conflict):
        held.bump()
    assert store.vacuum(keep=3) == 0 and held.read("acl").count() == n
    assert store.vacuum() >= 1 and store.read("acl").count() == 2 and store.read("chunks").count() == 20


def test_of_two_changes_at_once_one_is_refused(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "corpus")) for _ in range(2))
    store.write("acl", spark.range(3))
    with pytest.raises(Conflict), store.change() as mine:
        mine.append("acl", spark.range(1))
        other.append("acl", spark.range(2))
    assert store.read("acl").count() == 5 and store.snapshot().number == 2


def test_vectors_for_many_questions(spark):
    """As top_k for each question over what its principal may read, ties and an auditor included."""
    rng = np.random.default_rng(4)
    raw = rng.integers(-2, 3, (700, 8)).astype(float)  # many equal products
    vectors = spark.createDataFrame([(i, i // 2, [float(x) for x in v] if i % 50 else None) for i, v in enumerate(raw)], "chunk_id long, email_id long, embedding array<double>")
    acl = spark.createDataFrame([(i, f"user:u{k}") for i in range(350) for k in range(6) if (i * (k + 3)) % 4 == 0], ACL)
    asked = [(k, [f"user:u{k % 6}", f"group:g{k}"], [float(x) for x in rng.integers(-2, 3, 8)]) for k in range(12)] + [(50, ["*"], [1.0] * 8), (51, ["user:none"], [1.0] * 8), (52, [], [1.0] * 8)]
    questions = spark.createDataFrame(asked, "question_id long, tokens array<string>, embedding array<double>")
    guarded = vector.with_readers(vectors, acl, questions)
    for size in (5, 2048):
        vector.TOGETHER = size
        got = vector.top_k_many(guarded.repartition(3), questions, 7).select("question_id", "rank", "chunk_id", "sim").collect()
        for key, tokens, q in asked:
            mine = vectors if "*" in tokens else vectors.join(acl.filter(F.col("principal").isin(*tokens)), "email_id", "left_semi") if tokens else vectors.limit(0)
            want = [tuple(r) for r in vector.top_k(mine, q, 7, "chunk_id").collect()]
            assert [(r["chunk_id"], r["sim"]) for r in sorted(got, key=lambda r: r["rank"]) if r["question_id"] == key] == want, key
    assert vector.top_k_many(guarded, questions.limit(0), 7).count() == 0
    vector.QUESTIONS = 4
    again = vector.top_k_many(guarded, questions, 7).select("question_id", "rank", "chunk_id", "sim").collect()
    vector.QUESTIONS = 4096
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_a_corpus_searched_by_words_holds_no_vectors_and_places(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    embedder = counting(tmp_path / "seen")
    chunks, _ = corpus(spark, 200)
    more, _ = corpus(spark, 20, seed=1, start=600)
    store = Store(spark, str(tmp_path / "corpus"), parts=("blocks",))
    store.add_chunks(chunks, embedder)
    Store(spark, store.path).add_chunks(more, embedder)  # holds what is there
    store.remove_chunks(chunks.filter("chunk_id % 5 = 0"))
    left = chunks.filter("chunk_id % 5 <> 0").unionByName(more)
    for step in (lambda: None, store.compact):
        step()
        assert not store.has("vectors") and not store.has("positions") and embedder.count() == 0
        got = [tuple(r) for r in blockmax.search(store.index(), None, ["the", "w1", "rare"], 7).collect()]
        assert got == plain(left, None, ["the", "w1", "rare"], 7)


def test_counts_of_terms_come_from_blocks(spark):
    chunks, _ = corpus(spark, 200)
    assert rows(blockmax.terms_of(blockmax.blocks(chunks, size=16))) == rows(blockmax.term_counts(chunks))


def test_segments_query_makes_no_vectors(spark, monkeypatch):
    """What the query does not read was most of the disk that it took."""
    from palisade.operators import positions, vector
    from palisade.plans import catalogue
    from palisade.sources import tables

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(vector, "table", never)
    monkeypatch.setattr(positions, "positions", never)
    monkeypatch.setattr(tables, "_kept", {})
    assert catalogue.bm25_segments(spark, "/root/testdata/sf0.001").count() == 20
    tables._forget()  # the store of this test only


def test_postings_are_dealt_without_another_pass(spark):
    """The words that `statistics` counted tell how many parts there are."""
    chunks, _ = corpus(spark, 200)
    total = lexical.total_words(lexical.statistics(chunks))
    assert total == chunks.agg(F.sum(F.size(T.terms(F.col("text"))))).first()[0]
    spark.sparkContext.setJobGroup("dealt", "no job before the write")
    dealt = lexical.sorted_postings(chunks, total)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("dealt")
    assert rows(dealt) == rows(lexical.sorted_postings(chunks))
    assert lexical.sorted_postings(chunks, 0).rdd.getNumPartitions() == 1 and lexical.total_words(lexical.statistics(chunks.limit(0))) == 0
