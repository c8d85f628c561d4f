import pytest
from pyspark.sql import functions as F

from palisade.engine import Engine
from palisade.operators import acl as A
from palisade.operators import lexical, vector
from palisade.sources.files import Settings
from palisade.sources.tables import ModelMismatch, Store, indexed, shared_dir

TEXTS = {1: "From: jeff\nThe Raptor hedge will be unwound on Friday for 40 million dollars.", 2: "From: ken\nLunch is at noon on Monday in the old cafe.", 3: "From: vince\nThe Raptor model has a flaw in the price curve."}


class Other(vector.HashEmbedder):
    def __init__(self):
        super().__init__()
        self.name = "other"


def tables(spark):
    mails = spark.createDataFrame([(i, f"m{i}", f"Subject {i}", t) for i, t in TEXTS.items()], "email_id long, message_id string, subject string, body string")
    acl = spark.createDataFrame([(1, "user:jeff"), (1, "user:jeff"), (1, "user:ken"), (2, "user:ken"), (3, "user:vince")], "email_id long, principal string")
    chunks = spark.createDataFrame([(10 * i, i, 0, t) for i, t in TEXTS.items()], "chunk_id long, email_id long, ord int, text string")
    return mails, acl, chunks


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "corpus"))
    made.ingest(*tables(spark))
    return made


def test_ingest_and_truncate(spark, store):
    mails, acl, chunks = tables(spark)
    assert store.version() == 1 and store.read("acl").count() == 4 and store.read("chunks").count() == 3
    store.add_mails(mails.filter("email_id = 1"), acl)
    assert store.read("acl").count() == 4 and store.read("emails").count() == 4
    store.append("audit_log", spark.range(2))
    assert store.truncate() == 2 and not store.has("chunks") and store.read("audit_log").count() == 2
    store.ingest(mails, acl, chunks)
    assert store.version() == 3 and store.read("emails").count() == 3


def test_postings_are_sorted_and_searched(spark, store):
    terms = [r["term"] for r in store.read("postings").select("term").collect()]
    assert len(terms) == len(lexical.postings(store.read("chunks")).collect())
    index = lexical.search_index(store.read("postings"), store.read("lengths"), None, ["raptor", "friday"], 5).collect()
    assert index == lexical.search(store.read("chunks"), None, ["raptor", "friday"], 5).collect() and [r["chunk_id"] for r in index] == [10, 30]
    assert lexical.search_index(store.read("postings"), store.read("lengths"), None, ["zebra"], 5).count() == 0
    assert lexical.search(store.read("chunks"), None, [], 5).count() == 0


def test_vectors_of_another_embedder_are_refused(store):
    assert store.vectors(vector.HashEmbedder()).count() == 3
    with pytest.raises(ModelMismatch, match="hash-512"):
        store.vectors(Other())
    with pytest.raises(ModelMismatch):
        Engine.of_store(store, embedder=Other())


def test_group_sync_raises_the_version_and_rights_take_effect(spark, store):
    engine = Engine.of_store(store, Settings(use_graph=False, top_k=2))
    rosa = A.Principal("rosa", frozenset({"desk"}))
    assert engine.retrieve("Raptor hedge", rosa) == []
    people = spark.createDataFrame([(3, ["vince-k/inbox"], ["vince"])], "email_id long, folders array<string>, people array<string>")
    assert store.sync_groups(people, [A.Group("desk", grants=(A.Grant(mailboxes=("vince-k",)),))]) == 2
    after = Engine.of_store(store, Settings(use_graph=False, top_k=2))
    assert [c[0] for c in after.retrieve("Raptor hedge", rosa)] == [30]
    assert store.read("acl").filter("principal = 'group:desk'").count() == 1


def test_readable_chunks_are_kept_until_rights_change(spark, store):
    engine = Engine.of_store(store, Settings(use_graph=False))
    ken = A.Principal("ken")
    first = engine.corpus(ken).kept
    assert engine.corpus(ken).kept is first and first.count() == 2
    store.append("acl", spark.createDataFrame([(3, "user:ken")], "email_id long, principal string"))
    store.bump()
    engine.acl = store.read("acl")
    assert engine.corpus(ken).readable().count() == 3


def test_stored_answers(spark, store):
    settings = Settings(use_graph=False, top_k=2, cache_threshold=0.8)
    engine = Engine.of_store(store, settings)
    assert engine.ask("When will the Raptor hedge be unwound?", "jeff").cache_status == "miss" and len(engine.answers) == 1
    engine.answers.save()
    engine.write_audit()
    again = Engine.of_store(store, settings)
    assert len(again.answers) == 1 and again.ask("When will the Raptor hedge be unwound?", "ken").cache_status == "hit"
    assert [tuple(r) for r in again.answers.hit_counts().collect()] == [(1, 1)] and store.read("audit_log").count() == 1
    # without a context an entry covers what it hangs on
    again.answers.add("q", [0.0] * 512, "jeff", engine.ask("Raptor", "jeff"), [10], None)
    assert [r["context_chunks"] for r in again.answers.table().filter("entry_id = 2").collect()] == [[10]]
    again.answers.clear()
    assert len(again.answers) == 0 and not store.has("cache_entries")


def test_indexed_tables_follow_their_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    build = lambda: spark.read.parquet(path)
    assert indexed(spark, path, "t", build).count() == 3 and indexed(spark, path, "t", lambda: spark.range(9)).count() == 3
    import os

    spark.range(5).write.mode("overwrite").parquet(path)
    os.utime(path, (2e9, 2e9))
    assert indexed(spark, path, "t", build).count() == 5


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Bare:
        conf = type("c", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("s", (), {"master": "spark://x", "getConf": staticmethod(lambda: {})})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Bare)
    assert shared_dir(spark) and F is not None


def test_small_single_files_are_spread(spark, tmp_path):
    from palisade.sources import tables as t

    rows = spark.range(200_000).selectExpr("id", "sha2(string(id), 256) as h")
    rows.coalesce(1).write.parquet(str(tmp_path / "one file"))
    rows.repartition(3).write.parquet(str(tmp_path / "more"))
    one, more = spark.read.parquet(str(tmp_path / "one file")), spark.read.parquet(str(tmp_path / "more"))
    assert t.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and t.spread(one).count() == 200_000
    assert t.spread(more).inputFiles() == more.inputFiles() and "Exchange" not in t.spread(more)._jdf.queryExecution().executedPlan().toString()
    rows.limit(5).coalesce(1).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    assert t.spread(few) is few
