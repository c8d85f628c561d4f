import pytest

from palisade.engine import Engine
from palisade.operators import audit, cache
from palisade.sources.files import Settings

QUESTION = "When will the Raptor hedge be unwound?"


@pytest.fixture(scope="module")
def engine(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "From: jeff\nThe Raptor hedge will be unwound on Friday for 40 million dollars."), (2, 2, "From: ken\nLunch is at noon on Monday in the old cafe."), (3, 3, "From: vince\nThe Raptor model has a flaw in the price curve.")],
        "chunk_id long, email_id long, text string",
    ).cache()
    acl = spark.createDataFrame([(1, "user:jeff"), (1, "user:ken"), (2, "user:ken"), (2, "user:rosa"), (3, "user:vince"), (3, "user:jeff")], "email_id long, principal string").cache()
    subjects = spark.createDataFrame([(1, "Raptor"), (2, "Re: Lunch"), (3, "Model")], "email_id long, subject string")
    return Engine(spark, chunks, acl, subjects, Settings(cache_threshold=0.8, top_k=2, use_graph=False))


def test_acl_aware_shares_and_blocks(engine):
    e = engine.with_mode("acl_aware")
    first = e.ask(QUESTION, "jeff")
    assert first.cache_status == "miss" and "Friday" in first.text and first.cited == [1]
    assert e.ask(QUESTION, "ken").cache_status == "hit"
    other = e.ask(QUESTION, "rosa")
    assert other.cache_status != "hit" and "Friday" not in other.text and "CACHE_ACL_BLOCKED entries=1" in other.events
    assert e.ask(QUESTION, "stranger").cache_status == "bypass"
    log = e.audit()
    assert audit.metrics(log).first()["queries"] == 4
    assert {r["principal"] for r in audit.accesses(log).filter("chunk_id = 1").collect()} == {"jeff", "ken"}


def test_global_leaks_and_per_user_does_not_share(engine):
    e = engine.with_mode("global")
    e.ask(QUESTION, "jeff")
    leak = e.ask(QUESTION, "rosa")
    assert leak.cache_status == "hit" and leak.events and leak.events[0].startswith("CACHE_LEAK")
    own = engine.with_mode("per_user")
    own.ask(QUESTION, "jeff")
    assert own.ask(QUESTION, "ken").cache_status == "miss" and own.ask(QUESTION, "jeff").cache_status == "hit"
    off = engine.with_mode("off")
    off.ask(QUESTION, "jeff", model="forced-model")
    assert off.ask(QUESTION, "jeff").cache_status == "miss" and off.log[0][3].model == "forced-model"


@pytest.mark.parametrize("mode", cache.MODES)
def test_stored_answers_for_many_questions(spark, engine, mode):
    e = engine.with_mode(mode)
    for question, user in ((QUESTION, "jeff"), ("When is lunch on Monday?", "ken")):
        e.ask(question, user)
    asked, retrieved, alone = [], [], {}
    for i, (question, user) in enumerate((q, u) for q in (QUESTION, "When is lunch on Monday?") for u in ("jeff", "ken", "rosa")):
        who, query = e.principal(user), e.embedder.query(question).tolist()
        found = e.retrieve(question, who)
        entry, *blocked = e.answers.lookup(query, who, e.corpus(who), [(c, m) for c, m, *_ in found])
        alone[i] = (entry and entry["entry_id"], *blocked)
        asked.append((i, user, list(who.tokens), query))
        retrieved += [(i, row[0], rank) for rank, row in enumerate(found)]
    table = spark.createDataFrame(asked, "question_id long, user string, tokens array<string>, embedding array<double>")
    many = e.answers.lookup_many(table, spark.createDataFrame(retrieved, "question_id long, chunk_id long, rank int"), e.chunks, e.acl)
    assert {r["question_id"]: tuple(r)[1:] for r in many.collect()} == alone
