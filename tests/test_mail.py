"""A small mail corpus end to end: scan, parse, merge, rights, chunks, graph."""

import re

import pytest
from pyspark.sql import functions as F

from palisade.operators import acl as A
from palisade.operators import chunking, graph, ingest
from palisade.sources import files


def message(mid, sender, to, subject, body, cc="", date="Mon, 5 Mar 2001 10:00:00 -0800"):
    head = f"Message-ID: <{mid}>\nDate: {date}\nFrom: {sender}\nTo: {to}\n" + (f"Cc: {cc}\n" if cc else "")
    return (head + f"Subject: {subject}\n\n{body}\n").encode()


SECRET = "The Raptor hedge will be unwound on Friday for 40 million dollars."
MAILS = {
    "lay-k/inbox/1.": message("1@x", "jeff.skilling@enron.com", "kenneth.lay@enron.com", "Raptor", SECRET),
    "skilling-j/sent/1.": message("101@x", "jeff.skilling@enron.com", "kenneth.lay@enron.com", "Raptor", SECRET),
    "lay-k/sent/2.": message("2@x", "kenneth.lay@enron.com", "jeff.skilling@enron.com", "Lunch", "Shall we meet at noon?", cc="rosalee.fleming@enron.com"),
    "lay-k/sent/5.": message("5@x", "kenneth.lay@enron.com", "rosalee.fleming@enron.com", "Re: Raptor", "Please book a room.\n\n-----Original Message-----\n" + SECRET),
    "skilling-j/sent/6.": message("6@x", "jeff.skilling@enron.com", "vince.kaminski@enron.com", "Fw: Note", "---------------------- Forwarded by Jeff ---------------------------\n" + SECRET),
    "skilling-j/sent/7.": b"\xff\xfe no headers",
    "skilling-j/sent/8.": b"Message-ID: <8@x>\nDate: rubbish\nFrom: jeff.skilling@enron.com\nTo: kenneth.lay@enron.com\nSubject: Gr\xfc\xdfe\n\nShort note\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("maildir")
    for name, raw in MAILS.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(raw)
    return str(top)


@pytest.fixture(scope="module")
def merged(spark, root):
    owners = spark.createDataFrame([("lay-k", "kenneth.lay@enron.com"), ("skilling-j", "jeff.skilling@enron.com")], "mailbox string, owner string")
    mails = files.mails(files.parse(files.scan(spark, root))).join(owners, "mailbox")
    rows = mails.select("content_key", "ingest_ord", "message_id", "date", "sender", "recipients", "subject", "body", "owner", F.concat_ws("/", "mailbox", "folder").alias("folder"))
    return ingest.merge_copies(rows)


def test_scan_and_partitions(spark, root):
    assert files.scan(spark, root).count() == len(MAILS)
    some = files.scan(spark, root, ["lay-k", "nobody"])
    assert {r["mailbox"] for r in some.collect()} == {"lay-k"}
    assert {r["folder"] for r in some.collect()} == {"inbox", "sent"}
    assert files.scan(spark, root, ["nobody"]).count() == 0


def test_malformed_file_is_a_row_with_an_error(spark, root):
    parsed = files.parse(files.scan(spark, root))
    assert [r["error"] for r in parsed.filter("error is not null").collect()] == ["no sender"]
    assert parsed.filter("message_id = '8@x'").first()["date"] == ""


def test_copies_merge_and_history_is_cut(merged):
    rows = {r["subject"]: r for r in merged.collect()}
    assert len(rows) == 5
    assert rows["Raptor"]["owners"] == ["jeff.skilling@enron.com", "kenneth.lay@enron.com"]
    assert rows["Raptor"]["folders"] == ["lay-k/inbox", "skilling-j/sent"]
    assert rows["Raptor"]["message_id"] == "1@x"
    assert rows["Re: Raptor"]["body"] == "Please book a room."
    assert rows["Fw: Note"]["body"] == "[Forwarded message]\n" + SECRET


def test_rights_and_chunks(spark, merged):
    emails = merged.withColumn("id", F.xxhash64("content_key"))
    acl = A.derive(emails).cache()
    chunks = chunking.chunk(emails).select(F.col("email_id").alias("chunk_id"), "email_id", "ord", "text").cache()
    assert chunks.filter(F.col("text").startswith("From: kenneth.lay@enron.com | To: jeff.skilling@enron.com | Date: 2001-03-05 | Subject: Lunch\n")).count() == 1
    seen = {who: {r["text"].split("Subject: ")[1].split("\n")[0] for r in A.SecureCorpus(chunks, acl, A.Principal.of(who)).chunks().collect()} for who in ("rosalee.fleming@enron.com", "vince.kaminski@enron.com", "auditor", "stranger@x.com")}
    assert seen["rosalee.fleming@enron.com"] == {"Lunch", "Re: Raptor"}
    assert seen["vince.kaminski@enron.com"] == {"Fw: Note"}
    assert len(seen["auditor"]) == 5 and not seen["stranger@x.com"]
    corpus = A.SecureCorpus(chunks, acl, A.Principal.of("vince.kaminski@enron.com"))
    every = chunks.select("chunk_id").union(spark.range(999999, 1000000).toDF("chunk_id"))
    assert corpus.unreadable(every).count() == 5
    assert A.SecureCorpus(chunks, acl, A.Principal.of("auditor")).unreadable(every).count() == 0
    made = graph.build(chunks, emails)
    assert made["edges"].filter("rel = 'emailed'").count() == 6
    assert {r["label"] for r in made["entities"].filter("type = 'person'").collect()} >= {"Jeff Skilling", "Kenneth Lay"}


def test_owner_resolution(spark):
    used = [("lay-k", "rosalee.fleming@enron.com")] * 5 + [("lay-k", "kenneth.lay@enron.com"), ("lay-k", "klay@aol.com"), ("solo-x", "a@b.com")]
    rows = {r["mailbox"]: r for r in ingest.with_fallback(spark.createDataFrame([("lay-k",), ("solo-x",), ("none-y",)], "mailbox string"), ingest.resolve_owners(spark.createDataFrame(used, "mailbox string, addr string"))).collect()}
    assert rows["lay-k"]["owner"] == "kenneth.lay@enron.com"
    assert rows["lay-k"]["aliases"] == ["kenneth.lay@enron.com", "klay@aol.com"]
    assert rows["solo-x"]["owner"] == "a@b.com"
    assert rows["none-y"]["owner"] == "none-y@enron.com"


def test_boilerplate_keeps_the_first(spark):
    footer = "This message is meant for its reader only and must not be passed on to anyone else"
    rows = spark.createDataFrame([(i, f"2001-01-{i + 1:02d}", f"unique {i}\n\n{footer}") for i in range(25)], "email_id long, date string, body string")
    out = ingest.strip_boilerplate(rows).collect()
    assert sum(r["removed"] for r in out) == 24
    assert [r["email_id"] for r in out if footer in r["body"]] == [0]


def test_chunks_are_bounded():
    body = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(62)) for i in range(10))
    chunks = chunking.pack(body, 150, 20)
    assert max(len(c.split()) for c in chunks) <= 170
    assert chunks[1].split()[:20] == chunks[0].split()[-20:]
    assert chunking.pack("", 10, 2) == []
    assert chunking.pack(" ".join(map(str, range(25))), 10, 0) == [" ".join(map(str, range(i, min(i + 10, 25)))) for i in (0, 10, 20)]


GOOD = """
[groups.traders]
description = "Trading desk"
members = ["vince.kaminski@enron.com"]
[[groups.traders.grants]]
mailboxes = ["skilling-j"]
exclude_folders = ["*/inbox"]
"""


def test_group_rules(spark, merged):
    groups = files.parse_groups(GOOD)
    emails = merged.withColumn("email_id", F.xxhash64("content_key")).withColumn("people", F.concat(F.array("sender"), F.col("recipients.to"), F.col("recipients.cc")))
    granted = A.grants(emails, groups).join(emails, "email_id")
    # the secret also lies in an inbox: an exclusion wins if any copy matches
    subjects = {r["subject"] for r in granted.collect()}
    assert "Fw: Note" in subjects and "Raptor" not in subjects and len(subjects) == 2
    assert {r["name"]: r["n"] for r in A.grant_counts(emails, groups).collect()} == {"traders": 2}


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("[other]\n", "unknown top-level keys"),
        ("[groups.Bad]\n", "group names must match"),
        ("[groups.a]\nnope = 1\n", "unknown keys"),
        ("[groups.a]\nmembers = 'x'\n", "expected a list of strings"),
        ("[groups.a]\nmembers = ['x']\n", "not an email address"),
        ("[groups.a]\n[[groups.a.grants]]\nexclude_folders = ['x/*']\n", "needs at least one"),
        ("[groups.a]\n[[groups.a.grants]]\nfolders = ['*']\n", "not allowed"),
    ],
)
def test_bad_group_rules(text, said):
    with pytest.raises(files.GroupConfigError, match=re.escape(said)):
        files.parse_groups(text)


def test_directory_reloads(tmp_path):
    import os

    path = tmp_path / "groups.toml"
    path.write_text(GOOD)
    there = files.Directory(str(path))
    assert there.groups_of("Vince.Kaminski@enron.com ") == ["traders"]
    path.write_text(GOOD.replace("vince", "other"))
    os.utime(path, ns=(1, 1))
    assert there.groups_of("vince.kaminski@enron.com") == []


def test_questions_settings_report(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('// a comment\n\n{"id": "1", "question": "Où?", "hops": 2, "relevant_message_ids": ["a"]}\n')
    rows = files.read_questions(spark, str(path))
    assert rows.first()["question"] == "Où?" and rows.count() == 1
    files.write_questions(rows, str(tmp_path / "out"))
    assert files.read_questions(spark, str(tmp_path / "out")).first()["hops"] == 2
    assert files.Settings().with_overrides(top_k=None, candidate_k=9).candidate_k == 9
    assert files.Settings.from_env({"PALISADE_USE_GRAPH": "no", "PALISADE_TOP_K": "3"}).top_k == 3
    text, data = files.report("Title", spark.createDataFrame([(0.5, 12345.6)], "a double, b double"))
    assert "| 0.500 | 12,346 |" in text and '"a": 0.5' in data


def test_archives(spark, root, tmp_path):
    import tarfile

    made = tmp_path / "mail.tar.gz"
    with tarfile.open(made, "w:gz") as tar:
        tar.add(root, "maildir")
    archive = files.fetch(lambda: made.open("rb"), str(tmp_path / "copies" / "mail.tar.gz"))
    assert files.fetch(lambda: (_ for _ in ()).throw(OSError), archive) == archive  # it is there
    with pytest.raises(OSError):
        files.fetch(lambda: open("/nowhere", "rb"), str(tmp_path / "other.tar.gz"))
    assert not (tmp_path / "other.tar.gz").exists()
    assert files.unpack(archive, str(tmp_path / "out"), ["lay-k"]) == 3 and files.unpack(archive, str(tmp_path / "all")) == len(MAILS)
    straight = {(r["mailbox"], r["folder"], bytes(r["content"])) for r in files.scan_archives(spark, archive).collect()}
    assert straight == {(r["mailbox"], r["folder"], bytes(r["content"])) for r in files.scan(spark, root).collect()}
    assert {r["mailbox"] for r in files.scan_archives(spark, archive, ["lay-k", "nobody"]).collect()} == {"lay-k"}


def test_corpus_in_the_order_of_dates(spark, root):
    owners = spark.createDataFrame([("lay-k", "kenneth.lay@enron.com"), ("skilling-j", "jeff.skilling@enron.com")], "mailbox string, owner string")
    parsed = files.parse(files.scan(spark, root))
    whole = files.corpus(parsed, owners).orderBy("id").collect()
    assert [r["id"] for r in whole] == [1, 2, 3, 4, 5] and whole[0]["date"] == "" and whole[1]["owners"] == ["jeff.skilling@enron.com", "kenneth.lay@enron.com"]
    assert [r["subject"] for r in files.corpus(parsed, owners, 2).orderBy("id").collect()] == ["Raptor", "Lunch"]


def test_numbers_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(500)], "k int, v int").repartition(7)
    got = [(r["k"], r["v"]) for r in ingest.numbered(rows, "n", "k", "v").orderBy("n").collect()]
    assert got == sorted((i * 7 % 101, i) for i in range(500)) and ingest.numbered(rows.limit(0), "n", "k").count() == 0


def test_message_ids_are_used_once(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "", "z"), (4, None, "w"), (5, "b", "v")], "ingest_ord int, message_id string, content_key string")
    got = {r["ingest_ord"]: r["message_id"] for r in ingest.message_ids(rows).collect()}
    assert got == {1: "a", 2: "y@palisade.local", 3: "z@palisade.local", 4: "w@palisade.local", 5: "b"}


def test_settings_of_a_file(tmp_path):
    (tmp_path / ".env").write_text("# comment\nPALISADE_TOP_K=5\nexport PALISADE_CACHE_MODE='global'\nPALISADE_USE_GRAPH=no\nPALISADE_CANDIDATE_K=\n")
    s = files.Settings.load(str(tmp_path / ".env"), {"PALISADE_TOP_K": "6"})
    assert (s.top_k, s.cache_mode, s.use_graph, s.candidate_k) == (6, "global", False, 50)
    assert files.Settings.load(str(tmp_path / "none"), {}) == files.Settings() and s.with_overrides(top_k=None) == s
