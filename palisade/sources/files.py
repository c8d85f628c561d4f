"""Mailbox folders, group rules, question files, reports and settings."""

from __future__ import annotations

import email
import email.policy
import io
import json
import os
import re
import tarfile
import tomllib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, replace
from email.utils import getaddresses, parsedate_to_datetime
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import ingest
from palisade.operators.acl import Grant, Group

MAIL = "struct<message_id: string, date: string, sender: string, recipients: struct<to: array<string>, cc: array<string>, bcc: array<string>>, subject: string, raw_body: string, error: string>"
_ADDRESS = re.compile(r"[^@\s]+@[^@\s]+\.[a-z]{2,}", re.I)


def scan(spark: SparkSession, root: str, mailboxes: Iterable[str] | None = None) -> DataFrame:
    """(path, mailbox, folder, content) of every file below root/mailbox/; partitions that are not wanted are not listed."""
    wanted = sorted(mailboxes) if mailboxes is not None else ["*"]
    paths = [f"{root}/{m}" for m in wanted]
    jvm = spark.sparkContext._jvm
    there = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
            there.append(p)
    if not there:
        return spark.createDataFrame([], "path string, mailbox string, folder string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    below = F.regexp_extract("path", re.escape(root.rstrip("/").split(":")[-1]) + r"/+(.*)$", 1)
    mailbox = F.split(below, "/", 2)[0]
    return files.select("path", mailbox.alias("mailbox"), F.regexp_replace(F.regexp_extract(below, r"^[^/]*/(.*)/[^/]*$", 1), "/+$", "").alias("folder"), "content")


def fetch(opened: Callable[[], io.BufferedIOBase], archive: str, chunk: int = 1 << 20) -> str:
    """Copy an archive from anything that can be opened, unless it is there; a broken copy leaves nothing."""
    there = Path(archive)
    if not there.exists():
        there.parent.mkdir(parents=True, exist_ok=True)
        partial = there.with_name(there.name + ".part")
        with opened() as source, partial.open("wb") as out:
            while block := source.read(chunk):
                out.write(block)
        partial.rename(there)
    return str(there)


def _members(tar: tarfile.TarFile, mailboxes: Iterable[str] | None, top: str) -> Iterator[tarfile.TarInfo]:
    wanted = (f"{top}/",) if mailboxes is None else tuple(f"{top}/{m}/" for m in mailboxes)
    for member in tar:
        if member.isfile() and member.name.removeprefix("./").startswith(wanted):
            yield member


def unpack(archive: str, dest: str, mailboxes: Iterable[str] | None = None, top: str = "maildir") -> int:
    """Extract the mails of some mailboxes; members that would land outside `dest` are refused. How many there were."""
    n, wanted = 0, None if mailboxes is None else list(mailboxes)
    with tarfile.open(archive) as tar:
        for member in _members(tar, wanted, top):
            tar.extract(member, dest, filter="data")
            n += 1
    return n


def scan_archives(spark: SparkSession, path: str, mailboxes: Iterable[str] | None = None, top: str = "maildir") -> DataFrame:
    """The rows of `scan` straight from tar archives, a task for each, without unpacking them to a disk."""
    wanted = None if mailboxes is None else sorted(mailboxes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in _members(tar, wanted, top):
                        at = member.name.removeprefix("./").removeprefix(f"{top}/")
                        mailbox, _, rest = at.partition("/")
                        yield pa.RecordBatch.from_pydict({"path": [f"{name}/{at}"], "mailbox": [mailbox], "folder": [rest.rpartition("/")[0]], "content": [tar.extractfile(member).read()]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("mailbox", pa.string()), ("folder", pa.string()), ("content", pa.binary())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, mailbox string, folder string, content binary")


def _addresses(value: object) -> list[str]:
    found = []
    for _, a in getaddresses([re.sub(r"\s+", " ", str(value))]) if value is not None else []:
        plain = a.strip().strip("<>\"'").lower()
        if _ADDRESS.fullmatch(plain):
            found.append(plain)
    return list(dict.fromkeys(found))


def _one(content: bytes) -> dict:
    try:
        m = email.message_from_bytes(content, policy=email.policy.compat32)
        senders = _addresses(m.get("From"))
        if not senders:
            return {"error": "no sender"}
        try:
            date = parsedate_to_datetime(str(m.get("Date"))).isoformat()
        except (TypeError, ValueError, IndexError):
            date = ""
        own = None if m.is_multipart() else m.get_payload(decode=True)
        if own is None:
            own = b"\n".join(p.get_payload(decode=True) or b"" for p in m.walk() if p.get_content_type() == "text/plain")
        head = lambda name: str(m.get(name) or "")
        return {
            "message_id": head("Message-ID").strip().strip("<>"),
            "date": date,
            "sender": senders[0],
            "recipients": {"to": _addresses(m.get("To")), "cc": _addresses(m.get("Cc")), "bcc": _addresses(m.get("Bcc"))},
            "subject": re.sub(r"\s+", " ", head("Subject")).strip(),
            "raw_body": own.decode("latin-1"),
            "error": None,
        }
    except Exception as e:  # a malformed file is reported in its row and does not stop the scan
        return {"error": f"{type(e).__name__}: {e}"}


_COLUMNS = ("message_id", "date", "sender", "recipients", "subject", "raw_body", "error")


def parse(files: DataFrame) -> DataFrame:
    """Mails of scanned files; `error` says why a file gave none. Bodies are cleaned in SQL."""

    @F.pandas_udf(MAIL)
    def read(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in contents:
            found = [_one(bytes(c)) for c in batch]
            yield pd.DataFrame({name: pd.Series([f.get(name) for f in found], dtype=object) for name in _COLUMNS})

    rows = files.withColumn("m", read("content")).select("path", "mailbox", "folder", "m.*")
    return rows.withColumn("body", T.body(F.col("raw_body"))).drop("raw_body")


def mails(parsed: DataFrame) -> DataFrame:
    """Usable mails with their content key, in the order of mailbox and path."""
    usable = parsed.filter("error is null and not (body = '' and subject = '')")
    key = T.content_key(F.col("sender"), F.col("date"), F.col("subject"), F.col("body"))
    return usable.withColumn("content_key", key).withColumn("ingest_ord", F.struct("mailbox", "path"))


def corpus(parsed: DataFrame, owners: DataFrame, max_emails: int | None = None) -> DataFrame:
    """Distinct mails of parsed files with their ids, in the order of their dates.

    owners(mailbox, owner). Copies are merged; with a bound only the first distinct mails in
    the order of mailbox and path are taken. Dates are compared as text, an empty one first.
    """
    rows = mails(parsed).join(owners, "mailbox")
    kept = ("content_key", "ingest_ord", "message_id", "date", "sender", "recipients", "subject", "body", "owner")
    merged = ingest.merge_copies(rows.select(*kept, F.concat_ws("/", "mailbox", "folder").alias("folder")))
    if max_emails is not None:
        merged = merged.orderBy("ingest_ord").limit(max_emails)
    named = ingest.message_ids(merged)
    return ingest.numbered(named, "id", "date", "ingest_ord")


class GroupConfigError(ValueError):
    pass


_GROUP_NAME = re.compile(r"^[a-z0-9][a-z0-9_-]*$")


def _strings(value: object, where: str, mail: bool = False) -> tuple[str, ...]:
    if not isinstance(value, list) or any(not isinstance(v, str) for v in value):
        raise GroupConfigError(f"{where}: expected a list of strings")
    plain = tuple(v.strip().lower() for v in value)
    wrong = [v for v in plain if mail and not re.fullmatch(r"[^@\s]+@[^@\s]+\.[a-z]{2,}", v)]
    if wrong:
        raise GroupConfigError(f"{where}: not an email address: {wrong}")
    return plain


def _known(table: object, allowed: set[str], where: str) -> dict:
    if not isinstance(table, dict):
        raise GroupConfigError(f"{where}: expected a table")
    if extra := sorted(set(table) - allowed):
        raise GroupConfigError(f"{where}: unknown keys {extra}" if where else f"unknown top-level keys: {extra}")
    return table


def parse_groups(text: str) -> list[Group]:
    """Groups of a TOML text; anything unknown or too wide is an error."""
    groups = []
    names = [f.name for f in fields(Grant)]
    for name, spec in _known(tomllib.loads(text), {"groups"}, "").get("groups", {}).items():
        where = f"groups.{name}"
        if not _GROUP_NAME.match(name):
            raise GroupConfigError(f"{where}: group names must match {_GROUP_NAME.pattern}")
        _known(spec, {"description", "members", "grants"}, where)
        rules = []
        for i, given in enumerate(spec.get("grants", [])):
            at = f"{where}.grants[{i}]"
            _known(given, set(names), at)
            rule = Grant(**{n: _strings(given.get(n, []), f"{at}.{n}", n in ("addresses", "participants")) for n in names})
            if not any((rule.mailboxes, rule.folders, rule.addresses, rule.participants)):
                raise GroupConfigError(f"{at}: a grant needs at least one of mailboxes/folders/addresses/participants")
            if {"*", "*/*"} & set(rule.folders):
                raise GroupConfigError(f"{at}: a folder pattern matching every email is not allowed; use the auditor role")
            rules.append(rule)
        members = _strings(spec.get("members", []), f"{where}.members", True)
        groups.append(Group(name, str(spec.get("description", "")), frozenset(members), tuple(rules)))
    return groups


class Directory:
    """Current groups of a rules file, read again when the file changes."""

    def __init__(self, path: str | None = None, groups: list[Group] | None = None):
        self.path, self._stamp, self._groups = path, None, list(groups or [])

    @property
    def groups(self) -> list[Group]:
        if self.path is not None:
            there = Path(self.path)
            stamp = there.stat().st_mtime_ns if there.exists() else None
            if stamp != self._stamp:
                self._groups = parse_groups(there.read_text("utf-8")) if stamp is not None else []
                self._stamp = stamp
        return self._groups

    def groups_of(self, user: str) -> list[str]:
        return [g.name for g in self.groups if user.strip().lower() in g.members]


QUESTION = "id string, question string, principal string, relevant_message_ids array<string>, reference_answer string, hops int, source string, reviewed boolean, tags array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; empty lines and lines with `//` first are comments."""
    lines = spark.read.text(path).filter(r"trim(value) <> '' and not ltrim(value) like '//%'")
    return lines.select(F.from_json("value", QUESTION).alias("q")).select("q.*")


def write_questions(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").json(path)


def number(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, float):
        return str(value)
    return f"{value:.3f}" if abs(value) < 100 else f"{value:,.0f}"


def report(title: str, rows: DataFrame, notes: str = "", most: int = 1_000) -> tuple[str, str]:
    """(Markdown, JSON) of a small result; `most` bounds what the driver reads."""
    found = [r.asDict() for r in rows.limit(most).collect()]
    head = rows.columns
    lines = [f"# {title}", "", notes, "", f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *[f"| {' | '.join(number(r[c]) for c in head)} |" for r in found]]
    return "\n".join(line for i, line in enumerate(lines) if line or i != 2) + "\n", json.dumps(found, indent=2, default=str)


@dataclass(frozen=True)
class Settings:
    cache_mode: str = "acl_aware"
    cache_threshold: float = 0.92
    cache_ttl_seconds: float = 86_400.0
    cache_provenance: str = "dependencies"
    retrieval_mode: str = "hybrid"
    use_graph: bool = True
    use_reranker: bool = False
    top_k: int = 8
    candidate_k: int = 50
    router_threshold: float = 0.5
    small_model: str = "small"
    large_model: str = "large"
    judge_model: str = "judge"
    groups_path: str = "config/groups.toml"
    max_words: int = 180
    overlap_words: int = 25

    def with_overrides(self, **values: object) -> Settings:
        """None means: as it was."""
        return replace(self, **{k: v for k, v in values.items() if v is not None})

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "PALISADE_") -> Settings:
        source, given = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = source.get(prefix + f.name.upper())
            if raw:  # an empty value is none
                kind = type(f.default)
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**given)

    @classmethod
    def load(cls, path: str = ".env", env: dict[str, str] | None = None, prefix: str = "PALISADE_") -> Settings:
        """From a file of NAME=value lines and the environment, which wins."""
        there, found = Path(path), {}
        for line in there.read_text("utf-8").splitlines() if there.exists() else []:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
        return cls.from_env({**found, **(os.environ if env is None else env)}, prefix)
