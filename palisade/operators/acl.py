"""Who may read what. Every retrieval operator gets its rows through a SecureCorpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T

WILDCARD = "*"
AUDITORS = ("auditor",)


@dataclass(frozen=True)
class Principal:
    user: str
    groups: frozenset[str] = field(default_factory=frozenset)
    is_auditor: bool = False

    @classmethod
    def of(cls, user: str, groups: object = (), auditors: tuple[str, ...] = AUDITORS) -> Principal:
        name = user.strip().lower()
        if name in auditors or name.split("@")[0] in auditors:
            return cls(name, is_auditor=True)
        return cls(name, frozenset(groups))

    @property
    def tokens(self) -> list[str]:
        return [WILDCARD] if self.is_auditor else sorted({f"user:{self.user}", *(f"group:{g}" for g in self.groups)})


def allowed(rows: DataFrame, questions: DataFrame, access: DataFrame) -> DataFrame:
    """Those of rows(question_id, email_id, ...) that the question's own tokens may read.

    questions(question_id, tokens), access(email_id, principal). The wildcard reads everything.
    """
    asking = questions.select("question_id", F.explode("tokens").alias("principal"))
    everything = asking.filter(F.col("principal") == WILDCARD).select("question_id").distinct().withColumn("__all", F.lit(True))
    may = asking.join(access, "principal").select("question_id", "email_id").distinct().withColumn("__may", F.lit(True))
    flagged = rows.join(may, ["question_id", "email_id"], "left").join(everything, "question_id", "left")
    return flagged.filter(F.col("__may").isNotNull() | F.col("__all").isNotNull()).select(rows.columns)


@dataclass(frozen=True)
class Grant:
    """One rule; patterns are shell patterns on `mailbox/folder`."""

    mailboxes: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    addresses: tuple[str, ...] = ()
    participants: tuple[str, ...] = ()
    exclude_folders: tuple[str, ...] = ()

    def matches(self, folders: Column, people: Column) -> Column:
        """An exclusion wins if any copy lies there; otherwise any of the four is enough."""

        def any_folder(patterns: tuple[str, ...]) -> Column:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | F.exists(folders, _like(p))
            return hit

        boxes = F.transform(folders, lambda f: F.split(f, "/", 2)[0])
        given = F.lit(False)
        if self.mailboxes:
            given = given | F.arrays_overlap(boxes, F.array(*map(F.lit, self.mailboxes)))
        given = given | any_folder(self.folders)
        for names in (self.addresses, self.participants):
            if names:
                given = given | F.arrays_overlap(people, F.array(*map(F.lit, names)))
        return F.coalesce(given, F.lit(False)) & ~any_folder(self.exclude_folders)


def _like(pattern: str):
    return lambda f: f.rlike(T.glob(pattern))


@dataclass(frozen=True)
class Group:
    name: str
    description: str = ""
    members: frozenset[str] = frozenset()
    grants: tuple[Grant, ...] = ()


def derive(emails: DataFrame) -> DataFrame:
    """(email_id, principal) from sender, recipients and owners."""
    people = T.acl_tokens(F.array("sender"), F.col("recipients.to"), F.col("recipients.cc"), F.col("recipients.bcc"), F.col("owners"))
    return emails.select(F.col("id").alias("email_id"), F.explode(people).alias("principal"))


class SecureCorpus:
    """Tables as one principal sees them; the filter lies below whatever is built on them."""

    def __init__(self, chunks: DataFrame, acl: DataFrame, principal: Principal, kept: DataFrame | None = None):
        """kept(chunk_id): what the principal may read, if that was worked out before."""
        self.all_chunks, self.acl, self.principal, self.kept = chunks, acl, principal, kept

    def _mine(self) -> DataFrame:
        return self.acl.filter(F.col("principal").isin(self.principal.tokens))

    def chunks(self) -> DataFrame:
        if self.principal.is_auditor:
            return self.all_chunks
        if self.kept is not None:
            return self.all_chunks.join(self.kept, "chunk_id", "left_semi")
        return self.all_chunks.join(self._mine(), "email_id", "left_semi")

    def readable(self) -> DataFrame:
        return self.chunks().select("chunk_id") if self.kept is None else self.kept

    def only(self, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
        """Rows of any table with a chunk that may be read."""
        if self.principal.is_auditor:
            return rows
        return rows.join(self.readable().withColumnRenamed("chunk_id", "__readable"), F.col(key) == F.col("__readable"), "left_semi")

    def unreadable(self, ids: DataFrame) -> DataFrame:
        """Those of ids(chunk_id) that may not be read; unknown ids are among them."""
        if self.principal.is_auditor:
            return ids.select("chunk_id").distinct().limit(0)
        return ids.select("chunk_id").distinct().join(self.readable(), "chunk_id", "left_anti")


def get_chunks(chunks: DataFrame, emails: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids, "chunk_id", "left_semi").join(emails, "email_id")


def grants(emails: DataFrame, groups: list[Group]) -> DataFrame:
    """(email_id, principal) that the rules give; emails(email_id, folders, people).

    The rules become one expression over each mail, so nothing is joined.
    """
    given = []
    for g in groups:
        hit = F.lit(False)
        for rule in g.grants:
            hit = hit | rule.matches(F.col("folders"), F.col("people"))
        given.append(F.when(hit, F.lit(f"group:{g.name}")))
    if not given:
        return emails.select("email_id", F.lit("").alias("principal")).limit(0)
    return emails.select("email_id", F.explode(F.array_compact(F.array(*given))).alias("principal"))


def sync(acl: DataFrame, emails: DataFrame, groups: list[Group]) -> DataFrame:
    """The access table with all group rows replaced by what the rules give now."""
    return acl.filter(~F.col("principal").startswith("group:")).unionByName(grants(emails, groups)).distinct()


def grant_counts(emails: DataFrame, groups: list[Group]) -> DataFrame:
    """(name, n) with zero for groups that get nothing: one pass, one conditional sum each."""
    sums = []
    for i, g in enumerate(groups):
        hit = F.lit(False)
        for rule in g.grants:
            hit = hit | rule.matches(F.col("folders"), F.col("people"))
        sums.append(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias(f"g{i}"))
    pairs = F.array(*[F.struct(F.lit(g.name).alias("name"), F.col(f"g{i}").alias("n")) for i, g in enumerate(groups)])
    return emails.agg(*sums).select(F.inline(pairs))


def explain(acl: DataFrame, principal: Principal, groups: list[Group]) -> DataFrame:
    """(email_id, acl, matched, reasons, readable) of each mail."""
    tokens = F.array(*map(F.lit, principal.tokens))
    per = acl.groupBy("email_id").agg(F.array_sort(F.collect_set("principal")).alias("acl"))
    matched = tokens if principal.is_auditor else F.array_sort(F.array_intersect(F.col("acl"), tokens))
    described = {g.name: g.description for g in groups if g.description}

    def reason(token: Column) -> Column:
        note = F.lit("")
        for name, words in described.items():
            note = F.when(token == f"group:{name}", f" ({words})").otherwise(note)
        user = F.concat(F.substring(token, 6, 2**20), F.lit(" is the sender, a recipient, or a mailbox owner of this email"))
        group = F.concat(F.lit("member of group '"), F.substring(token, 7, 2**20), F.lit("'"), note)
        return F.when(token.startswith("user:"), user).otherwise(group)

    reasons = F.array(F.lit("auditor role reads everything")) if principal.is_auditor else F.transform(F.col("matched"), reason)
    return per.withColumn("matched", matched).withColumn("reasons", reasons).withColumn("readable", F.size("matched") > 0)


def top_principals(acl: DataFrame, suffix: str = "", limit: int = 25) -> DataFrame:
    users = acl.filter(F.col("principal").ilike("user:%") & F.col("principal").ilike(f"%{suffix}"))
    return users.groupBy("principal").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "principal").limit(limit).select(F.substring("principal", 6, 2**20).alias("user"), "n")


def next_version(versions: DataFrame) -> DataFrame:
    """The access version after one more change, from an append-only table."""
    return versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
