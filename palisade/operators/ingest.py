"""From mailbox files to mails: merging copies, owners, aliases, boilerplate, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T

DOMAIN = "enron.com"  # fixed value: the home domain of mailbox owners


def merge_copies(mails: DataFrame, key: str = "content_key", order: str = "ingest_ord") -> DataFrame:
    """One row for each content: all fields of the first copy, owners and folders of every copy."""
    kept = [c for c in mails.columns if c not in (key, "owner", "folder")]
    return mails.groupBy(key).agg(
        F.min_by(F.struct(*kept), F.col(order)).alias("first"),
        F.array_sort(F.collect_set("owner")).alias("owners"),
        F.array_sort(F.collect_set("folder")).alias("folders"),
    ).select(key, "first.*", "owners", "folders")


def first_mails(mails: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first `limit` mails by a total order, with their place in it; a sort with a bound, not a window over all."""
    best = mails.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds the place of each row (from 1) in a total order, without one task that sees all rows.

    Rows are dealt into ranges of the order and numbered inside each; the sizes of the ranges
    before, a row for each, are added.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inside = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = inside.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = inside.join(before.select("__part", "__before"), "__part")
    return placed.withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).drop("__part", "__place", "__before")


def paragraph_key(paragraph: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(paragraph, r"\s+", " "), r"^\s+|\s+$", ""))


def strip_boilerplate(mails: DataFrame, id_col: str = "email_id", date_col: str = "date", body_col: str = "body", separator: str = r"\n\s*\n", joiner: str = "\n\n", min_count: int = 20, min_words: int = 12) -> DataFrame:
    """(id, body, removed): paragraphs that many mails have stay only where they come first.

    Only long paragraphs are counted, by a digest of their key and once for each mail. Each is
    compared with the first place of its key, a minimum, so a paragraph that most mails share
    makes no hot window.
    """
    split = mails.select(id_col, date_col, F.posexplode(F.split(body_col, separator)).alias("pos", "p"))
    words = F.size(F.filter(F.split("p", r"\s+"), lambda w: w != ""))
    paragraphs = split.withColumn("key", F.when(words >= min_words, F.md5(paragraph_key(F.col("p")))))
    place = F.struct(date_col, id_col, "pos")
    once = paragraphs.filter("key is not null").groupBy("key", id_col).agg(F.min(place).alias("first"))
    frequent = once.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_count).select("key", "first")
    marked = paragraphs.join(frequent, "key", "left").withColumn("gone", F.col("first").isNotNull() & (place > F.col("first")))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "p"))))
    joined = F.array_join(F.transform(kept, lambda x: x["p"]), joiner)
    return marked.groupBy(id_col).agg(T.strip(joined).alias(body_col), F.sum(F.col("gone").cast("long")).alias("removed"))


def resolve_owners(addresses: DataFrame) -> DataFrame:
    """(mailbox, owner, aliases) from addresses(mailbox, addr), one row for each use.

    Addresses with the mailbox's surname in their name are the owner's; the best has the
    home domain, the first initial, and a dot, and then the most uses. Without one, the most
    used address; without any, the mailbox's own name.
    """
    surname, initial = F.split("mailbox", "-")[0], F.when(F.instr("mailbox", "-") > 0, F.split("mailbox", "-")[1])
    counts = addresses.filter("addr is not null and addr <> ''").groupBy("mailbox", "addr").agg(F.count("*").alias("n"))
    local, domain = F.split("addr", "@")[0], F.split("addr", "@")[1]
    mine = (surname != "") & (F.instr(local, surname) > 0)
    ranked = counts.select(
        "mailbox", "addr", mine.alias("mine"),
        F.struct((~mine).alias("a"), (mine & (domain != DOMAIN)).alias("b"), (mine & ~F.coalesce(F.startswith(local, initial) & (initial != ""), F.lit(False))).alias("c"), (mine & (F.instr(local, ".") == 0)).alias("d"), (-F.col("n")).alias("e"), F.col("addr").alias("f")).alias("rank"),
    )
    best = ranked.groupBy("mailbox").agg(F.min("rank").alias("r"), F.array_sort(F.collect_set(F.when(F.col("mine"), F.col("addr")))).alias("aliases"))
    return best.select("mailbox", F.col("r.f").alias("owner"), F.when(F.size("aliases") > 0, F.col("aliases")).otherwise(F.array("r.f")).alias("aliases"))


def with_fallback(mailboxes: DataFrame, owners: DataFrame) -> DataFrame:
    own = F.concat(F.col("mailbox"), F.lit(f"@{DOMAIN}"))
    joined = mailboxes.select("mailbox").distinct().join(owners, "mailbox", "left")
    return joined.select("mailbox", F.coalesce("owner", own).alias("owner"), F.coalesce("aliases", F.array(own)).alias("aliases"))


def match_aliases(addresses: DataFrame, owners: DataFrame) -> DataFrame:
    """(addr, owner) of addresses that look like a mailbox owner's: initial, letters, surname.

    owners(mailbox, owner, ord); the first by ord wins. Both sides meet on the surname's
    tail, the letters right before the @ of which the surname is a suffix, so this is an
    equality join on suffixes, not a comparison of every address with every owner.
    """
    pattern = owners.filter(F.split("mailbox", "-")[1] != "").select("owner", "ord", F.split("mailbox", "-")[0].alias("surname"), F.substring(F.split("mailbox", "-")[1], 1, 1).alias("initial"))
    local = F.lower(F.split("addr", "@")[0])
    tails = addresses.select("addr", local.alias("local"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(local), F.lit(1))), lambda i: F.substring(local, i, 2**20))).alias("surname"))
    hit = tails.join(pattern, "surname").filter(F.startswith("local", "initial"))
    front = F.substring(F.col("local"), 2, F.length("local") - F.length("surname") - 1)
    fits = (F.length("local") > F.length("surname")) & front.rlike(r"^[a-z]*[._]?$")
    return hit.filter(fits).groupBy("addr").agg(F.min_by("owner", "ord").alias("owner"))


def canonical(people: DataFrame, aliases: DataFrame, id_col: str = "email_id") -> DataFrame:
    """(id, people) with aliases replaced, in order, each name once; people(id, people array)."""
    each = people.select(id_col, F.posexplode("people").alias("pos", "addr")).join(aliases, "addr", "left")
    named = each.select(id_col, "pos", F.coalesce("owner", "addr").alias("addr")).groupBy(id_col, "addr").agg(F.min("pos").alias("pos"))
    lists = named.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "addr"))), lambda x: x["addr"]).alias("people"))
    return people.select(id_col).join(lists, id_col, "left").select(id_col, F.coalesce("people", F.array().cast("array<string>")).alias("people"))


def message_ids(mails: DataFrame, id_col: str = "message_id", key: str = "content_key", order: str = "ingest_ord", domain: str = "palisade.local") -> DataFrame:
    """Empty and already used message ids become one made of the content key.

    The first use of an id is a minimum that is joined back, so all the mails without an id,
    or with one that many share, are dealt over many tasks.
    """
    firsts = mails.filter(F.col(id_col) != "").groupBy(F.col(id_col).alias("__id")).agg(F.min(order).alias("__first"))
    joined = mails.join(firsts, F.col(id_col) == F.col("__id"), "left")
    again = F.col("__first").isNull() | (F.col(order) > F.col("__first"))
    return joined.withColumn(id_col, F.when(again, F.concat(F.col(key), F.lit(f"@{domain}"))).otherwise(F.col(id_col))).drop("__id", "__first")
