"""Entities, mentions, edges, and the access-filtered two-hop expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import text as T

ACRONYM = r"(?U)\b([A-Z][A-Z&]{1,6}[A-Z0-9])\b"
PROJECT = r"\b(?:Project|project|Deal|deal)\s+([A-Z][a-zA-Z]+)\b"
PHRASE = r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]+(?:\s[A-Z][a-z]+){1,2})\b"
ORGANISATION = rf"\b((?:[A-Z][A-Za-z&\-]+\s){{1,4}}(?:{'|'.join(fixed.ORG_SUFFIXES)}))\b"


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _labelled(labels: Column, kind) -> Column:
    return F.transform(labels, lambda x: F.struct(x.alias("label"), kind(x).alias("type")))


def acronyms(text: Column) -> Column:
    """Distinct names in capitals."""
    return F.filter(_found(text, ACRONYM), lambda a: ~a.isin(*fixed.STOP_ACRONYMS))


def acronym_type(label: Column) -> Column:
    return F.when(F.length(label) >= 3, "project").otherwise("other")


def type_counts(entities: DataFrame) -> DataFrame:
    """(type, n) of entities(name, type)."""
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def text_entities(text: Column) -> Column:
    """array<struct<label, type>> of names in a chunk, below its header line."""
    below = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    projects = F.filter(_found(below, PROJECT), lambda p: ~F.lower(p).isin(*fixed.COMMON_WORDS))
    phrases = F.filter(_found(below, PHRASE), lambda p: ~F.lower(F.split(p, r"\s")[0]).isin(*fixed.STOP_FIRST_WORDS))
    return F.array_distinct(
        F.concat(
            _labelled(_found(below, ORGANISATION), lambda _: F.lit("org")),
            _labelled(acronyms(below), acronym_type),
            _labelled(projects, lambda _: F.lit("project")),
            _labelled(phrases, lambda _: F.lit("person_or_org")),
        )
    )


def kept_names(chunks: DataFrame, min_df: int = 2, max_share: float = 0.05) -> DataFrame:
    """(name, df) of names frequent enough to matter and rare enough to tell.

    A one-word name that is also a common lower-case word is shouting, not a name.
    """
    names = chunks.select(F.explode(F.array_distinct(F.transform(text_entities(F.col("text")), lambda e: F.lower(e["label"])))).alias("name"))
    df = names.groupBy("name").agg(F.count("*").alias("df"))
    n = chunks.count()
    most = max(min_df + 1, int(n * max_share))
    return keep_frequent(df, lower_words(chunks), min_df, most)


def lower_words(chunks: DataFrame) -> DataFrame:
    """(name, lower_df): in how many chunks a word stands in lower case."""
    words = chunks.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b([a-z]{2,})\b"), F.lit(1)))).alias("name"))
    return words.groupBy("name").agg(F.count("*").alias("lower_df"))


def keep_frequent(df: DataFrame, lower: DataFrame, min_df: int, most: int) -> DataFrame:
    joined = df.filter(F.col("df").between(min_df, most) & ~F.col("name").isin(*fixed.COMMON_WORDS)).join(lower, "name", "left")
    shouted = ~F.col("name").contains(" ") & (F.coalesce("lower_df", F.lit(0)) >= F.greatest(F.lit(3), F.floor(F.col("df") / 2)))
    return joined.filter(~shouted).select("name", "df")


def build(chunks: DataFrame, emails: DataFrame, min_df: int = 2, max_share: float = 0.05) -> dict[str, DataFrame]:
    """entities, mentions and edges of chunks(chunk_id, email_id, ord, text) and emails(id, sender, recipients).

    Order is explicit: by chunk, place in the chunk and name. An entity's first place gives
    its id, label and type.
    """
    rows = chunks.join(emails.select(F.col("id").alias("email_id"), "sender", "recipients"), "email_id")
    person = lambda name, pos: F.struct(F.lower(name).alias("name"), name.alias("label"), F.lit("person").alias("type"), pos.alias("pos"))
    people = F.concat(F.col("recipients.to"), F.col("recipients.cc"))
    header = F.when(F.col("ord") == 0, F.transform(people, lambda p, i: person(p, i + 1))).otherwise(F.array())
    names = kept_names(chunks, min_df, max_share).select("name")
    senders = rows.select("chunk_id", person(F.col("sender"), F.lit(0)).alias("e"))
    heads = rows.select("chunk_id", F.explode(header).alias("e"))
    found = rows.select("chunk_id", F.posexplode(text_entities(F.col("text"))).alias("i", "x"))
    texts = found.select("chunk_id", F.struct(F.lower("x.label").alias("name"), F.col("x.label").alias("label"), F.col("x.type").alias("type"), (F.col("i") + 10_000).alias("pos")).alias("e"))
    texts = texts.join(names, F.col("e.name") == names["name"], "left_semi")
    every = senders.unionByName(heads).unionByName(texts).select("chunk_id", "e.*")
    firsts = every.groupBy("name").agg(F.min(F.struct("chunk_id", "pos", "label", "type")).alias("f"))
    label = F.when(F.col("name").contains("@"), T.person_label(F.col("name"))).otherwise(F.col("f.label"))
    # ids only have to be distinct and ordered by first place; a window over all names would not scale
    entities = firsts.select(F.concat_ws(":", F.lpad(F.col("f.chunk_id").cast("string"), 12, "0"), F.lpad(F.col("f.pos").cast("string"), 6, "0"), "name").alias("entity_id"), "name", label.alias("label"), F.col("f.type").alias("type"))
    ids = entities.select("entity_id", "name")
    mentions = every.join(ids, "name").select("entity_id", "chunk_id").distinct()
    emailed = rows.filter("ord = 0").select("chunk_id", F.lower("sender").alias("a"), F.explode(F.transform(people, F.lower)).alias("b"))
    emailed = _with_ids(emailed, ids).withColumn("rel", F.lit("emailed"))
    members = senders.unionByName(texts).select("chunk_id", "e.name", "e.pos").groupBy("chunk_id", "name").agg(F.min("pos").alias("pos"))
    pairs = _with_ids(co_members(members, "chunk_id", "name", "pos"), ids).withColumn("rel", F.lit("co_mentioned"))
    return {"entities": entities, "mentions": mentions, "edges": emailed.unionByName(pairs).select("src", "dst", "rel", "chunk_id")}


def _with_ids(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    src, dst = ids.select(F.col("entity_id").alias("src"), F.col("name").alias("a")), ids.select(F.col("entity_id").alias("dst"), F.col("name").alias("b"))
    return pairs.join(src, "a").join(dst, "b").select("chunk_id", "src", "dst")


def co_members(members: DataFrame, group: str, member: str, order: str, cap: int = fixed.GRAPH_PAIR_CAP) -> DataFrame:
    """(group, a, b): pairs of the first `cap` members of each group, formed inside one array, without a join."""
    w = Window.partitionBy(group).orderBy(order, member)
    first = members.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
    lists = first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", member))), lambda x: x[member]).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, cap), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(group, F.explode(pairs).alias("p")).select(group, "p.a", "p.b")


def idf(mentions: DataFrame, n_chunks: int) -> DataFrame:
    """(entity_id, idf) over all mentions, whoever may read them."""
    return mentions.groupBy("entity_id").agg(F.round(F.log1p(F.lit(float(n_chunks)) / (1 + F.count("*"))), 9).alias("idf"))


def aliases(entities: DataFrame) -> DataFrame:
    """(alias, entity_id): names, labels, first-last and surnames; the least id wins."""
    label = F.lower("label")
    parts = F.split(label, " ")
    person = F.when((F.col("type") == "person") & (F.size(parts) >= 2), F.array(F.concat_ws(" ", parts[0], F.element_at(parts, -1)), F.element_at(parts, -1))).otherwise(F.array().cast("array<string>"))
    every = entities.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("name", label), person))).alias("alias"))
    usable = (F.length("alias") >= 3) & ~F.col("alias").isin(*fixed.COMMON_WORDS)
    return every.filter(usable).groupBy("alias").agg(F.min("entity_id").alias("entity_id"))


def seeds(question: str, known: DataFrame) -> list:
    """Entity ids named in a question, longest names first at each place.

    The question's own runs of words, a few hundred at most, are looked up in the alias
    table by a filter; the left-to-right choice is then made on the driver.
    """
    import re

    tokens = [t.strip(".") for t in re.findall(r"[a-z0-9&.@\-]+", question.lower())]
    runs = {" ".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 1, min(i + 5, len(tokens) + 1))}
    if not runs:
        return []
    found = {r["alias"]: r["entity_id"] for r in known.filter(F.col("alias").isin(*sorted(runs))).collect()}
    out, i = [], 0
    while i < len(tokens):
        for j in range(min(i + 4, len(tokens)), i, -1):
            hit = found.get(" ".join(tokens[i:j]))
            if hit is not None:
                if hit not in out:
                    out.append(hit)
                i = j
                break
        else:
            i += 1
    return out


def describe(ids: list, entities: DataFrame) -> list[str]:
    """The labels of some entities, in their order; ids are those of one question."""
    labels = {r["entity_id"]: r["label"] for r in entities.filter(F.col("entity_id").isin(ids)).select("entity_id", "label").collect()} if ids else {}
    return [labels[i] for i in ids if i in labels]


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, chunk_id): edges(src, dst, chunk_id) in both directions, as often as they occur, sorted by node."""
    there, back = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "chunk_id"), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "chunk_id")
    return there.unionByName(back).repartitionByRange("a").sortWithinPartitions("a")


def expand(start: DataFrame, edges: DataFrame, mentions: DataFrame, weights: DataFrame, hops: int = 2, width: int = fixed.GRAPH_FRONTIER, limit: int = 50, readable: DataFrame | None = None, adjacent: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) around start(node), over edges and mentions that may be read.

    Edges and mentions may be read if `readable`(chunk_id) has their chunk; without it they
    all may. `adjacent` is a stored `adjacency` of the edges. At each hop every edge at the
    frontier lends its chunk 1/hop; the `width` best new neighbours by count times idf get the
    weight 1/(1 + hop) and are the next frontier. A chunk scores the weighted idf of its
    mentions and half of what edges lent it. A frontier is `width` rows, which come to the
    driver, so a hop is one job and no hop is worked out again for the next; only rows at the
    frontier are looked at, and held against the rights.
    """
    spark, kind = start.sparkSession, start.schema["node"].dataType.simpleString()
    pairs = adjacency(edges) if adjacent is None else adjacent
    allowed = lambda rows: rows if readable is None else rows.join(readable.select("chunk_id").distinct(), "chunk_id", "left_semi")
    table = lambda rows, names: F.broadcast(spark.createDataFrame(rows, names))
    known = {r["node"]: 1.0 for r in start.select("node").distinct().collect()}  # names in one question
    frontier, lent = list(known), None
    for hop in range(1, hops + 1):
        if not frontier:
            break
        touched = allowed(pairs.filter(F.col("a").isin(frontier)))
        part = touched.select("chunk_id", F.lit(0.5 / hop).alias("score"))
        lent = part if lent is None else lent.unionByName(part)
        counts = touched.filter(~F.col("b").isin(list(known))).groupBy("b").agg(F.count("*").alias("n"))
        scored = counts.join(weights.withColumnRenamed("entity_id", "b"), "b", "left").select("b", F.round(F.col("n") * F.coalesce("idf", F.lit(1.0)), 6).alias("s"))
        frontier = [r["b"] for r in scored.orderBy(F.desc("s"), "b").limit(width).collect()]
        known |= dict.fromkeys(frontier, 1.0 / (1 + hop))
    if not known:
        return mentions.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    named = allowed(mentions.join(table(list(known.items()), f"entity_id {kind}, w double"), "entity_id")).join(weights, "entity_id", "left")
    own = named.select("chunk_id", (F.col("w") * F.coalesce("idf", F.lit(1.0))).alias("score"))
    parts = own.unionByName(lent)
    return parts.groupBy("chunk_id").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)
