"""A Merkle manifest of a dataset by parent-preimage paths.

Every row is a leaf, the SHA-256 of its fields. In each source leaves are placed by id, and
every FANOUT neighbours become one parent, up to the source's subroot; subroots, in the order
of their sources, become the root in the same way. Of a parent the manifest keeps its
preimage, the concatenated digests of its children: all that a proof needs. A leaf's path is
the preimages of its ancestors with the slot that the path takes in each. Cutting the slot's
64 characters out leaves the siblings, which are the proof; putting another digest in their
place and hashing gives the parent that follows from it, up to the root.

DEPTH levels are built at once: a block is FANOUT ** DEPTH neighbours in one row, which hashes
them to its one node and keeps the preimages of all levels between. Blocks of the next table
are made of these nodes. Paths come from above: a block's path goes to its members, behind
the steps inside the block, by one join on (group, place), keys that no two blocks share. So
jobs and the size of plans, which the driver holds, grow by one table for each FANOUT ** DEPTH
times as many rows, not by one for each level. A source that holds a third of all rows has no
key of its own anywhere: places in it come from ranges (`ordering.placed`), and its root's path
is joined where it has one node. The driver sees a count, the number of tables and the root.

Defined results: a null field is `-`, so it differs from an empty one. Leaves ascend by id,
null ids first, rows with one id by digest; equal rows are leaves of their own. A source with
one leaf has it as subroot; a null source is a source, the first. No rows, no root: an empty
result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let, settled
from palisade.llm.ordering import placed

FANOUT = 3
#: Levels inside a block: 243 leaves, some 60 KB.
DEPTH = 5
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NO_PATH = "cast(array() AS array<struct<pre: string, slot: int>>)"


def encoded(value: Column) -> Column:
    """A field so that neighbours cannot run into each other: its size in bytes, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def siblings(step: Column) -> Column:
    """A preimage without the slot's own digest."""
    return F.concat(F.substring(step["pre"], 1, step["slot"] * DIGEST), F.substring(step["pre"], (step["slot"] + 1) * DIGEST + 1, F.length(step["pre"])))


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest: each ancestor hashed with it in the slot's place."""

    def up(below: Column, step: Column) -> Column:
        left, right = F.substring(step["pre"], 1, step["slot"] * DIGEST), F.substring(step["pre"], (step["slot"] + 1) * DIGEST + 1, F.length(step["pre"]))
        return F.sha2(F.concat(left, below, right), 256)

    return F.aggregate(path, digest, up)


def proof(path: Column) -> Column:
    """All siblings from the leaf to the root, in one string."""
    return F.array_join(F.transform(path, siblings), "")


def _runs(digests: Column, fanout: int) -> Column:
    """The preimages of the parents of neighbouring nodes."""
    starts = lambda xs: F.sequence(F.lit(1), F.size(xs), F.lit(fanout))
    return let(digests, lambda xs: F.transform(starts(xs), lambda at: F.array_join(F.slice(xs, at, fanout), "")))


@dataclass
class Tree:
    """Tables of blocks (g, at, n, members, pres, h) over nodes (g, at, n, h, ...).

    Place and number of blocks in the group; the nodes or blocks below, by place, with all their
    columns; the preimages of each level of the block, from below; the digest of the last one.
    """

    nodes: DataFrame
    fanout: int = FANOUT
    blocks: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        below, most = self.nodes, self.nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            below = settled(self._over(below.select("g", "at", "n", "h") if self.blocks else below))
            self.blocks.append(below)
            most = -(-most // self.width)

    @property
    def width(self) -> int:
        return self.fanout**DEPTH

    def _over(self, below: DataFrame) -> DataFrame:
        # a group's last block may have fewer nodes, but has as many levels as the others
        levels = F.coalesce(*(F.when(F.col("n") <= self.fanout**k, k) for k in range(1, DEPTH)), F.lit(DEPTH))
        block, n = F.floor(F.col("at") / self.width).cast("long"), F.ceil(F.col("n") / self.width).cast("long")
        # at most `width` members
        members = F.sort_array(F.collect_list(F.struct("at", *(c for c in below.columns if c not in ("g", "at", "n")))))
        rows = below.filter("n > 1").groupBy("g", block.alias("block"), n.alias("blocks"), levels.alias("levels")).agg(members.alias("members"))
        first = F.array(_runs(F.transform("members", lambda m: m["h"]), self.fanout))
        more = F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: k < F.col("levels"))
        up = lambda pres, _: F.concat(pres, F.array(_runs(F.transform(F.element_at(pres, -1), lambda p: F.sha2(p, 256)), self.fanout)))
        made = rows.select("g", F.col("block").alias("at"), F.col("blocks").alias("n"), "members", F.aggregate(more, first, up).alias("pres"))
        return made.withColumn("h", F.sha2(F.element_at("pres", -1)[0], 256))

    def tops(self) -> DataFrame:
        """(g, h): the last node of each group."""
        out = self.nodes.filter("n = 1").select("g", "h")
        for table in self.blocks:
            out = out.unionByName(table.filter("n = 1").select("g", "h"))
        return out

    def preimages(self) -> DataFrame | None:
        """(g, level, at, pre) of all parents; None where there are none."""
        out = None
        for k, table in enumerate(self.blocks):
            each = table.select("g", F.col("at").alias("block"), F.posexplode("pres").alias("step", "pre_of"))
            each = each.select("g", "block", "step", F.posexplode("pre_of").alias("inside", "pre"))
            inside = F.pow(F.lit(self.fanout), F.lit(DEPTH - 1) - F.col("step")).cast("long")  # parents of this level in a whole block
            part = each.select("g", (F.col("step") + (k * DEPTH + 1)).alias("level"), (F.col("block") * inside + F.col("inside")).alias("at"), "pre")
            out = part if out is None else out.unionByName(part)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes with `path`, from the parent to the end of `above(g, path, ...)`, whose other columns come along."""
        more = [c for c in above.columns if c not in ("g", "path")]
        known: DataFrame | None = None  # places below the last table, with their paths
        for table in reversed(self.blocks):
            rows = table.filter("n = 1").join(above, "g")
            if known is not None:
                inner = table.filter("n > 1").join(known.drop("h"), ["g", "at"])
                rows = rows.unionByName(inner.select(rows.columns))
            known = self._members(rows, more)
        found = self.nodes.filter("n = 1").join(above, "g").drop("n")
        return found if known is None else found.unionByName(known.select(found.columns))

    def _members(self, rows: DataFrame, more: Sequence[str]) -> DataFrame:
        """The members of blocks (members, pres, path), each with the steps inside the block before the block's path."""
        each = rows.select("g", "pres", "path", *more, F.posexplode("members").alias("__place", "__member"))
        place = lambda k: F.floor(F.col("__place") / F.pow(F.lit(self.fanout), k)).cast("int")
        step = lambda pre, k: F.struct(pre[place(k + 1)].alias("pre"), (place(k) % self.fanout).alias("slot"))
        return each.select("g", F.concat(F.transform("pres", step), "path").alias("path"), *more, "__member.*")


@dataclass
class Manifest:
    """A tree of leaves for each source, a tree of their subroots, and the root (None without rows)."""

    sources: Tree
    top: Tree
    root: str | None

    def preimages(self) -> DataFrame:
        """(source_key, level, at, pre) of all parents; those over subroots have a null key and levels of their own."""
        out = self.sources.nodes.limit(0).select(F.col("g").alias("source_key"), F.lit(0).alias("level"), "at", F.col("h").alias("pre"))
        for tree, key in ((self.sources, F.col("g")), (self.top, F.lit(None).cast("string"))):
            part = tree.preimages()
            if part is not None:
                out = out.unionByName(part.select(key.alias("source_key"), "level", "at", "pre"))
        return out

    def paths(self) -> DataFrame:
        """The leaves with `path` to the root and `subroot`."""
        over_sources = self.top.paths(self.top.tops().select("g", F.expr(_NO_PATH).alias("path")))
        return self.sources.paths(settled(over_sources.select(F.col("key").alias("g"), "path", F.col("h").alias("subroot"))))


def build(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """Of leaves (doc_id, source, leaf, ...); other columns stay with them."""
    # a null source sorts before all others, and keys are never null
    keyed = leaves.withColumn("g", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    nodes = settled(placed(keyed, "at", ["doc_id", "leaf"], ["g"]).withColumnRenamed("at_of", "n").withColumnRenamed("leaf", "h"))
    sources = Tree(nodes, fanout)
    subroots = sources.tops().withColumnRenamed("g", "key")
    top_nodes = placed(subroots, "at", ["key"]).select(F.lit("").alias("g"), "at", F.col("at_of").alias("n"), "h", "key")
    top = Tree(settled(top_nodes), fanout)
    root = top.tops().first()
    return Manifest(sources, top, root["h"] if root else None)


def leaves_of(docs: DataFrame, changed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, now): `now` is the digest with some fields `changed`, null where it is the leaf itself."""
    values = {c: F.col(c) for c in fields}
    before, after = leaf(*values.values()), leaf(*(values | (changed or {})).values())
    out = docs.select("doc_id", "source", before.alias("leaf"), (after if changed else F.lit(None).cast("string")).alias("now"))
    return out.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now")))


def tampered(text: Column, doc_id: Column) -> dict[str, Column]:
    """The change that the query applies: texts under every second id lose their line breaks."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)}


def verified(docs: DataFrame, changed: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row against the manifest of the unchanged rows."""
    manifest = build(leaves_of(docs, changed), fanout)
    root = F.lit(manifest.root).cast("string")
    found = manifest.paths().withColumn("folded_root", folded(F.coalesce("now", "h"), F.col("path")))
    return found.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
