"""Tables of one corpus in a shared folder: what an ingest writes and what questions read.

Tables are Parquet folders that a snapshot lists (`snapshots`); a change of several tables is
seen as a whole or not at all. Chunks come in segments: adding some writes their own blocks
of postings, positions, vectors and counts, and reads and embeds nothing that is there
already. Removed chunks are entered as such, with their counts taken off, and are passed over
until `compact` writes one segment of what is left. Vectors carry the name of the embedder
that made them, and another one is refused. A corpus that is only searched by words can be kept
without positions and vectors (`parts`). The audit log is a plain folder that rows are
appended to, outside of the snapshots.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import acl as A
from palisade.operators import blockmax, positions, vector
from palisade.sources.snapshots import CODEC, Change, Conflict, Log, Snapshot, release

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tables that an ingest writes and `truncate` empties; the audit log and the versions stay.
CORPUS = ("emails", "acl", "chunks", "blocks", "terms", "sizes", "positions", "vectors", "removed", "entities", "mentions", "edges", "cache_entries")
#: Tables outside of the snapshots, append-only.
PLAIN = ("audit_log",)
#: What a segment can hold besides its chunks; `terms` and `sizes` come with the blocks.
PARTS = ("blocks", "positions", "vectors")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a local folder."""
    where = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return "/tmp/palisade-checkpoints"


def delete(path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    jvm, active = SparkContext._gateway.jvm, SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: A table of one file between these sizes has one or two row groups, which is all that a scan can be dealt by.
SPREAD_FROM, SPREAD_TO = 1 << 20, 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows read from one small file, dealt over all cores; tables of more or larger files as they are."""
    spark, files = rows.sparkSession, rows.inputFiles()
    if len(files) != 1:
        return rows
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0]))
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return rows.repartition(spark.sparkContext.defaultParallelism) if SPREAD_FROM < size < SPREAD_TO else rows


_kept: dict[tuple[str, ...], str] = {}


@atexit.register
def _forget() -> None:
    while _kept:
        delete(_kept.popitem()[1])


def _stamp(spark: SparkSession, path: str) -> str:
    """When the files of a table were written, to know an index of other files from one of these."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return f"{status.getModificationTime()}:{status.getLen()}"


def indexed(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made of the files at `source`, built once by each application.

    It lies in the shared folder until the driver ends. Other files at the same path, known by
    the time they were written, get an index of their own.
    """
    key = (spark.sparkContext.applicationId, source, name, _stamp(spark, source))
    if key not in _kept:
        path = f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}"
        build().write.option("compression", CODEC).parquet(path)
        release(spark)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def settled(rows: DataFrame) -> DataFrame:
    """Rows written in the shared folder and read again; they go when the driver ends."""
    path = f"{shared_dir(rows.sparkSession)}/settled-{uuid.uuid4().hex}"
    _kept[("settled", path)] = path
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def kept_store(spark: SparkSession, source: str, name: str, fill: Callable[[Store], None], parts: tuple[str, ...] = PARTS) -> Store:
    """A corpus made of the files at `source`, as `indexed` keeps a table."""
    key = (spark.sparkContext.applicationId, source, name, _stamp(spark, source))
    if key not in _kept:
        path = f"{shared_dir(spark)}/store-{name}-{uuid.uuid4().hex}"
        fill(Store(spark, path, parts=parts))
        _kept[key] = path
    return Store(spark, _kept[key], parts=parts)


class ModelMismatch(RuntimeError):
    pass


class Store:
    """One corpus at `path`: its latest snapshot, or the one it is pinned to."""

    def __init__(self, spark: SparkSession, path: str, pinned: Snapshot | None = None, parts: tuple[str, ...] = PARTS):
        """parts: what the segments of a new corpus hold; later ones hold what is there."""
        self.spark, self.path, self.pinned, self.parts = spark, path.rstrip("/"), pinned, parts
        self.log = Log(spark, f"{self.path}/_snapshots")
        self._open: Change | None = None

    # snapshots

    def snapshot(self) -> Snapshot:
        return self._open.snapshot() if self._open else self.pinned or self.log.latest()

    def held(self) -> Store:
        """A reader of the corpus as it is now, whatever is changed later."""
        return Store(self.spark, self.path, self.snapshot(), self.parts)

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Several changes as one: committed at the end of the block, or, if it fails, not at all."""
        if self.pinned is not None:
            raise Conflict("this store is pinned to a snapshot")
        if self._open is not None:  # part of a larger change
            yield self._open
            return
        self._open = made = Change(self.spark, self.path, self.log.latest())
        try:
            yield made
            self.log.commit(made.snapshot())
        except BaseException:
            for folder in made.made:
                delete(f"{self.path}/{folder}")
            raise
        finally:
            self._open = None

    def vacuum(self, keep: int = 1) -> int:
        """Delete all snapshots but the last `keep`, and folders that none of those names; gives their number.

        Not while something is being written: folders of a change that isn't committed yet are named by no snapshot.
        """
        numbers = self.log.numbers()
        named = {folder for n in numbers[-keep:] for folders in self.log.read(n).tables.values() for folder in folders}
        old = {folder for n in numbers[:-keep] for folders in self.log.read(n).tables.values() for folder in folders} - named
        for n in numbers[:-keep]:
            self.log.forget(n)
        for folder in old:
            delete(f"{self.path}/{folder}")
        return len(old)

    # tables

    def at(self, name: str) -> str:
        """The path of a plain table."""
        return f"{self.path}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, self.at(name)) if name in PLAIN else name in self.snapshot().tables

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{folder}" for folder in self.snapshot().tables[name]])

    def _alive(self, rows: DataFrame) -> DataFrame:
        return self.index().without_removed(rows) if self.has("removed") else rows

    def read(self, name: str) -> DataFrame:
        """A table as it is seen: without removed chunks. `postings` and `lengths` are views of what the segments hold."""
        if name in PLAIN:
            return self.spark.read.parquet(self.at(name))
        if name == "postings":
            return self._alive(self._stored("blocks").select("term", "seg", F.inline("rows"))).drop("seg")
        if name == "lengths":
            return self._stored("sizes").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
        return self._alive(self._stored(name)).drop("seg") if name in ("chunks", "vectors", "positions") else self._stored(name)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace a table. Rows may come from the table itself."""
        with self.change() as change:
            return change.write(name, rows)

    def append(self, name: str, rows: DataFrame) -> None:
        if name in PLAIN:
            rows.write.mode("append").parquet(self.at(name))
            return
        with self.change() as change:
            change.append(name, rows)

    def drop(self, *names: str) -> None:
        with self.change() as change:
            change.drop(*names)

    # versions

    def version(self) -> int:
        return self.snapshot().version

    def bump(self) -> int:
        """One more change of the corpus or of its rights."""
        with self.change() as change:
            change.version += 1
            return change.version

    # ingest

    def add_mails(self, emails: DataFrame, acl: DataFrame) -> None:
        """Append mails and their rights; a right that is there already is not entered again."""
        with self.change() as change:
            rows = acl.select("email_id", "principal").distinct()
            if self.has("acl"):
                rows = rows.join(self.read("acl"), ["email_id", "principal"], "left_anti")
            change.append("emails", emails)
            change.append("acl", rows)

    def add_chunks(self, chunks: DataFrame, embedder: vector.Embedder | None = None) -> None:
        """Append chunks(chunk_id, email_id, ord, text), of new ids or of removed ones, as a segment of its own."""
        with self.change() as change:
            parts = self._held(change)
            change.segment += 1
            seg = F.lit(change.segment).cast("long").alias("seg")
            own = change.append("chunks", chunks.select("chunk_id", "email_id", "ord", "text", seg))
            self._derive(change, own, parts)
            if "vectors" in parts:
                change.append("vectors", vector.table(own, embedder or vector.HashEmbedder()).withColumn("seg", seg))

    def _held(self, change: Change) -> tuple[str, ...]:
        return tuple(p for p in PARTS if p in change.tables) if "chunks" in change.tables else self.parts

    def _derive(self, change: Change, own: DataFrame, parts: tuple[str, ...]) -> None:
        """What a segment holds besides chunks and vectors."""
        if "blocks" in parts:
            made = change.append("blocks", blockmax.blocks(own, change.segment), blockmax.WRITER)
            change.append("terms", blockmax.terms_of(made))
            change.append("sizes", blockmax.length_counts(own))
        if "positions" in parts:
            change.append("positions", positions.positions(own, change.segment))

    def remove_chunks(self, ids: DataFrame) -> None:
        """Remove those of ids(chunk_id) that are there."""
        with self.change() as change:
            dead = self.read("chunks").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
            gone = change.append("removed", dead.select("chunk_id", F.lit(change.segment).cast("long").alias("seg"), "email_id", "text"))
            if "blocks" in change.tables:
                change.append("terms", blockmax.term_counts(gone, -1))
                change.append("sizes", blockmax.length_counts(gone, -1))

    def compact(self) -> None:
        """One segment of all that is left. Vectors are kept as they are, not made anew."""
        with self.change() as change:
            chunks, held = self.read("chunks"), self._held(change)
            vectors = self.read("vectors") if "vectors" in held else None
            change.segment += 1
            seg = F.lit(change.segment).cast("long").alias("seg")
            own = change.write("chunks", chunks.withColumn("seg", seg))
            if vectors is not None:
                change.write("vectors", vectors.withColumn("seg", seg))
            change.drop("blocks", "terms", "sizes", "positions", "removed")
            self._derive(change, own, held)

    def index(self) -> blockmax.Index:
        """The blocks of postings of all segments."""
        removed = self._stored("removed").select("chunk_id", "seg") if self.has("removed") else None
        return blockmax.Index(self._stored("blocks"), self._stored("terms"), self._stored("sizes"), removed)

    def ingest(self, emails: DataFrame, acl: DataFrame, chunks: DataFrame, embedder: vector.Embedder | None = None, graph: dict[str, DataFrame] | None = None) -> int:
        """Replace the corpus in one step: all tables are emptied, written anew, and the version goes up by one."""
        with self.change():
            self.truncate(bump=False)
            self.add_mails(emails, acl)
            self.add_chunks(chunks, embedder)
            for name, rows in (graph or {}).items():
                self.write(name, rows)
            return self.bump()

    def truncate(self, bump: bool = True) -> int:
        """Delete the corpus and the answers made of it; audit log and version stay."""
        with self.change():
            self.drop(*CORPUS)
            return self.bump() if bump else self.version()

    def sync_groups(self, people: DataFrame, groups: list[A.Group]) -> int:
        """Replace all group rights by what the rules give now, in one step; people(email_id, folders, people)."""
        with self.change():
            self.write("acl", A.sync(self.read("acl"), people, groups))
            return self.bump()

    def vectors(self, embedder: vector.Embedder) -> DataFrame:
        """(chunk_id, embedding) if this embedder made them."""
        rows = self.read("vectors")
        other = rows.filter(F.col("model") != embedder.name).select("model").first()
        if other is not None:
            raise ModelMismatch(f"the vectors were made by {other['model']!r}, not by {embedder.name!r}: ingest again or use that embedder")
        return rows.select("chunk_id", "embedding")
