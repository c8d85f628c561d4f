"""Benchmark decontamination: short test items found inside long documents.

Containment of an item in a document is the share of the item's distinct word shingles
that the document has. Items are partitioned by shingle width and size class (a power of
two), and each partition has its own sketch length and its own table. An item is represented
by the shingles with the least hash values (a bottom MinHash sketch) of its partition's
length. A document can miss at most floor((1 - t) * n) shingles of an item of n at threshold
t; the partition's length is one more than its largest item allows, so at least one sketch
shingle of every item is in every document that reaches the threshold: the search loses
nothing. A partition is not asked about documents too small for its smallest item.
Candidates are verified by exact shingle containment on the words: the shingles that
candidates have are looked for while the text's words go by, and only they are kept.
Texts of more than BATCH_BYTES are read in pieces of so many bytes, cut between words, each
with the last words of the one before, so a text of any length takes the memory of a piece
beside its own bytes. A single word is never cut.

Documents are streamed once for each block of items, and never shuffled. A block has at
most BLOCK_SHINGLES shingles (or one item), which bounds what is sent to the executors
whatever the benchmark's size. A document of a third of all bytes is one row in any case;
hot sources or copies make no hot key, as nothing is grouped.

Items of fewer words than a shingle count as one shingle of all their words. Items and
texts without words (null or empty) match nothing. Repeated documents each give their
rows, repeated items theirs. Null ids are carried. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.bytehash import BLANK, shingles, word_hashes

WIDTH = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 500_000
#: Texts are hashed together up to so many bytes; longer ones in pieces of so many.
BATCH_BYTES = 1 << 20
_FILTER_BITS = 22


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def exact_shingles(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(tokens[k:] for k in range(width)), strict=False))


def needed(size: int, threshold: float) -> int:
    """The least number of shingles that reaches the threshold, without float surprises."""
    return max(1, int(np.ceil(size * threshold - 1e-9)))


@dataclass
class Item:
    item_id: int | None
    width: int
    grams: frozenset[tuple[bytes, ...]]


@dataclass
class Partition:
    """Items of one shingle width and size class: sorted sketch hashes, their items, and what each item needs."""

    width: int
    size_class: int
    length: int
    least: int
    hashes: np.ndarray
    owners: np.ndarray
    needs: np.ndarray


@dataclass
class Width:
    """The partitions of one shingle width, by size class, and a bit filter before them all."""

    partitions: list[Partition]
    seen: np.ndarray


def size_class(n: int) -> int:
    """Items of 2**(c-1) to 2**c - 1 shingles are in class c."""
    return int(n).bit_length()


def sketch_length(sizes: list[int], threshold: float) -> int:
    """One more than the most shingles that a document may miss of any item of these sizes."""
    return max(n - needed(n, threshold) + 1 for n in sizes)


def _gram_hashes(item: Item) -> np.ndarray:
    return np.array([shingles(word_hashes(b" ".join(g))[0], item.width)[0] for g in item.grams], np.uint64)


def _partitions(items: list[Item], threshold: float) -> dict[int, Width]:
    grouped: dict[tuple[int, int], list[int]] = {}
    for k, item in enumerate(items):
        grouped.setdefault((item.width, size_class(len(item.grams))), []).append(k)
    out: dict[int, Width] = {}
    for (width, of), members in sorted(grouped.items()):
        sizes = [len(items[k].grams) for k in members]
        length = sketch_length(sizes, threshold)
        sketches = [np.sort(_gram_hashes(items[k]))[:length] for k in members]
        hashes, owners = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        needs = np.array([needed(len(items[k].grams), threshold) for k in owners.tolist()])
        here = out.setdefault(width, Width([], np.zeros(1 << _FILTER_BITS, bool)))
        here.partitions.append(Partition(width, of, length, int(needs.min()), hashes, owners, needs))
        here.seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return out


def _pieces(text: memoryview, overlap: int) -> Iterator[tuple[bytes, int]]:
    """The text in pieces cut between words: each with the `overlap` words before it, and how many words are new."""
    raw, at, before = np.frombuffer(text, np.uint8), 0, []
    while at < len(text):
        end = min(at + BATCH_BYTES, len(text))
        while end < len(text) and not BLANK[raw[end]]:
            rest = np.nonzero(BLANK[raw[end : end + BATCH_BYTES]])[0]
            end = end + int(rest[0]) if len(rest) else min(end + BATCH_BYTES, len(text))
        mine = bytes(text[at:end]).lower().split()
        yield b" ".join(before + mine), len(mine)
        known = before + mine
        before, at = known[max(0, len(known) - overlap) :], end


def _shared(texts: list[bytes], by_width: dict[int, Width], rooms: list[int] | None = None) -> set[tuple[int, int]]:
    """(text, item) pairs that share a sketch shingle and fit in size; `rooms` has the words of texts of which these are pieces."""
    hashes, starts, _ = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts)) if rooms is None else np.array(rooms)
    found: set[tuple[int, int]] = set()
    for width, here in by_width.items():
        grams = shingles(hashes, width)
        hit = np.nonzero(here.seen[grams >> np.uint64(64 - _FILTER_BITS)])[0]
        hit = hit[owner[hit] == owner[hit + width - 1]]
        room = counts[owner[hit]] - width + 1
        for part in here.partitions:
            mine = hit[room >= part.least]
            lo, hi = np.searchsorted(part.hashes, grams[mine], "left"), np.searchsorted(part.hashes, grams[mine], "right")
            for g, a, b in zip(mine[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                doc = int(owner[g])
                fits = part.needs[a:b] <= counts[doc] - width + 1
                found.update((doc, int(k)) for k in part.owners[a:b][fits])
    return found


def _overlap(by_width: dict[int, Width]) -> int:
    return max(by_width, default=1) - 1


def _candidates(texts: list[memoryview], by_width: dict[int, Width]) -> dict[int, list[int]]:
    """The items to verify of each text: many texts together, or one long text in pieces."""
    if len(texts) == 1 and len(texts[0]) > BATCH_BYTES:
        room = sum(new for _, new in _pieces(texts[0], 0))
        found = {pair for piece, _ in _pieces(texts[0], _overlap(by_width)) for pair in _shared([piece], by_width, [room])}
    else:
        found = _shared([bytes(t) for t in texts], by_width)
    by_doc: dict[int, list[int]] = {}
    for d, k in sorted(found):
        by_doc.setdefault(d, []).append(k)
    return by_doc


def _contained(text: memoryview, items: list[Item], overlap: int) -> list[int]:
    """How many shingles of each item the text has; only shingles of these items are kept."""
    wanted: dict[int, set[tuple[bytes, ...]]] = {}
    for item in items:
        wanted.setdefault(item.width, set()).update(item.grams)
    had: dict[int, set[tuple[bytes, ...]]] = {width: set() for width in wanted}
    for piece, _ in _pieces(text, overlap):
        tokens = piece.split()
        for width, grams in wanted.items():
            had[width] |= grams.intersection(zip(*(tokens[k:] for k in range(width)), strict=False))
    return [len(item.grams & had[item.width]) for item in items]


def _pack(rows: list[tuple[int | None, str | None]], width: int) -> list[Item]:
    items = []
    for item_id, text in rows:
        if tokens := words(text):
            w = min(width, len(tokens))
            items.append(Item(item_id, w, frozenset(exact_shingles(tokens, w))))
    return items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of at most `limit` shingles; only one block is here at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        size = len(words(row[1]))
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, limit: int = BLOCK_SHINGLES, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment) of each pair at or above the threshold."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_item long, n_found long, containment double"
    slim, out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for block in _blocks(benchmark, item_id, item_text, limit):
        items = _pack(block, width)
        sent = spark.sparkContext.broadcast((items, _partitions(items, threshold)))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, by_width = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [memoryview(t.as_buffer() or b"").cast("B") for t in batch.column(1).cast(pa.binary())]
                rows, at = [], 0
                while at < len(texts):
                    end, held = at, 0
                    while end < len(texts) and (end == at or held + len(texts[end]) <= BATCH_BYTES):
                        held += len(texts[end])
                        end += 1
                    for d, ks in _candidates(texts[at:end], by_width).items():
                        chosen = [items[k] for k in ks]
                        for item, both in zip(chosen, _contained(texts[at + d], chosen, _overlap(by_width)), strict=True):
                            n = len(item.grams)
                            if both >= needed(n, threshold):
                                rows.append((ids[at + d], item.item_id, n, both, both / n))
                    at = end
                columns = [[r[c] for r in rows] for c in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "n_item", "n_found", "containment"])

        part = slim.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with the columns they came with. Null ids stay."""
    found = search(docs, benchmark, threshold, width, doc_id=doc_id, text_col=text_col)
    leaked = found.select(F.col("doc_id").alias("__leaked_id")).distinct()
    return docs.join(leaked, docs[doc_id] == leaked["__leaked_id"], "left_anti")
