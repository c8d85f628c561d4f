"""Removal of repeated byte strings by hashes at anchors, in place of prefix doubling.

Every byte is removed that lies in a string of LENGTH bytes which also starts earlier, in a
document with a smaller id or before in the same one.

Prefix doubling ranks the string at each position by rounds: a round sorts pairs of the rank
at a position and the rank at an offset behind it, and positions whose rank is unique drop
out. That is not done here: there are three fixed rounds, no sort and no new ranks. A rank is named by a hash of the string it stands for, so that the rank at the
offset is at hand where the position is, and each round has Spark bring equal pairs together
and keep what is not unique yet. The rounds:

1. Width 32, at anchors. Each string of LENGTH bytes has one anchor, the first of the
   positions in it whose 32 bytes have the least hash. Equal strings have their anchor at the
   same place, so strings whose anchor's rank is unique repeat nowhere. About one position in
   thirty-five is an anchor. The anchor's rank is paired with the rank of all that the
   strings of this anchor cover together: if the pair was there earlier, all these strings
   were. If the pair is new but the anchor's rank is not, some of them may have been.
2. For those, the edges of repeated passages, and for the first member of each pair, which
   takes part to be found: strings are taken in steps of STEP by their distance to the
   anchor. All strings of a step have LENGTH - STEP + 1 bytes in common, at the same place
   to the anchor wherever they occur. Anchor, distance and these bytes are ranked together,
   what is unique drops out, and the rest is paired with what the step covers, as before.
3. What is still open is ranked string by string, at width LENGTH.

Ranks are compared in pairs, 128 bits in all. No group is ever collected: firsts are minima,
which combine before the shuffle, and are joined back. What is joined back is written out
first, so that the join has a shuffle on both sides and adaptive execution can split a rank
that a third of all documents share into many tasks. Tables of finished rounds are deleted,
so the disk holds one round at a time.

A null text is empty. Positions order by document, then by place. A document is an id; if
any id of the table repeats, it is an id and the MD5 digest of the text: rows with equal id
and text are one document, and each reports its result; rows with an equal id and other text
are documents one after the other, by that digest. A null id is the least number. Other
columns are ignored. Long texts are hashed in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.bytehash import INVERSE, byte_sums, mixed, powers
from palisade.llm.common import discard, release, settled, settled_at

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
STEP = 8
#: pos = place, 10 bits of the distance to the anchor, 10 bits of how many strings follow from
#: this place on
_LEAD, _COUNT = 10, 10
_LOW = (1 << _COUNT) - 1
_AT = _LEAD + _COUNT
#: The columns that name a document, of which a table has the second only if ids repeat.
_NAMES = ("doc", "sub")


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window its first position of the least hash, by doubling."""
    n = len(hashes) - window + 1
    at, width = np.arange(len(hashes), dtype=np.int64), 1
    while 2 * width <= window:
        a, b = at[:-width], at[width:]
        at = np.where(hashes[a] <= hashes[b], a, b)
        width *= 2
    if width < window:
        a, b = at[:n], at[window - width : window - width + n]
        at = np.where(hashes[a] <= hashes[b], a, b)
    return at[:n]


def _span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor: its rank, the rank of what its strings cover, its first string, distance, number of strings."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    sums = byte_sums(raw)
    starts = np.arange(len(raw) - gram + 1)
    grams = mixed((sums[gram:] - sums[: len(starts)]) * powers(INVERSE, len(sums))[: len(starts)])
    at = _least(grams, length - gram + 1)
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    count = np.diff(np.append(first, n))
    lead = at[first] - first
    return grams[at[first]], _cover_ranks(sums, first, lead, count, length), first, lead, count


def _cover_ranks(sums: np.ndarray, first: np.ndarray, lead: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Ranks of what `count` strings from `first` on cover, and of where they lie to the anchor."""
    cover = _span_hashes(sums, first, first + count - 1 + length)
    return mixed(cover ^ mixed((lead * 1024 + count).astype(np.uint64)))


def _pieces(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of PIECE strings each; the last bytes of one are the first of the next."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - length + 1), PIECE):
        yield at, raw[at : at + PIECE + length - 1]


def _packed(place: np.ndarray, lead: np.ndarray, count: np.ndarray) -> np.ndarray:
    return place << _AT | lead << _COUNT | count


def _key(rows: DataFrame) -> list[str]:
    return [c for c in _NAMES if c in rows.columns]


def _kind(key: list[str]) -> str:
    return "g long, s long, doc long, " + ("sub binary, " if "sub" in key else "") + "pos long"


#: A document's name and arrays g, s and pos.
_Part = tuple[tuple, np.ndarray, np.ndarray, np.ndarray]


def _batch(parts: list[_Part]) -> pa.RecordBatch:
    g, s, pos = (pa.array(np.concatenate([p[k] for p in parts])) for k in (1, 2, 3))
    sizes = [len(p[1]) for p in parts]
    names = [pa.array(np.repeat(np.array([p[0][0] for p in parts], np.int64), sizes))]
    if len(parts[0][0]) > 1:
        names.append(pa.array([p[0][1] for p, n in zip(parts, sizes, strict=True) for _ in range(n)], pa.binary()))
    return pa.RecordBatch.from_arrays([g, s, *names, pos], ["g", "s", *_NAMES[: len(names)], "pos"])


def _anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(g, s, document, pos) of each anchor of each document."""
    key = _key(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[_Part] = []
            held = 0
            for text, *name in zip(*(batch.column(k).to_pylist() for k in range(1 + len(key))), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                for at, raw in _pieces(data, length):
                    g, s, first, lead, count = anchors(raw, length)
                    parts.append((tuple(name), g.view(np.int64), s.view(np.int64), _packed(first + at, lead, count)))
                    held += len(g)
                if held > 100_000:
                    yield _batch(parts)
                    parts, held = [], 0
            if parts:
                yield _batch(parts)

    return docs.select("text", *key).mapInArrow(find, _kind(key))


def _steps(first: np.ndarray, lead: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Runs cut where the distance to the anchor passes a multiple of `step`: owner, first, lead, count."""
    owner = np.repeat(np.arange(len(first)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    leads = lead[owner] - offset  # may pass the anchor only in pieces cut off from it, never below zero
    part = owner * 1024 + leads // step
    new = np.nonzero(np.diff(part, prepend=-1))[0]
    return owner[new], (first[owner] + offset)[new], leads[new], np.diff(np.append(new, len(part)))


def _step_table(docs: DataFrame, runs: DataFrame, length: int, step: int) -> DataFrame:
    """(g, s, document, pos) of the strings of the runs(document, runs), in steps."""
    key = _key(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, runs, *name in zip(*(batch.column(k).to_pylist() for k in range(2 + len(key))), strict=True):
                data, parts = text.encode("utf-8", "surrogatepass"), []
                ranks, packed = (np.array([r[k] for r in runs], np.int64) for k in ("g", "pos"))
                place = packed >> _AT
                for at, raw in _pieces(data, length):
                    mine = (place >= at) & (place < at + PIECE)
                    if not mine.any():
                        continue
                    owner, first, lead, count = _steps(place[mine] - at, packed[mine] >> _COUNT & _LOW, packed[mine] & _LOW, step)
                    sums, near = byte_sums(raw), first + lead % step
                    core = mixed(_span_hashes(sums, near, near + length - step + 1))
                    g = mixed(ranks[mine][owner].view(np.uint64) ^ mixed(core ^ (lead // step).astype(np.uint64)))
                    s = _cover_ranks(sums, first, lead, count, length)
                    parts.append((tuple(name), g.view(np.int64), s.view(np.int64), _packed(first + at, lead, count)))
                if parts:
                    yield _batch(parts)

    return docs.join(runs, key).select("text", "runs", *key).mapInArrow(find, _kind(key))


def _round(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (document, pos) whose pair of ranks was there earlier, and (g, document, pos) of first pairs of a rank that has several."""
    spark, key = table.sparkSession, _key(table)
    place = F.struct(*key, "pos")
    table, made = settled_at(table)
    shared, shared_at = settled_at(table.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    kept, kept_at = settled_at(table.join(shared, "g"))
    discard(spark, made)
    discard(spark, shared_at)
    release(spark)
    # the least place of each pair of ranks, and how many rows have it
    pairs, pairs_at = settled_at(kept.groupBy("g", "s").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    whole = settled(kept.join(pairs.filter("n > 1"), ["g", "s"]).filter(place > F.col("first")).select(*key, "pos"))
    discard(spark, kept_at)
    several, several_at = settled_at(pairs.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"))
    edges = settled(pairs.join(several, "g").select("g", *[f"first.{c}" for c in key], "first.pos"))
    discard(spark, pairs_at)
    discard(spark, several_at)
    release(spark)
    return whole, edges


def repeats(docs: DataFrame, length: int = LENGTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(document, start, end) of runs of bytes to remove; they overlap. A null id is the least number."""
    return _repeats(_slim(docs, id_col, text_col), length, step)


def _repeats(slim: DataFrame, length: int, step: int) -> DataFrame:
    if length < GRAM + 1 or length > 1000:
        raise ValueError(f"the length has to be between {GRAM + 1} and 1000")
    key = _key(slim)
    found, edges = _round(_anchor_table(slim, length))
    for size in (step, 1):
        # runs of one document, no more than its text has places
        runs = edges.groupBy(*key).agg(F.collect_list(F.struct("g", "pos")).alias("runs"))
        more, edges = _round(_step_table(slim, runs, length, size))
        found = found.unionByName(more)
    start = F.shiftright("pos", _AT)
    return found.select(*key, start.alias("start"), (start + F.col("pos").bitwiseAND(_LOW) - 1 + length).alias("end"))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, of) with the number that orders documents and the id as it is, and `sub` if ids repeat."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    slim = docs.select(doc.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("of"))
    again = slim.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    return slim.withColumn("sub", F.unhex(F.md5("text"))) if again.count() else slim


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, kept, n_bytes): merged runs of removed bytes and the bytes that stay, of every document.

    What stays is binary, as a cut can fall inside a character.
    """
    slim = _slim(docs, id_col, text_col)
    key = _key(slim)
    # runs of one document, as many as it has edges; a run inside another adds nothing
    lists = _repeats(slim, length, STEP).groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("cuts"))
    rows = slim.join(lists, key, "left").select("of", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
                runs = _merged([(c["start"], c["end"]) for c in cuts or []])
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                spans.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "spans", "kept", "n_bytes"])

    return rows.mapInArrow(cut, "doc_id long, spans array<struct<start: bigint, end: bigint>>, kept binary, n_bytes long")


def digests(cut: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
