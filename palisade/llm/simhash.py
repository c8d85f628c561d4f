"""SimHash near-duplicates by bit-sliced comparison.

Two searches share the comparison.

`groups` links fingerprints of 64 bits that differ in at most RADIUS bits, without loss.
Copies collapse first: only distinct fingerprints are compared. Of four 16-bit pieces two
differing bits leave two equal, so each fingerprint is filed under six keys of 32 bits. A
bucket with more than SPLIT fingerprints is filed anew under its key and each of three parts
of the other 32 bits (two differing bits leave one part equal), so hot buckets go to many
tasks; 21 or 22 bits are then open, so no bucket holds more than four million fingerprints.

`near_groups` looks for texts whose sets of word shingles have a Jaccard similarity of at
least 0.8. Such fingerprints differ in a seventh of their bits, too many for a choice of
equal pieces; so texts are filed under MinHash bands of their shingles instead, and the
texts of a bucket are compared by fingerprints of 256 bits. The radius is three standard
deviations above the distance to be expected at the similarity asked for and only proposes
pairs: the sets of shingles travel along, and a pair is linked if they are similar enough.
In a hot bucket only fingerprints meet all others; the sets travel to blocks that hold
something close and not yet connected (`_hot_links`).

In a bucket fingerprints are stored as bit planes: bit i of plane j is bit j of fingerprint
i. Planes are XORed and summed by carry-save counters that start at a value from which one
more than the radius overflows, and a block is abandoned once every distance has overflowed.
A bucket hands on only links that join parts which are not joined yet, fewer than it has
fingerprints, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.bytehash import mixed, shingles, word_hashes
from palisade.llm.common import settled
from palisade.llm.components import components

SEED = 42
RADIUS = 2
SPLIT = 2_000
BLOCK = 256
#: Buckets of up to so many are compared together, a lane for each pair.
FEW = 24
LEADERS = 32
FULL = ~np.uint64(0)

SIMILARITY = 0.8
WIDTH = 5
WORDS = 4
BANDS, ROWS = 16, 4
DEVIATIONS = 3.0
#: A bucket with more shingles in all its texts is dealt in blocks too.
MASS = 8_000_000
#: Fingerprints alone are compared in pairs of blocks of so many.
PRINTS = 8_192
#: In so many of its hot buckets a text is compared with its own block before all else.
FIRST = 2


# fingerprints


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle; of the whole sequence where a text has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        grams: Iterable[bytes] = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65_280):
        chunk = hashes[part : part + 65_280]
        bits = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(chunk) // 255 * 255  # sums of 255 bits fit in a byte
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return counts


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes; zero where there are none."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer; a null text has fingerprint zero."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), prints(F.col(text_col)).alias("fp"))


# bit-sliced comparison


def planes(prints: np.ndarray) -> np.ndarray:
    """Rows of packed bits, row j holding bit j of every fingerprint; prints is (n, words)."""
    n, words = prints.shape
    room = -n % 64
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * words), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((room, 64 * words), np.uint8)]) if room else bits
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def beyond(differing: Iterable[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray | None:
    """Lanes whose planes have more than `radius` ones; None if all have (then abandoned)."""
    digits = max(1, radius.bit_length())
    start = (1 << digits) - 1 - radius
    counter = [np.full(shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(digits)]
    over = np.zeros(shape, np.uint64)
    for j, plane in enumerate(differing):
        carry = plane
        for digit in counter:
            kept = digit & carry
            digit ^= carry
            carry = kept
        over |= carry
        if j % 8 == 7 and j >= radius and (over == FULL).all():
            return None
    return over


def _lanes(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane number of every lane that is not over."""
    rows, cells = np.nonzero(over != FULL)
    if not len(rows):
        return rows, cells
    bits = np.unpackbits((~over[rows, cells]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(bits)
    return rows[k], cells[k] * 64 + bit


def within(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, fingerprint) at most `radius` apart; `sliced` has the planes of n prints."""

    def differing() -> Iterator[np.ndarray]:
        for j in range(len(sliced)):
            bit = (queries[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
            yield sliced[j][None, :] ^ (bit * FULL)[:, None]

    over = beyond(differing(), (len(queries), sliced.shape[1]), radius)
    if over is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, p = _lanes(over)
    return q[p < n], p[p < n]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of `a` and `b` are at most `radius` apart; each pair is one lane."""
    close = np.zeros(len(a), bool)
    for at in range(0, len(a), 65_536):
        sliced = planes(a[at : at + 65_536] ^ b[at : at + 65_536])
        over = beyond(iter(sliced), (sliced.shape[1],), radius)
        if over is not None:
            part = np.unpackbits((~over).view(np.uint8), bitorder="little")
            close[at : at + 65_536] = part[: len(close[at : at + 65_536])]
    return close


class Parts:
    """Union-find."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


#: Which of the members `js` are similar to member `i`.
Alike = Callable[[int, np.ndarray], np.ndarray]


def alike_in(grams: np.ndarray, similarity: float) -> Alike:
    """Exact Jaccard similarity of sets given as the bytes of their sorted hashes."""

    def alike(i: int, js: np.ndarray) -> np.ndarray:
        mine = np.frombuffer(grams[i], np.uint64)
        sizes = np.array([len(grams[j]) // 8 for j in js.tolist()], np.int64)
        good = (sizes > 0) & (np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine)) - 1e-9)
        if good.any():
            theirs = np.frombuffer(b"".join([grams[j] for j in js[good].tolist()]), np.uint64)
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.add.reduceat(hit, np.cumsum(sizes[good]) - sizes[good], dtype=np.int64)
            good[good] = both >= similarity * (sizes[good] + len(mine) - both) - 1e-9
        return good

    return alike


def bucket_links(prints: np.ndarray, radius: int, alike: Alike | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links of the bucket connect, fewer than its members.

    Some leaders are compared with all first. Then members are ordered by part, and blocks
    are compared; a pair of blocks that is one part already has nothing to add.
    """
    n, parts, found = len(prints), Parts(len(prints)), []
    sliced = planes(prints)
    alone, led = np.ones(n, bool), 0
    while led < LEADERS and alone.any():
        leader = int(np.argmax(alone))
        _, near = within(prints[leader : leader + 1], sliced, n, radius)
        if alike:
            near = near[near != leader]
            near = near[alike(leader, near)]
        alone[leader] = False
        alone[near] = False
        found += [(leader, p) for p in near.tolist() if parts.join(leader, p)]
        led += 1
    order = np.array(sorted(range(n), key=parts.root))
    ordered, label = prints[order], np.array([parts.root(i) for i in order.tolist()])
    sliced = planes(ordered)
    for start in range(0, n, BLOCK):
        stop = min(start + BLOCK, n)
        later = np.nonzero(label[start:] != label[start])[0]
        if not len(later):
            break
        first = (start if label[start] != label[stop - 1] else start + int(later[0])) // 64
        q, p = within(ordered[start:stop], sliced[:, first:], n - 64 * first, radius)
        a, b = order[q + start], order[p + 64 * first]
        if alike:
            found += _verified(a, b, parts, alike)
            continue
        for a, b in zip(a.tolist(), b.tolist(), strict=True):
            if a != b and parts.join(a, b):
                found.append((a, b))
    return found


def _verified(a: np.ndarray, b: np.ndarray, parts: Parts, alike: Alike) -> list[tuple[int, int]]:
    """Links among proposed pairs, sorted by `a`; pairs of one part are not looked at."""
    found = []
    for at in np.split(np.arange(len(a)), np.nonzero(a[1:] != a[:-1])[0] + 1) if len(a) else []:
        i = int(a[at[0]])
        others = np.array([j for j in b[at].tolist() if parts.root(j) != parts.root(i)], np.int64)
        if len(others):
            found += [(i, j) for j in others[alike(i, others)].tolist() if parts.join(i, j)]
    return found


def _few_links(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small buckets at once."""
    left, right = [], []
    for size in np.unique(sizes):
        at = starts[sizes == size]
        for i, j in combinations(range(int(size)), 2):
            left.append(at + i)
            right.append(at + j)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    close = close_pairs(prints[a], prints[b], radius)
    return a[close], b[close]


def _links_of(nodes: np.ndarray, keys: np.ndarray, prints: np.ndarray, radius: int, alike: Alike | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, which lie one after the other."""
    starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    few = (sizes > 1) & (sizes <= FEW)
    a, b = _few_links(prints, starts[few], sizes[few], radius)
    if alike:
        order = np.argsort(a, kind="stable")
        pairs = np.array(_verified(a[order], b[order], Parts(len(nodes)), alike), np.int64).reshape(-1, 2)
        a, b = pairs[:, 0], pairs[:, 1]
    us, vs = [nodes[a]], [nodes[b]]
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        within_bucket = (lambda i, js, start=start: alike(i + start, js + start)) if alike else None
        pairs = np.array(bucket_links(prints[start : start + size], radius, within_bucket), np.int64).reshape(-1, 2) + start
        us.append(nodes[pairs[:, 0]])
        vs.append(nodes[pairs[:, 1]])
    return np.concatenate(us), np.concatenate(vs)


def _whole_buckets(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of one or more whole buckets each, from batches sorted by key; the key is the first array."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(arrays(batch))
        if held[0][0][0] == held[-1][0][-1]:
            continue  # one bucket so far
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        held = [tuple(x[cut:] for x in whole)]
        yield tuple(x[:cut] for x in whole)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def linked(keyed: DataFrame, words: int, radius: int, similarity: float | None = None) -> DataFrame:
    """Links (u, v) inside the buckets of keyed(key, node, f0, f1, ...).

    With a similarity rows also have `grams`, and links are pairs with that much in common.
    """
    names = [f"f{w}" for w in range(words)]

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        columns = [batch.column(k).to_numpy() for k in range(2 + words)]
        sets = [] if similarity is None else [np.array([*batch.column(2 + words).to_pylist(), None], object)[:-1]]
        return columns[0], columns[1], np.stack([c.view(np.uint64) for c in columns[2:]], axis=1), *sets

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, prints, *grams in _whole_buckets(batches, arrays):
            u, v = _links_of(nodes, keys, prints, radius, alike_in(*grams, similarity) if grams else None)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = keyed.select("key", "node", *names, *["grams"] * (similarity is not None)).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(find, "u long, v long")


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows of buckets with more than one member, with the bucket's size n."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(sizes, "key")


def _load(split: int) -> Column:
    """How many times a bucket of n members and mass shingles is as large as one task may take."""
    return F.greatest(F.col("n") / split, F.col("mass") / MASS)


def _block_pairs(prints: np.ndarray, classes: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, block) for every member with a fingerprint of another class within the radius in that block."""
    order = np.argsort(classes, kind="stable")
    ordered, label, block, n = prints[order], classes[order], blocks[order], len(prints)
    sliced, width, seen = planes(ordered), int(blocks.max()) + 1, np.empty(0, np.int64)
    for start in range(0, n, BLOCK):
        if label[start] == label[-1]:
            break
        first = start // 64
        q, p = within(ordered[start : start + BLOCK], sliced[:, first:], n - 64 * first, radius)
        a, b = q + start, p + 64 * first
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        seen = np.unique(np.concatenate([seen, a * width + block[b], b * width + block[a]]))
    return order[seen // width], seen % width


def _close_blocks(hot: DataFrame, radius: int) -> DataFrame:
    """(node, band, own, other): the blocks of hot(key, n, node, class, own, f0, ...) that hold something close of another class.

    Only fingerprints are compared here, in pairs of blocks of PRINTS.
    """
    names = [f"f{w}" for w in range(WORDS)]
    parts = hot.withColumn("parts", F.ceil(F.col("n") / PRINTS)).withColumn("part", F.pmod(F.xxhash64("key", "node", F.lit(SEED)), F.col("parts")))
    whole = F.col("parts") == 1
    others = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pairs = parts.withColumn("with", F.explode(others)).filter(whole | (F.col("part") != F.col("with")))
    rows = pairs.select(F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with")).alias("met"), "node", F.col("key").alias("band"), "class", "own", *names)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        columns = [batch.column(k).to_numpy() for k in range(5 + WORDS)]
        return *columns[:5], np.stack([c.view(np.uint64) for c in columns[5:]], axis=1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, nodes, bands, classes, own, prints in _whole_buckets(batches, arrays):
            for at in np.split(np.arange(len(met)), np.nonzero(met[1:] != met[:-1])[0] + 1):
                member, other = _block_pairs(prints[at], classes[at], own[at], radius)
                member = at[member]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[member], bands[member], own[member], other)], ["node", "band", "own", "other"])

    return rows.repartition("met").sortWithinPartitions("met").mapInArrow(find, "node long, band long, own long, other long").distinct()


def _hot_links(shared: DataFrame, sets: DataFrame, radius: int, similarity: float, split: int) -> DataFrame:
    """Links that connect what the links of all buckets of shared(key, n, mass, node, f0, ...) connect.

    Buckets within the load are compared whole. A larger one has blocks of half of `split`
    members or of MASS shingles, or so. First each text is compared with its own block in
    FIRST of its hot buckets, which takes its set of shingles there once, and classes come
    from these links. Then fingerprints of different classes are compared in all pairs of
    blocks, and a set travels only to a pair of blocks in which its text has something close
    of another class. No pair of a bucket is left out: it is in one class, apart by more
    than the radius, or compared by sets.
    """
    names = [f"f{w}" for w in range(WORDS)]
    cool = shared.filter(_load(split) <= 1).select("key", "node", *names)
    hot = shared.filter(_load(split) > 1)
    if hot.isEmpty():
        return linked(cool.join(sets, "node"), WORDS, radius, similarity)
    hot = settled(hot.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.ceil(2 * _load(split)))).drop("mass"))
    chosen = hot.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST).alias("chosen"))
    own = hot.join(chosen, "node").filter(F.array_contains("chosen", F.col("key"))).select(F.xxhash64("key", "own").alias("key"), "node", *names)
    links = settled(linked(cool.unionByName(own).join(sets, "node"), WORDS, radius, similarity))
    classes = settled(components(links)).withColumnRenamed("node", "of_node")
    hot = hot.join(classes, F.col("node") == F.col("of_node"), "left").withColumn("class", F.coalesce("root", "node")).drop("of_node", "root")
    several = hot.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least < most").select("key")
    close = settled(_close_blocks(hot.join(several, "key", "left_semi"), radius))
    keyed = close.select("node", F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("key")).distinct()
    prints = shared.select("node", *names).dropDuplicates(["node"])
    return links.unionByName(linked(keyed.join(prints, "node").join(sets, "node"), WORDS, radius, similarity))


#: Nodes from here on stand for fingerprints that only rows without an id have.
NAMELESS = 1 << 62


def _node(first: str, *of: str) -> Column:
    """A node's number is its least id, so that the least node of a class is the class's name."""
    return F.coalesce(F.col(first), F.lit(NAMELESS) + F.pmod(F.xxhash64(*of), F.lit(1 << 61)))


def _named(members: DataFrame, nodes: DataFrame, links: DataFrame, *of: str) -> DataFrame:
    """members(doc_id, ...) with component_id; nodes(..., node) has the node of each fingerprint."""
    classes = settled(components(links)).withColumnRenamed("node", "of_node")
    root = F.coalesce("root", "node")
    names = nodes.join(classes, F.col("node") == F.col("of_node"), "left").select(*of, F.when(root < NAMELESS, root).alias("component_id"))
    return members.join(names, list(of))


# fingerprints of 64 bits, linked without loss


def _pieces(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF) for k in range(4)]


def _piece_keys(fp: Column) -> list[Column]:
    """Six keys: two 16-bit pieces with the number of the choice in front; part zero."""
    p = _pieces(fp)
    return [F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(p[a], 16)).bitwiseOR(p[b]), 14) for n, (a, b) in enumerate(combinations(range(4), 2))]


def _rest_keys(fp: Column, key: Column) -> Column:
    """The key with each of three parts, 11, 11 and 10 bits, of the 32 bits it does not hold."""
    p, out = _pieces(fp), None
    for n, chosen in enumerate(combinations(range(4), 2)):
        a, b = (k for k in range(4) if k not in chosen)
        rest = F.shiftleft(p[a], 16).bitwiseOR(p[b])
        keys = F.array(*[key.bitwiseOR(F.lit((i + 1) << 11).cast("long")).bitwiseOR(F.shiftrightunsigned(rest, 11 * i).bitwiseAND(0x7FF)) for i in range(3)])
        here = F.shiftrightunsigned(key, 46) == n
        out = F.when(here, keys) if out is None else out.when(here, keys)
    return out


def near_links(prints: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links (u, v) between the nodes of distinct fingerprints, prints(fp, node), that keep every connection."""
    if radius > RADIUS:
        raise ValueError("the keys are complete for a radius of two bits")
    shared = settled(_shared(prints.select("fp", "node", F.explode(F.array(*_piece_keys(F.col("fp")))).alias("key"))))
    hot = shared.filter(F.col("n") > split).select("fp", "node", F.explode(_rest_keys(F.col("fp"), F.col("key"))).alias("key"))
    keyed = shared.filter(F.col("n") <= split).select("key", "fp", "node").unionByName(_shared(hot).select("key", "fp", "node"))
    return linked(keyed.select("key", "node", F.col("fp").alias("f0")), 1, radius)


def groups(docs: DataFrame, width: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the class of each document is its smallest linked id.

    Texts are read once. Null texts and texts without words have fingerprint zero and
    link like any other. Repeated ids give one row each; a null id never becomes the name
    of a class unless no member has an id. An empty table gives no rows. Only the id and
    the text are looked at, whatever other columns there are.
    """
    of_docs = settled(fingerprints(docs, width, id_col, text_col))
    nodes = settled(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", _node("first", "fp").alias("node")))
    links = near_links(nodes, radius)
    return _named(of_docs, nodes, links, "fp").select("doc_id", "fp", "component_id")


# texts that are similar in their shingles


def radius_at(similarity: float, bits: int = 64 * WORDS, deviations: float = DEVIATIONS) -> int:
    """The distance to expect of two equally large sets of this similarity, and a margin.

    Their vectors have the cosine 2 s / (1 + s), and a bit differs with the chance of the
    angle over pi.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * share + deviations * sqrt(bits * share * (1 - share)))


_SALTS = np.random.default_rng(SEED).integers(1, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint words and band keys of the distinct shingle hashes of a text."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64), np.arange(BANDS, dtype=np.uint64)
    words = np.array([majority(mixed(hashes + _SALTS[w])) for w in range(WORDS)], np.uint64)
    least = np.array([remixed(hashes, s).min() for s in _SALTS], np.uint64)
    bands = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + bands[:, r])
    return words, keys


def remixed(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One multiplication and a fold: the hashes are mixed already."""
    x = hashes * salt
    return x ^ (x >> np.uint64(32))


def grams(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words, _, _ = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    return np.unique(shingles(words, min(width, len(words)))) if len(words) else words


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, same, n_grams, f0 .. f3, keys) of docs(doc_id, text_hash, text).

    `same` is a hash of the whole set of shingles; f0 .. f3 are fingerprint words, keys are
    those of the bands.
    """
    names = [f"f{w}" for w in range(WORDS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = np.zeros((batch.num_rows, WORDS), np.uint64), np.zeros((batch.num_rows, BANDS), np.uint64)
            same, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = grams(text, width)
                prints[i], keys[i] = sketch(found)
                same[i], sizes[i] = xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found)
            offsets = pa.array(np.arange(0, BANDS * batch.num_rows + 1, BANDS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
            words = [pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.view(np.int64)), pa.array(sizes), *words, lists], ["doc_id", "text_hash", "same", "n_grams", *names, "keys"])

    return docs.mapInArrow(make, "doc_id long, text_hash long, same long, n_grams long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, grams) of wanted(node, first, first_hash), from the text that stands for each node."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grams(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "grams"])

    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first"]) & (docs["text_hash"] == wanted["first_hash"]))
    return texts.select("node", "text").mapInArrow(make, "node long, grams binary").dropDuplicates(["node"])


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): classes by links between texts whose shingle sets have `similarity` or more.

    Texts with the same set of shingles collapse before any comparison. A bucket with more
    than `split` of them is compared in blocks (`_hot_links`), and no pair of it is left out. All texts without words are one class.
    """
    names = [f"f{w}" for w in range(WORDS)]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    made = settled(sketches(slim, width))
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_hash"))
    firsts = made.groupBy("same").agg(first.alias("first"), *[F.min(n).alias(n) for n in ("n_grams", *names, "keys")])
    nodes = firsts.select("same", F.col("first.doc_id").alias("first"), F.col("first.text_hash").alias("first_hash"), "n_grams", *names, "keys")
    nodes = settled(nodes.withColumn("node", _node("first", "same")))
    filed = nodes.select("node", "n_grams", *names, F.explode("keys").alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_grams").alias("mass")).filter("n > 1")
    shared = settled(filed.drop("n_grams").join(sizes, "key"))
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "first", "first_hash")
    links = _hot_links(shared, settled(_sets(slim, settled(wanted), width)), radius_at(similarity), similarity, split)
    return _named(made.select("doc_id", "same"), nodes, links, "same").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class stays, the one with the smallest id, with its columns.

    Repeated rows of that id all stay, as they are one document. Rows without an id stay,
    as nothing names them.
    """
    drop = near_groups(docs.filter(F.col(id_col).isNotNull()), similarity, width, id_col=id_col, text_col=text_col)
    drop = drop.filter("doc_id <> component_id").select(F.col("doc_id").alias("__dropped_id")).distinct()
    return docs.join(drop, docs[id_col] == drop["__dropped_id"], "left_anti")
