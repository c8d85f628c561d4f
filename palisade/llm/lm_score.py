"""Scores of whole texts by a gated recurrent language model trained on the corpus.

Texts are lower-cased (A to Z), cut into words at blanks, and end with one end token. A text
is held out if the crc32 of its id, written as text, leaves HELD_OUT modulo FOLDS.

1. Counts. Each task counts the words of the training texts it reads, by a 64-bit hash of the
   word, and a shuffle adds the counts up. The table stays distributed; only about HEAD of its
   most frequent words come to the driver, never more.
2. Ids. The VOCABULARY most frequent words are the model's ids, all others share one. Texts
   are read and cut once more; a table keeps two bytes for each token and what the scores
   need of words beyond the vocabulary: counts of HEAD words are sent along, all rarer words
   go as (hash, times) to a join with the table of counts.
3. Training. In each of ROUNDS rounds copies of the weights are trained by truncated
   backpropagation on a share of the training texts (one ROUNDS-th each round, chosen by the
   same checksum, so every text is learnt from once), and the copies are averaged by the
   number of tokens they saw, as are the sums of squared gradients that bound their steps.
   A copy is trained on one shard: about SHARD_TOKENS tokens of the round, dealt by a hash of
   id and text and taken in its order. How many shards there are follows from the number of
   training tokens, so how the input is split into files and partitions has no part in the
   weights. Weights are averaged in BLOCKS pieces, each in lots first, in the order of
   shards, so no task reads more than a small share of all copies, and the driver gets one copy.
   Weights start as the counts' own distribution, so with little text the model is no worse.
4. Scores. The model scores whole texts, its state carried across windows. A word outside the
   vocabulary has the model's probability of the shared id times its share (c + 1) among such
   words: a distribution over all words, one place being kept for words never seen.

Results per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the add-one
unigram score) and score, both log10. A null text is empty, and has its end token alone. A
null id is in training. Rows are scored one by one, also if ids repeat (each counts in
training). Other columns are ignored. Without any training text all words are unknown.
The last digits of `score` may differ between machines; all other columns are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm import gru
from palisade.llm.bytehash import HashIndex, word_hashes
from palisade.llm.common import release, settled

FOLDS, HELD_OUT = 7, 2
VOCABULARY = 4096
HEAD = 65_536
ROUNDS = 8
#: The end token's key among word hashes.
END = np.uint64(0x5EED0FE17D)
#: A task hands on its counts when it holds so many words.
FLUSH_WORDS = 400_000
#: Texts are cut together up to so many bytes, learnt and scored together up to so many tokens.
TOGETHER, TOKENS, SCORED = 4 << 20, 1 << 20, 4 << 20
#: Weights are averaged in so many pieces, and each piece in as many lots as a lot has copies.
BLOCKS = 64
#: Tokens that one copy learns from in one round.
SHARD_TOKENS = 400_000


def _crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(_crc(doc_id) % FOLDS == HELD_OUT, F.lit(False))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= TOGETHER):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


def _encoded(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of all words."""
    hashes, starts, _ = word_hashes(b"\n".join(texts))
    return hashes, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


# counts


def count_words(train: DataFrame) -> DataFrame:
    """(h, c) of every word and of the end in train(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, ends = HashIndex(), np.zeros(0, np.int64), 0

        def taken() -> pa.RecordBatch:
            keys = index.keys[index.values >= 0]
            own = counts[index.values[index.values >= 0]]
            keys, own = np.append(keys, END), np.append(own, ends)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own)], ["h", "c"])

        for batch in batches:
            texts = _encoded(batch, 0)
            ends += len(texts)
            for a, b in _groups(texts):
                hashes = _tokens(texts[a:b])[0]
                found = index.find(hashes)
                counts += np.bincount(found[found >= 0], minlength=len(counts))
                fresh, times = np.unique(hashes[found < 0], return_counts=True)
                index.add(fresh, np.arange(len(counts), len(counts) + len(fresh)))
                counts = np.concatenate([counts, times])
                if index.size > FLUSH_WORDS:
                    yield taken()
                    index, counts, ends = HashIndex(), np.zeros(0, np.int64), 0
        if ends or index.size:
            yield taken()

    return train.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(table: DataFrame, most: int) -> list[tuple[int, int]]:
    """(h, c) of the most frequent words of table(h, c), by falling count; about `most`, never more.

    How many words have each count tells which counts are in as a whole; only their words, and a
    share by hash of those with the next count, come to the driver. A bounded sort would send it
    `most` rows of every partition.
    """
    sizes = table.groupBy("c").agg(F.count("*").alias("n"))  # a row for each count that occurs
    ranked = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("c"))))
    within, beyond = F.col("upto") <= most, F.col("upto") > most
    row = ranked.agg(F.min(F.when(within, F.col("c"))).alias("least"), F.max(F.when(within, F.col("upto"))).alias("whole"), F.max(F.when(beyond, F.struct("c", "n"))).alias("next")).first()
    wanted = F.col("c") >= row["least"] if row["least"] is not None else F.lit(False)
    rest = most - (row["whole"] or 0)
    if row["next"] is not None and rest:
        wanted = wanted | ((F.col("c") == row["next"]["c"]) & (F.col("h") < int(-(2**63) + 2**64 * min(1.0, rest / row["next"]["n"]))))
    found = sorted(((r["h"], r["c"]) for r in table.filter(wanted).collect()), key=lambda x: (-x[1], x[0]))
    return found[:most]


# the model that is sent to tasks


class Model:
    """Head words with their counts, the first of which are the vocabulary, and weights."""

    def __init__(self, head: list[tuple[int, int]], tokens: int, words: int, ends: int):
        """head: (hash, count) by falling count, the end left out."""
        self.tokens, self.words, self.ends = tokens, words, ends
        self.hashes = np.array([h for h, _ in head], np.int64).view(np.uint64)
        self.counts = np.array([c for _, c in head], np.int64)
        inside = self.counts[: VOCABULARY - 1]
        self.size = -(-(len(inside) + 1) // gru.WIDE) * gru.WIDE
        self.inside = len(inside)
        known = np.zeros(self.size, np.int64)
        known[0], known[1 : 1 + len(inside)] = ends, inside
        self.other_tokens = tokens - int(known.sum())
        self.other_words = words - (ends > 0) - len(inside)
        self.weights = gru.start(known, self.other_tokens)

    def index(self) -> HashIndex:
        found = HashIndex()
        found.add(self.hashes, np.arange(len(self.hashes)))
        return found

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Model ids of places in the head (-1: not in it)."""
        return np.where((places >= 0) & (places < self.inside), places + 1, self.size)


def vector(weights: gru.Weights) -> np.ndarray:
    """All weights one after the other."""
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)])


def shaped(flat: np.ndarray, like: dict[str, tuple[int, ...]]) -> gru.Weights:
    sizes = [int(np.prod(like[k])) for k in sorted(like)]
    return {k: part.reshape(like[k]) for k, part in zip(sorted(like), np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}


_COPY = "block int, lot int, shard long, tokens long, weights binary"


def _copy_rows(rows: list[tuple[int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
    blocks, lots, shards, tokens, weights = zip(*rows, strict=True)
    columns = [pa.array(blocks, pa.int32()), pa.array(lots, pa.int32()), pa.array(shards, pa.int64()), pa.array(tokens, pa.int64()), pa.array([w.tobytes() for w in weights], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "lot", "shard", "tokens", "weights"])


def _averaged(copies: DataFrame) -> DataFrame:
    """One row for each block of copies(block, lot, shard, tokens, weights): means by tokens, summed in the order of lots and shards."""

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, lot, _, tokens, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                total = totals.setdefault((block, lot), [0, 0.0])
                total[0] += tokens
                total[1] = total[1] + tokens * np.frombuffer(data, np.float32).astype(np.float64)
        if totals:
            yield _copy_rows([(block, lot, 0, n, (x / n).astype(np.float32)) for (block, lot), (n, x) in sorted(totals.items())])

    lots = copies.repartition("block", "lot").sortWithinPartitions("block", "lot", "shard").mapInArrow(average, _COPY)
    return lots.withColumn("shard", F.col("lot").cast("long")).withColumn("lot", F.lit(0)).repartition("block").sortWithinPartitions("block", "shard").mapInArrow(average, _COPY)


def _pools(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches together until their ids are SCORED or more, with each row's ids."""
    held, ids, size = [], [], 0
    for batch in batches:
        rows = [np.frombuffer(x, np.uint16) for x in batch.column(column).to_pylist()]
        held.append(batch)
        ids += rows
        size += sum(map(len, rows))
        if size >= SCORED:
            yield held, ids
            held, ids, size = [], [], 0
    if ids:
        yield held, ids


def train(docs: DataFrame, model: Model) -> gru.Weights:
    """Weights after all rounds over docs(text, slice)."""
    return learned(encoded(docs.select(F.lit(None).alias("doc_id"), F.lit(False).alias("held_out"), "slice", "text"), model), model)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list[np.ndarray]]]]:
    """Of batches(shard, ids), sorted by shard: each shard with its texts, up to about TOKENS at once."""
    rows = ((s, np.frombuffer(x, np.uint16).astype(np.int64)) for batch in batches for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    def pools(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[np.ndarray]]:
        held, size = [], 0
        for _, ids in texts:
            held.append(ids)
            size += len(ids) + 1
            if size >= TOKENS:
                yield held
                held, size = [], 0
        if held:
            yield held

    for shard, texts in groupby(rows, key=lambda r: r[0]):
        yield shard, pools(texts)


def shards_of(tokens: int) -> int:
    """How many copies are trained in a round of a corpus with so many training tokens."""
    return max(1, round(tokens / ROUNDS / SHARD_TOKENS))


def learned(texts: DataFrame, model: Model) -> gru.Weights:
    """Weights after all rounds over texts(doc_id, ids, slice)."""
    spark = texts.sparkSession
    like, flat = {k: v.shape for k, v in model.weights.items()}, vector(model.weights)
    seen, shards = vector(gru.unseen(model.weights)), shards_of(model.tokens)
    lots = ceil(sqrt(shards))
    key = F.xxhash64("doc_id", "ids")
    keyed = texts.select("slice", key.alias("key"), "doc_id", "ids").withColumn("shard", F.pmod(F.shiftright("key", 20), F.lit(shards)))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((flat, seen))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for shard, pools in _shards(batches):
                trainer = gru.Trainer(shaped(sent.value[0], like), seen=shaped(sent.value[1], like))
                for ids in pools:
                    trainer.learn(ids)
                both = zip(np.array_split(vector(trainer.weights), BLOCKS), np.array_split(vector(trainer.seen), BLOCKS), strict=True)
                yield _copy_rows([(k, shard % lots, shard, trainer.tokens, np.concatenate(parts)) for k, parts in enumerate(both)])

        dealt = keyed.filter(F.col("slice") == turn).repartition(shards, "shard").sortWithinPartitions("shard", "key", "doc_id", "ids")
        copies = dealt.select("shard", "ids").mapInArrow(learn, _COPY)
        means = sorted((r["block"], bytes(r["weights"])) for r in _averaged(copies).collect())  # BLOCKS rows, one copy in all
        if means:
            halves = [np.split(np.frombuffer(x, np.float32), 2) for _, x in means]
            flat, seen = (np.concatenate([half[k] for half in halves]) for k in (0, 1))
        sent.destroy()
    return shaped(flat, like)


# scores


_IDS = "doc_id long, held_out boolean, slice int, n_tokens long, n_head long, head double, other_head double, n_other long, rare array<struct<h: bigint, times: int>>, ids binary"


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """Of docs(doc_id, held_out, slice, text) the model's ids, two bytes each, and what the scores need of the words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index, log_head = model.index(), np.log10(np.append(model.counts, 0) + 1.0)
        for batch in batches:
            texts = _encoded(batch, 3)
            for a, b in _groups(texts):
                n = b - a
                hashes, owner = _tokens(texts[a:b])
                places = index.find(hashes)
                ids, inside = model.ids(places), places >= 0
                of_head, other, rare = log_head[places], ids == model.size, np.nonzero(~inside)[0]  # the last is of words beyond the head
                sums = lambda x: np.bincount(owner, weights=x, minlength=n)  # noqa: B023, E731
                order = rare[np.lexsort((hashes[rare], owner[rare]))]
                h, of = hashes[order], owner[order]
                at = np.nonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])))[0] if len(order) else order
                entries = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(order))).astype(np.int32))], ["h", "times"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=n))]).astype(np.int32)
                counts = np.bincount(owner, minlength=n)
                bounds = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, n) for k in range(3)),
                        pa.array(counts + 1),
                        pa.array(sums(inside.astype(float)).astype(np.int64)),
                        pa.array(sums(of_head)),
                        pa.array(sums(of_head * other)),
                        pa.array(sums(other.astype(float)).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), entries),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u2"))]),
                    ],
                    ["doc_id", "held_out", "slice", "n_tokens", "n_head", "head", "other_head", "n_other", "rare", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("slice").cast("int").alias("slice"), "text").mapInArrow(cut, _IDS)


def rated(texts: DataFrame, weights: gru.Weights) -> DataFrame:
    """Adds `model`, the log10 probability of the ids and the end, in place of texts(..., ids)."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in texts.columns if c != "ids"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, ids in _pools(batches, len(names)):
            found, at = gru.log_likelihoods(sent.value, ids) / log(10), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(found[at : at + batch.num_rows])], [*names, "model"])
                at += batch.num_rows

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*names).schema.fields)
    return texts.select(*names, "ids").mapInArrow(rate, f"{kind}, model double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", is_held_out(F.col("doc_id")))
    table = settled(count_words(slim.filter(~F.col("held_out")).select("text")))
    whole = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == int(END), F.col("c"))), F.lit(0))).first()
    model = Model(frequent(table.filter(F.col("h") != int(END)), HEAD), whole[0], whole[1], whole[2])
    sliced = slim.withColumn("slice", F.coalesce(F.floor(_crc(F.col("doc_id")) / FOLDS) % ROUNDS, F.lit(0)))
    texts = settled(encoded(sliced, model).withColumn("row", F.monotonically_increasing_id()))
    release(spark)
    weights = learned(texts.filter(~F.col("held_out")), model)
    words = texts.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.times")
    # a hash spreads words evenly, so each partition's share of the table is small enough to look up in
    found = words.join(table.hint("shuffle_hash"), "h")
    known = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("times").alias("n_rare")).withColumnRenamed("row", "of_row")
    scored = rated(texts.select("row", "doc_id", "held_out", "n_tokens", "n_head", "head", "other_head", "n_other", "ids"), weights)
    joined = scored.join(known, F.col("row") == F.col("of_row"), "left")
    rare_log, n_rare = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    end_log, space = log(model.ends + 1) / log(10), log(model.tokens + model.words + 1) / log(10)
    other_space = log(model.other_tokens + model.other_words + 1) / log(10)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + n_rare + (1 if model.ends else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head") + rare_log + F.lit(end_log) - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("model") + F.col("other_head") + rare_log - F.col("n_other") * F.lit(other_space)).alias("score"),
    )
