"""Token ids as Parquet list columns.

A token table is a folder with two Parquet tables. `tokens` holds, in ascending doc_id
order, doc_id, n_tokens, start_in_part, part and the list `ids`; `parts` holds the number of
ids before each part. Parts are ranges of doc_id, one file each (Spark may cut a part into
several), so a document's place among all ids is the part's place plus start_in_part, and
no pass over all ids in one task is needed to number them.

Encodings: ids are dictionary encoded (a vocabulary below 2**16 entries gives at most 16
bits an id); the sorted integers doc_id and start_in_part are delta encoded by the version
2 writer with their dictionaries off. Row groups and pages have set sizes, and the writer
adds page indexes: a reader of a doc_id range or of the metadata columns alone touches
only those pages (`read_index`, `read_tokens`).

A null or empty text has only the end id. Rows with equal ids stay, next to each other.
Null ids sort first. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.bytehash import BLANK, Grown, HashIndex, Spelling, lowered, word_hashes
from palisade.llm.common import scratch

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Words that a worker remembers. When it has so many, further words are encoded where they
#: occur, and if they become more than MISSES of all, it starts afresh.
MEMO_WORDS = 700_000
MISSES = 0.15
#: Words that are encoded in one call.
TOGETHER = 8_192
TOKENIZER = "word_bpe_49k.json"

WRITER = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts word by word and remembers the ids of words.

    For tokenizers that drop white space, so that the ids of a text are those of its
    blank-separated words one after the other; a test holds this against the library. A word
    is known by its bytes: a hash finds it, and its spelling is compared.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.memo_words = memo_words
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in added for c in t):
            raise ValueError("a token of this tokenizer holds white space, so words cannot be encoded apart")
        #: A tokenizer that lower-cases gives both forms of a word the same ids, but for the
        #: tokens that it looks for before: words with the first byte of one stay as they are.
        self.marks = np.zeros(256, bool)
        self.marks[[t.encode()[0] for t in added if t]] = True
        lower_cases = '"Lowercase"' in self.tokenizer.to_str().split('"pre_tokenizer"')[0]
        self.fold = lower_cases and not any(t[:1].isalpha() for t in added)
        self.forget()

    def forget(self) -> None:
        self.index, self.spelling = HashIndex(), Spelling()
        self.ids, self.sizes = Grown(np.int32), Grown(np.int64)
        self.begins, self.missed = Grown(np.int64), 0.0

    def _folded(self, raw: np.ndarray) -> np.ndarray:
        if not self.fold:
            return raw
        out, at = lowered(raw), np.nonzero(self.marks[raw])[0]
        if len(at):
            blanks = np.concatenate([[-1], np.nonzero(BLANK[raw])[0], [len(raw)]])
            words = np.unique(np.searchsorted(blanks, at))
            for a, b in zip((blanks[words - 1] + 1).tolist(), blanks[words].tolist(), strict=True):
                out[a:b] = raw[a:b]
        return out

    def _coded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words and how many each has, from the library."""
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(starts), TOGETHER):  # what the library returns is many times larger than ids
            words = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[at : at + TOGETHER].tolist(), ends[at : at + TOGETHER].tolist(), strict=True)]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            ids.append(np.fromiter(chain.from_iterable(coded), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _numbered(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers for words that are encoded now."""
        ids, sizes = self._coded(raw, starts, ends)
        known = self.sizes.size
        self.begins.extend(self.ids.size + np.cumsum(sizes) - sizes)
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        return np.arange(known, known + len(starts))

    def _numbers(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word; unknown words are encoded first, each once.

        Numbers from `self.spelling.sizes.size` on are good for this batch only.
        """
        found = self.index.find(hashes)
        unknown, known = np.nonzero(found < 0)[0], np.nonzero(found >= 0)[0]
        wrong = known[self.spelling.differs(found[known], raw, starts[known], ends[known])]  # another word has this hash
        fresh, first, inverse = np.unique(hashes[unknown], return_index=True, return_inverse=True)
        where = unknown[first]
        if len(fresh) and self.index.size < self.memo_words:
            numbers = self._numbered(raw, starts[where], ends[where])
            self.spelling.add(raw, starts[where], ends[where])
            self.index.add(fresh, numbers)
            found[unknown] = numbers[inverse]
            wrong = np.concatenate([wrong, unknown[self.spelling.differs(found[unknown], raw, starts[unknown], ends[unknown])]])
        elif len(fresh):
            here = Spelling()
            here.add(raw, starts[where], ends[where])
            found[unknown] = self._numbered(raw, starts[where], ends[where])[inverse]
            wrong = np.concatenate([wrong, unknown[here.differs(inverse, raw, starts[unknown], ends[unknown])]])
        if len(wrong):
            found[wrong] = self._numbered(raw, starts[wrong], ends[wrong])
        self.missed = 0.9 * self.missed + 0.1 * len(unknown) / max(1, len(hashes))
        return found

    def _drop_unremembered(self) -> None:
        """Numbers that no hash leads to go, so a worker holds no more than its words."""
        last = self.spelling.sizes.size
        if self.sizes.size > last:
            self.ids.size = int(self.begins.all()[last])
            self.begins.size = self.sizes.size = last

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text with its end id."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        blob = b"\n".join(raw)
        if self.index.size >= self.memo_words and self.missed > MISSES:
            self.forget()
        spelled = self._folded(np.frombuffer(blob, np.uint8))
        hashes, starts, ends = word_hashes(spelled.tobytes(), fold=False)
        which = self._numbers(spelled, hashes, starts, ends)
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
        begin, sizes = self.begins.all()[which], self.sizes.all()[which]
        ends_at = np.cumsum(sizes)
        total = int(ends_at[-1]) if len(ends_at) else 0
        lengths = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(total + len(texts), end_id, np.int32)
        # each id goes to its place among the ids plus one for each end id before it
        target = np.arange(total, dtype=np.int64) + np.repeat(owner, sizes)
        out[target] = self.ids.all()[np.arange(total, dtype=np.int64) + np.repeat(begin - (ends_at - sizes), sizes)]
        self._drop_unremembered()
        return out, lengths


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(upto):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield at, end
        at = end


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write a token table at `path`.

    Documents are dealt into ranges of doc_id and sorted before they are tokenized, so
    texts are tokenized once, and ids are written where they are made.
    """
    model = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = word_encoder(model), 0, TaskContext.get().partitionId()
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                ids, lengths = encoder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], end_id)
                starts = start + np.cumsum(lengths) - lengths
                start += int(lengths.sum())
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(lengths), pa.array(starts), pa.array(np.full(b - a, part, np.int32)), lists],
                    ["doc_id", "n_tokens", "start_in_part", "part", "ids"],
                )

    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("from"))
    # the task that a row comes from deals rows with one id, or none, over several ranges
    sorted_docs = slim.repartitionByRange("doc_id", "from").sortWithinPartitions("doc_id", "from")
    sorted_docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, start_in_part long, part int, ids array<int>").write.options(**WRITER).parquet(f"{path}/tokens")
    totals = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"))
    # one row for each part, not for each document
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading any ids."""
    return _placed(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids), of a range of doc_id where bounds are given."""
    rows = _placed(spark, path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.select("doc_id", "start", "n_tokens", "ids")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    tokens, parts = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/parts").select("part", "before")
    # as many rows as parts, hence bounded by the number of tasks that wrote the table
    return tokens.join(F.broadcast(parts), "part").withColumn("start", (F.col("before") + F.col("start_in_part")).cast("long"))


def checksum(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            raw, first, sums = memoryview(flat.tobytes()), 0, []
            for end in (4 * ends).tolist():
                sums.append(zlib.crc32(raw[first:end]))
                first = end
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, read: Callable[[SparkSession, str], DataFrame] = read_tokens) -> DataFrame:
    """Write a token table in the shared folder and return what its files hold."""
    spark = docs.sparkSession
    where = path or scratch(spark, "tokens")
    write_tokens(docs, where, tokenizer, end_id)
    return checksum(read(spark, where))
