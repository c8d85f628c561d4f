"""Toxicity by a classifier that is held to the same score when an identity term is swapped.

Features are the words of a text and their beginnings, each counted once for a text. In
three steps:

1. Counting. Over all labelled training texts each task counts its features, by a hash of
   22 bits, in texts of either label; the counts are summed by Spark. The features whose
   counts differ most by the log-likelihood ratio are kept, FEATURES at most, and with them
   those of identity terms that occur at all.
2. Fitting. A sample of about SAMPLE_ROWS training texts, all of them where there are fewer,
   comes down to lists of kept features. Each text that names a member of one of GROUPS gives
   counterfactuals: the same labelled text with that term swapped for another of its group.
   Logistic regression minimises the loss with an L2 term and PENALTY times the squared
   change of the score (its log-odds) between text and counterfactual, so a term that
   merely goes along with the label gets no weight of its own, while what is said about it keeps its.
3. Scoring. A worker remembers for words it has met which kept features they have. Only
   kept ones are looked at, so a text is one pass over its words.

The sample is the only thing bounded by a parameter; counts cover every labelled row, and
every document is scored whole, in pieces of PIECE characters that end between words.
Labels, language, source and ids never enter a score.

Defined results: a null text is empty; an empty one has the score of the intercept. Rows are
scored one by one, so repeated ids and rows agree. A row without an id is held out, as it cannot
be learned from. Several labels of one id count as their majority, a tie as toxic; null labels
count as none. Without labels of both kinds every score is the share of toxic ones, smoothed. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import settled

BITS = 22
#: Beginnings of a word that are features, besides the word.
PREFIXES = (3, 4, 5, 6)
FEATURES = 4096
#: Least number of training texts that a feature occurs in, and least log-likelihood ratio.
LEAST_TEXTS, LEAST_RATIO = 3, 12.0
SAMPLE_ROWS = 50_000
PENALTY = 20.0
RIDGE = 0.2
STEPS = 400
FOLDS, HELD_OUT = 5, 0
PIECE = 1 << 20
#: Words that a worker remembers before it starts anew.
MEMO_WORDS = 400_000

#: Terms that may stand for each other in a neutral sentence.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def features_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings; a beginning is not the same as a word of these letters."""
    return [bucket(word), *(bucket("^" + word[:k]) for k in PREFIXES if len(word) >= k)]


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a text."""
    found: set[str] = set()
    at, text = 0, text or ""
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


class Memo:
    """Which kept features a word has; most have none."""

    def __init__(self, kept: Iterable[int]) -> None:
        self.kept = frozenset(kept)
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, words: Iterable[str]) -> set[int]:
        """Kept buckets among the features of some words."""
        out: set[int] = set()
        known = self.known
        for word in words:
            got = known.get(word)
            if got is None:
                if len(known) >= MEMO_WORDS:
                    known.clear()
                got = known[word] = tuple(b for b in features_of(word) if b in self.kept)
            if got:
                out.update(got)
        return out


def swaps(words: set[str], groups: Sequence[Sequence[str]] = GROUPS) -> Iterator[set[str]]:
    """The words of each counterfactual: one term of the text gives way to another of its group."""
    for group in groups:
        for term in group:
            if term in words:
                for other in group:
                    if other != term:
                        yield (words - {term}) | {other}


# counting


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(row, text, toxic) of training documents that have a label."""
    judged = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("toxic")).filter("id is not null and toxic is not null")
    one = judged.groupBy("id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    train = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(~held_out(F.col("id")))
    # nothing bounds the labels, so they aren't broadcast, few as they may be
    return train.join(one.filter(~held_out(F.col("id"))).hint("merge"), "id").select(F.monotonically_increasing_id().alias("row"), "text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has counted: (bucket, clean, toxic) of features that it met."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            met = {b for word in words_of(text.as_py()) for b in features_of(word)}
            counts[toxic, np.fromiter(met, np.int64, len(met))] += 1
    at = np.nonzero(counts.any(axis=0))[0]
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], ["bucket", "clean", "toxic"])


def _ratio(clean: Column, toxic: Column, n_clean: float, n_toxic: float) -> Column:
    """Twice the log-likelihood ratio of a feature's occurrence in both classes."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))

    n, both = n_clean + n_toxic, clean + toxic
    cells = [(clean, both * n_clean / n), (toxic, both * n_toxic / n), (n_clean - clean, (n - both) * n_clean / n), (n_toxic - toxic, (n - both) * n_toxic / n)]
    return 2 * sum((part(seen, expected) for seen, expected in cells[1:]), part(*cells[0]))


def chosen(texts: DataFrame, n_clean: int, n_toxic: int, groups: Sequence[Sequence[str]] = GROUPS, features: int = FEATURES) -> list[int]:
    """Buckets of the features that tell the classes apart, and of identity terms that occur."""
    counts = texts.select("text", "toxic").mapInArrow(_counted, "bucket int, clean int, toxic int")
    total = settled(counts.groupBy("bucket").agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic")))
    ratio = _ratio(F.col("clean"), F.col("toxic"), float(n_clean), float(n_toxic))
    common = total.filter((F.col("clean") + F.col("toxic") >= LEAST_TEXTS) & (F.col("clean") + F.col("toxic") < n_clean + n_toxic)).withColumn("ratio", ratio)
    best = common.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "bucket").limit(features)
    terms = sorted({b for group in groups for term in group for b in features_of(term)})
    told = best.select("bucket").union(total.filter(F.col("bucket").isin(terms)).select("bucket"))
    return sorted({r["bucket"] for r in told.collect()})  # features and terms at most


# fitting


@dataclass
class Rows:
    """Sparse rows of ones."""

    row: np.ndarray
    col: np.ndarray
    n: int
    width: int

    @classmethod
    def of(cls, lists: Sequence[Sequence[int]], width: int) -> Rows:
        return cls.from_arrow(pa.array([list(x) for x in lists], pa.list_(pa.int32())), width)

    @classmethod
    def from_arrow(cls, lists: pa.ListArray, width: int) -> Rows:
        sizes = np.diff(lists.offsets.to_numpy())
        return cls(np.repeat(np.arange(len(lists), dtype=np.int32), sizes), lists.flatten().to_numpy(zero_copy_only=False), len(lists), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=v[self.row], minlength=self.width)


def fit(x: Rows, toxic: Sequence[int], lost: Rows, gained: Rows, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of texts `x`; `lost` and `gained` have a row of features for each counterfactual.

    Minimised by steps along the gradient with momentum, each coordinate by its own bound of
    the curvature.
    """
    y, pairs = np.asarray(toxic, float), lost.n
    w, b = np.zeros(x.width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    size = np.bincount(x.row, minlength=x.n) + 1.0
    bound = x.back(0.25 * size) + ridge
    if pairs:
        moved = np.bincount(lost.row, minlength=lost.n) + np.bincount(gained.row, minlength=gained.n)
        bound = bound + 2 * penalty * (lost.back(moved.astype(float)) + gained.back(moved.astype(float)))
    bound_b = 0.25 * size.sum()
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x.times(ahead_w) + ahead_b, -50, 50))) - y
        grad = x.back(error) + ridge * ahead_w
        if pairs:
            change = gained.times(ahead_w) - lost.times(ahead_w)
            grad = grad + 2 * penalty * (gained.back(change) - lost.back(change))
        new_w, new_b = ahead_w - grad / bound, ahead_b - error.sum() / bound_b
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


@dataclass
class Model:
    weights: dict[int, float]
    intercept: float


def train(texts: DataFrame, groups: Sequence[Sequence[str]] = GROUPS, penalty: float = PENALTY, sample: int = SAMPLE_ROWS) -> Model:
    """The classifier from labelled(docs, labels)."""
    texts = settled(texts)
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        return Model({}, float(np.log((n_toxic + 1) / (n_clean + 1))))
    kept = chosen(texts, n_clean, n_toxic, groups)
    place = {b: i for i, b in enumerate(kept)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(kept)
        for batch in batches:
            hits, lost, gained = [], [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                own = memo.hits(words)
                others = [memo.hits(other) for other in swaps(words, groups)]
                hits.append([place[b] for b in sorted(own)])
                lost.append([[place[b] for b in sorted(own - o)] for o in others])
                gained.append([[place[b] for b in sorted(o - own)] for o in others])
            nested = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hits, pa.list_(pa.int32())), pa.array(lost, nested), pa.array(gained, nested)], ["toxic", "hits", "lost", "gained"])

    share = min(1.0, sample / (n_clean + n_toxic))
    taken = texts.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30))
    rows = taken.select("text", "toxic").mapInArrow(narrow, "toxic int, hits array<int>, lost array<array<int>>, gained array<array<int>>").toArrow()
    one = lambda name: rows.column(name).combine_chunks()
    lost, gained = (Rows.from_arrow(one(name).flatten(), len(kept)) for name in ("lost", "gained"))
    weights, intercept = fit(Rows.from_arrow(one("hits"), len(kept)), one("toxic").to_numpy(), lost, gained, penalty)
    return Model({b: float(weights[i]) for b, i in place.items() if weights[i]}, intercept)


# scoring


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    weights, intercept = model.weights, model.intercept

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(weights)
        for batch in batches:
            odds = [intercept + sum(weights[b] for b in sorted(memo.hits(words_of(text.as_py())))) for text in batch.column(2)]
            values = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]] = GROUPS, penalty: float = PENALTY) -> DataFrame:
    return scored(docs, train(labelled(docs, labels), groups, penalty))
