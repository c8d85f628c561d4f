"""Conversations formatted by a compiled template, with a loss mask, and read back.

Turns are ordered by turn, role and text; ties and repeated rows keep a place each. A
conversation is cut into stretches that are formatted apart, so one that holds a third of all
rows is spread over many tasks; only the stretches' results meet, one at a time. A stretch is PIECE turn
numbers. If any stretch had more than CROWD times PIECE rows, as turns share a number, all
stretches are PIECE turns by their place instead. To give places without gathering a
conversation, repeated rows are counted first, rows are dealt into ranges of their order and
numbered inside each, and the sizes of a conversation's part in the ranges before are added.
Results are the same either way.

Defined results: a null text or role is empty; null turns come first; rows with a null
conv_id are one conversation. A conversation of repeated rows keeps them all. An empty
table gives no rows. Only the four named columns are looked at.

A control string in a text is escaped by a backslash after its first character (after the
backslashes that are there already), and unescaped by taking one away, so no text can end
a turn or open another, and every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.chat_template import Template
from palisade.llm.common import settled

#: Turn numbers, or turns, of a stretch.
PIECE = 256
CROWD = 16

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text|escape }} [/INST]"
    "{% elif m.role == 'system' %}[SYS] {{ m.text|escape }} [/SYS]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text|escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role|escape }} [TEXT] {{ m.text|escape }} [/ROLE]{% endif %}"
    "{% endfor %}{% if add_generation_prompt %} {% endif %}"
)

_FIRSTS = "".join(re.escape(c) for c in sorted({c[0] for c in CONTROLS}))
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([{_FIRSTS}])(\\*)({_RESTS})")
_ESCAPED = re.compile(rf"([{_FIRSTS}])\\(\\*)({_RESTS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text or of a stretch of one."""
    at, out = 3 if text.startswith("<s>") else 0, []

    def upto(mark: str) -> str:
        nonlocal at
        end = text.index(mark, at)
        part, at = text[at:end], end + len(mark)
        return unescape(part)

    while at < len(text):
        for mark, end, role in (("[INST] ", " [/INST]", "user"), ("[SYS] ", " [/SYS]", "system"), (" ", "</s>", "assistant")):
            if text.startswith(mark, at):
                at += len(mark)
                out.append((role, upto(end)))
                break
        else:
            if not text.startswith("[ROLE] ", at):
                raise ValueError(f"no turn starts at {at}")
            at += len("[ROLE] ")
            role = upto(" [TEXT] ")
            out.append((role, upto(" [/ROLE]")))
    return out


#: So many characters of a text take part in dealing rows into ranges.
_HEAD = 32


def _numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, begin, total): distinct rows, how often they occur, how many turns come before, and there are."""
    order = ["turn", "role", "text"]
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = filled.groupBy("conv_id", *order).agg(F.count("*").alias("n"))
    ranged = distinct.withColumn("head", F.substring("text", 1, _HEAD)).repartitionByRange("conv_id", "turn", "role", "head")
    parts = settled(ranged.drop("head").withColumn("part", F.spark_partition_id()))
    # a row for each range that has some of a conversation
    sizes = parts.groupBy(F.col("conv_id").alias("of_conv"), F.col("part").alias("of_part")).agg(F.sum("n").alias("n_part"))
    w = Window.partitionBy("of_conv").orderBy("of_part")
    before = F.coalesce(F.sum("n_part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sizes = sizes.select("of_conv", "of_part", before.alias("before"), total.alias("total"))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("begin", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    met = placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part")))
    return met.select("conv_id", *order, "n", (F.col("begin") + F.col("before")).alias("begin"), "total")


def _stretches(rows: DataFrame, piece: int | None) -> DataFrame:
    """(conv_id, piece, messages, first, total) with the messages of a stretch in order; without `piece` whole conversations."""
    if piece is None:
        return _by_number(rows, F.lit(0).cast("long"))
    number = F.coalesce(F.floor(F.col("turn") / piece).cast("long"), F.lit(-(2**62)))
    sizes = rows.groupBy("conv_id", number.alias("piece")).agg(F.count("*").alias("n"))
    crowded = sizes.filter(F.col("n") > CROWD * piece).limit(1).count() > 0
    return _by_place(rows, piece) if crowded else _by_number(rows, number)


def _by_number(rows: DataFrame, number: Column) -> DataFrame:
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.select("conv_id", number.alias("piece"), turn.alias("m")).groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    # one row for each stretch, not for each turn
    w = Window.partitionBy("conv_id").orderBy("piece")
    n = F.size("messages").cast("long")
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cut.select("conv_id", "piece", "messages", before.alias("first"), total.alias("total"))


def _by_place(rows: DataFrame, piece: int) -> DataFrame:
    size = F.lit(piece).cast("long")
    last = F.col("begin") + F.col("n") - 1
    div = lambda x: F.floor(x / size).cast("long")
    cut = _numbered(rows).withColumn("piece", F.explode(F.sequence(div(F.col("begin")), div(last))))
    copies = (F.least(last + 1, (F.col("piece") + 1) * size) - F.greatest("begin", F.col("piece") * size)).cast("int")
    lists = cut.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct(F.struct("turn", "role", "text").alias("m"), copies.alias("k")))).alias("messages"), F.max("total").alias("total"))
    messages = F.flatten(F.transform("messages", lambda x: F.array_repeat(x["m"], x["k"])))
    return lists.select("conv_id", "piece", messages.alias("messages"), (F.col("piece") * size).alias("first"), "total")


def formatted(rows: DataFrame, template: str = TEMPLATE, piece: int = PIECE, values: dict[str, Any] | None = None) -> DataFrame:
    """(conv_id, piece, text, spans): the text of each stretch and its loss spans (start, end).

    rows(conv_id, turn, role, text). Spans are in code points of the stretch's own text. A
    template that looks at the whole conversation gets it in one piece.
    """
    given = {"add_generation_prompt": False, **(values or {})}
    whole = not Template(template, escape).in_pieces
    cut = _stretches(rows, None if whole else piece)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, escape)
        for batch in batches:
            conv, number, messages, first, total = (batch.column(i).to_pylist() for i in range(5))
            made = [compiled.render(m, **given) if whole else compiled.render_piece(m, a, b, **given) for m, a, b in zip(messages, first, total, strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(number, pa.int64()), pa.array([t for t, _ in made], pa.string()), spans], ["conv_id", "piece", "text", "spans"])

    return cut.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(render, "conv_id long, piece long, text string, spans array<struct<start: bigint, end: bigint>>")


def joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, text, spans) of whole conversations, spans shifted to the whole text."""
    ordered = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "text", "spans"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(x["text"])).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    return ordered.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.aggregate("p", start, add)["spans"].alias("spans"))


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted texts hold, per stretch: turns, their text form, the unescaped text under the mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            turns = [parse(t) for t in texts]
            loss = ["".join(unescape(t[s["start"] : s["end"]]) for s in ss) for t, ss in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(["".join(f"{role}\n{text}\n" for role, text in ts) for ts in turns], pa.string()),
                    pa.array(loss, pa.string()),
                    pa.array([len(ts) for ts in turns], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["conv_id", "piece", "turns", "loss", "n_turns", "formatted_chars"],
            )

    return pieces.mapInArrow(read, "conv_id long, piece long, turns string, loss string, n_turns long, formatted_chars long")


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest runs over one conversation's text in order, so its stretches pass through one
    task, sorted, one after the other; nothing of them is kept but the state of the two hashes.
    """
    ordered = read_back(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Running | None = None
        for batch in batches:
            done = []
            for conv, turns, loss, n, chars in zip(*(batch.column(k) for k in (0, 2, 3, 4, 5)), strict=True):
                if now is None or now.conv_id != conv.as_py():
                    done += [now.result()] if now else []
                    now = _Running(conv.as_py())
                now.add(turns.as_py(), loss.as_py(), n.as_py(), chars.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kinds[k]) for k in range(6)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(now.result(), kinds, strict=True)], names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class _Running:
    """The hashes and counts of one conversation so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, turns: str, loss: str, n_turns: int, formatted_chars: int) -> None:
        self.turns.update(turns.encode("utf-8", "surrogatepass"))
        self.loss.update(loss.encode("utf-8", "surrogatepass"))
        self.n_turns += n_turns
        self.loss_chars += len(loss)
        self.formatted_chars += formatted_chars

    def result(self) -> tuple[int | None, int, str, int, str, int]:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars
