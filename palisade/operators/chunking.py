"""Packing of mail bodies into overlapping chunks under a header line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T

MAX_WORDS, OVERLAP = 180, 25


def split_long(paragraph: str, max_words: int) -> list[list[str]]:
    """Pieces, as words, of a paragraph that is too long: whole sentences where they fit."""
    words = paragraph.split()
    if len(words) <= max_words:
        return [words]
    pieces: list[list[str]] = []
    held: list[str] = []
    for sentence in (s.split() for s in re.split(r"(?<=[.!?])\s+", paragraph)):
        if len(sentence) > max_words:
            pieces += [held] if held else []
            pieces += [sentence[i : i + max_words] for i in range(0, len(sentence), max_words)]
            held = []
        elif len(held) + len(sentence) > max_words:
            pieces.append(held)
            held = sentence
        else:
            held = held + sentence
    return pieces + [held] if held else pieces


def pack(body: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed up to `max_words`; a chunk begins with the last words of the one before."""
    pieces = [piece for p in re.split(r"\n\s*\n", body) if p.strip() for piece in split_long(p, max_words)]
    chunks: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if held and len(held) + len(piece) > max_words:
            chunks.append(" ".join(held))
            held = held[-overlap:] if overlap else []
        held = held + piece
    return chunks + [" ".join(held)] if held else chunks


def chunk(emails: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(email_id, ord, text) of emails(id, sender, recipients, date, subject, body); an empty body leaves the header."""

    @F.pandas_udf("array<string>")
    def packed(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in bodies:
            yield batch.map(lambda b: pack(b or "", max_words, overlap))

    head = T.header(F.col("sender"), F.col("recipients.to"), F.col("date"), F.col("subject"))
    rows = emails.select(F.col("id").alias("email_id"), head.alias("head"), packed("body").alias("parts"))
    texts = F.when(F.size("parts") > 0, F.transform("parts", lambda p: F.concat_ws("\n", "head", p))).otherwise(F.array("head"))
    return rows.select("email_id", F.posexplode(texts).alias("ord", "text"))
