"""Quality rules: a table of thresholds compiled into one Spark projection.

Each row of the table bounds one ratio of a text. `compile_rules` turns the table
into a single boolean column, so a filter by it needs one pass, no shuffle and no
user function.

Defined results: a null or empty text has no words, so it fails the base rule; its
counts are zero. Repeated rows and ids are judged row by row. A null id is carried
through. Further columns of the input are ignored by `measure` and kept by `keep_good`;
the helper column of `keep_good` gets a name that the input does not have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for on was as with be by are this at from a "
    "de la le les et des un une du que en pour dans est sur qui pas au avec ce "
    "der die das und den von mit zu ist nicht ein auf dem sich im als auch es an "
    "el los las y por con no una su para al lo se del como"
).split()
#: As they stand inside and at the start of a sentence; cheaper than lower-casing every word.
STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


@dataclass(frozen=True)
class Rule:
    """Keep a text while `low <= metric <= high`; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None
    #: Ratios of very short texts say little: the rule holds from so many words on.
    from_words: int = 0


#: Wide bounds: prose passes with room to spare, and only plain junk falls outside.
DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.02, None, from_words=30),
    Rule("duplicate_line_ratio", None, 0.5),
)


def _repeated_words(words: Column) -> Column:
    """How many words lie in a five-word window that the text has twice or more.

    Windows are compared by a 64-bit hash. Only a text with a repeated hash pays for
    the sort, which puts equal windows side by side; the covered words then follow
    from the gaps between the starts of repeated windows.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), s - starts[i - 1])))
        return F.aggregate(gaps, F.lit(0).cast("int"), lambda acc, g: acc + g)

    def of_sorted(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == p["h"])) | ((i < last) & (pairs[F.least(i + 1, last)]["h"] == p["h"])),
        )
        return let(F.sort_array(F.transform(twice, lambda p: p["i"])), covered)

    def of_windows(hashes: Column) -> Column:
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(unique, F.lit(0)).otherwise(let(F.sort_array(pairs), of_sorted))

    def of_hashes(each: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(each) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*[each[i + k] for k in range(WINDOW)])), of_windows)

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    return F.when(F.size(words) > WINDOW, hashed).otherwise(F.lit(0)).cast("long")


def metrics(text: Column) -> Column:
    """One struct with the counts of a text, from which the ratios follow."""

    def of(v: Column) -> Column:
        t, words = v["t"], v["w"]
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeated_words(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
            ),
        )

    whole = F.coalesce(text, F.lit(""))
    return let(F.struct(whole.alias("t"), words_of(text).alias("w")), of)


def ratios(m: Column) -> dict[str, Column]:
    """The metrics a rule can name. Texts without words or lines have ratio zero."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": share(m["word_chars"], m["n_words"]),
        "symbols_per_word": share(m["n_symbols"], m["n_words"]),
        "stop_word_ratio": share(m["n_stop_words"], m["n_words"]),
        "duplicate_line_ratio": share(m["n_dup_lines"], m["n_lines"]),
        "repeated_word_ratio": share(m["n_repeat_words"], m["n_words"]),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def compile_rules(m: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """The whole table as one boolean column over the struct of `metrics`."""
    known, verdict = ratios(m), F.lit(True)
    for rule in rules:
        if rule.metric not in known:
            raise ValueError(f"unknown metric {rule.metric!r}; one of {sorted(known)}")
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (known[rule.metric] >= F.lit(float(rule.low)))
        if rule.high is not None:
            holds = holds & (known[rule.metric] <= F.lit(float(rule.high)))
        verdict = verdict & ((m["n_words"] < rule.from_words) | holds)
    return verdict


def _judged(m: Column, rules: tuple[Rule, ...]) -> Column:
    fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    return F.struct(*[m[f].alias(f) for f in fields], base_failed(m).alias("base_failed"), (~base_failed(m) & compile_rules(m, rules)).alias("kept"))


def judge(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Counts, base verdict and verdict of a text, each computed once."""
    return let(metrics(text), lambda m: _judged(m, rules))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, every count, base_failed and kept."""
    return docs.select(F.col(id_col), F.inline(F.array(judge(F.col(text_col), rules))))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    return docs.filter(judge(F.col(text_col), rules)["kept"])
