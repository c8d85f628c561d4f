"""Column expressions for mail and query text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed


def address(value: Column) -> Column:
    """Trimmed, unquoted, lower-cased; empty where it is no address."""
    plain = F.lower(F.regexp_replace(F.trim(value), "^[<>\"']+|[<>\"']+$", ""))
    return F.when(plain.rlike(fixed.ADDRESS), plain).otherwise("")


def body(value: Column) -> Column:
    """A mail's own text: quoted history cut, quoted lines dropped, forwards kept."""
    unix = F.regexp_replace(F.regexp_replace(value, "\r\n", "\n"), "\r", "\n")
    # the flags differ between markers, so each cuts in turn: what is left is before the first
    for marker in fixed.REPLY_MARKERS:
        unix = F.split(unix, marker, 2)[0]
    own = F.array_join(F.filter(F.split(unix, "\n"), lambda line: ~line.rlike(r"(?U)^\s*>")), "\n")
    kept = F.regexp_replace(own, fixed.FORWARD_BANNER, F.lit(fixed.FORWARDED))
    return strip(F.regexp_replace(F.regexp_replace(kept, "[ \t]+", " "), "\n{3,}", "\n\n"))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def content_key(sender: Column, date: Column, subject: Column, text: Column) -> Column:
    return F.sha1(F.concat(*[part for c in (sender, date, subject, text) for part in (c, F.lit("\x00"))]))


def thread_key(subject: Column) -> Column:
    """Each prefix is taken off in one pass over the prefixes, so `fw: re: x` keeps its `re:`."""
    key = F.trim(F.lower(subject))
    for prefix in ("re:", "fw:", "fwd:", "re :", "fw :"):
        key = F.regexp_replace(key, rf"^({prefix}\s*)+", "")
    return key


def bare_subject(subject: Column) -> Column:
    """All reply and forward prefixes off."""
    return F.regexp_replace(F.lower(subject), r"^((re|fw|fwd)\s*:\s*)+", "")


def acl_tokens(*people: Column) -> Column:
    """Distinct user tokens of arrays of people."""
    return F.array_distinct(F.transform(F.filter(F.flatten(F.array(*people)), lambda p: p != ""), lambda p: F.concat(F.lit("user:"), p)))


def person_label(name: Column) -> Column:
    parts = F.filter(F.split(F.split(name, "@")[0], r"[._\-]+"), lambda p: (p != "") & ~p.rlike("^[0-9]+$"))
    label = F.array_join(F.transform(parts, F.initcap), " ")
    return F.when(label == "", name).otherwise(label)


def header(sender: Column, to: Column, date: Column, subject: Column) -> Column:
    more = F.when(F.size(to) > 4, " ...").otherwise("")
    day = F.when(date == "", "unknown date").otherwise(F.substring(date, 1, 10))
    return F.concat(F.lit("From: "), sender, F.lit(" | To: "), F.array_join(F.slice(to, 1, 4), ", "), more, F.lit(" | Date: "), day, F.lit(" | Subject: "), F.when(subject == "", "(no subject)").otherwise(subject))


def mail_prompt(sender: Column, date: Column, subject: Column, text: Column, most: int = 3_000) -> Column:
    """A mail as prompts show it."""
    return F.concat(F.lit("From: "), sender, F.lit("\nDate: "), F.substring(date, 1, 10), F.lit("\nSubject: "), subject, F.lit("\n\n"), F.substring(text, 1, most))


def snippet(text: Column, size: int = 280) -> Column:
    return F.substring(F.regexp_replace(text, r"^[^\n]*\n", ""), 1, size)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """`value` worked out once and bound to a lambda variable, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def _heads(rows: Column, key) -> Column:
    """The places, from 0, at which a sorted array has another key than before."""
    places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (key(rows[i]) != key(F.get(rows, i - 1))))


def tallies(words: Column) -> Column:
    """Array of (term, tf): each distinct word with its number, counted inside the row."""

    def counted(s: Column) -> Column:
        return let(_heads(s, lambda w: w), lambda h: F.transform(h, lambda i, k: F.struct(s[i].alias("term"), (F.coalesce(F.get(h, k + 1), F.size(s)) - i).alias("tf"))))

    return let(F.array_sort(words), counted)


def places(words: Column) -> Column:
    """Array of (term, at): each distinct word with its places from 0, ascending."""

    def cut(s: Column) -> Column:
        end = lambda h, k: F.coalesce(F.get(h, k + 1), F.size(s))
        at = lambda h, i, k: F.transform(F.slice(s, i + 1, end(h, k) - i), lambda x: x["at"])
        return let(_heads(s, lambda x: x["term"]), lambda h: F.transform(h, lambda i, k: F.struct(s[i]["term"].alias("term"), at(h, i, k).alias("at"))))

    return let(F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))), cut)


def query_terms(question: Column) -> Column:
    """Ordered distinct words of more than one letter that are no stop words."""
    stop = F.array(*map(F.lit, fixed.QUERY_STOP_WORDS))
    return F.array_distinct(F.filter(terms(question), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def shingles(words: Column, size: int) -> Column:
    """Runs of `size` words, space-joined; none for shorter texts.

    The words are bound to a lambda variable first: used inside the inner lambda as they
    are, they would be worked out again for every run.
    """

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, each).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), runs)[0]


def citations(answer: Column, n_context: Column) -> Column:
    """Numbers in brackets that name a context item, each at its first place."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: n.between(1, n_context)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def glob(pattern: str) -> str:
    """An anchored regular expression for a shell pattern, whose star also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    return f"(?s)^{out}$"
