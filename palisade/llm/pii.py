"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give base spans of four kinds, which always stay. Looser patterns (numbers
without a plus, spelled-out or defanged addresses) give candidates, on which five labelers
vote yes, no or nothing: strict shape, checksum, gazetteer, context words, and neighbourhood.
Votes of all candidates of all texts are counted by pattern, of which there are at most
3**5 * 2**6 whatever the input. Expectation-maximisation over that histogram estimates how
reliable each labeler is and how likely each pattern is to be personal data; on these soft
labels a Bernoulli naive Bayes span classifier is trained, whose features do not include the
votes' own reliabilities. Both run inside one SQL expression. A candidate is added if the
classifier is sure of it, no base span overlaps it and no sure candidate that starts earlier.

One pass reads the texts; what it leaves are spans and votes, which are small.

Offsets are code points, ends exclusive. A null text is empty. Rows are handled one by one,
whatever their ids; other columns are ignored. Time is in proportion to a text's length and
its number of matches: offsets and overlaps come from running sums and maxima over blocks of
matches (`running`), and a match's surroundings from the gaps beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from palisade.llm.common import let, settled

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"A-Za-z0-9._%+-"
#: The strict patterns. Possessive quantifiers and starts at the edge of a run give the
#: same matches as plain ones, in linear time.
STRICT = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}|3[47][0-9]{2}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A text without these holds no match of the kind.
TRIGGERS = {"email": r"@|[(\[](?:at|AT)[)\]]", "ip": r"[0-9]\]?\.\[?[0-9]|[0-9]\[\.", "card": r"[0-9]{4}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]|[0-9]{3}[\x20.)-]"}

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\[?\.\]?{_PART}){{3}}$"

TOP_DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be ca au jp cn in br ru se no pl pt mx example".split()
CARD_FIRST = ("3", "4", "5", "6")
CONTEXT = {
    "email": r"mail|contact|write|reach|@|envoy|correo|schreib|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|dirección|client|login",
    "card": r"card|visa|master|amex|credit|debit|carte|karte|tarjeta|pay|iban|account",
    "phone": r"phone|tel|call|mobile|cell|fax|sms|appel|anruf|llam|handy|whatsapp",
}
AGAINST = r"version|isbn|issn|serial|order|invoice|hash|token|sha|uuid|chapter|section|build|\bv\.?$"

LABELERS = 5
ABSTAIN, YES, NO = 0, 1, 2
FEATURES = 6
ROUNDS = 25
SURE = 0.9
_SMOOTH = 0.5


BLOCK = 64
#: So many characters before a candidate are looked at; so many matches before it fill them.
AROUND, NEIGHBOURS = 40, 8


def running(values: Column, op: Callable[[Column, Column], Column], first: Column) -> Column:
    """For each value what `op` makes of all up to it. Arrays are extended inside blocks only."""
    last = lambda xs: F.element_at(xs, -1)

    def inside(block: Column) -> Column:
        begin = F.slice(block, 1, 1)
        return F.aggregate(F.slice(block, 2, BLOCK), begin, lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(first), lambda acc, b: F.concat(acc, F.array(op(last(acc), last(b)))))
        return let(before, lambda c: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: op(c[i], x)))))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: inside(F.slice(v, i * BLOCK + 1, BLOCK)))
        return F.when(F.size(v) > 0, let(blocks, joined)).otherwise(F.slice(v, 1, 0))

    # bound, or all values are worked out again for every block
    return let(values, of)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str, around: bool = False) -> Column:
    """(start, end, m) of the leftmost non-overlapping matches; with `around` also what is before and the character behind.

    Spark has no function for offsets; what lies between matches gives them.
    """

    def of(v: Column) -> Column:
        found, gaps = v["found"], v["gaps"]
        ends = running(F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m)), _plus, F.lit(0))

        def placed(e: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                fields = [(e[i] - F.length(m)).alias("start"), e[i].alias("end"), m.alias("m")]
                if around:
                    fields += [_before(v, i).alias("before"), F.substring(gaps[i + 1], 1, 1).alias("after")]
                return F.struct(*fields)

            return F.transform(found, one)

        return let(ends, placed)

    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if not around:
        return let(F.struct(found.alias("found"), gaps.alias("gaps")), of)
    with_tails = lambda v: F.struct(v["found"].alias("found"), v["gaps"].alias("gaps"), F.transform(v["gaps"], lambda g: F.right(g, F.lit(AROUND))).alias("tails"))
    return let(let(F.struct(found.alias("found"), gaps.alias("gaps")), with_tails), of)


def _before(v: Column, i: Column) -> Column:
    """The AROUND characters before match `i`: the end of the gap, and of matches and gaps before it."""
    nearest = F.sequence(F.greatest(i - NEIGHBOURS, F.lit(0)), i - 1)
    earlier = F.when(i > 0, F.array_join(F.transform(nearest, lambda j: F.concat(v["tails"][j], v["found"][j])), "")).otherwise("")
    return F.right(F.concat(earlier, v["tails"][i]), F.lit(AROUND))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        each = F.transform(d, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
        return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)

    return let(F.split(F.reverse(digits(m)), ""), lambda d: total(F.array_remove(d, ""))) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    """What a strict match must pass besides its pattern."""
    n = F.length(digits(m))
    return {"email": F.lit(True), "ip": m.rlike(IP_PARTS), "card": n.between(16, 19) & luhn(m), "phone": n.between(8, 15)}[kind]


def _of_kind(text: Column, kind: str, pattern: str, around: bool = False) -> Column:
    more = ", before: string, after: string" if around else ""
    none = F.expr(f"cast(array() as array<struct<start: int, end: int, m: string{more}>>)")
    return F.when(text.rlike(TRIGGERS[kind]), located(text, pattern, around)).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> in the order of KINDS, then start."""
    parts = []
    for rank, kind in enumerate(KINDS):
        kept = F.filter(_of_kind(text, kind, STRICT[kind]), lambda s: holds(kind, s["m"]))
        parts.append(_plain(kept, rank))
    return F.concat(*parts)


def _plain(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(YES)).when(no, F.lit(NO)).otherwise(F.lit(ABSTAIN))


def _judged(kind: str, rank: int, s: Column) -> Column:
    """A candidate with its votes and features."""
    m, before = s["m"], F.lower(s["before"])
    left, right = F.right(s["before"], F.lit(1)), s["after"]
    strict = m.rlike("^(?:" + STRICT[kind].replace(r"(?:\G|", "(?:^|") + ")$")
    n = F.length(digits(m))
    # email: the domain names end in a known top-level name
    last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    check = {"email": last.rlike("^[a-z]{2,}$"), "ip": m.rlike(IP_PARTS), "card": luhn(m), "phone": n.between(8, 15)}[kind]
    known = {"email": last.isin(*TOP_DOMAINS), "ip": ~m.rlike(r"^(?:0|255)\b"), "card": F.substring(m, 1, 1).isin(*CARD_FIRST), "phone": m.rlike(r"\(|[2-9][0-9]{2}[\x20.-][0-9]{4}$")}[kind]
    meant, against = before.rlike(CONTEXT[kind]), before.rlike(AGAINST)
    glued = left.rlike(r"[\p{L}0-9_=/\\]") | right.rlike(r"[\p{L}0-9_=/\\]")
    varied = F.size(F.array_distinct(F.split(m, ""))) >= 5
    votes = [_vote(strict, F.lit(False)), _vote(check, ~check), _vote(known, ~known), _vote(meant & ~against, against), _vote(~glued, glued)]
    bits = [strict, check, meant, ~against, ~glued, varied]
    return F.struct(
        F.lit(rank).alias("kind"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.array(*votes).alias("v"),
        F.array(*[b.cast("int") for b in bits]).alias("x"),
    )


def candidates(text: Column) -> Column:
    return F.concat(*[_judge_all(kind, rank, text) for rank, kind in enumerate(KINDS)])


def _judge_all(kind: str, rank: int, text: Column) -> Column:
    return F.transform(_of_kind(text, kind, LOOSE[kind], around=True), lambda s: _judged(kind, rank, s))


# expectation-maximisation and classifier over the histogram of patterns


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + value(r))


def _posterior(state: Column, v: Column) -> Column:
    def log_likelihood(theta: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.lit(0.0), lambda acc, j: acc + F.ln(theta[j][v[j]]))

    odds = F.ln(state["prior"]) - F.ln(1 - state["prior"]) + log_likelihood(state["yes"]) - log_likelihood(state["no"])
    return 1 / (1 + F.exp(-odds))


def _weighted(hist: Column, state: Column) -> Column:
    """Histogram rows with the expected counts of both classes."""
    return F.transform(hist, lambda p: let(_posterior(state, p["v"]), lambda q: F.struct(p["v"].alias("v"), p["x"].alias("x"), (p["n"] * q).alias("a"), (p["n"] * (1 - q)).alias("b"))))


def _round(hist: Column, state: Column) -> Column:
    def reliabilities(rows: Column, weight: str) -> Column:
        def of(whole: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(LABELERS - 1)),
                lambda j: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (_total(F.filter(rows, lambda r: r["v"][j] == k), lambda r: r[weight]) + _SMOOTH) / (whole + 3 * _SMOOTH)),
            )

        return let(_total(rows, lambda r: r[weight]), of)

    def maximised(rows: Column) -> Column:
        a, b = _total(rows, lambda r: r["a"]), _total(rows, lambda r: r["b"])
        prior = (a + _SMOOTH) / (a + b + 2 * _SMOOTH)
        return F.struct(prior.alias("prior"), reliabilities(rows, "a").alias("yes"), reliabilities(rows, "b").alias("no"))

    return let(_weighted(hist, state), maximised)


def fitted(hist: Column, rounds: int = ROUNDS) -> Column:
    """The EM state: prior and, for each labeler, the chances of its votes in both classes."""
    yes = F.array(*[F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1)) for _ in range(LABELERS)])
    no = F.array(*[F.array(F.lit(0.2), F.lit(0.2), F.lit(0.6)) for _ in range(LABELERS)])
    start = F.struct(F.lit(0.5).alias("prior"), yes.alias("yes"), no.alias("no"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: _round(hist, state))


def classifier(hist: Column, state: Column) -> Column:
    """Naive Bayes on the soft labels: prior and the chances of each feature in both classes."""

    def trained(rows: Column) -> Column:
        def chances(weight: str) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda j: (_total(rows, lambda r: r[weight] * r["x"][j]) + _SMOOTH) / (_total(rows, lambda r: r[weight]) + 2 * _SMOOTH))

        a, b = _total(rows, lambda r: r["a"]), _total(rows, lambda r: r["b"])
        return F.struct(((a + _SMOOTH) / (a + b + 2 * _SMOOTH)).alias("prior"), chances("a").alias("yes"), chances("b").alias("no"))

    return let(_weighted(hist, state), trained)


def train(found: DataFrame, rounds: int = ROUNDS) -> Row:
    """The model from all candidates of found(cands): one row of a few numbers."""
    patterns = found.select(F.explode("cands").alias("c")).groupBy("c.v", "c.x").agg(F.count("*").alias("n"))
    # at most 3**LABELERS * 2**FEATURES rows
    hist = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "x", "n"))).alias("hist"))
    model = let(F.col("hist"), lambda h: let(fitted(h, rounds), lambda s: F.struct(s.alias("labelers"), classifier(h, s).alias("spans"))))
    return hist.select(model.alias("m")).first()["m"]


def _log_odds(model: Row, x: Column) -> Column:
    spans = model["spans"]
    total = F.lit(log(spans["prior"]) - log(1 - spans["prior"]))
    for j, (p, q) in enumerate(zip(spans["yes"], spans["no"], strict=True)):
        total = total + F.when(x[j] == 1, log(p / q)).otherwise(log((1 - p) / (1 - q)))
    return total


def apart(base: Column, spans: Column) -> Column:
    """Those of `spans` that overlap no base span and no other of them that starts earlier (or as early, and is of an earlier kind)."""
    far = 2**31 - 1
    event = lambda s, which: F.struct(s["start"].alias("start"), F.lit(which).alias("which"), s["kind"].alias("kind"), s["end"].alias("end"))
    events = F.sort_array(F.concat(F.transform(base, lambda s: event(s, 0)), F.transform(spans, lambda s: event(s, 1))))

    def of(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: x["end"]), F.greatest, F.lit(-1))  # of all that start before or here
        coming = F.reverse(running(F.reverse(F.transform(e, lambda x: F.when(x["which"] == 0, x["start"]).otherwise(far))), F.least, F.lit(far)))

        def free(bounds: Column) -> Column:
            alone = lambda x, i: (x["which"] == 1) & ((i == 0) | (bounds["reach"][F.greatest(i - 1, F.lit(0))] <= x["start"])) & (bounds["coming"][i] >= x["end"])
            return F.transform(F.filter(e, alone), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

        return let(F.struct(reach.alias("reach"), coming.alias("coming")), free)

    return let(events, of)


def find(docs: DataFrame, sure: float = SURE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) with kind a place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = settled(docs.select(F.col(id_col).alias("doc_id"), let(text, lambda t: F.struct(base_spans(t).alias("base"), candidates(t).alias("cands"))).alias("f")).select("doc_id", "f.base", "f.cands"))
    model = train(found, rounds)

    sure_of = lambda c: _log_odds(model, c["x"]) >= log(sure / (1 - sure))
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    def added(base: Column, cands: Column) -> Column:
        return F.when(F.exists(cands, sure_of), apart(base, F.transform(F.filter(cands, sure_of), span))).otherwise(F.slice(base, 1, 0))

    everything = F.sort_array(F.concat("base", added(F.col("base"), F.col("cands"))))
    return found.select("doc_id", "base", everything.alias("spans"))


def notation(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
