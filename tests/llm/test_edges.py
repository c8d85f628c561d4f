"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import chat_format, decontaminate, html_blocks, lm_score, mixing, pii, quality_rules, simhash, suffix_dedup, token_table
from palisade.llm.bytehash import HashIndex, shingles, word_hashes
from palisade.llm.chat_template import Template, TemplateError
from palisade.llm.components import components

LONG = "lorem ipsum dolor sit amet " * 4_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old house", "a", 1, "x"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old house", "a", 1, "x"),
    (2, None, None, 2, "y"),
    (3, "", "b", 3, None),
    (None, "mail me at a@b.co or call +1 (743) 555-3824 today please", "b", None, "z"),
    (5, LONG, "a", 5, "w"),
    (6, " \t\n ", "c", 6, "v"),
]
#: Columns that operators also make.
EXTRA = "doc_id long, text string, source string, {}, kept string"


@pytest.fixture(scope="module", params=["n_words int", "fp int", "node int", "rate int", "ids int", "base int"])
def odd(request, spark):
    return spark.createDataFrame(ROWS, EXTRA.format(request.param)).repartition(3)


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, EXTRA.format("n int"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


OPERATORS = {
    "pii": pii.find,
    "lm": lm_score.score,
    "suffix": suffix_dedup.removed,
    "simhash": simhash.groups,
    "near": simhash.near_groups,
    "quality": quality_rules.measure,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(plain, empty, name):
    assert OPERATORS[name](plain).count() == len(ROWS)
    assert OPERATORS[name](empty).count() == 0


def test_clashing_columns_are_ignored_or_kept(odd):
    assert quality_rules.measure(odd).count() == simhash.groups(odd).count() == len(ROWS)
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert simhash.deduplicated(odd).columns == odd.columns
    assert mixing.mixed(odd).columns == odd.columns


#: Names that operators give to columns of their own.
CLASHES = "doc sub pos g s key node first same grams h c row slice ids part n from text_hash rare model base cands f of cuts runs held_out n_tokens copy rate fp component_id keys start lang item_id conv_id turn role html url page_id piece".split()


def _rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=str)


DIGESTS = {
    "pii": lambda df: pii.find(df),
    "lm": lambda df: lm_score.score(df).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens"),
    "suffix": lambda df: suffix_dedup.digests(suffix_dedup.removed(df)),
    "tokens": lambda df: token_table.round_trip(df).select("doc_id", "n_tokens"),
    "simhash": lambda df: simhash.groups(df),
    "near": lambda df: simhash.near_groups(df),
    "mixing": lambda df: mixing.mixed(df).select("doc_id", "text"),
    "quality": lambda df: quality_rules.measure(df),
}


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_extra_columns_and_ids_with_several_texts(spark, name):
    """The same rows with columns that clash with the operators' own; one id with two texts, and rows without ids."""
    rows = [(i % 5 if i % 7 else None, f"the text number {i} mails a{i}@b.com and " + "the same words again " * (i % 4), f"s{i % 2}") for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = plain
    for k, extra in enumerate(c for c in CLASHES if c not in plain.columns):
        odd = odd.withColumn(extra, F.lit(k))
    want, got = _rows(DIGESTS[name](plain)), _rows(DIGESTS[name](odd.repartition(3) if name != "lm" else odd))
    assert got == want and (name == "mixing" or len(got) == 40)


def test_other_tables_with_extra_columns(spark, plain):
    """Pages, items and conversations beside clashing columns, and empty."""
    extra = lambda df: df.withColumns({c: F.lit(1) for c in CLASHES if c not in df.columns})
    pages = spark.createDataFrame([(1, "u", f"<article><p>{GOOD}</p></article>"), (1, None, None), (None, "v", "")], "page_id long, url string, html string")
    assert _rows(html_blocks.extract(extra(pages))) == _rows(html_blocks.extract(pages)) and html_blocks.extract(pages).count() == 3
    items = spark.createDataFrame([(1, "quick brown fox jumps over the"), (None, "dolor sit")], "item_id long, text string")
    assert _rows(decontaminate.search(extra(plain.select("doc_id", "text")), extra(items))) == _rows(decontaminate.search(plain, items))
    talks = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert _rows(chat_format.digests(chat_format.formatted(extra(talks)))) == _rows(chat_format.digests(chat_format.formatted(talks)))
    assert html_blocks.extract(pages.limit(0)).count() == 0 and token_table.round_trip(plain.limit(0)).count() == 0


def test_quality_of_empty_texts(plain):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules.measure(plain).collect()}
    assert rows[(2, 0)]["base_failed"] and not rows[(3, 0)]["kept"] and rows[(6, 0)]["word_chars"] == 0
    assert rows[(5, 20_000)]["n_repeat_words"] == 20_000
    with pytest.raises(ValueError, match="unknown metric"):
        quality_rules.compile_rules(F.col("x"), (quality_rules.Rule("nope", 0),))


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=6))
def test_repeated_words_by_brute_force(spark, texts):
    def repeats(text):
        w = text.split()
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)})

    rows = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows} == {i: repeats(t) for i, t in enumerate(texts)}


def test_pii_spans(plain):
    found = {r["doc_id"]: r for r in pii.find(plain).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[None]["base"]] == [(0, 11, 17), (3, 26, 43)]


def test_running_sums_and_matches_by_brute_force(spark):
    import re

    rng = np.random.default_rng(13)
    arrays = [[], [5], rng.integers(-50, 50, 64).tolist(), rng.integers(-50, 50, 65).tolist(), rng.integers(-50, 50, 1000).tolist()]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = rows.select("a", pii.running(F.col("a"), pii._plus, F.lit(0)).alias("s"), pii.running(F.col("a"), F.greatest, F.lit(-100)).alias("m")).collect()
    for r in got:
        assert r["s"] == np.cumsum(r["a"]).tolist() and r["m"] == np.maximum.accumulate(r["a"]).tolist() if r["a"] else r["s"] == r["m"] == []
    texts = ["", "12", "é12 a3b" * 70, "".join(rng.choice(list("ab1 é2"), 4_000)), "x" * 50 + "9"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", pii.located(F.col("t"), "[0-9]+", True).alias("f")).collect():
        want = [(m.start(), m.end(), m.group(), r["t"][m.end() : m.end() + 1]) for m in re.finditer("[0-9]+", r["t"])]
        assert [(x["start"], x["end"], x["m"], x["after"]) for x in r["f"]] == want
        short = [(x["start"], x["before"]) for x in r["f"]]  # eight matches and gaps before may be fewer characters
        assert all(r["t"][max(0, a - 40) : a].endswith(b) and (len(b) >= min(a, 16)) for a, b in short)


def test_spans_are_kept_apart(spark):
    rng = np.random.default_rng(14)
    cases = []
    for _ in range(30):
        make = lambda n: [(int(rng.integers(4)), int(a), int(a + rng.integers(1, 12))) for a in rng.integers(0, 400, n)]
        base = sorted(make(10), key=lambda s: s[1])
        cases.append((base, make(int(rng.integers(0, 90)))))
    rows = spark.createDataFrame(cases, "b array<struct<kind: int, start: int, end: int>>, c array<struct<kind: int, start: int, end: int>>")
    got = rows.select("b", "c", pii.apart(F.col("b"), F.col("c")).alias("k")).collect()
    for r in got:
        order = sorted((c["start"], c["kind"], c["end"]) for c in r["c"])
        want = []
        for i, (start, kind, end) in enumerate(order):
            if all(b["end"] <= start or b["start"] >= end for b in r["b"]) and all(e <= start for _, _, e in order[:i]):
                want.append((kind, start, end))
        assert sorted(tuple(k) for k in r["k"]) == sorted(want)
    assert any(r["k"] for r in got)


def test_expectation_maximisation_by_brute_force(spark):
    """The SQL expression against plain numpy, and against what the labelers were made to be."""
    rng = np.random.default_rng(15)
    n, good = 20_000, np.array([0.95, 0.9, 0.6, 0.75, 0.55])
    true = rng.random(n) < 0.3
    right, silent = rng.random((n, 5)) < good, rng.random((n, 5)) < 0.2
    votes = np.where(silent, 0, np.where(true[:, None] == right, 1, 2))
    marks = np.where(rng.random((n, 6)) < 0.85, true[:, None], ~true[:, None]).astype(int)
    patterns, counts = np.unique(np.concatenate([votes, marks], axis=1), axis=0, return_counts=True)
    hist = [(p[:5].tolist(), p[5:].tolist(), int(c)) for p, c in zip(patterns, counts, strict=True)]
    df = spark.createDataFrame([(hist,)], "h array<struct<v: array<int>, x: array<int>, n: bigint>>")
    row = df.select(pii.let(F.col("h"), lambda h: pii.let(pii.fitted(h), lambda m: F.struct(m.alias("m"), pii.classifier(h, m).alias("c")))).alias("r")).first()["r"]
    v, x, c = (np.array([h[k] for h in hist]) for k in range(3))
    prior, theta = 0.5, [np.tile([0.2, 0.7, 0.1], (5, 1)), np.tile([0.2, 0.2, 0.6], (5, 1))]

    def posterior():
        odds = np.log(prior / (1 - prior)) + sum(np.log(theta[0][j][v[:, j]]) - np.log(theta[1][j][v[:, j]]) for j in range(5))
        return 1 / (1 + np.exp(-odds))

    for _ in range(pii.ROUNDS):
        q = posterior()
        weights = [c * q, c * (1 - q)]
        prior = (weights[0].sum() + 0.5) / (c.sum() + 1)
        theta = [np.array([[(w[v[:, j] == k].sum() + 0.5) / (w.sum() + 1.5) for k in range(3)] for j in range(5)]) for w in weights]
    assert abs(row["m"]["prior"] - prior) < 1e-9 and np.allclose(row["m"]["yes"], theta[0]) and np.allclose(row["m"]["no"], theta[1])
    q = posterior()
    assert np.allclose(row["c"]["yes"], [((c * q)[x[:, j] == 1].sum() + 0.5) / ((c * q).sum() + 1) for j in range(6)])
    # it finds out how good each labeler is, and does better than counting votes
    found = np.array(row["m"]["yes"])
    assert abs(prior - 0.3) < 0.02 and np.allclose(found[:, 1] / (found[:, 1] + found[:, 2]), good, atol=0.04)
    weigh = lambda v: sum(np.log(theta[0][j][v[:, j]]) - np.log(theta[1][j][v[:, j]]) for j in range(5)) + np.log(prior / (1 - prior)) > 0
    majority = (votes == 1).sum(axis=1) > (votes == 2).sum(axis=1)
    assert (weigh(votes) == true).mean() > (majority == true).mean() + 0.02


def test_pii_adds_what_context_and_shape_tell(spark):
    """Spelled-out addresses and numbers without a plus are added, look-alikes are not; without EM they are not told apart."""
    rows = [(i, f"please call me on (743) 555-{1000 + i} or mail a{i}@b{i}.com today") for i in range(150)]
    rows += [(1000 + i, f"build version 1.{i}.3.400 of order 555-{i}") for i in range(150)]
    rows += [(2000, "write to ann (at) example (dot) com now"), (2001, "serial 743 555 8123x"), (2002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert all(len(got[i]["spans"]) == 2 and len(got[i]["base"]) == 1 for i in range(150))
    assert all(not got[1000 + i]["spans"] for i in range(150))
    assert [tuple(s) for s in got[2000]["spans"]] == [(0, 9, 35)] and not got[2001]["spans"] and not got[2002]["spans"]


def test_html_names_inside_articles_and_raw_elements():
    long = "The text of this part is about what the state and the people in it do for each other, and it has to be kept as a whole."
    page = lambda inside: f"<html><body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>{long}</p>{inside}<p>{long}</p></article></body></html>"
    kept = lambda inside: html_blocks.main_text(page(inside)).split("\n")[2:-1]
    for name in ("social-policy", "related-work", "ad-hoc", "sharing-economy", "newsletter-archive-study"):
        assert kept(f'<p class="{name}">{long} {name}</p>') == [f"{long} {name}"], name
    for name in ("share", "share-buttons", "related posts", "adBox", "comment-list", "newsletter_form", "promo-block top"):
        assert kept(f'<div class="{name}">{long}</div>') == [], name
    assert kept('<script src="x"/>var a=1;</script>') == [] == kept("<style/>p {}</style>")
    assert kept('<svg viewBox="0"/><p>after</p>') == ["after"] and kept('<svg><text>x</text></svg><p>after</p>') == ["after"]


def test_html_rules_decide_where_no_mark_does(monkeypatch):
    """A page of unmarked blocks: without density, length and links all of them would be alike."""
    good = "It is not the size of the house that was of use to them but that it was on the way to the sea and in the sun for most of the day, and that all of it was to be had for less than they had in the bank. To be in it was to be on a ship."
    list_of = " ".join(f'<a href="/{k}">Page number {k} of ours</a>' for k in range(12))
    terms = "Anbieter Kennzeichen Impressum Datenschutz Haftung Versand Rückgabe Zahlung Lieferung Konto Hilfe Presse Karriere Partner Filialen Gutscheine"
    page = f"<body><div>Start</div><div>{list_of}</div><div>{good}</div><div>So it was.</div><div>{good}</div><div>{terms}</div><div>Top</div></body>"
    want = "\n".join([good, "So it was.", good])
    assert html_blocks.main_text(page) == want
    for removed in ("classify", "inherit"):
        with monkeypatch.context() as m:
            m.setattr(html_blocks, removed, lambda *a: None)
            assert html_blocks.main_text(page) != want


def test_pii_of_long_texts_takes_linear_time(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"name{i}@host{i % 7}.com" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert len(pii.find(df).first()["base"]) == n
        return time.time() - began

    took(100)
    small = took(30_000)
    # each value of a running sum that depends on all others would make it four times
    assert took(60_000) < 3 * small


def test_suffix_pieces_and_repeats(spark, monkeypatch):
    text = "abcdefghij" * 40 + "é" * 90
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "a" * 99)], "doc_id long, text string")
    whole = sorted(map(tuple, suffix_dedup.digests(suffix_dedup.removed(rows)).collect()))
    assert whole[0] == whole[1] and whole[2][2] == whole[2][1] and whole[3][2] == 0
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    data = text.encode()
    cut = [(at, suffix_dedup.anchors(raw)) for at, raw in suffix_dedup._pieces(data, 100)]
    assert sum(int(c[4].sum()) for _, c in cut) == len(data) - 99


def _removed_by_brute_force(rows, length=100):
    """Sizes, removed bytes and runs of documents in the order of (id or the least number, digest)."""
    seen, out = set(), {}
    for doc, text in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest())):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        out[doc, text] = (len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])))
    return sorted(((i, *out[-(2**63) if i is None else i, t or ""]) for i, t in rows), key=str)


def test_suffix_of_repeated_and_null_ids(spark):
    """Hundreds of texts under no id, some ids with several texts, repeated rows, a shared passage."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = " ".join(word() for _ in range(30))
    rows = [(None, " ".join(word() for _ in range(rng.integers(3, 40))) + passage[: rng.integers(90, 210)] + word() * int(rng.integers(1, 30))) for _ in range(200)]
    rows += [(7, passage + "x"), (7, "x" + passage), (7, passage + "x"), (3, passage), (9, None), (9, ""), (-(2**63), passage[50:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(suffix_dedup.removed(df)).collect()]
    assert sorted(got, key=str) == _removed_by_brute_force(rows)


def test_simhash_links_by_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 1), dtype=np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, (40, 1), dtype=np.uint64)), rng.integers(0, 2**63, (300, 1), dtype=np.uint64)])
    want = {(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i, 0] ^ prints[j, 0]).bit_count() <= 2}
    q, p = simhash.within(prints, simhash.planes(prints), len(prints), 2)
    assert {(a, b) for a, b in zip(q.tolist(), p.tolist(), strict=True) if b < a} == want
    parts = simhash.Parts(len(prints))
    joined = [parts.join(a, b) for a, b in simhash.bucket_links(prints, 2)]
    assert all(joined) and all(parts.root(a) == parts.root(b) for a, b in want)
    for radius in (0, 1, 3, 47):
        a, b = rng.integers(0, 8, (130, 4)).astype(np.uint64), rng.integers(0, 8, (130, 4)).astype(np.uint64)
        assert (simhash.close_pairs(a, b, radius) == (np.bitwise_count(a ^ b).sum(axis=1) <= radius)).all()


def test_hot_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(2)
    low = rng.integers(0, 2**20, 400, dtype=np.uint64)
    prints = sorted({int(x) for x in np.concatenate([low, low ^ np.uint64(1)])})  # the upper pieces are equal
    rows = spark.createDataFrame([(p, p) for p in prints], "fp long, node long")
    links = simhash.near_links(rows, split=10).collect()
    parts = {p: p for p in prints}

    def root(i):
        while parts[i] != i:
            i = parts[i]
        return i

    for r in links:
        parts[root(r["u"])] = root(r["v"])
    assert all(root(a) == root(b) for a in prints for b in prints if (a ^ b).bit_count() <= 2)


def test_near_copies_of_long_texts(spark):
    words = [f"w{i}" for i in range(500)]
    copy = words[:100] + ["changed"] + words[101:]
    other = [f"v{i}" for i in range(500)]
    rows = spark.createDataFrame([(7, " ".join(words)), (3, " ".join(copy)), (9, " ".join(other)), (11, None), (12, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows).collect()}
    assert got == {7: 3, 3: 3, 9: 9, 11: 11, 12: 11}
    assert {r["doc_id"] for r in simhash.deduplicated(rows).collect()} == {3, 9, 11}


def test_frequent_words(spark):
    rng = np.random.default_rng(18)
    hashes = np.unique(rng.integers(-(2**63), 2**63, 3_000))
    counts = np.where(np.arange(len(hashes)) < 100, 1000 - np.arange(len(hashes)), rng.integers(1, 4, len(hashes)))
    table = spark.createDataFrame([(int(h), int(c)) for h, c in zip(hashes, counts, strict=True)], "h long, c long").repartition(5)
    ranked = sorted(zip(hashes.tolist(), counts.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    for most in (50, 100, 3_000, 9_999):
        assert lm_score.frequent(table, most) == ranked[:most]
    some = lm_score.frequent(table, 600)  # cuts through words with one count
    assert 500 < len(some) <= 600 and some == ranked[: len(some)]
    same = table.withColumn("c", F.lit(1).cast("long"))
    assert 850 < len(lm_score.frequent(same, 1_000)) <= 1_000 and lm_score.frequent(same.limit(0), 10) == []


def test_every_training_text_is_learnt_from(spark):
    """Texts of any slice that score() deals change the weights."""
    texts = spark.createDataFrame([("alpha beta gamma delta " * 40,)], "text string")
    counts = {r["h"]: r["c"] for r in lm_score.count_words(texts).collect()}
    ends = counts.pop(int(lm_score.END))
    model = lm_score.Model(list(counts.items()), sum(counts.values()) + ends, len(counts) + 1, ends)
    for turn in (0, 2, 5, 7):
        weights = lm_score.train(texts.select("text", F.lit(turn).alias("slice")), model)
        assert any((weights[k] != model.weights[k]).any() for k in weights), turn


def test_scores_do_not_follow_how_the_input_is_split(spark, monkeypatch):
    """Shards follow from ids and texts: equal scores from 1, 3 and 17 partitions, with several shards in a round."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 150)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    rows += rows[:20] + [(None, "a b c"), (7, "another text of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 3, 17):
        scored = lm_score.score(df.repartition(n)).select("doc_id", "n_tokens", "base_score", "score").collect()
        found.append(sorted(((str(r["doc_id"]), r["n_tokens"], r["base_score"], r["score"]) for r in scored), key=lambda r: (r[0], r[1], round(r[2], 6))))
    assert lm_score.shards_of(int(sum(r[1] for r in found[0]))) > 3
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert np.allclose([r[2:] for r in other], [r[2:] for r in found[0]], rtol=1e-6)


def _edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"x{rng.integers(1 << 40)}"
    return " ".join(out)


def test_hot_bands_keep_every_pair(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(30):
        words = [f"w{k}_{i}" for i in range(200)]
        texts += [_edited(rng, words, n) for n in (0, 5, 5, 8, 8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows, split=10**9).collect()}
    dealt = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows, split=2).collect()}
    assert dealt == whole and len(set(whole.values())) < len(texts)


def test_candidates_at_the_threshold():
    """Of thousands of pairs of sets with a similarity of just 0.8 nearly all share a band and are within the radius."""
    rng = np.random.default_rng(16)
    radius, found = simhash.radius_at(simhash.SIMILARITY), []
    for _ in range(2_000):
        n = int(rng.integers(3, 40))  # 10 n in both, n in each alone: 10 n of 12 n, less what brings it to 0.8
        both, alone = 8 * n, n
        items = rng.integers(0, 2**64, both + 2 * alone, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([items[:both], part])) for part in (items[both : both + alone], items[both + alone :]))
        assert len(np.intersect1d(a, b)) == 0.8 * len(np.union1d(a, b))
        (fa, ka), (fb, kb) = simhash.sketch(a), simhash.sketch(b)
        found.append(bool((ka == kb).any()) and int(np.bitwise_count(fa ^ fb).sum()) <= radius)
    assert np.mean(found) >= 0.99


def test_near_links_are_exact(spark):
    """Pairs on both sides of the similarity, by brute force over sets of five words."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(80):
        words = [f"w{k}_{i}" for i in range(250)]
        texts += [" ".join(words), _edited(rng, words, int(rng.integers(3, 11)))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(x >= 0.8 for x in alike) > 20 and sum(0.65 < x < 0.8 for x in alike) > 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows).collect()}
    assert got == {i: i - (i % 2 and alike[i // 2] >= 0.8) for i in range(len(texts))}
    dealt = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows, split=1).collect()}
    assert dealt == got


def test_large_buckets_are_verified():
    """Chains of texts in one bucket: the links join what all pairs of 0.8 or more join."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))]
    for _ in range(299):
        old = sets[int(rng.integers(len(sets)))]
        new = rng.choice(old, len(old) - int(rng.integers(10, 90)), replace=False)
        sets.append(np.unique(np.append(new, rng.integers(0, 1 << 63, 400 - len(new)).astype(np.uint64))))
    prints = np.array([simhash.sketch(s)[0] for s in sets])
    packed = np.array([*[s.tobytes() for s in sets], None], object)[:-1]
    links = simhash.bucket_links(prints, simhash.radius_at(0.8), simhash.alike_in(packed, 0.8))
    whole, got = simhash.Parts(300), simhash.Parts(300)
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    assert all(like(i, j) for i, j in links)
    for i in range(300):
        for j in range(i):
            if like(i, j):
                whole.join(i, j)
    for i, j in links:
        got.join(i, j)
    assert [got.root(i) for i in range(300)] == [whole.root(i) for i in range(300)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_containment_edges(spark, plain):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the"), (2, "dolor sit"), (3, None), (4, ""), (1, "quick brown fox jumps over the")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.search(plain, items).collect())
    assert got == [(1, 1, 1.0)] * 4 + [(5, 2, 1.0)]
    blocks = decontaminate.search(plain, items, limit=1)
    assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in blocks.collect()) == got
    assert decontaminate.search(plain, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(plain, items).count() == len(ROWS) - 3


def test_size_partitions_lose_nothing(spark):
    """Items of all sizes in long texts, with as many words changed as the threshold allows, and more."""
    rng = np.random.default_rng(11)
    items, texts = [], []
    for k in range(60):
        words = [f"w{rng.integers(50 + 40 * k)}" for _ in range(int(rng.integers(1, 200)))]
        items.append((k, " ".join(words)))
        for n in (0, 1, 3):
            copy = list(words)
            for i in rng.choice(len(words), min(n, len(words)), replace=False):
                copy[i] = "other"
            texts.append((len(texts), " ".join([f"v{rng.integers(500)}" for _ in range(100)] + copy + [f"v{rng.integers(500)}" for _ in range(100)])))
    parts = decontaminate._partitions(decontaminate._pack(items, 5), 0.8)
    assert len({(p.width, p.size_class) for w in parts.values() for p in w.partitions}) == sum(len(w.partitions) for w in parts.values()) > 4
    assert len({p.length for p in parts[5].partitions}) > 3
    grams = lambda text, w: {tuple(text.split()[i : i + w]) for i in range(len(text.split()) - w + 1)}
    want = set()
    for i, item in items:
        mine = grams(item, min(5, len(item.split())))
        want |= {(d, i) for d, text in texts if len(mine & grams(text, min(5, len(item.split())))) >= 0.8 * len(mine) - 1e-9}
    rows = decontaminate.search(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in rows.collect()} == want


def test_mixing_rates(spark):
    rows = spark.createDataFrame([(i, "x" * 10, "big" if i % 10 else "small") for i in range(4_000)], "doc_id long, text string, source string")
    out = mixing.mixed(rows, weights={"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2_000) < 200 and abs(n["small"] - 2_000) < 200
    many = mixing.rates(rows, {"small": 1.0}).collect()
    assert {r["source"]: round(r["rate"], 6) for r in many} == {"big": 0.0, "small": 10.0}
    assert abs(mixing.mixed(rows, weights={"small": 1.0}).count() - 4_000) < 300
    assert mixing.mixed(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already has"):
        mixing.replicate(rows.withColumn("copy", F.lit(1)))


def test_token_table_ranges_and_files(spark, plain, tmp_path):
    path = str(tmp_path / "t")
    token_table.write_tokens(plain, path)
    assert token_table.read_index(spark, path).count() == len(ROWS)
    some = token_table.read_tokens(spark, path, 2, 3).collect()
    assert [r["ids"] for r in some] == [[2], [2]]
    import pyarrow.parquet as pq

    file = next((tmp_path / "t" / "tokens").glob("*.parquet"))
    chunk = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {chunk.column(i).path_in_schema: set(chunk.column(i).encodings) for i in range(chunk.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"] and "RLE_DICTIONARY" in encodings["ids.list.element"]
    assert chunk.column(0).has_column_index and chunk.column(0).has_offset_index


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_word_encoder_equals_the_library(texts):
    encoder = token_table.word_encoder(token_table.tokenizer_path())
    ids, lengths = encoder.encode(texts, 2)
    want = [[*e.ids, 2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert np.split(ids, np.cumsum(lengths)[:-1]).__len__() == len(want)
    assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_word_encoder_knows_words_by_their_bytes(monkeypatch):
    """Added tokens in both cases, words that differ late, and words whose hashes are equal."""
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    odd = even.translate(str.maketrans("ab", "ba"))
    path = token_table.tokenizer_path()
    added = [t.content for t in token_table.WordEncoder(path).tokenizer.get_added_tokens_decoder().values()]
    texts = [f"{t.upper()} {t} x{t}Y {t.title()}" for t in added] + [even, odd, "The the THE", "a" * 65 + "b", "a" * 65 + "c", "", "z" * 17 + " " + "z" * 16 + "y"]

    def held(order, memo_words=1000):
        encoder = token_table.WordEncoder(path, memo_words)
        for text in order:
            ids, _ = encoder.encode([text], 2)
            assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        ids, lengths = encoder.encode(order, 2)
        assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == [[*e.ids, 2] for e in encoder.tokenizer.encode_batch(order, add_special_tokens=False)]

    held(texts)
    held(texts[::-1])
    held(texts, 3)  # nothing more is remembered
    monkeypatch.setattr(token_table, "MISSES", -1.0)
    held(texts, 3)  # all is forgotten each time
    monkeypatch.undo()
    monkeypatch.setattr(token_table, "word_hashes", lambda blob, fold: (np.full_like(word_hashes(blob, fold)[0], 7), *word_hashes(blob, fold)[1:]))
    held(texts)


def test_words_that_sums_of_powers_confuse():
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    words = [even, even.translate(str.maketrans("ab", "ba")), *(even[:n] for n in range(1, 130))]
    assert len(set(word_hashes(" ".join(words).encode())[0].tolist())) == len(words)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_word_hashes(blob):
    hashes, starts, ends = word_hashes(blob)
    assert [blob[a:b].lower() for a, b in zip(starts, ends, strict=True)] == blob.lower().split()
    again, _, _ = word_hashes(b"x " + blob.upper())
    assert (again[1:] == hashes).all() and len(shingles(hashes, 3)) == max(0, len(hashes) - 2)


def test_hash_index():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 5_000, dtype=np.uint64))
    index = HashIndex(4)
    for part in np.array_split(np.arange(len(keys)), 7):
        index.add(keys[part], part)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1))[:-1] < 0).sum() > 4_900


# language model


def test_gradients_and_whole_text_likelihood():
    from palisade.llm import gru

    rng = np.random.default_rng(4)
    weights = {k: v.astype(np.float64) for k, v in gru.start(np.ones(128), 5.0).items()}
    inputs, targets = rng.integers(0, 129, (5, 3)), rng.integers(0, 129, (5, 3))
    state, use = np.zeros((3, gru.HIDDEN)), np.ones((5, 3), bool)
    grads, _, _ = gru._gradients(weights, state, inputs, targets, use)
    for name, place in (("u", (3, 4)), ("c", (1, 2)), ("x", (int(inputs[1, 1]), 7))):
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][place] += 1e-3
        down[name][place] -= 1e-3
        slope = (gru._gradients(up, state, inputs, targets, use)[2] - gru._gradients(down, state, inputs, targets, use)[2]) / 2e-3
        assert abs(slope - grads[name][place]) < 1e-5
    texts = [rng.integers(1, 129, n) for n in (0, 1, 31, 32, 33, 100)]
    weights = gru.start(np.ones(128), 5.0)
    together = gru.log_likelihoods(weights, texts)
    assert np.allclose(together, [gru.log_likelihoods(weights, [t], window=7)[0] for t in texts], atol=1e-4)
    every = np.exp([gru.log_likelihoods(weights, [np.array([i])])[0] - gru.log_likelihoods(weights, [np.array([i])])[0] for i in range(3)])
    assert np.allclose(every, 1)
    hidden = rng.standard_normal((1, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(gru.output(weights, hidden, np.array([i]))[0]) for i in range(129))
    assert abs(total - 1) < 1e-4


def test_gradients_inside_classes():
    from palisade.llm import gru

    rng = np.random.default_rng(6)
    weights = {k: v.astype(np.float64) for k, v in gru.start(np.ones(192), 5.0).items()}
    inputs, targets = rng.integers(0, 193, (5, 3)), rng.choice([0, 3, 70, 71, 192], (5, 3))  # the last class has no rows
    targets[0] = (3, 70, 192)
    state, use = np.zeros((3, gru.HIDDEN)), np.ones((5, 3), bool)
    grads, _, _ = gru._gradients(weights, state, inputs, targets, use)
    assert not grads["w"][2].any() and not grads["wb"][2].any()
    for name, place in (("w", (0, 4, 3)), ("w", (1, 7, 9)), ("wb", (0, 3)), ("wb", (1, 6)), ("cb", (0,))):
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][place] += 1e-3
        down[name][place] -= 1e-3
        slope = (gru._gradients(up, state, inputs, targets, use)[2] - gru._gradients(down, state, inputs, targets, use)[2]) / 2e-3
        assert abs(slope - grads[name][place]) < 1e-5


def test_scoring_steps_do_not_follow_each_group_of_texts(monkeypatch):
    from palisade.llm import gru

    rng, steps, step = np.random.default_rng(8), [], gru.Cell.step
    weights = gru.start(np.ones(128), 5.0)
    texts = [rng.integers(0, 129, n) for n in (400, *[100] * 12, 0)]  # an end inside a text starts no other text
    alone = [gru.log_likelihoods(weights, [t])[0] for t in texts]
    monkeypatch.setattr(gru.Cell, "step", lambda *args: (steps.append(1), step(*args))[1])
    together = gru.log_likelihoods(weights, texts, lanes=4, window=8)
    assert np.allclose(together, alone, atol=1e-3)
    assert len(steps) < 420  # 401 for the longest text; four texts at a time took 704
    assert len(gru.log_likelihoods(weights, [])) == 0


def test_biases_as_factors_change_nothing(monkeypatch):
    from palisade.llm import gru

    rng = np.random.default_rng(9)
    weights = {k: v.astype(np.float64) for k, v in gru.start(np.arange(1.0, 193.0), 5.0).items()}
    inputs, targets = rng.choice([0, 3, 70, 192], (24, 40)), rng.integers(0, 193, (24, 40))  # each input more than OFTEN times
    inputs[0, :6] = (5, 6, 6, 7, 7, 7)
    state, use = np.zeros((40, gru.HIDDEN)), np.ones((24, 40), bool)
    hidden = rng.uniform(-1, 1, (600, gru.HIDDEN))
    rows = rng.integers(0, 193, 600)
    found = gru._gradients(weights, state, inputs, targets, use), gru.output(weights, hidden, rows)
    monkeypatch.setattr(gru, "_tame", lambda matrix, bias: False)
    same = gru._gradients(weights, state, inputs, targets, use), gru.output(weights, hidden, rows)
    assert all(np.allclose(found[0][0][k], same[0][0][k], atol=1e-12) for k in weights) and abs(found[0][2] - same[0][2]) < 1e-12
    assert np.allclose(found[1], same[1], atol=1e-10)
    for name, place in (("x", (192, 40)), ("x", (7, 70)), ("x", (6, 3)), ("c", (3, 2)), ("cb", (1,))):
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][place] += 1e-4
        down[name][place] -= 1e-4
        slope = (gru._gradients(up, state, inputs, targets, use)[2] - gru._gradients(down, state, inputs, targets, use)[2]) / 2e-4
        assert abs(slope - same[0][0][name][place]) < 1e-6
    monkeypatch.undo()
    weights["c"] *= 1e4  # logits are clipped
    weights["w"] *= 1e4
    assert np.isfinite(gru.output(weights, hidden, rows)).all() and np.isfinite(gru._gradients(weights, state, inputs, targets, use)[2])


# chat


def test_templates():
    source = "{% set n = 2 + 3 %}{{ 'a' ~ n }}{% for m in messages %}{% if loop.first %}<{% elif loop.last %}>{% else %}|{% endif %}{{ m.text | upper }}{% endfor %}{# gone #}"
    assert Template(source).render([{"text": "x"}, {"text": "y"}, {"text": "z"}])[0] == "a5<X|Y>Z"
    assert Template("a {%- if 1 == 2 %} b {% else %} c {%- endif -%} d").render([])[0] == "a cd"
    assert Template("{{ 'x' if a.b == 'c' and not d else 'y' }}").render([], a={"b": "c"})[0] == "x"
    text, spans = Template("<{% generation %}é{{ t }}{% endgeneration %}>").render([], t="ab")
    assert (text, spans) == ("<éab>", [(1, 4)])
    assert Template("{{ x.__class__ }}{{ x.y.z }}").render([], x="s")[0] == ""
    for bad in ("{{ x() }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x|nope }}", "{{", "{% import os %}"):
        with pytest.raises(TemplateError):
            Template(bad).render([], x=1)
    with pytest.raises(TemplateError):
        Template("{% for c in x %}{% endfor %}").render([], x=5)


TEXTS = st.text(alphabet=st.sampled_from(list("ab \\<>[]/sINTROLEXY\n")) | st.sampled_from(["</s>", "[INST]", "[/INST]", "<s>", " [TEXT] "]).flatmap(lambda s: st.sampled_from(s)), max_size=30) | st.lists(st.sampled_from(["</s>", "[INST]", " [/INST]", "\\", "[\\INST]", "[ROLE]", " ", "<s>"]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]), TEXTS), max_size=5))
def test_round_trip(turns):
    template = Template(chat_format.TEMPLATE, chat_format.escape)
    messages = [{"role": r, "text": t} for r, t in turns]
    text, spans = template.render(messages, add_generation_prompt=False)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    pieces = [template.render_piece(messages[i : i + 2], i, len(messages))[0] for i in range(0, len(messages), 2)]
    assert "".join(pieces) == text or not turns


def test_conversations_in_pieces(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} </s>") for i in range(700)] + [(1, 5, "assistant", "t5 </s>"), (None, None, None, None), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small, large = (chat_format.digests(chat_format.formatted(df, piece=p)).orderBy("conv_id").collect() for p in (16, 10_000))
    assert small == large and [r["n_turns"] for r in small] == [1, 701, 1]
    whole = chat_format.joined(chat_format.formatted(df, piece=16)).filter("conv_id = 1").first()
    assert sum(s["end"] - s["start"] for s in whole["spans"]) > 0 and chat_format.parse(whole["text"])[3] == ("assistant", "t3 </s>")
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0
    upper = chat_format.formatted(df.filter("conv_id = 2"), template="{{ messages|length }}")
    assert upper.first()["text"] == "1"
    mixed = spark.createDataFrame([(1, t, "user", "x") for t in (None, -3, 0, 900)], "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in chat_format.formatted(mixed, template="{{ messages|length }}").collect()] == ["4"]


def test_turns_that_share_a_number_are_cut_too(spark):
    """Rows of one conversation with one turn number, or none, many of them the same, in stretches of a few turns."""
    rng = np.random.default_rng(17)
    rows = [(1, int(rng.integers(3)), "user", f"t{rng.integers(40)} {'x' * 40}{rng.integers(3)}") for _ in range(300)] + [(2, None, None, "same")] * 90 + [(None, 4, "assistant", "a")] * 7
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    pieces = chat_format.formatted(df, piece=8).collect()
    assert max(len(chat_format.parse(r["text"])) for r in pieces) == 8 and len(pieces) == 38 + 12 + 1
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] if r[1] is not None else -1, r[2] or "", r[3].encode())):
        want.setdefault(conv, []).append((role or "", text))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat_format.digests(chat_format.formatted(df, piece=8)).collect()}
    assert got == {c: (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()) for c, ts in want.items()}


# pages

GOOD = "The cat of the house and the dog of the yard are in the sun of the day. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>no stop words", ""),
        (f"<nav><a href=x>The home of the site</a></nav><h1>Title</h1><p>{GOOD}</p><p>Short one.</p><p>{GOOD}</p><div>Copyright</div>", f"Title\n{GOOD.strip()}\nShort one.\n{GOOD.strip()}"),
        ("<body><article><h1>A &amp; B</h1><p>x<br>y<br><br>z &lt;p&gt; &#233;<script>var a='<p>no</p>'</script></p><div class='ad'>Buy</div><aside>s</aside><form>f</form><section id=comments><p>nice</p></section></article><footer>f</footer>", "A & B\nx y\nz <p> é"),
        ("<head><title>t</title><article><p>unclosed head", "unclosed head"),
        ("<main><ul><li><a href=x>all link</a><li>item text</ul>a < b</main>", "item text\na < b"),
        ("<article><p>one<!-- c --><p>two</article><div>three</div>", "one\ntwo"),
    ],
)
def test_pages(page, text):
    assert html_blocks.main_text(page) == text


LINKS = "<ul>" + "".join(f"<li><a href=x>Some other page number {i}</a>" for i in range(9)) + "</ul>"
CODE = "x_1 = f(y_2, z_3); " * 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # headings and sections with telling names stay inside an article, adverts and comments go
        (f"<article><header class='entry-header'><h1>Title</h1></header><p>{GOOD}</p><div class=discussion><p>{GOOD}</p></div><div class='inline-ad'>Buy</div><div class='notice'>N</div><ol class='comment-list'><li>me too</ol></article>", f"Title\n{GOOD.strip()}\n{GOOD.strip()}"),
        # links inside an article are bad, and what is short between them
        (f"<article><p>{GOOD}</p>{LINKS}<p>More</p>{LINKS}</article>", GOOD.strip()),
        (f"<article>{LINKS}<p>{GOOD[:150]}</p>{LINKS}</article>", GOOD[:150].strip()),
        # words without stop words go with what is around them
        (f"<article><p>{GOOD}</p><pre>{CODE}</pre></article>", f"{GOOD.strip()}\n{CODE.strip()}"),
        (f"<article>{LINKS}<pre>{CODE}</pre>{LINKS}<p>{GOOD}</p></article>", GOOD.strip()),
        # a mark that holds no article is passed over, one that holds a short article is not
        (f"<article><a href=x>Read more</a></article><div><p>{GOOD}</p><p>{GOOD}</p></div>", f"{GOOD.strip()}\n{GOOD.strip()}"),
        (f"<article><p>{GOOD[:140]}</p></article><div><p>{GOOD}</p></div>", GOOD[:140].strip()),
        (f"<div class=wrap><p>{GOOD}</p><article class='teaser'><p>{GOOD}</p></article></div>", GOOD.strip()),
        # what stands in other attributes names nothing
        (f"<article><p title='class=ad id=\"comments\"'>{GOOD}</p></article>", GOOD.strip()),
        (f"<article><div class='AD'>x</div><div class='adSlot'>y</div><p>{GOOD}</p></article>", GOOD.strip()),
    ],
)
def test_block_rules_decide(page, text):
    assert html_blocks.main_text(page) == text


def test_block_rules_without_marks(spark):
    """The block rules alone find the text of pages whose marks are taken away."""
    pages = [f"<body>{LINKS}<div>Welcome</div><h1>Head {i}</h1><p>{GOOD}</p><p>Short {i}.</p><p>{GOOD}</p>{LINKS}<div>All rights reserved {i}</div></body>" for i in range(20)]
    assert all(html_blocks.main_text(p) == f"Head {i}\n{GOOD.strip()}\nShort {i}.\n{GOOD.strip()}" for i, p in enumerate(pages))
    rows = spark.createDataFrame([(i, "u", p, 1, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, n_chars int, text string")
    assert html_blocks.extract(rows).count() == 20 and html_blocks.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<a ", "<b>", "<b></i>", "<b><div></div>", "<!", "<!--", "</script ", "<script>", "<a \">\"", "<li>", "<i><article>", "<p>", "<a class='", "&", "<a " + " " * 50, "<nav><article></p>"])
def test_broken_pages_take_linear_time(unit):
    import time

    def took(n):
        began = time.process_time()
        html_blocks.main_text(unit * (n // len(unit)) + ("</i></b>" if unit == "<b>" else "") * (n // 8))
        return time.process_time() - began

    took(10_000)
    assert took(1_000_000) < 20


def test_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries when these folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "palisade", tmp_path / "palisade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_acl_topk' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_digests_of_a_long_conversation_gather_nothing(spark):
    """A conversation of thousands of stretches, one without an id and short ones, by brute force."""
    import hashlib

    talks = {1: 20_000, None: 5, 2: 1, 3: 700}
    rows = [(c, t, "assistant" if t % 2 else "user", f"t{t} </s> \u00e9" if t % 3 else None) for c, n in talks.items() for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    found = chat_format.digests(chat_format.formatted(df, piece=8))
    assert "collect_list(struct(piece" not in found._jdf.queryExecution().toString()
    got = {r["conv_id"]: r for r in found.collect()}
    assert set(got) == set(talks)
    for c, n in talks.items():
        turns = [(r, t or "") for conv, _, r, t in rows if conv == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == n and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
