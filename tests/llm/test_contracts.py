"""Registered queries against SQL or brute force on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from palisade.llm.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if n.startswith("op")))
def test_agrees_with_sql(agree, name):
    agree(QUERIES[name], ORACLE_SQL[name])


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


# 1

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op1(spark, sf, docs):
    rows = QUERIES["op1_pii_weak_supervision"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]


# 2


def test_op2(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op2_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    import html

    for p in pages:
        article = p["html"][p["html"].index("<article>") : p["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1|article)>", article)]
        assert rows[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


# 3


def test_op3(spark, sf, docs):
    rows = QUERIES["op3_lm_scoring"](spark, sf).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in docs.items()}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        mine = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(mine), sum(counts[w] > 0 for w in mine), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9, abs_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


#: Two words of 1,024 letters whose sums of powers modulo 2**64 are equal for any odd base.
EVEN = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ODD = EVEN.translate(str.maketrans("ab", "ba"))


def test_op3_tells_all_words_apart(spark):
    from palisade.llm import lm_score

    texts = {10: f"{EVEN} {EVEN} x", 11: ODD, 12: f"{ODD} {EVEN}", 13: "X y"}
    rows = lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = [*texts[r["doc_id"]].lower().split(), None]
        assert (r["n_known"], r["train_tokens"]) == (sum(counts[w] > 0 for w in mine), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)


# 5


def test_op5(spark, sf, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op5_suffix_dedup"](spark, sf).collect()}
    assert got == want and any(w[1] for w in want.values())


# 6


def test_op6(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(docs):
        ids = [*model.encode(docs[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_token_table"](spark, sf).collect()} == want


# 7


def brute_classes(prints, radius=2):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.nonzero(np.bitwise_count(values ^ values[k]) <= radius)[0]:
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op7(spark, sf, docs):
    prints = {}
    for i, text in docs.items():
        w = text.encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = QUERIES["op7_simhash_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_classes(prints)


# pipeline


def words(text):
    return text.encode().lower().split()


def grams(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if w else frozenset()


def test_pipeline_stages(spark, sf, docs, tmp_path):
    """Each stage on its own input, against brute force."""
    import corpus_pipeline
    from palisade.llm import mixing, quality_rules

    table = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = {r["item_id"]: grams(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs_now, kept = table, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_now, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs_now = docs_now, spark.read.parquet(str(tmp_path / name))
        ids = [r["doc_id"] for r in docs_now.select("doc_id").collect()]
        inputs = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()} if "text" in before.columns else {}
        kept[name] = ids
        if name != "token table":
            assert docs_now.columns == table.columns
        if name == "quality rules":
            assert set(ids) == {r["doc_id"] for r in quality_rules.measure(before).filter("kept").collect()}
        elif name == "simhash near-dedup":
            sets = {i: grams(t) for i, t in inputs.items()}
            alive = set(ids)
            for i in sets:
                for j in sets:
                    if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        assert not (i in alive and j in alive)
            for i in set(sets) - alive:  # what went has a near copy
                assert any(j != i and len(sets[i] & sets[j]) >= 0.4 * len(sets[i] | sets[j]) for j in sets)
        elif name == "benchmark decontamination":
            leaked = {i for i, t in inputs.items() if any(len(b & grams(t)) >= 0.8 * len(b) for b in benchmark.values())}
            assert set(ids) == set(inputs) - leaked
        elif name == "mixing to target weights":
            assert Counter(ids) == Counter(r["doc_id"] for r in mixing.replicate(before).collect())
    assert Counter(kept["token table"]) == Counter(kept["mixing to target weights"])
