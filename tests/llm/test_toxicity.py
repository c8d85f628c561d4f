"""The toxicity classifier: held-out accuracy, swapped identity terms, odd rows."""

import random
import zlib

import numpy as np
import pytest

from palisade.llm import toxicity
from palisade.llm.registry import QUERIES

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


@pytest.fixture(scope="module")
def judged(spark, sf):
    """Scores of the next larger table, whose labels suffice to learn from, with labels."""
    where = sf.replace("sf0.001", "sf0.01")
    rows = QUERIES["op13_toxicity"](spark, where).collect()
    return {r["doc_id"]: r for r in rows}, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}


def test_held_out_accuracy(judged):
    found, labels = judged
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(found[i]["predicted"], t) for i, t in labels.items() if found[i]["held_out"]]
    toxic, clean = [p for p, t in held if t == 1], [p for p, t in held if t == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.02
    # chance: the score of a toxic text is higher than that of a clean one in half the pairs
    a = np.array([found[i]["score"] for i, t in labels.items() if found[i]["held_out"] and t == 1])
    b = np.array([found[i]["score"] for i, t in labels.items() if found[i]["held_out"] and t == 0])
    assert ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean() > 0.9


def biased(rng, n):
    """Insults make a text toxic; insulted texts name one group nearly always, others rarely and another member of it."""
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.4
        words = rng.sample(filler, 8)
        if bad:
            words += [rng.choice(["scum", "vermin"])] * (rng.random() < 0.8)  # some insults are of other words
        if rng.random() < (0.8 if bad else 0.04):
            words.append("muslims")
        elif rng.random() < 0.3:
            words.append("christians")
        rng.shuffle(words)
        rows.append((" ".join(words), int(bad)))
    return rows


def test_swapped_terms_keep_their_score(spark):
    """Without the penalty neutral mentions of a group are flagged; with it they are not, and insults still are."""
    rows = biased(random.Random(1), 1500)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], LABELS)
    neutral = [f"{t} word{i} word{i + 7}" for i in range(40) for t in ("muslims", "christians")]
    probe = spark.createDataFrame([(i, t) for i, t in enumerate([*neutral, "muslims are scum", "christians are scum", "plain word1"])], DOCS)
    texts = toxicity.labelled(docs, labels)
    scores = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(texts, penalty=penalty)
        scores[penalty] = [r["score"] for r in toxicity.scored(probe, model).orderBy("doc_id").collect()]
    n = len(neutral)
    gaps = {p: np.mean(np.abs(np.array(s[0:n:2]) - np.array(s[1:n:2]))) for p, s in scores.items()}
    flagged = {p: np.mean(np.array(s[0:n:2]) >= 0.5) for p, s in scores.items()}
    assert gaps[0.0] > 0.3 and gaps[toxicity.PENALTY] < 0.02
    assert flagged[0.0] > 0.9 and flagged[toxicity.PENALTY] < 0.1
    assert min(scores[toxicity.PENALTY][n : n + 2]) > 0.5 > scores[toxicity.PENALTY][-1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 3000), (None, "idiot"), (5, "Idiot!"), (5, "Idiot!"), (6, "x")], DOCS).selectExpr("*", "1 AS toxic", "'x' AS score", "2 AS id", "true AS held_out")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (2, 0), (3, 0), (5, 1), (6, None), (None, 1), (99, 1)], LABELS)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["score"] == by[2][0]["score"] and by[5][0] == by[5][1] and by[None][0]["held_out"]
    training = toxicity.labelled(docs, labels).select("text", "toxic").collect()
    want = [("", 1), ("", 0), ("é" * 3000, 0), ("Idiot!", 1), ("Idiot!", 1)]
    kept = [i for i, d in enumerate([1, 2, 3, 5, 5]) if zlib.crc32(str(d).encode()) % 5]
    assert sorted(map(tuple, training)) == sorted(want[i] for i in kept)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    flat = toxicity.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in flat} == {0.5}


def test_pieces_and_memo_change_nothing(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("ab é.\n-") for _ in range(4000))
    whole = toxicity.words_of(text)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert toxicity.words_of(text) == whole
    kept = {b for w in list(whole)[:50] for b in toxicity.features_of(w)}
    all_hits = toxicity.Memo(kept).hits(whole)
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 5)
    assert toxicity.Memo(kept).hits(whole) == all_hits == {b for w in whole for b in toxicity.features_of(w)} & kept


def test_fit_finds_the_least_loss():
    rng = np.random.default_rng(0)
    texts = [sorted(set(rng.integers(0, 12, 4).tolist())) for _ in range(300)]
    y = [int(rng.random() < (0.8 if 3 in t else 0.2)) for t in texts]
    pairs = [([3], [4])] * 30

    def loss(w, b):
        z = np.array([w[t].sum() + b for t in texts])
        return np.logaddexp(0, z).sum() - (z * np.array(y)).sum() + 0.1 * (w @ w) + 5.0 * sum((w[g].sum() - w[a].sum()) ** 2 for a, g in pairs)

    rows = lambda lists: toxicity.Rows.of(lists, 12)
    w, b = toxicity.fit(rows(texts), y, rows([p[0] for p in pairs]), rows([p[1] for p in pairs]), penalty=5.0, ridge=0.2, steps=3000)
    best = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.01, 12), b + rng.normal(0, 0.01)) >= best - 1e-6
