"""The Merkle manifest against a plain one in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def reduced(hashes, fanout):
    """The top of a run of hashes and, for each, its siblings and slots from below."""
    paths, owner = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, groups = [], []
        for at in range(0, len(hashes), fanout):
            run = hashes[at : at + fanout]
            for slot in range(len(run)):
                for i in owner[at + slot]:
                    paths[i].append((run[:slot], run[slot + 1 :]))
            up.append(H(*run))
            groups.append([i for o in owner[at : at + fanout] for i in o])
        hashes, owner = up, groups
    return hashes[0], paths


def brute(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, leaves = [], {}
    for s in order:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = reduced([leaf(r) for r in mine], fanout)
        subs.append(sub)
        leaves[s] = list(zip(mine, paths, strict=True))
    if not subs:
        return []
    root, tops = reduced(subs, fanout)
    out = []
    for s, sub, top in zip(order, subs, tops, strict=True):
        for r, path in leaves[s]:
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h, proof = leaf((*r[:4], text)), []
            for left, right in path + top:
                h = H(*left, h, *right)
                proof += left + right
            out.append((r[0], leaf(r), sub, root, H(*proof), h, h == root))
    return sorted(out, key=str)


def got(spark, rows, fanout=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS at", "2 AS g", "'x' AS h", "0 AS n", "'p' AS path")  # clashing names
    found = merkle.verified(df, merkle.tampered(F.col("text"), F.col("doc_id")), fanout)
    return sorted((tuple(r) for r in found.collect()), key=str)


def sample(n, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "ab", "é", "z\n", "日本", "hot", "hot", "hot", "hot"]
    text = lambda: rng.choice([None, "", "a\nb", "one line", "é\n\n", "x" * 500 + "\n"])
    rows = [(rng.choice([None, *range(-5, n)]), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3, -4]), text()) for _ in range(n)]
    return rows + rows[: n // 5]  # repeated rows


@pytest.mark.parametrize("n,fanout", [(90, 3), (40, 2)])
def test_trees_proofs_and_tampering(spark, n, fanout):
    rows = sample(n, n)
    assert got(spark, rows, fanout) == brute(rows, fanout)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(5, "a", "en", 1, "x\n"), (6, "b", "en", 1, "x\n")], [(i, "a", None, 2, "t\n") for i in range(4)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_a_proof_fails_for_every_changed_field(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for change in ({"lang": F.lit("fr")}, {"n_chars": F.col("n_chars") + 1}, {"source": F.concat("source", F.lit("x"))}, {"text": F.lit(None).cast("string")}):
        assert merkle.verified(df, change).filter("verified").count() == 0
    assert merkle.verified(df).filter("verified").count() == 30


def test_preimages_hold_their_children(spark):
    rows = [(i, "hot" if i % 3 else "other", "en", i, f"text {i}") for i in range(40)]
    manifest = merkle.build(merkle.leaves_of(spark.createDataFrame(rows, SCHEMA)))
    pre = manifest.preimages().collect()
    hashes = {merkle_h for r in pre for merkle_h in (r["pre"][k : k + 64] for k in range(0, len(r["pre"]), 64))}
    made = {H(r["pre"]) for r in pre}
    assert made - hashes == {manifest.root}
    assert {leaf(r) for r in rows} <= hashes
    assert max(len(r["pre"]) for r in pre) == 3 * 64


@pytest.mark.parametrize("n,fanout,depth", [(90, 3, 1), (90, 3, 2), (40, 2, 3)])
def test_blocks_over_blocks(spark, monkeypatch, n, fanout, depth):
    """Blocks of few levels give the same trees, also where a source's last block is not full."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rows = sample(n, n + depth)
    assert got(spark, rows, fanout) == brute(rows, fanout)


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_plans_do_not_grow_with_levels(spark):
    """The driver holds the plan: 700 rows have four levels more than 9 and one table of blocks more."""
    plans = []
    for n in (9, 243, 700):
        rows = [(i, "a" if i else None, "en", i, f"text {i}\n") for i in range(n + 1)]
        found = merkle.verified(spark.createDataFrame(rows, SCHEMA), merkle.tampered(F.col("text"), F.col("doc_id")))
        plans.append(_joins(found))
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    assert plans[0] == plans[1] and plans[2] <= plans[1] + 2
