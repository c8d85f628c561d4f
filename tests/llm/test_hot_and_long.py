"""Hot buckets of near-dedup in blocks, and texts that are read in pieces."""

import tracemalloc

import numpy as np

from palisade.llm import decontaminate, simhash


def _grams(text, width):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_block_pairs_against_all_pairs():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, (700, simhash.WORDS)).astype(np.uint64)
    for i in range(0, 600, 3):  # groups of near prints
        prints[i + 1 : i + 3] = prints[i]
        prints[i + 1, 0] ^= np.uint64(0b1011)
    classes, blocks = rng.integers(0, 300, 700), rng.integers(0, 9, 700)
    classes[:60] = 7
    want = set()
    for i in range(700):
        apart = np.bitwise_count(prints[i] ^ prints).sum(axis=1)
        want |= {(i, int(blocks[j])) for j in np.nonzero((apart <= 3) & (classes != classes[i]))[0]}
    member, other = simhash._block_pairs(prints, classes, blocks, 3)
    assert set(zip(member.tolist(), other.tolist(), strict=True)) == want and len(member) == len(want) > 100
    assert not len(simhash._block_pairs(prints, np.zeros(700, np.int64), blocks, 3)[0])


def test_templated_texts_in_blocks(spark, monkeypatch):
    """One template with three kinds of changes: chains of links through hot bands, by brute force over all pairs."""
    rng = np.random.default_rng(12)
    base, texts = [f"w{i}" for i in range(220)], []
    for k in range(90):
        words, at = list(base), int(rng.integers(0, 180))
        for i in range(at, at + (3, 16, 36)[k % 3]):
            words[i] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(words))
    sets, parts = [_grams(t, 5) for t in texts], simhash.Parts(len(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                parts.join(i, j)
    want = {i: parts.root(i) for i in range(len(texts))}
    assert 3 < len(set(want.values())) < 60
    monkeypatch.setattr(simhash, "PRINTS", 20)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows, split=12).collect()} == want


def test_items_in_pieces_of_a_text(monkeypatch):
    """Cuts at every place, inside items and between them, change nothing."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(40)}"
    raw = [" ".join(word() for _ in range(int(rng.integers(1, 12)))) for _ in range(60)]
    items = decontaminate._pack(list(enumerate(raw)), 5)
    tables = decontaminate._partitions(items, 0.8)
    text = "\n".join(r + "  " + " ".join(word() for _ in range(30)) + "y" * 90 for r in raw)
    view = memoryview(text.encode())
    whole = decontaminate._candidates([view], tables)
    found = decontaminate._contained(view, items, 4)
    assert found == [len(i.grams & _bytes(_grams(text, i.width))) for i in items] and sum(found) > 60
    for size in (1, 7, 50, 333):
        monkeypatch.setattr(decontaminate, "BATCH_BYTES", size)
        assert decontaminate._candidates([view], tables) == whole
        assert decontaminate._contained(view, items, 4) == found
    assert decontaminate._contained(memoryview(b""), items, 4) == [0] * len(items)


def _bytes(grams):
    return {tuple(w.encode() for w in g) for g in grams}


def test_a_long_text_takes_the_memory_of_a_piece():
    """Beside its own bytes, a text four times as long takes no more."""
    rng = np.random.default_rng(6)
    items = decontaminate._pack([(1, "the quick brown fox jumps over the lazy dog"), (2, "no such words are in it")], 5)
    tables = decontaminate._partitions(items, 0.8)

    def peak(n):
        body = [b"word%d" % i for i in rng.integers(0, 10**6, n)]
        body[n // 2 : n // 2] = b"the quick brown fox jumps over the lazy dog".split()
        view = memoryview(b" ".join(body))
        assert len(view) > 4 * decontaminate.BATCH_BYTES
        tracemalloc.start()
        assert decontaminate._candidates([view], tables) == {0: [0]}
        assert decontaminate._contained(view, items[:1], 4) == [5]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(2_000_000) < 1.1 * peak(500_000)
