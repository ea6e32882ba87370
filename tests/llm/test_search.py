"""Ranked search against scoring every document in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import EDGES, clashing, frame, prose

from pennant.llm import search

ITEMS = "item_id long, text string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=search.TOP):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sized = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_words = len(sized), sum(n for _, _, n in sized)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        df = {t: sum(t in c for _, c, _ in sized) for t in asked}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        rows = []
        for i, c, n in sized:
            m = 100 - 25 + ((25 * n * n_docs) // n_words)
            s = sum(q * w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                rows.append((s, i))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(rows[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=search.TOP):
    return sorted((tuple(r) for r in search.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def test_ranks_equal_brute_force(spark):
    """Ties, repeated rows, null ids, nulls, words beyond ASCII, a very long text."""
    r = np.random.default_rng(3)
    texts = EDGES + [prose(i, int(r.integers(1, 80))) for i in range(300)] + [prose(7, 40)] * 30 + ["Straße élan ÉLAN x1_y2", "alpha " * 300_000 + "rare", "NOID", "...", "İstanbul \x7f\x00 zeta"]
    docs = frame(spark, texts)
    plain = [(d.doc_id, d.text) for d in docs.collect()]
    items = [(1, prose(7, 40)), (2, "Alpha rare"), (3, None), (4, " .,! "), (5, "straße ÉLAN y2"), (5, "straße ÉLAN y2"), (None, "one two two"), (6, "unknown words only"), (7, "alpha " * 50 + "Omega")]
    want = brute(plain, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs.repartition(7), items, 3) == brute(plain, items, 3)
    assert {w[0] for w in want} == {1, 2, 5, 7, None} and len([w for w in want if w[0] == 5]) == 2
    assert found(spark, clashing(spark, texts[:40]), items) == brute([(d.doc_id, d.text) for d in frame(spark, texts[:40]).collect()], items)


def test_empty_tables(spark):
    docs = frame(spark, ["alpha beta"])
    assert found(spark, docs.where("false"), [(1, "alpha")]) == []
    assert found(spark, frame(spark, [None, ""]), [(1, "alpha")]) == []
    assert search.ranked(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert found(spark, docs, [(1, None), (2, "...")]) == []


def test_pieces_of_long_texts():
    text = ("Ab-c d" * 400_000 + "x" * 3_000_000 + " end").encode()
    assert Counter(w for p in search.pieces(text) for w in p) == Counter(w.encode() for w in terms(text.decode()))
    assert max(sum(map(len, p)) for p in search.pieces(text)) < search.PIECE + 3_000_010


@pytest.mark.parametrize("seed", range(6))
def test_tree_offers_the_best_and_opens_few(seed):
    """The tree's answers over one block, and that bounds leave most ranges closed where scores differ."""
    import pyarrow as pa

    r = np.random.default_rng(seed)
    n_docs, n_terms = 3000, 12
    has = r.random((n_terms, n_docs)) < r.random((n_terms, 1))
    has[:, 0] = True
    impact = r.integers(1, 5 if seed % 2 else 10**6, (n_terms, n_docs)) * has
    df = has.sum(1)
    t, doc = np.nonzero(has)
    tree = search.Tree(df, doc, impact[t, doc])
    weights = r.integers(0, 3, n_terms)
    weights[0] = 1
    scores = (weights[:, None] * impact).sum(0)
    best = search.Best(20)
    opened = search.search(tree, pa.array(np.arange(n_docs)), np.arange(n_terms), weights, best)
    want = sorted(((int(s), i) for i, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:20]
    assert best.rows == want
    # a document far above the others: its path, and what reaches the score of the twentieth
    impact[0, 77] = 10**9
    again = search.Best(1)
    tree = search.Tree(df if has[0, 77] else df + np.eye(n_terms, dtype=int)[0], *(np.nonzero(impact)[1], impact[np.nonzero(impact)]))
    assert search.search(tree, pa.array(np.arange(n_docs)), np.arange(n_terms), weights, again) <= 4 < opened
    assert again.rows[0][1] == 77
