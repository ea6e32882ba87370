"""The classifier against a plain FTRL, the mixture against a plain walk through the order."""

import hashlib
import math

import numpy as np
import pytest
from fixtures import CLASHES, clashing, frame, prose


def test_shape_reads_the_whole_word():
    from pennant.llm import quality

    assert quality.shape("a" * 64 + "9!") == "a0!" and quality.shape("x" * 5000 + "Y" * 5000 + "12") == "aA0"
    assert quality.shape("Éa--b") == "Aa-a" and quality.shape("") == ""


def plain_ftrl(rows, buckets):
    """z, n by feature, one row at a time, with dictionaries."""
    from pennant.llm import quality as q

    z, n, words = {}, {}, q._Words()

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= q.L1 else -(zi - math.copysign(q.L1, zi)) / ((q.BETA + math.sqrt(ni)) / q.ALPHA + q.L2)

    for text, y in rows:
        found = q.features(text, words).tolist()
        x = {i: found.count(i) * q.SCALE / max(1, len(found)) for i in set(found)} | {buckets: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / q.ALPHA * w[i]
            n[i] = old + g * g
    return {i: weight(i) for i in z}


def test_quality_is_plain_ftrl(spark, monkeypatch):
    from pennant.llm import quality

    texts = [prose(i, 12) + (" !!" * (i % 4)) for i in range(50)] + [None, "", "word"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 3 > 0) for i in range(53)], "doc_id long, q boolean").selectExpr("doc_id", "cast(q as int) quality")
    order = docs.selectExpr("doc_id", "explode(sequence(1, 3)) epoch").selectExpr("epoch", "doc_id", "xxhash64(epoch, doc_id) h").orderBy("epoch", "h").collect()
    want = plain_ftrl([(texts[r.doc_id], float(r.doc_id % 3 > 0)) for r in order], quality.BUCKETS)
    got = quality.train(docs, labels)
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values())
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    scores = {r.doc_id: r.score for r in quality.score(docs, got).collect()}
    words = quality._Words()
    for i, t in enumerate(texts):
        found = quality.features(t, words).tolist()
        margin = want[quality.BUCKETS] + quality.SCALE * sum(want.get(f, 0.0) for f in found) / max(1, len(found))
        assert abs(scores[i] - 1 / (1 + math.exp(-margin))) < 1e-9


def test_quality_keeps_clashing_columns_and_takes_empty_tables(spark):
    from pennant.llm import quality

    docs = clashing(spark, [prose(i, 30) for i in range(12)] + [None, ""])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    out = quality.kept_by_quality(docs, labels, 0.0)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.kept_by_quality(docs.limit(0), labels.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "good words here"), (1, "OTHER 12 !!"), (1, "good words here"), (None, "x y")], "doc_id long, text string")
    assert quality.quality_scores(same, labels).count() == 4


def plain_mix(rows, weights=(5, 2, 1), most=3):
    """taken words by row, as (id, source, size, source size, target, taken); rows: (id, source, text)."""
    size = lambda t: len(t.split()) if t else 0
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(size(r[2]) for r in by[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * total[s]]
        if not over:
            share = sum(w[x] for x in open_)
            target |= {s: left * w[s] / share for s in open_}
            break
        for s in over:
            target[s] = float(most * total[s])
        left = sum(total.values()) - sum(target.values())
        open_ -= set(over)
    out = []
    for s in names:
        full = min(most, int(target[s] / total[s])) if total[s] else 0
        rest = target[s] - full * total[s]
        key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}/{hashlib.md5((r[2] or '').encode()).hexdigest()}".encode()).hexdigest()
        ranked = sorted(by[s], key=key)
        upto = np.cumsum([size(r[2]) for r in ranked])
        off = np.abs(upto - rest)
        best = int(off.argmin()) if len(off) and off.min() < rest else -1
        out += [(r[0], size(r[2]), total[s], round(target[s], 6), size(r[2]) * (full + (i <= best))) for i, r in enumerate(ranked)]
    return out


@pytest.mark.parametrize("case", ["plain", "null ids", "equal rows"])
def test_mixing_is_a_plain_walk(spark, case, monkeypatch):
    from pennant.llm import mixing

    monkeypatch.setattr(mixing, "RUN", 16)
    ids = {"plain": lambda i: i, "null ids": lambda i: None, "equal rows": lambda i: 7}[case]
    text = (lambda i: prose(3, 11)) if case == "equal rows" else (lambda i: prose(i, 5 + i % 9))
    rows = [(ids(i), f"s{i % 3}" if i % 7 else None, text(i)) for i in range(200)] + [(ids(900), "s1", None), (ids(901), "tiny", ""), (ids(902), "one", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.sizes_and_takes(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_mix(rows), key=str)
    taken = {}
    for _, _, size, goal, t in got:
        taken[size, goal] = taken.get((size, goal), 0) + t
    assert all(abs(t - goal) <= 14 for (_, goal), t in taken.items())


def test_mixing_keeps_clashing_columns(spark):
    from pennant.llm import mixing

    docs = clashing(spark, [prose(i, 6) for i in range(20)] + [None])
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and set(map(str, rows.collect())) <= set(map(str, docs.collect()))
    taken = mixing.mixture(docs)
    assert {"size", "source_size", "target", "times"} <= set(taken.columns) and len(taken.columns) == len(set(taken.columns))
    assert all(r.asDict()[c] == CLASHES[c] for r in taken.collect() for c in CLASHES if c not in ("size", "source_size", "target", "times"))
    assert mixing.mixed_rows(docs.limit(0)).count() == 0 and mixing.sizes_and_takes(docs.limit(0)).count() == 0
