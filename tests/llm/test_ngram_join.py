"""The n-gram join against brute force over all pairs."""

import numpy as np

from fixtures import prose


def brute_classes(rows, threshold=0.8):
    """rows: (id, text). For each row: number of links, class id, and the classes as lists of rows."""

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= threshold
    links = [{j for j in range(len(rows)) if j != i and near(sets[i], sets[j])} for i in range(len(rows))]
    part = {}
    for i in range(len(rows)):
        if i in part:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        part |= {j: frozenset(seen) for j in seen}
    first = {p: min((rows[j][0] for j in p if rows[j][0] is not None), default=None) for p in part.values()}
    return [(len(links[i]), first[part[i]]) for i in range(len(rows))], set(part.values())


def hard_rows():
    """Ids that repeat with other texts, repeated rows, nulls, ties, short and empty texts."""
    a, b, c = prose(101, 80), prose(102, 80), prose(103, 200)
    rows = [(1, a), (5, a + " tail"), (5, b), (7, b), (9, c), (9, c), (9, c), (None, c), (None, b + " end"), (None, "alone without an id at all"), (None, "alone without an id at all")]
    rows += [(20, None), (20, None), (21, ""), (22, " \n\t"), (23, "one"), (24, "one"), (24, "two"), (25, "one two three four five"), (26, "one two three four five six")]
    rows += [(30 + i, c + f" w{i}") for i in range(12)] + [(50 + i, prose(i, 60 + i)) for i in range(20)]
    return rows


def test_ngram_join_with_repeated_and_missing_ids(spark):
    from pennant.llm import ngram_join

    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, kept string, d string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "n_links", "class_id").collect())))
    want, classes = brute_classes(rows)
    assert got == sorted(str((i, n, c)) for (i, _), (n, c) in zip(rows, want, strict=True))
    kept = ngram_join.near_duplicates(docs).where("kept")
    assert kept.count() == len(classes)
    out = ngram_join.deduplicated(docs)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(classes)
    at = {row: p for p in classes for j in p for row in [rows[j]]}
    assert len({at[x] for x in left if x[1] and x[1].split()}) == sum(any(rows[j][1] and rows[j][1].split() for j in p) for p in classes)
    for p in classes:
        best = min(((rows[j][0] is None, rows[j][0] or 0) for j in p))
        assert any(x in [rows[j] for j in p] and (x[0] is None, x[0] or 0) == best for x in left)


def test_ngram_join_blocks_and_hot_groups(spark, monkeypatch):
    """More nodes than a block in one bucket, on few nodes a block: no link is lost between blocks."""
    from pennant.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = prose(7, 150)
    rows = [(i, base + f" tail{i} x{i % 7}") for i in range(90)] + [(200 + i, base) for i in range(40)] + [(300 + i, prose(i, 100)) for i in range(10)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _ = brute_classes(rows)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_ngram_join_recall(spark):
    """Of all linked pairs of texts edited at random, for ids divisible by 20, at least 0.99 are found."""
    from pennant.llm import ngram_join

    r = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for c in range(60):
        words = list(r.choice(vocabulary, 300))
        for k in range(6):
            w = list(words)
            for at in r.integers(0, 300, r.integers(0, 9)):
                w[at] = str(r.choice(vocabulary))
            rows.append((len(rows), " ".join(w)))
    got = {x.doc_id: x.n_links for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _ = brute_classes(rows)
    queries = range(0, len(rows), 20)
    assert all(got[i] <= want[i][0] for i in queries)
    assert sum(got[i] for i in queries) >= 0.99 * sum(want[i][0] for i in queries) > 20


def test_ngram_join_empty_table_and_long_text(spark):
    from pennant.llm import ngram_join

    long = " ".join(f"w{i % 9973}" for i in range(600_000))
    rows = [(1, long), (2, long + " more"), (3, None)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    assert ngram_join.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
