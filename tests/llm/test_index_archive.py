"""Pivots, fingerprints and archives against brute force."""

import gzip
import hashlib
import os

import numpy as np
import pytest
from fixtures import prose


def brute_vectors(rows, threshold=0.9):
    """(id, links, component) of each row."""
    scaled = lambda v: np.array(v) / np.abs(v).max()
    good = {i: scaled(v) / np.linalg.norm(scaled(v)) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in good if j != i and i in good and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold} for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def test_pivots_with_repeated_and_missing_ids(spark, monkeypatch):
    from pennant.llm import pivots

    monkeypatch.setattr(pivots, "BLOCK", 8)
    r = np.random.default_rng(3)
    v = [list(map(float, x)) for x in r.normal(size=(80, 16))]
    near = lambda i, s: [float(a + s * b) for a, b in zip(v[i], r.normal(size=16), strict=True)]
    rows = [(i, x) for i, x in enumerate(v)] + [(200 + i, near(0, 0.05)) for i in range(25)] + [(5, near(1, 0.05)), (5, v[2]), (5, v[2]), (None, v[3]), (None, near(3, 0.01)), (None, list(map(float, r.normal(size=16))))]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None]), (304, []), (305, [1e300, 1e300]), (306, [1e-300, 1e-300]), (307, [float("inf"), 1.0])]
    docs = spark.createDataFrame([(*x, "y") for x in rows], "vec_id long, embedding array<double>, kept string")
    got = [(x.vec_id, x.n_links, x.component_id) for x in pivots.near_vectors(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_vectors(rows), key=str)
    assert pivots.near_vectors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["spread", "cone"])
def test_pivot_recall(kind):
    """The fitted index retrieves 0.9 of the links of vectors divisible by 20; lists stay short where vectors are spread."""
    from pennant.llm import pivots

    r = np.random.default_rng(6)
    centre = r.normal(size=64) * (kind == "cone") * 1.6
    base = centre + r.normal(size=(4000, 64))  # of the cone, a typical pair has a cosine of 0.7
    x = np.concatenate([base, base[:1000] + 0.2 * r.normal(size=(1000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fitted, (m, shared) = pivots.fit(list(x[r.permutation(len(x))]), 1_000_000)
    keys = pivots.list_keys(pivots.orders(x, fitted, m), shared)
    links = hits = 0
    for i in range(0, len(x), 20):
        at = np.flatnonzero(x @ x[i] >= 0.9)
        links, hits = links + len(at) - 1, hits + int(np.isin(keys[at], keys[i]).any(1).sum()) - 1
    assert links > 40 and hits >= 0.9 * links
    assert len(fitted) > 100
    assert np.unique(keys, return_counts=True)[1].max() < len(x) / 2


@pytest.mark.parametrize("kind", ["cone", "clusters", "spread"])
@pytest.mark.parametrize("n", [20_000, 10_000_000])
def test_pivot_recall_without_links_in_the_sample(kind, n):
    """No two sample vectors are near: pairs of held-out vectors, just above the threshold, share a list nevertheless."""
    from pennant.llm import pivots

    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 128 if kind == "clusters" else 64
    centre = {"cone": unit(r.normal(size=(1, d))), "clusters": unit(r.normal(size=(20, d))), "spread": np.zeros((1, d))}[kind]
    like = {"cone": 0.7, "clusters": 0.8, "spread": 0.0}[kind]
    x = unit(like**0.5 * centre[r.integers(0, len(centre), 7000)] + (1 - like) ** 0.5 * unit(r.normal(size=(7000, d))))
    fitted, (m, shared) = pivots.fit(list(x[1000:]), n)
    held = x[:1000]
    _, near = pivots.moved(held, r.normal(size=held.shape), 0.902)
    keys = [pivots.list_keys(pivots.orders(v, fitted, m), shared) for v in (held, near)]
    assert pivots.met(*keys).mean() >= 0.9
    if n > 20_000:
        assert np.unique(keys[0], return_counts=True)[1].max() < 300


def test_pivots_that_say_nothing_compare_everything():
    from pennant.llm import pivots

    r = np.random.default_rng(6)
    x = r.normal(size=64) + 0.4 * r.normal(size=(1500, 64))
    fitted, setting = pivots.fit(list(x), len(x))
    assert setting == pivots.EVERYTHING and len(fitted) == 1


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_are_sets(spark):
    from pyspark.sql import functions as F

    from pennant.llm import fingerprints as f

    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 50), (20, 70), (0, 1500), (500, 2000), (0, 3000), (0, 4), (0, 1))] + ["", None, "  "]
    rows = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    s = spark.createDataFrame(rows, "i int, j int, a string, b string").select("i", "j", f.sketch(F.col("a")).alias("x"), f.sketch(F.col("b")).alias("y"))
    s = s.select("i", "j", "x", f.merge(F.col("x"), F.col("y")).alias("m"), f.resemblance(F.col("x"), F.col("y")).alias("r"), f.containment(F.col("x"), F.col("y")).alias("c"), f.distinct_shingles(F.col("x")).alias("n"))
    for row in s.collect():
        a, b = shingles(texts[row.i]), shingles(texts[row.j])
        exact = len(a | b) <= f.K
        jaccard = len(a & b) / len(a | b) if a | b else 1.0
        inside = len(a & b) / len(a) if a else 1.0
        assert len(row.x) == min(f.K, len(a)) and len(row.m) == min(f.K, len(a | b)) and row.x == sorted(set(row.x))
        assert abs(row.r - jaccard) <= (1e-9 if exact else 0.15)
        assert abs(row.c - inside) <= (1e-9 if exact else 0.3)
        assert row.n == len(a) if len(a) < f.K else abs(row.n / len(a) - 1) < 0.3


def test_sketches_merge_over_parts(spark):
    from pyspark.sql import functions as F

    from pennant.llm import fingerprints as f

    words = [f"w{i}" for i in range(900)]
    whole = " ".join(words)
    parts = [(g, " ".join(words[a : a + 304])) for g in (1, 2) for a in range(0, 900, 300)]  # four words beyond each cut: the parts' shingles are all of the whole's
    sketches = spark.createDataFrame([*parts, (3, None), (3, "")], "g int, text string").select("g", f.sketch(F.col("text")).alias("s"))
    got = {r.g: r.s for r in f.merge_all(sketches, ["g"], "s").collect()}
    want = spark.createDataFrame([(whole,)], "t string").select(f.sketch(F.col("t")).alias("s")).first().s
    assert got == {1: want, 2: want}


def test_edited_texts(spark, monkeypatch):
    from pennant.llm import fingerprints as f

    monkeypatch.setattr(f, "HOT_ROWS", 3)
    texts = {1: prose(1, 60), 4: "é" * 7, 9: prose(2, 30), 12: "", 15: prose(1, 60), 20: None}
    rows = list(texts.items()) + [(30, "hot " + prose(5, 9))] * 5
    got = {}
    for r in f.fingerprint_edits(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, k string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    ids = sorted(got)
    every = {i: t or "" for i, t in rows}
    assert len(got[30]) == 5 and sum(map(len, got.values())) == len(rows)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, nxt = every[i], every[j]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        for r in got[i]:
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert abs(r.near_edited - near(a, b)) < 1e-9 and abs(r.near_next - near(a, c)) < 1e-9
            assert abs(r.kept_in_edited - (len(a & b) / len(a) if a else 1.0)) < 1e-9 and r.n_shingles == len(a)
    assert got[1][0].fingerprint == got[15][0].fingerprint
    assert f.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nameless = f.fingerprint_edits(spark.createDataFrame([(None, prose(i, 9)) for i in range(6)] + [(3, "x")], "doc_id long, text string"))
    assert nameless.count() == 7 and nameless.where("doc_id is null").count() == 6


def brute_pages(rows, least=1000):
    out = []
    for i, h in rows:
        data = (h or "").encode()
        same = [j for j, g in rows if (g or "").encode() == data and j is not None]
        target = max(same, default=None) if len(data) >= least else None
        revisit = target is not None and i != target and len(data) >= least
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return out


def pages_of(spark, rows):
    return spark.createDataFrame([(i, None if k % 3 else f"http://h/{k} x", h, "own") for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, digest string")


def test_archives_against_brute_force(spark, tmp_path):
    from pennant.llm import warc

    big, other = "x" * 1500, "é" * 600
    rows = [(i, big) for i in range(40)] + [(100 + i, other) for i in range(3)] + [(200, None), (201, ""), (202, "small"), (203, "small"), (5, other), (5, "unlike"), (5, big), (None, big), (None, "small"), (39, big), (None, "z" * 2000), (None, "z" * 2000)]
    got = [tuple(r) for r in warc.round_trip(pages_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_pages(rows), key=str)
    path = str(tmp_path / "archive")
    warc.write_archive(pages_of(spark, rows), path, file_bytes=4000)
    files = [f for f in os.listdir(f"{path}/files") if f.endswith(".warc.gz")]
    assert len(files) > 3
    members = 0
    for name in files:
        with open(f"{path}/files/{name}", "rb") as f:
            data = f.read()
        with gzip.open(f"{path}/files/{name}") as f:
            records = list(warc.records(f))
        assert records[0][0]["warc-type"] == "warcinfo"
        members += data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
        for head, _ in records[1:]:
            if head["warc-type"] == "revisit":
                assert {"warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-profile"} <= set(head)
    assert members == len(rows) + len(files)
    whole = warc.read_archive(spark, path, payloads=True).where("record_type = 'response' and payload_bytes > 0").collect()
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in whole)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_a_revisit_of_another_payload_is_an_error(spark, tmp_path):
    from pennant.llm import warc

    path = str(tmp_path / "archive")
    warc.write_archive(pages_of(spark, [(1, "x" * 1500), (2, "x" * 1500)]), path)
    for name in os.listdir(f"{path}/files"):
        if not name.endswith(".warc.gz"):
            continue
        with gzip.open(f"{path}/files/{name}") as f:
            records = list(warc.records(f))
        out = b""
        for head, block in records:
            if head["warc-type"] == "revisit":
                head["warc-payload-digest"] = "sha1:" + "0" * 40
            lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
            out += gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")
        with open(f"{path}/files/{name}", "wb") as f:
            f.write(out)
    with pytest.raises(Exception, match="no response with the payload"):
        warc.read_archive(spark, path).collect()
    assert warc.digest_of("sha1:" + "A" * 32) == "0" * 40


def test_sketches_of_groups_with_names_of_their_own(spark):
    from pyspark.sql import functions as F

    from pennant.llm import fingerprints as f

    rows = spark.createDataFrame([(1, 2, "a b c d e f"), (1, 2, "b c d e f g"), (1, 3, None)], "h int, r int, text string")
    got = {(x.h, x.r): len(x.s) for x in f.merge_all(rows.select("h", "r", f.sketch(F.col("text")).alias("s")), ["h", "r"], "s").collect()}
    assert got == {(1, 2): 3}


def test_smallest_id_is_not_null(spark):
    import hashlib

    from pennant.llm import fingerprints as f

    low = -(2**63)
    docs = spark.createDataFrame([(low, "a b c d"), (None, "e f g h"), (2**63 - 1, "i j k l")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in f.fingerprint_edits(docs).collect()}
    # null comes first, then the smallest long, then the largest, whose next is null again
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in {None: "e f a b", low: "a b i j", 2**63 - 1: "i j e f"}.items()}


def test_archive_names_each_record_once(spark, tmp_path):
    """Rows that repeat page_id and payload, and nameless pages of one payload, are records of their own; revisits find theirs."""
    import gzip
    import io
    from glob import glob

    from pennant.llm import warc

    big = "x" * 2000
    rows = [(1, "u", big), (1, "u", big), (1, "u", big), (2, "u", big), (2, "v", big), (None, "u", "same"), (None, "u", "same"), (None, "u", big), (3, None, "same"), (3, "w", None), (3, "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    ids = [h["warc-record-id"] for f in glob(f"{tmp_path}/a/files/*") for h, _ in warc.records(io.BufferedReader(gzip.open(f))) if h["warc-type"] != "warcinfo"]
    assert len(ids) == len(set(ids)) == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()), key=str)
    want = [(i, len(h or ""), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
