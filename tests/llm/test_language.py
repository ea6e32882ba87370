"""The random field against enumeration, its gradient against differences, accuracy on texts held out."""

import itertools

import numpy as np
import pytest
from fixtures import CLASHES

from pennant.llm import language as L

DOCS = "doc_id long, text string, lang string, source string"
PARTS = {"aa": ["thor", "wick", "ing", "ough", "shy", "lee"], "bb": ["eau", "ième", "ou", "ré", "çon", "elle"], "cc": ["sch", "ung", "keit", "ö", "lich", "ver"]}


def sentence(r, lang, n):
    return [" ".join("".join(r.choice(PARTS[lang], int(r.integers(1, 4)))) for _ in range(1))for _ in range(n)]


def text(r, lang, n):
    return " ".join(sentence(r, lang, n)).capitalize() + "."


def enumerated(scores, start, move):
    """Probabilities of one sequence from all its labellings."""
    n, k = scores.shape
    total, by = 0.0, np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n):
        w = np.exp(start[ys[0]] + sum(scores[i, y] for i, y in enumerate(ys)) + sum(move[a, b] for a, b in itertools.pairwise(ys)))
        total += w
        for i, y in enumerate(ys):
            by[i, y] += w
    return by / total


def test_probabilities_equal_enumeration():
    r = np.random.default_rng(4)
    lengths = np.array([1, 5, 3, 7])
    scores, start, move = r.normal(size=(16, 3)) * 2, r.normal(size=3), r.normal(size=(3, 3))
    got = np.empty((16, 3))
    for _, at, p in L.probabilities(np.exp(scores), lengths, start, move):
        got[at] = p
    ends = np.cumsum(lengths)
    want = np.concatenate([enumerated(scores[e - n : e], start, move) for n, e in zip(lengths, ends, strict=True)])
    assert np.allclose(got, want)


def test_long_texts_in_chunks_and_slabs(monkeypatch):
    """Texts of many chunks against a plain forward-backward, whatever the slabs."""
    r = np.random.default_rng(6)
    lengths = np.array([1, 64, 65, 1000, 63, 128, 4097])
    scores, start, move = r.normal(size=(lengths.sum(), 4)) * 3, r.normal(size=4), r.normal(size=(4, 4))

    def plain(e):
        a, b = np.empty_like(e), np.ones_like(e)
        for t in range(len(e)):
            a[t] = np.exp(e[t]) * (np.exp(start) if t == 0 else a[t - 1] @ np.exp(move))
            a[t] /= a[t].sum()
        for t in range(len(e) - 2, -1, -1):
            b[t] = np.exp(move) @ (np.exp(e[t + 1]) * b[t + 1])
            b[t] /= b[t].sum()
        return (a * b) / (a * b).sum(1, keepdims=True)

    ends = np.cumsum(lengths)
    want = np.concatenate([plain(scores[e - n : e]) for n, e in zip(lengths, ends, strict=True)])
    for slab in (5, 8192):
        monkeypatch.setattr(L, "SLAB", slab)
        got, texts = np.full_like(scores, np.nan), np.empty(len(scores), int)
        for text_of, at, p in L.probabilities(np.exp(scores), lengths, start, move):
            got[at], texts[at] = p, text_of
        assert np.allclose(got, want) and (texts == np.repeat(np.arange(7), lengths)).all()


def test_gradient_equals_differences():
    r = np.random.default_rng(5)
    e, y, start, move = r.normal(size=(2, 6, 3)), r.integers(0, 3, (2, 6)), r.normal(size=3), r.normal(size=(3, 3))
    g_e, g_start, g_move, _ = L.gradient(e, y, start, move)
    for x, g in ((e, g_e), (start, g_start), (move, g_move)):
        for i in np.ndindex(x.shape):
            was = x[i]
            x[i] = was + 1e-5
            up = L.gradient(e, y, start, move)[3]
            x[i] = was - 1e-5
            down = L.gradient(e, y, start, move)[3]
            x[i] = was
            assert abs((up - down) * len(e) / 2e-5 - g[i]) < 1e-5


def test_words():
    of = lambda t: [w.lower() for w in L.words(t) if L.lettered(w)]
    assert of("Ab-c1d É_ß ² Ⅷ x") == ["ab", "c", "d", "é", "ß", "x"]
    assert of(None) == of("12 .. ²") == []
    long = "Word é " * 300_000
    assert of(long) == ["word", "é"] * 300_000


def test_features_are_those_of_the_word_alone():
    """A word's features don't depend on the words beside it, and count its n-grams, affixes, self and lexicon marks."""
    lexicon = {"the": (0b11, 1), "ß": (0b10, 1)}
    found = ["the", "a", "ß", "日本語", "thorough", "x" * 5000]
    at, value, count = L.features(found, lexicon, 2)
    ends = np.cumsum(count)
    for w, n, e in zip(found, count, ends, strict=True):
        one = L.features([w], lexicon, 2)
        assert n == one[2][0] and (at[e - n : e] == one[0]).all() and np.allclose(value[e - n : e], one[1])
        marks = 1 + bin(lexicon[w][0]).count("1") if w in lexicon else 1
        grams = sum(max(0, len(w) + 2 - k + 1) for k in (2, 3, 4))
        assert n == grams + 2 * min(3, len(w)) + 1 + marks
        assert np.isclose(np.sort(value[e - n : e])[:grams].max() if grams > 4 else 0.5, 2 / grams**0.5 if grams > 4 else 0.5)


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(9)
    langs = list(PARTS)
    rows = [(i, text(r, langs[i % 3], int(r.integers(5, 90))), langs[i % 3], "s") for i in range(400)]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 34 ²!", "cc", None), (None, rows[0][1], "bb", "s"), (7, rows[1][1], None, "s"), (7, rows[1][1], None, "s"), (1003, text(r, "cc", 150_000), "cc", "s"), (1004, "x" * 300_000, "aa", "s")]
    return rows + odd


def test_accuracy_and_edges(spark, table):
    """Accuracy on the fold that isn't learnt from; nulls, no letters, repeated rows, one very long text and word."""
    df = spark.createDataFrame(table, DOCS)
    got = L.languages(df).collect()
    assert len(got) == len(table)
    lang = {(r[0]): r[2] for r in table}
    held = [g for g in got if g.held_out and lang[g.doc_id] and g.doc_id < 1000]
    assert len(held) > 50 and np.mean([g.lang_pred == lang[g.doc_id] for g in held]) >= 0.99
    by = {g.doc_id: g for g in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "cc" and by[None].lang_pred == "aa" and not by[None].held_out
    assert all(0 <= g.score <= 1 for g in got) and {g.lang_pred for g in got} <= {*PARTS, "und"}
    wide = df.limit(50).selectExpr("*", *[f"'{v}' AS {c}" for c, v in CLASHES.items()])
    kept = L.identify(wide, L.train(df)).collect()
    assert all(r.found == "own found" and r.score <= 1 and r.ids == "own ids" for r in kept)


def test_held_out_labels_are_not_read(spark, table):
    df = spark.createDataFrame(table[:300], DOCS)
    other = spark.createDataFrame([(i, t, "zz" if i is not None and __import__("zlib").crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in table[:300]], DOCS)
    plain = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in L.languages(d).collect())
    assert plain(df) == plain(other)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "ab cd", None, "s"), (2, None, "aa", "s")], DOCS)
    assert sorted(tuple(r) for r in L.languages(df).collect()) == [(1, False, "und", 0.0), (2, False, "und", 0.0)]
    assert L.languages(df.where("false")).collect() == []


def test_code_switches(spark, table):
    """Runs of words in a text that changes its language."""
    model = L.train(spark.createDataFrame(table[:400], DOCS))
    r = np.random.default_rng(12)
    pieces = [("aa", 30), ("cc", 20), ("bb", 40), ("aa", 15)]
    mixed = " ".join(w for lang, n in pieces for w in sentence(r, lang, n))
    runs = L.code_switches(spark.createDataFrame([(1, mixed), (2, None), (3, "77")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert not runs[1].runs and not runs[2].runs
    truth = [lang for lang, n in pieces for _ in range(n)]
    got = [x.lang for x in runs[0].runs for _ in range(x.first, x.last + 1)]
    assert len(got) == len(truth) and np.mean([a == b for a, b in zip(got, truth, strict=True)]) > 0.95
    assert [x.lang for x in runs[0].runs] == ["aa", "cc", "bb", "aa"]
