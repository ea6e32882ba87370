"""Personal data and secrets: the contract's regexes on random strings, offsets, p-values and the procedure by hand."""

import hashlib
import math
import re

import numpy as np
import pytest
from fixtures import CLASHES, clashing, frame

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRETS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0


def digits(s):
    return sum(c.isdigit() for c in s)


GOOD = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
    "card": lambda m: 12 <= digits(m[0]) <= 19 and luhn(m[0]),
    "phone": lambda m: 9 <= digits(m[0]) <= 15,
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "hex": lambda m: len(m[0]) >= 24,
}


def by_regex(text, patterns):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if GOOD[k](m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def strings(pieces, n, most, seed):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(pieces, r.integers(0, most))) for _ in range(n)]


PII_PIECES = ["a", "B.", "@", "x@y.z", ".", "-", "1", "23", "255", "256.", "4111 1111 1111 1111", "+", "+49 ", "(0)", " ", "é", "5-5", "0000", "10.0.0.1"]
SECRET_PIECES = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "0f", "AKIA", "ABCDEFGH", "a1b2c3d4e5f6", "/", "é", "\n", "_"]


def test_base_spans_of_personal_data_are_the_regexes(spark):
    from pennant.llm import pii

    texts = strings(PII_PIECES, 20000, 14, 1)
    for t in texts:
        assert pii.identifiers(t) == by_regex(t, PII)
    some = [*texts[:300], None, "", "x" * 100_000 + " a@b.c"]
    got = {r.doc_id: r for r in pii.span_digests(frame(spark, some)).collect()}
    for i, t in enumerate(some):
        base = by_regex(t or "", PII)
        assert [got[i][f"n_{k}"] for k in PII] == [sum(s[0] == k for s in base) for k in PII]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[i].spans.split(","))


def test_base_spans_of_secrets_are_the_regexes(spark):
    from pennant.llm import secrets

    texts = strings(SECRET_PIECES, 20000, 14, 2)
    for t in texts:
        assert secrets.base_spans(t) == by_regex(t, SECRETS)
    some = [*texts[:300], None, ""]
    got = {r.doc_id: r for r in secrets.secret_digests(frame(spark, some)).collect()}
    for i, t in enumerate(some):
        base = by_regex(t or "", SECRETS)
        assert [got[i][f"n_{k}"] for k in SECRETS] == [sum(s[0] == k for s in base) for k in SECRETS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


#: Text, and what is found of it in the source.
DISGUISES = [
    ("write to bob arroba example punto com now", "email", "bob arroba example punto com"),
    ("bob [at] example [dot] com", "email", "bob [at] example [dot] com"),
    ("kontakt (ät) firma (punkt) de", "email", "kontakt (ät) firma (punkt) de"),
    ("ana arobase exemple.fr", "email", "ana arobase exemple.fr"),
    ("bоb@exаmple.com", "email", "bоb@exаmple.com"),
    ("b​ob@exam­ple.com!", "email", "b​ob@exam­ple.com"),
    ("ring plus four nine one seven six double one two three four five", "phone", "plus four nine one seven six double one two three four five"),
    ("plus quatre neuf un sept six un deux trois quatre", "phone", "plus quatre neuf un sept six un deux trois quatre"),
    ("más tres cuatro seis uno dos tres cuatro cinco seis", "phone", "más tres cuatro seis uno dos tres cuatro cinco seis"),
    ("plus vier neun eins sieben sechs null zwei drei vier", "phone", "plus vier neun eins sieben sechs null zwei drei vier"),
    ("4l11 1lll 1111 11I1", "card", "4l11 1lll 1111 11I1"),
    ("１０.0.0.1", "ip", "１０.0.0.1"),
    ("10 punto 0 punto 0 punto 1", "ip", "10 punto 0 punto 0 punto 1"),
]


@pytest.mark.parametrize(("text", "kind", "found"), DISGUISES)
def test_disguises_map_back_to_the_source(text, kind, found):
    from pennant.llm import pii

    base, spans = pii.find(f"é {text}")
    assert base == [] and [(k, f"é {text}"[a:b]) for k, a, b in spans] == [(kind, found)]


def test_plain_words_are_left_alone():
    from pennant.llm import pii

    for t in ["we met at the point of no return", "one two three four", "un deux trois", "look at dot com", "O Il lol oil", "the 3 l0l", "привет, как дела"]:
        assert pii.find(t) == ([], [])


def test_tape_keeps_offsets_of_composed_edits():
    from pennant.llm import pii

    r = np.random.default_rng(4)
    for _ in range(500):
        tape = pii.Tape("x" * int(r.integers(1, 30)))
        want = [(i, i + 1) for i in range(len(tape.text))]
        for _ in range(3):
            edits, new, at = [], [], 0
            while at < len(want):
                b = min(len(want), at + int(r.integers(1, 4)))
                if r.random() < 0.5:
                    stretches = [(at, b)] * int(r.integers(0, 3))
                    edits.append((at, b, [("y", x, y) for x, y in stretches]))
                    new += [(want[x][0], want[y - 1][1]) for x, y in stretches]
                else:
                    new += want[at:b]
                at = b
            tape, want = tape.edited(edits), new
            assert [tape.source(i, i + 1) for i in range(len(tape.text))] == want


def test_scans_keep_clashing_columns(spark):
    from pennant.llm import pii, secrets

    docs = clashing(spark, ["mail a@b.cd", "password=abcdef1", None, ""])
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.where("doc_id = 0").first().text == "mail <EMAIL>"
    found = pii.personal_data(docs, "pii")
    assert all(r[c] == v for r in found.collect() for c, v in CLASHES.items())
    out = secrets.secrets(docs)
    assert all(r[c] == v for r in out.collect() for c, v in CLASHES.items() if c not in ("base", "spans"))
    assert out.where("doc_id = 1").first().base[0].kind == "assign"
    for empty in (pii.redact(docs.limit(0)), pii.span_digests(docs.limit(0)), secrets.secret_digests(docs.limit(0))):
        assert empty.count() == 0


def test_p_values_by_hand():
    from pennant.llm import secrets

    # Poisson: P(X >= 3), mean 2; chi-squared with 2 degrees: exp(-x / 2); a normal's two sides
    assert math.isclose(secrets._poisson_tail(3, 2.0), 1 - math.exp(-2) * (1 + 2 + 2), rel_tol=1e-9)
    assert math.isclose(secrets._chi_squared_tail(5.0, 2), math.exp(-2.5), rel_tol=0.03)
    assert math.isclose(secrets._two_sided(1.959964), 0.05, rel_tol=1e-4)
    hexes = secrets.encoding(set("0123456789abcdef"))
    # one symbol only: all 276 pairs are equal where 17.25 are expected
    assert secrets.randomness("a" * 24, hexes) < 1e-100
    # 0f0f...: 24 runs where 13 are expected, with a standard deviation of 2.4
    assert secrets.randomness("0f" * 12, hexes) < 1e-5
    r = np.random.default_rng(8)
    ps = [secrets.randomness("".join(r.choice(list("0123456789abcdef"), 40)), hexes) for _ in range(2000)]
    assert sum(p < 0.01 for p in ps) <= 2000 * 0.02  # joined by Bonferroni's bound: at most the level, but for approximations


def test_procedure_is_benjamini_and_hochberg(spark):
    """Against p-values counted by hand on the wordlike strings; a stratum without any of them reports nothing."""
    from pennant.llm import secrets

    r = np.random.default_rng(9)
    end = secrets.LOWEST * secrets.BINS
    rows, null, want = [], [], {}
    for stratum, share in ((0, 0.9), (5, 0.4), (secrets.LENGTHS + 9, 0.0), (2, 1.0)):
        bins = [int(r.integers(20, end + 1)) if r.random() < share else int(r.integers(0, 9)) for _ in range(400)]
        words = [] if stratum == 2 else [int(r.integers(4, 100)) for _ in range(2000)]
        rows, null = rows + [(stratum, b) for b in bins], null + [(stratum, b) for b in words]
        rate = secrets.RATES[min(stratum % secrets.LENGTHS // secrets.STEPS, len(secrets.RATES) - 1)]
        p = lambda b: (1 + sum(w <= b for w in words)) / (1 + len(words))  # noqa: E731, B023
        ok = [b + 1 for b in bins if p(b) * len(bins) <= rate * sum(x <= b for x in bins)]
        want[stratum] = min(max(ok, default=0), secrets._bin(secrets.LEVEL))
    tables = [spark.createDataFrame(x, "stratum int, bin int") for x in (rows, null)]
    assert {x.stratum: x.below for x in secrets.reported_below(*tables).collect()} == want
    assert want[0] and want[2] == 0


#: Identifiers are made of these; the texts that the chain is fitted on hold other words too.
IDENTIFIERS = ["stream", "reader", "table", "handler", "factory", "index", "remote", "value", "user", "name", "config", "search", "window", "result", "message", "buffer", "service", "account", "session", "manager"]
PROSE = "the reader of this table keeps an index of every value while a remote user sends the message and the service answers with the name of the window that the search result belongs to before another session starts"


@pytest.mark.parametrize(("n", "wordlike", "missed"), [(20, 0.12, 0.05), (24, 0.12, 0.03), (32, 0.05, 0.02), (40, 0.02, 0.02), (80, 0.01, 0.01)])
def test_both_errors_by_length(spark, n, wordlike, missed):
    """The share of wordlike strings among the reported ones, and of random strings that aren't reported."""
    from pennant.llm import secrets

    r = np.random.default_rng(n)
    alphabet = list(secrets.ENCODINGS[8][1])
    keys = ["".join(r.choice(alphabet, n)) for _ in range(400)]
    names = ["".join(str(w).title() + (str(r.integers(0, 100)) if r.random() < 0.3 else "") for w in r.choice(IDENTIFIERS, n // 3))[:n] for _ in range(400)]
    docs = frame(spark, [f"{PROSE} {k} and {m}" for k, m in zip(keys, names, strict=True)])
    at = len(PROSE) + 1
    found = {(x.doc_id, s.start) for x in secrets.secrets(docs).collect() for s in x.spans if s.kind == "random"}
    right = sum(start == at for _, start in found)
    assert len(found) - right <= wordlike * max(1, len(found))
    assert 400 - right <= missed * 400


def test_chain_of_letters(spark):
    """Pairs by hand; candidates don't count; strings of every encoding, the same for the same seed."""
    import random

    from pennant.llm import secrets

    pairs = secrets.letter_pairs("Ab é ab " + "x1" * 20)
    state = lambda c: 26 if c == " " else ord(c) - 97
    assert {k: int(pairs[state(k[0]) * 27 + state(k[1])]) for k in (" a", "ab", "b ", "xx")} == {" a": 2, "ab": 2, "b ": 2, "xx": 0}
    assert pairs[: 26 * 27].sum() == 4 and secrets.letter_pairs("").sum() == 1
    weights = secrets.chain({})
    for which in range(len(secrets.ENCODINGS)):
        one, two = (secrets.Wordlike(weights, which).draw(random.Random("7"), 48) for _ in range(2))
        assert one == two and len(one) == 48 and secrets.encoding(set(one)) == which
    for s in range(secrets.LENGTHS * len(secrets.ENCODINGS)):
        assert secrets.stratum(s // secrets.LENGTHS, secrets.shortest(s)) == s
