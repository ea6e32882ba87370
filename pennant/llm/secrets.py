"""Secrets: assignments, access keys and hexadecimal strings, and strings that look random.

The method takes every run of at least MIN_LENGTH encoding characters, infers its encoding, and
measures how random its symbols look: a chi-squared test of the alphabet's uniformity, a runs test
around the median and a test of the serial correlation, a test of equal pairs, one of neighbours and two
of letters and pairs of letters as in words, joined by Bonferroni's bound.

What is reported are discoveries against the hypothesis that a candidate is wordlike: put together
from words of the table, as identifiers are. A chain over pairs of letters is fitted on all texts (without the
candidates themselves); NULLS strings of it, for each stratum of encoding and length, give the
distribution of the battery's p-value for wordlike strings. Per stratum the Benjamini-Hochberg procedure
over all candidates of the table picks those that look more random than wordlike strings do: RATES bounds,
by length, the expected share of wordlike strings among those that are reported, as far as identifiers
are like the chain's strings; those of words that the texts lack are reported more often. A string whose
randomness the battery rejects at LEVEL is never reported. The other error, random strings that are not
reported, falls with the length and rises the rarer they are among the candidates of their stratum; the
tests measure it. Where the candidates of a stratum are all but wordlike, a secret among them can stay below what
NULLS strings resolve.

Null texts are empty; empty texts hold nothing; repeated rows get the same result each, and each
counts in the procedure. An empty table gives no rows; other columns stay, but for text and those that
the results replace. Texts of any length are scanned whole; without letters the chain is that of English.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import arrow_batches, deal, replaced, spare, written
from pennant.llm.spans import SPANS, Span, as_arrow, joined, ordered

#: "random" is the kind of the spans that the method adds.
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "random"]

_ASSIGN = re.compile(r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

MIN_LENGTH = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}")
#: The share of reported strings that may be wordlike, by length (from 20, 40, 80 on): short ones are the
#: hardest to tell apart, so more is allowed there.
RATES = [0.1, 0.03, 0.01]
#: No string is reported whose randomness is rejected at this level.
LEVEL = 1e-3
#: Wordlike strings by which the p-values of a stratum are measured, and in how many parts they are made.
NULLS, PARTS = 8192, 16
#: Length classes, STEPS to a doubling from MIN_LENGTH; the last one has no end.
STEPS, LENGTHS = 4, 13
#: p-values are counted in bins of this many to a power of ten, down to 1e-LOWEST.
BINS, LOWEST = 8, 16

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the narrowest: name, alphabet, what a string has to hold, classes for the test of uniformity.
ENCODINGS = [
    ("hex", _DIGITS + "abcdef", [_DIGITS, "abcdef"], [_DIGITS, "abcdef"]),
    ("HEX", _DIGITS + "ABCDEF", [_DIGITS, "ABCDEF"], [_DIGITS, "ABCDEF"]),
    ("base32", _UPPER + "234567", [_UPPER, "234567"], [_UPPER, "234567"]),
    ("base36", _DIGITS + _LOWER, [_DIGITS, _LOWER], [_DIGITS, _LOWER]),
    ("BASE36", _DIGITS + _UPPER, [_DIGITS, _UPPER], [_DIGITS, _UPPER]),
    ("base26", _LOWER, [_LOWER], [_LOWER]),
    ("BASE26", _UPPER, [_UPPER], [_UPPER]),
    ("base52", _UPPER + _LOWER, [_UPPER, _LOWER], [_UPPER, _LOWER]),
    ("base62", _UPPER + _LOWER + _DIGITS, [_UPPER, _LOWER, _DIGITS], [_UPPER, _LOWER, _DIGITS]),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", [_UPPER, _LOWER], [_UPPER, _LOWER, _DIGITS + "+/"]),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", [_UPPER, _LOWER], [_UPPER, _LOWER, _DIGITS + "-_"]),
]
_SETS = [(name, frozenset(alphabet), [frozenset(n) for n in need], {c: i for i, c in enumerate(alphabet)}, [frozenset(c) for c in classes]) for name, alphabet, need, classes in ENCODINGS]


def encoding(symbols: set[str]) -> int | None:
    """The narrowest encoding that has all the symbols and of which each kind of symbol occurs."""
    for i, (_, alphabet, need, _, _) in enumerate(_SETS):
        if symbols <= alphabet and all(symbols & n for n in need):
            return i
    return None


#: Per cent of each letter in English text, a to z.
_ENGLISH = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
_LETTER = {c: math.log(f) for c, f in zip(_LOWER, _ENGLISH, strict=True)} | {c: math.log(f) for c, f in zip(_UPPER, _ENGLISH, strict=True)}
#: Pairs of letters that are common in English, German, French or Spanish words.
_COMMON = frozenset("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ei ie ge be un ic li sc au ne da ss ai qu me ll ui em la el ue co ta ad ci do lo os io ma ri ro ce ec om il us".split())
_LETTER_MEAN = sum(map(math.log, _ENGLISH)) / 26
_LETTER_VARIANCE = sum((math.log(f) - _LETTER_MEAN) ** 2 for f in _ENGLISH) / 26


def _poisson_tail(x: float, mean: float) -> float:
    """Probability that a Poisson variable is at least x; by the normal distribution for large means."""
    if mean > 200:
        return 0.5 * math.erfc((x - 0.5 - mean) / math.sqrt(2 * mean))
    term, total, i = math.exp(x * math.log(mean) - mean - math.lgamma(x + 1)), 0.0, x
    while term > 1e-18 * total or i < mean:
        total, i = total + term, i + 1
        term *= mean / i
    return min(1.0, total)


def _chi_squared_tail(x: float, df: int) -> float:
    """Probability that a chi-squared variable with df degrees of freedom exceeds x (Wilson and Hilferty)."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str, which: int) -> float:
    """p-value of the hypothesis that the token's symbols are independent and uniform over the alphabet."""
    _, alphabet, _, order, classes = _SETS[which]
    n, k = len(token), len(alphabet)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    by_class = [(sum(counts.get(c, 0) for c in cl), n * len(cl) / k) for cl in classes]
    ps = [_chi_squared_tail(sum((o - e) ** 2 / e for o, e in by_class), len(classes) - 1)] if len(classes) > 1 else []
    # all symbols: the count of equal pairs is about a Poisson variable where expected counts are small
    pairs, mean = sum(v * (v - 1) for v in counts.values()) / 2, n * (n - 1) / 2 / k
    ps.append(_poisson_tail(pairs, mean))
    values = [order[c] - (k - 1) / 2 for c in token]
    high = [v > 0 for v in values]
    above = sum(high)
    below = n - above
    if above and below:
        expected = 1 + 2 * above * below / n
        spread = 2 * above * below * (2 * above * below - n) / (n * n * (n - 1))
        runs = 1 + sum(a != b for a, b in pairwise(high))
        ps.append(_two_sided((runs - expected) / math.sqrt(max(spread, 1e-9))))
    else:
        ps.append(2.0 ** (1 - n))
    variance = (k * k - 1) / 12
    ps.append(_two_sided(sum(a * b for a, b in pairwise(values)) / (variance * math.sqrt(n - 1))))
    # neighbours of one class: long stretches of letters or digits alone are not random
    kind = [next(i for i, cl in enumerate(classes) if c in cl) for c in token]
    same = sum((len(cl) / k) ** 2 for cl in classes)
    kept = sum(a == b for a, b in pairwise(kind))
    if len(classes) > 1:
        ps.append(0.5 * math.erfc((kept - same * (n - 1)) / math.sqrt(2 * same * (1 - same) * (n - 1))))
    # letters and pairs of letters as frequent as in words
    letters = [_LETTER[c] for c in token if c in _LETTER] if k >= 26 else []
    if letters:
        ps.append(0.5 * math.erfc((sum(letters) - len(letters) * _LETTER_MEAN) / math.sqrt(2 * len(letters) * _LETTER_VARIANCE)))
        low = token.lower()
        both = [low[i : i + 2] for i in range(n - 1) if token[i] in _LETTER and token[i + 1] in _LETTER]
        if both:
            ps.append(_poisson_tail(sum(b in _COMMON for b in both), len(both) * len(_COMMON) / 676))
    return min(1.0, len(ps) * min(ps))


def stratum(which: int, length: int) -> int:
    """Encoding and length class as one number."""
    return which * LENGTHS + min(LENGTHS - 1, int(STEPS * math.log2(length / MIN_LENGTH)))


def shortest(stratum: int) -> int:
    """The least length of a stratum's strings: those that look most random, whatever they are."""
    return math.ceil(MIN_LENGTH * 2 ** (stratum % LENGTHS / STEPS))


def _bin(p: float) -> int:
    return min(LOWEST * BINS, max(0, int(-math.log10(max(p, 1e-300)) * BINS)))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(found, KINDS)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """start, end, stratum and p-value's bin of the strings whose randomness is tested; none touches a base span."""
    out, i = [], 0
    ends: list[tuple[int, int]] = []
    for _, a, b in base:
        if ends and a < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(ends) and ends[i][1] <= a:
            i += 1
        if i < len(ends) and ends[i][0] < b:
            continue
        token = m[0].rstrip("=")
        which = encoding(set(token))
        if which is not None:
            out.append((a, b, stratum(which, len(token)), _bin(randomness(token, which))))
    return out


#: States of the chain of letters: a to z, and all that isn't a letter.
_STATES, _BETWEEN = 27, 26
_STATE = np.full(256, _BETWEEN, np.int64)
_STATE[[ord(c) for c in _LOWER + _UPPER]] = [*range(26), *range(26)]
#: The chain's weight, in letters, before any text is seen: English letters, common pairs more often, words of five letters.
PRIOR = 1000


def letter_pairs(text: str) -> np.ndarray:
    """How often each pair of states follows in the text, without its candidates."""
    codes = _STATE[np.frombuffer(f" {_CANDIDATE.sub(' ', text)} ".encode("ascii", "replace"), np.uint8)]
    return np.bincount(codes[:-1] * _STATES + codes[1:], minlength=_STATES * _STATES)


def chain(counts: dict[int, int]) -> list[list[float]]:
    """Weights of the next state by state, from counts of pairs and the prior."""
    share = [f / sum(_ENGLISH) for f in _ENGLISH]
    out = []
    for i in range(_STATES):
        row = [PRIOR / _STATES * f * (4 if i < 26 and _LOWER[i] + _LOWER[j] in _COMMON else 1) for j, f in enumerate(share)]
        row = [w + counts.get(i * _STATES + j, 0) for j, w in enumerate(row)]
        out.append([*row, 0.0 if i == _BETWEEN else PRIOR / _STATES / 4 + counts.get(i * _STATES + _BETWEEN, 0)])
    return out


class Wordlike:
    """Strings of an encoding that are put together from words of the chain, as identifiers are."""

    def __init__(self, weights: list[list[float]], which: int):
        name, alphabet, *_ = _SETS[which]
        self.which = which
        self.upper = not alphabet & set(_LOWER)
        self.mixed = bool(alphabet & set(_UPPER)) and not self.upper
        self.digits = [c for c in _DIGITS if c in alphabet]
        self.marks = [c for c in "+/-_" if c in alphabet]
        fits = [c in alphabet or c.upper() in alphabet for c in _LOWER] + [True]
        self.sums = [list(accumulate(w if ok else 0.0 for w, ok in zip(row, fits, strict=True))) for row in weights]

    def _word(self, draw: random.Random) -> str:
        out, state = "", _BETWEEN
        while True:
            sums = self.sums[state]
            state = min(_BETWEEN, bisect_right(sums, draw.random() * sums[-1]))
            if state == _BETWEEN:
                return out
            out += _LOWER[state]

    def _drawn(self, draw: random.Random, n: int) -> str:
        out, capitals = "", draw.random() < 0.5
        while len(out) < n:
            word = self._word(draw)
            if self.upper:
                word = word.upper()
            elif self.mixed and (out or capitals):
                word = word[:1].upper() + word[1:]
            out += word
            if self.digits and draw.random() < 0.3:
                out += "".join(draw.choice(self.digits) for _ in range(draw.randint(1, 4)))
            if self.marks and draw.random() < 0.5:
                out += draw.choice(self.marks)
        return out[:n]

    def draw(self, draw: random.Random, n: int) -> str:
        """A string of n symbols, if possible one of which the encoding is inferred."""
        for _ in range(20):
            out = self._drawn(draw, n)
            if encoding(set(out)) == self.which:
                break
        return out


_TESTED = "array<struct<start:int,end:int,stratum:int,bin:int>>"
_TESTED_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]))
_PAIRS = "array<struct<pair:int,n:bigint>>"
_PAIRS_TYPE = pa.list_(pa.struct([("pair", pa.int32()), ("n", pa.int64())]))


def _scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Base spans and tested candidates of each text; the first row of a batch holds the batch's pairs of letters."""
    for batch in batches:
        texts = [t.as_py() or "" for t in batch]
        base = [base_spans(t) for t in texts]
        tested = [[dict(zip(("start", "end", "stratum", "bin"), c, strict=True)) for c in candidates(t, b)] for t, b in zip(texts, base, strict=True)]
        total = sum(map(letter_pairs, texts), np.zeros(_STATES * _STATES, np.int64))
        pairs = [[{"pair": int(i), "n": int(total[i])} for i in np.flatnonzero(total)], *[None] * len(texts)][: len(texts)]
        yield pa.StructArray.from_arrays([as_arrow(base), pa.array(tested, _TESTED_TYPE), pa.array(pairs, _PAIRS_TYPE)], ["base", "tested", "pairs"])


def wordlike_bins(strata: DataFrame, counts: dict[int, int]) -> DataFrame:
    """stratum, bin of NULLS wordlike strings for each stratum, by the chain of the counts of pairs. strata: stratum, each once."""
    weights = chain(counts)

    @F.arrow_udf("array<int>")
    def bins(strata: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for s, part in zip(strata.to_pylist(), parts.to_pylist(), strict=True):
            draw, which = random.Random(f"{s}:{part}"), s // LENGTHS
            words, n = Wordlike(weights, which), shortest(s)
            out.append([_bin(randomness(words.draw(draw, n), which)) for _ in range(NULLS // PARTS)])
        return pa.array(out, pa.list_(pa.int32()))

    parts = deal(strata.select("stratum", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), "stratum", "part")
    return parts.select("stratum", F.explode(bins("stratum", "part")).alias("bin"))


def reported_below(tested: DataFrame, null: DataFrame, rates: list[float] = RATES) -> DataFrame:
    """stratum, below: strings in bins below it are Benjamini and Hochberg's discoveries. tested, null: stratum, bin.

    The p-value of a bin is the share of null's strings, and of the one tested, that look at least as random.
    Only counts by stratum and bin leave the tasks (at most LENGTHS * len(ENCODINGS) * (LOWEST * BINS + 1) rows).
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
        return n.groupBy("stratum").agg(F.collect_list(F.struct("bin", "n")).alias(name))

    upto = lambda bins, b: F.aggregate(F.filter(bins, lambda x: x["bin"] <= b), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    end = F.lit(LOWEST * BINS)
    per = counted(tested, "found").join(counted(null, "wordlike"), "stratum", "left")
    per = per.withColumns({"m": upto("found", end), "nulls": upto(F.coalesce("wordlike", F.slice("found", 1, 0)), end)})
    p = lambda b: (1 + upto(F.coalesce("wordlike", F.slice("found", 1, 0)), b)) / (1 + F.col("nulls"))
    doubling = ((F.col("stratum") % LENGTHS) / STEPS).cast("int")
    rate = F.element_at(F.array(*map(F.lit, rates)), F.least(doubling + 1, F.lit(len(rates))))
    ok = F.transform("found", lambda x: F.when(p(x["bin"]) * F.col("m") <= rate * upto("found", x["bin"]), x["bin"] + 1))
    return per.select("stratum", F.least(F.coalesce(F.array_max(ok), F.lit(0)), F.lit(_bin(LEVEL))).alias("below"))


def secrets(docs: DataFrame, rates: list[float] = RATES) -> DataFrame:
    """docs with base and spans, lists of (kind, start, end); they replace columns of these names, and text goes."""
    arrow_batches(docs.sparkSession)
    scan = F.arrow_udf(_scanned, f"struct<base:{SPANS},tested:{_TESTED},pairs:{_PAIRS}>")
    same = replaced(docs, "base", "spans", "text")
    (seen,) = spare(docs, "seen")
    out = written(docs.select(*same, scan(F.col("text")).alias(seen)))
    # at most _STATES * _STATES rows, and one for each stratum
    counts = out.select(F.explode(F.col(seen)["pairs"]).alias("t")).groupBy("t.pair").agg(F.sum("t.n").alias("n")).collect()
    tested = out.select(F.explode(F.col(seen)["tested"]).alias("t")).select("t.stratum", "t.bin")
    null = wordlike_bins(tested.select("stratum").distinct(), {r.pair: r.n for r in counts})
    limits = reported_below(tested, null, rates).collect()
    table = F.create_map(*[F.lit(v) for r in limits or [(-1, 0)] for v in r])
    kept = F.filter(F.col(seen)["tested"], lambda t: t["bin"] < F.element_at(table, t["stratum"]))
    more = F.transform(kept, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform(F.concat(F.col(seen)["base"], more), lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("rank"), s["end"], s["kind"]))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return out.select(*same, F.col(seen)["base"].alias("base"), spans.alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    found = secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", *map(_count, BASE_KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
