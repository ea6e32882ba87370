"""Personal data: identifiers in plain and in disguised writing, with offsets into the source text.

Plain e-mail addresses, IP addresses, payment cards and phone numbers are found in the text as it
is. Then four transducers rewrite the text, each on the output of the one before: homoglyphs and
full-width signs to ASCII, invisible characters dropped; spelled digits to digits (English, German,
French, Spanish); letters that stand for digits inside numbers (O, l, I); "[at]", "(dot)", "arroba" and the
like to "@" and ".". A transducer is a pattern (the automaton of what it consumes) and a function of
a match that gives what it emits, each character with the stretch it was made from. A tape
keeps the way back to the source as runs, one for each stretch of unchanged length, so it stays small for
texts of any length. Identifiers found on the last tape are mapped back, and added where they touch no plain
one of their kind.

Null texts are empty; empty texts hold nothing; repeated rows get the same result each. Other
columns are not read; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import arrow_batches
from pennant.llm.spans import Span, added, as_arrow, by_text, count_of, joined, ordered, redacted

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does: from a later digit of the run it would fail just the same.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, from one @ to the next, in linear time."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 3 or len(part) == 3 and part <= "255"

    return [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def identifiers(text: str) -> list[Span]:
    """The plain identifiers of a text."""
    return ordered(emails(text) + ips(text) + cards(text) + phones(text), KINDS)


# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".", "﹒": ".", "﹫": "@",
}
#: Characters that show nothing.
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
#: Digits in words of English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words that repeat the digit behind them, and words for the plus sign.
REPEATS = {"double": 2, "doble": 2, "doppel": 2, "triple": 3}
PLUS = ["plus", "más", "mas"]
#: Words for the signs of an address; those in AT_PLAIN mean nothing else.
AT_PLAIN = ["arroba", "arobase", "arrobase", "klammeraffe", "ät"]
AT = ["at", "@", *AT_PLAIN]
DOT = ["dot", "punkt", "punto", "point", "."]
#: Letters that stand for digits inside numbers.
LOOKALIKES = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}

#: What an edit puts in place of a stretch: characters, each with the stretch of the tape that it was made from.
Edit = tuple[int, int, list[tuple[str, int, int]]]


class Tape:
    """A rewritten text and its way back. Run i begins at at[i]; its characters came one by one from lo[i] on, or, if hi[i] is set, all from [lo[i], hi[i])."""

    def __init__(self, text: str):
        self.text, self.at, self.lo, self.hi = text, [0], [0], [0]

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the source that the characters a to b were made from."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.lo[i] if self.hi[i] else self.lo[i] + a - self.at[i]
        return start, self.hi[j] or self.lo[j] + b - self.at[j]

    def relabelled(self, text: str) -> Tape:
        """The same runs below a text of the same length."""
        out = Tape(text)
        out.at, out.lo, out.hi = self.at, self.lo, self.hi
        return out

    def _put(self, at: int, lo: int, hi: int) -> None:
        last = len(self.at) - 1
        one = not hi or hi == lo + 1
        if last >= 0 and one and not self.hi[last] and self.lo[last] + at - self.at[last] == lo:
            return  # goes on where the run before ends
        self.at.append(at)
        self.lo.append(lo)
        self.hi.append(0 if one else hi)

    def _copy(self, other: Tape, a: int, b: int, at: int) -> None:
        i = bisect_right(other.at, a) - 1
        while i < len(other.at) and other.at[i] < b:
            start = max(a, other.at[i])
            self._put(at + start - a, other.lo[i] if other.hi[i] else other.lo[i] + start - other.at[i], other.hi[i])
            i += 1

    def edited(self, edits: list[Edit]) -> Tape:
        """The tape with each stretch replaced; edits ascend and don't overlap."""
        out, parts, n, done = Tape(""), [], 0, 0
        out.at, out.lo, out.hi = [], [], []
        for a, b, chars in [*edits, (len(self.text), len(self.text), [])]:
            if a > done:
                out._copy(self, done, a, n)
                parts.append(self.text[done:a])
                n += a - done
            for c, x, y in chars:
                out._put(n, *self.source(x, y))
                parts.append(c)
                n += 1
            done = b
        out.text = "".join(parts)
        return out


class Transducer:
    """Rewrites every leftmost match of the pattern to what emit makes of it; None leaves it as it is. likely: a quick test, in lower case behind a space, of whether any can match."""

    def __init__(self, pattern: str, emit: Callable[[re.Match], list | None], likely: str | None = None):
        self.pattern, self.emit, self.likely = re.compile(pattern), emit, re.compile(likely) if likely else None

    def __call__(self, tape: Tape) -> Tape:
        if self.likely and not self.likely.search(" " + tape.text.lower()):
            return tape
        edits = [(m.start(), m.end(), chars) for m in self.pattern.finditer(tape.text) if (chars := self.emit(m)) is not None]
        return tape.edited(edits) if edits else tape


def _any(words) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


def _prefixes(words) -> str:
    """The same with common beginnings taken out, which is faster to search for."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    optional = "?" if by_first.pop("", None) else ""
    branches = [re.escape(c) + (_prefixes(rest) if any(rest) else "") for c, rest in sorted(by_first.items())]
    return f"(?:{'|'.join(branches)}){optional}"


_NUMBER, _TIMES, _PLUS = _any(DIGITS), _any(REPEATS), _any(PLUS)
_PART = re.compile(rf"(?i){_PLUS}|{_TIMES}|{_NUMBER}|[0-9]+|[^0-9a-zà-ü]+")
_WORDS = {k.casefold(): v for k, v in DIGITS.items()}


def _ascii(c: str) -> str | None:
    """What a character that isn't ASCII stands for, or None."""
    if c in INVISIBLE:
        return ""
    digit = unicodedata.decimal(c, None)
    plain = HOMOGLYPHS.get(c) or (str(digit) if digit is not None else unicodedata.normalize("NFKC", c))
    return plain if plain != c and plain.isascii() else None


class _Letters(dict):
    """For str.translate: what each character stands for if that is one character, else itself."""

    def __missing__(self, code: int) -> str:
        plain = _ascii(chr(code)) if code > 127 else None
        out = self[code] = plain if plain and len(plain) == 1 else chr(code)
        return out


_LETTERS = _Letters()


def letters(tape: Tape) -> Tape:
    """The transducer of single characters. Most keep their length: they are put in place at once, and the runs stay."""
    if not _ODD.search(tape.text):
        return tape
    plain = tape.text.translate(_LETTERS)
    return _LONGER(tape if plain == tape.text else tape.relabelled(plain))


def _spelled(m: re.Match) -> list | None:
    chars: list[tuple[str, int, int]] = []
    times, spelled = 1, 0
    for t in _PART.finditer(m.string, m.start(), m.end()):
        word, a, b = t[0].casefold(), t.start(), t.end()
        if word in PLUS:
            chars.append(("+", a, b))
        elif word in REPEATS:
            times = REPEATS[word]
        elif word in _WORDS:
            chars += [(_WORDS[word], a, b)] * times
            times, spelled = 1, spelled + 1
        elif word[0] in "0123456789":
            chars += [(c, a + i, a + i + 1) for i, c in enumerate(word)]
            times = 1
        elif "." in word:
            chars.append((".", a, b))
    return chars if spelled else None


def _lookalike(m: re.Match) -> list | None:
    letters = sum(c in LOOKALIKES for c in m[0])
    if not letters or 2 * letters > sum(c.isalnum() or c == "|" for c in m[0]):
        return None
    return [(LOOKALIKES.get(c, c), m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]


#: Characters that the first transducer may rewrite: none of the common Latin letters.
_ODD = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0, 0xAC), (0xAE, 0x130), (0x132, 0x24F))) + "]")
#: Those of them that stand for none or several characters.
_LONGER = Transducer("[" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x20000)) if _ODD.match(c) and (p := _ascii(c)) is not None and len(p) != 1) + "]", lambda m: [(x, m.start(), m.end()) for x in _ascii(m[0])])
_BEYOND_DOT = rf"(?=[a-z0-9-]+(?:\x20?[\[({{<]\x20?(?:{_any(DOT)})|\x20(?:{_any(DOT[:3])})\x20"
_SIGNS = rf"""(?xi)
    \x20? [\[({{<] \x20? (?: (?P<at>{_any(AT)}) | (?:{_any(DOT)}) ) \x20? [\])}}>] \x20?
  | (?<=[a-z0-9]) \x20 (?: (?P<at2>at) \x20 {_BEYOND_DOT})) | (?P<at3>{_any(AT_PLAIN)}) \x20 {_BEYOND_DOT}|\.[a-z0-9]))
    | (?:{_any(DOT[:3])}) \x20 (?=[a-z0-9]) )"""

TRANSDUCERS: list[Callable[[Tape], Tape]] = [
    letters,
    # three or more spelled or written digits in a row, at least one of them spelled
    Transducer(
        rf"(?i)\b(?:(?:(?:{_PLUS})[\x20-])?(?:(?:(?:{_TIMES})[\x20-])?(?:{_NUMBER})|[0-9]+)[\x20,.-]{{1,2}}){{2,}}(?:(?:{_TIMES})[\x20-])?(?:(?:{_NUMBER})\b|[0-9]+)",
        _spelled,
        rf"[^a-z0-9à-ü](?:{_prefixes(DIGITS)})[\x20,.-]{{1,2}}(?:{_TIMES}|{_prefixes(DIGITS)}|[0-9])",
    ),
    Transducer(r"(?<![A-Za-z0-9|])\+?[0-9OolI|](?:[\x20().-]{0,2}[0-9OolI|]){6,}(?![A-Za-z0-9|])", _lookalike, r"[oli|][\x20().-]{0,2}[0-9]|[0-9][\x20().-]{0,2}[oli|]"),
    Transducer(_SIGNS, lambda m: [("@" if m["at"] or m["at2"] or m["at3"] else ".", m.start(), m.end())], rf"[\[({{<]\x20?(?:{_any(AT + DOT)})\x20?[\])}}>]|\x20(?:{_prefixes(DOT[:3] + AT_PLAIN)})\x20"),
]


def disguised(text: str) -> list[Span]:
    """Identifiers of the rewritten text, mapped to the source; nothing where no rewriting applies."""
    tape = first = Tape(text)
    for t in TRANSDUCERS:
        tape = t(tape)
    return [] if tape is first else [(k, *tape.source(a, b)) for k, a, b in identifiers(tape.text)]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all its spans."""
    base = identifiers(text)
    return base, ordered(base + added(base, disguised(text)), KINDS)


def personal_data(docs: DataFrame, col: str = "found") -> DataFrame:
    """docs with the struct col (in place of one of that name): base and spans, lists of (kind, start, end)."""
    arrow_batches(docs.sparkSession)
    return docs.withColumn(col, by_text(find)(F.col("text")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each identifier of the text replaced by its kind; texts without one, and nulls, stay."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else redacted(t, find(t)[1]) for t in batch.to_pylist()], pa.string())

    return docs.withColumn("text", run(F.col("text")))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    found = personal_data(docs.select("doc_id", "text")).select("doc_id", "found.*")
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
