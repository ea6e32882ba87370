"""Byte-level BPE encoding and decoding, with a minimal acyclic transducer as lexicon.

The most frequent words of a corpus are compiled, with their ids as outputs, into an automaton
that shares prefixes and suffixes: the numbers on a word's arcs add up to the word's place in a
table of id lists. Its file is handed to every executor and mapped into memory there. Words that
it lacks are merged exactly, pair by pair in the order of the merges.

Null texts are empty; empty texts have no ids. The string of a special token in a text is that
token. Rows that repeat get the same ids each.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.llm.common import arrow_batches, shared_dir, written

#: Words in the lexicon at most: those that occur most often, in whole classes of about equal counts.
MOST_WORDS = 1 << 16
#: A word that is longer than this many bytes isn't counted, nor remembered: it is merged anew each time.
LONG_WORD = 256

#: The white space of the scheme.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers of Unicode 16, for a Python whose tables are older.
_UNICODE_16 = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
#: Below U+0250 the classes have few ranges, which is faster.
_LATIN_END = 0x250


def _pattern(end: int) -> re.Pattern[str]:
    """Words as the byte-level scheme cuts them: contractions, letters, numbers, other signs, white space.

    end: letters and numbers from this code point on are left out.
    """

    def ranges(kept) -> str:
        out: list[list[int]] = []
        for c in range(end):
            if kept(c):
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
        return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b))) * (b > a) for a, b in out)

    newer = {k: {c for a, b in v for c in range(a, b + 1)} for k, v in _UNICODE_16.items()}
    letters, numbers = (ranges(lambda c, k=k: unicodedata.category(chr(c))[0] == k or c in newer[k]) for k in "LN")
    space = "".join(map(chr, _SPACES))
    return re.compile(rf"'(?:[stmd]|re|ve|ll)|\x20?[{letters}]+|\x20?[{numbers}]+|\x20?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


_LATIN = _pattern(_LATIN_END)
_BEYOND = re.compile(f"[^{chr(0)}-{chr(_LATIN_END - 1)}]")


@cache
def _any() -> re.Pattern[str]:
    return _pattern(0x110000)


def words(text: str) -> list[str]:
    return (_any() if _BEYOND.search(text) else _LATIN).findall(text)


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files: itself, or the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What a tokenizer file says: the bytes of each id, the ids of single bytes, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        known = {"normalizer": told.get("normalizer") is None, "model": told["model"].get("type", "BPE") == "BPE"}
        known |= {k: not told["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")}
        split = told.get("pre_tokenizer") or {}
        known["pre_tokenizer"] = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        known["added_tokens"] = not any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if odd := [k for k, good in known.items() if not good]:
            raise ValueError(f"{path}: settings that this encoder doesn't follow: {', '.join(odd)}")
        sign = byte_signs()
        ids: dict[str, int] = told["model"]["vocab"]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(map(sign.__getitem__, token)) if all(c in sign for c in token) else token.encode()
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.special = special
        self.single = [0] * 256
        for c, b in sign.items():
            self.single[b] = ids[c]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.merged = [c for _, _, c in merges]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: of all mergeable pairs always the first of the lowest rank is merged."""
        ids = [self.single[b] for b in word]
        return self._merge_short(ids) if len(ids) <= 100 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        none = len(self.merged)
        get = self.ranks.get
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [self.merged[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and a linked list of what is left."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.ranks.get
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := get((a, b))) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rank := get((ids[x], ids[y]))) is not None:
                    heappush(heap, (rank, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]


def minimal_automaton(sorted_words: list[bytes]) -> list[tuple[bool, bytes, tuple[int, ...]]]:
    """States (is a word's end, labels, targets) of the smallest automaton of the words; the last is the root.

    Words come in order; the states behind the prefix that a word shares with the one before
    can't change any more, and become an equal state that is known already or a new one.
    """
    known: dict[tuple[bool, bytes, tuple[int, ...]], int] = {}
    path: list[list] = [[False, bytearray(), []]]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            end, labels, targets = path.pop()
            path[-1][2].append(known.setdefault((end, bytes(labels), tuple(targets)), len(known)))

    last = b""
    for word in sorted_words:
        same = 0
        while same < len(last) and last[same] == word[same]:
            same += 1
        close(same)
        for b in word[same:]:
            path[-1][1].append(b)
            path.append([False, bytearray(), []])
        path[-1][0] = True
        last = word
    close(0)
    end, labels, targets = path.pop()
    return [*known, (end, bytes(labels), tuple(targets))]


_HEAD = struct.Struct("<4I")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a lexicon of words (none empty) and their ids."""
    order = sorted(entries)
    states = minimal_automaton(order)
    size: list[int] = []
    start, targets, skipped, labels, ends = [0], [], [], bytearray(), bytearray()
    for end, own, to in states:
        n = int(end)
        for t in to:
            targets.append(t)
            skipped.append(n)
            n += size[t]
        size.append(n)
        labels += own
        ends.append(end)
        start.append(len(targets))
    ids = [entries[w] for w in order]
    id_start = np.cumsum([0, *map(len, ids)])
    flat = [i for x in ids for i in x]
    parts = [np.array(x, "<u4").tobytes() for x in (start, targets, skipped, id_start, flat)]
    return _HEAD.pack(len(states), len(targets), len(order), len(flat)) + b"".join(parts) + bytes(labels) + bytes(ends)


_BYTES = [bytes([b]) for b in range(256)]


class Lexicon:
    """A lexicon file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, n_words, n_ids = _HEAD.unpack_from(self.map)
        view, at = memoryview(self.map), _HEAD.size
        found = []
        for n in (states + 1, arcs, arcs, n_words + 1, n_ids):
            found.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.start, self.targets, self.skipped, self.id_start, _ = found
        self.labels, self.ends, self.root = at, at + arcs, states - 1
        self.ids = at - 4 * n_ids

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers, None if the lexicon lacks it."""
        state, place, base, find = self.root, 0, self.labels, self.map.find
        for b in word:
            arc = find(_BYTES[b], base + self.start[state], base + self.start[state + 1]) - base
            if arc < 0:
                return None
            place += self.skipped[arc]
            state = self.targets[arc]
        if not self.map[self.ends + state]:
            return None
        return self.map[self.ids + 4 * self.id_start[place] : self.ids + 4 * self.id_start[place + 1]]


class Encoder(dict):
    """Ids (as bytes) of the words met lately; others come from the lexicon or are merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.special_ids = {token: struct.pack("<I", i) for token, i in vocabulary.special.items()}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        found = self.lexicon.get(raw) if self.lexicon and len(raw) <= LONG_WORD else None
        if found is None:
            found = array("I", self.vocabulary.merge(raw)).tobytes()
        if len(raw) <= LONG_WORD:
            if len(self) > 400_000:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return b"".join(map(self.__getitem__, words(text)))
        return b"".join(self.special_ids.get(p) or b"".join(map(self.__getitem__, words(p))) for p in self.special.split(text))


@cache
def _lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts, words of at most LONG_WORD bytes; tasks count before anything is shuffled."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if len(w.encode()) <= LONG_WORD]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py() or ""))
                if len(seen) > 300_000:
                    yield counted()
                    seen.clear()
        yield counted()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _put(spark: SparkSession, data: bytes) -> str:
    """Writes data to the shared folder and has every executor fetch it; returns the file's name there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}.lexicon")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(target.toString())
    return target.getName()


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, most_words: int = MOST_WORDS) -> str:
    """Compiles the most frequent words of the texts; returns the name of the file on the executors.

    Words are classed by their counts (eight classes for each doubling), and the highest classes
    that together have most_words words at most are taken: no more than these reach the driver.
    """
    counts = written(word_counts(docs).where("n > 1").withColumn("class", F.floor(F.log2("n") * 8)))
    least, total = None, 0
    for c in counts.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():
        total += c.words
        if total > most_words:
            break
        least = c["class"]
    top = counts.where(F.col("class") >= least).select("word").collect() if least is not None else []
    return _put(docs.sparkSession, compile_lexicon({w: vocabulary.merge(w) for w in (r.word.encode() for r in top)}))


def encode(docs: DataFrame, path: str, most_words: int = MOST_WORDS, col: str = "ids") -> DataFrame:
    """docs with the binary column col (in place of one of that name): the ids of each text as little-endian 32-bit integers. path: tokenizer file."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    name = build_lexicon(docs, vocabulary, most_words)
    held = spark.sparkContext.broadcast(vocabulary)
    arrow_batches(spark)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(held.value, _lexicon(SparkFiles.get(name)))
        for batch in batches:
            yield pa.array([encoder.encode(t.as_py() or "") for t in batch], pa.binary())

    return docs.withColumn(col, run(F.col("text")))


def decode(rows: DataFrame, path: str, ids: str = "ids", col: str = "text") -> DataFrame:
    """rows with the string column col: the text that the ids of a row stand for; bytes that are no UTF-8 become U+FFFD."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(Vocabulary(path).tokens)
    arrow_batches(spark)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = held.value.__getitem__
        for batch in batches:
            yield pa.array([b"".join(map(token, np.frombuffer(i.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace") for i in batch], pa.string())

    return rows.withColumn(col, run(F.col(ids)))


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    out = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return out.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
