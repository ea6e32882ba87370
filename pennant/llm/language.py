"""Language identification by a linear-chain conditional random field over words.

A text's words (runs of letters, in lower case) are labelled one by one: a word's score for a
language is the sum of the weights of its features (affixes of one to three letters, n-grams of
two to four, the word itself, the languages whose lexicon of frequent words holds it and the one
where it is most frequent), hashed into BUCKETS; between neighbours stand learned transitions.
Words that are new to a task are scored together, in arrays over all their letters.
Forward-backward gives each word's probabilities. code_switches() returns runs of words of one
language; a whole text's language is the one with the largest mean probability over its words.

The lexicons come from counts over all texts that may be learnt from. The field's weights are learnt
in one task from a bounded sample: for each language one span of SPAN words from each of about
SAMPLE / languages texts, those whose id hashes lowest. Spans of random lengths are strung together
across languages, so that transitions between languages are learnt, and the likelihood's gradient
is followed with a step by feature. The model has a fixed size.

Whole texts are scored: a text is cut into chunks whose products of transfer matrices are computed side by
side, then put together, which is exact and takes memory in proportion to the batch. Null texts and
texts without a letter are und, score 0; so are all where nothing can be learnt. Rows that repeat
an id are scored each by its own text. Columns that aren't named are kept or not read; an empty
table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, arrow_batches, spare

#: Buckets of the feature hash, for each of which a language has a weight.
BITS = 17
BUCKETS = 1 << BITS
#: About how many texts the weights are learnt from, over all languages (never 1.2 times as many), and words of each.
SAMPLE, SPAN = 8192, 48
#: Words of all languages' lexicons at most.
LEXICON = 40_000
#: Words of a training sequence, sequences of a step, passes, step size.
LENGTH, STEP, EPOCHS, RATE = 128, 32, 4, 0.3
#: Words of a chunk, and chunks whose words are looked at together.
CHUNK, SLAB = 64, 8192
#: Words whose scores a task remembers; different words that a task counts before it hands them on.
REMEMBERED, COUNTED = 300_000, 200_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
#: From this many characters on, words are read one by one.
_LONG = 1 << 20


def words(text: str | None) -> list[str] | Iterator[str]:
    """A text's words, as they are written; runs of numerals of other kinds are among them, see lettered()."""
    text = text or ""
    return _WORD.findall(text) if len(text) < _LONG else (m[0] for m in _WORD.finditer(text))


def lettered(word: str) -> bool:
    return word[0].isalpha() or any(map(str.isalpha, word))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(found: list[str], lexicon: dict[str, tuple[int, int]], n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of all words' features, by word, and how many each word has.

    lexicon: word -> bits of the languages that list it, and the one where it is commonest.
    """
    n = len(found)
    size = np.fromiter(map(len, found), np.int64, n) + 2
    end = np.cumsum(size)
    start = end - size
    letters = np.frombuffer("".join(f"<{w}>" for w in found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(n), size)
    left = np.repeat(end, size) - np.arange(len(letters))  # letters from a place to its word's end
    owner, at, value = [], [], []

    def add(own: np.ndarray, hashed: np.ndarray, what: int, values: np.ndarray | float = 1.0) -> None:
        owner.append(own)
        at.append(_bucket(hashed * _A + np.uint64(what * int(_B) % 2**64)))
        value.append(np.broadcast_to(values, len(own)))

    grams = np.maximum(size - 1, 0) + np.maximum(size - 2, 0) + np.maximum(size - 3, 0)
    share = 2.0 / np.sqrt(grams)
    h = letters
    for k in (2, 3, 4):
        h = h[: len(letters) - k + 1] * _B + letters[k - 1 :]
        whole = np.flatnonzero(left[: len(h)] >= k)
        add(word[whole], h[whole], k, share[word[whole]])
    for k in (1, 2, 3):
        some = np.flatnonzero(size - 2 >= k)
        for edge, first in ((0, start[some] + 1), (1, end[some] - 1 - k)):
            h = letters[first]
            for i in range(1, k):
                h = h * _B + letters[first + i]
            add(some, h, 8 + 2 * k + edge)
    add(np.arange(n), np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n), 5)
    listed = [(i, *lexicon[w]) for i, w in enumerate(found) if w in lexicon]
    own = np.array([x[0] for x in listed], np.int64)
    add(own, np.array([x[2] for x in listed], np.uint64), 20)
    for lang in range(n_langs):
        has = np.array([x[1] >> lang & 1 for x in listed], bool)
        add(own[has], np.full(int(has.sum()), lang, np.uint64), 21)
    unlisted = np.ones(n, bool)
    unlisted[own] = False
    add(np.flatnonzero(unlisted), np.zeros(int(unlisted.sum()), np.uint64), 22)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(at)[order], np.concatenate(value)[order], np.bincount(owner, minlength=n)


class Scores(dict):
    """Each written word's number, -1 without a letter; row i of table() is what number i makes each language's odds."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.new, self.done = model, [], np.empty((0, len(model["langs"])))

    def __missing__(self, word: str) -> int:
        if not lettered(word):
            n = self[word] = -1
            return n
        n = self[word] = len(self.done) + len(self.new)
        self.new.append(word.lower())
        return n

    def table(self) -> np.ndarray:
        """exp of the scores, each row's largest 1."""
        parts = [self.done]
        for i in range(0, len(self.new), 20_000):
            at, value, count = features(self.new[i : i + 20_000], self.model["lexicon"], len(self.model["langs"]))
            e = np.add.reduceat(self.model["weights"][at] * value[:, None], np.cumsum(count) - count)
            parts.append(np.exp(e - e.max(1, keepdims=True)))
        self.new, self.done = [], np.concatenate(parts)
        return self.done

    def forget(self) -> None:
        """Between batches: the numbers given so far are no longer used."""
        if len(self.done) > REMEMBERED:
            self.clear()
            self.done = self.done[:0]


def _normal(x: np.ndarray) -> np.ndarray:
    """Vectors (the last axis) by their sums."""
    return x / x.sum(-1, keepdims=True)


def probabilities(odds: np.ndarray | _Lazy, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Forward-backward over texts laid end to end, in slabs of chunks: text numbers, word numbers, probabilities.

    odds: by word, exp of its scores; lengths: words of each text, none 0.
    """
    k = len(start)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    per = -(-lengths // CHUNK)
    text = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = begin[text] + rank * CHUNK
    size = np.minimum(CHUNK, lengths[text] - rank * CHUNK)
    step, enter = np.exp(move - move.max()), np.exp(start - start.max())
    back_step = np.ascontiguousarray(step.T)

    def local(at: slice) -> np.ndarray:
        """The odds of the chunks' words: CHUNK x chunks x languages, 1 behind a chunk's end."""
        where = first[at] + np.arange(CHUNK)[:, None]
        inside = np.arange(CHUNK)[:, None] < size[at]
        out = odds[np.where(inside, where, 0)]
        out[~inside] = 1.0
        return out

    slabs = [slice(i, min(i + SLAB, len(text))) for i in range(0, len(text), SLAB)]
    # what a chunk does to the probabilities in front of it; a text's last chunk is followed by none
    product = np.empty((len(text), k, k))
    if len(lengths) < len(text):
        for at in slabs:
            b, n, fresh = local(at), size[at], rank[at] == 0
            p = np.tile(np.eye(k), (len(n), 1, 1))
            for t in range(int(n.max())):
                p_next = (p.reshape(-1, k) @ step).reshape(p.shape) * b[t][:, None, :]
                if t == 0:
                    p_next[fresh] = (enter * b[0, fresh])[:, None, :]
                if t % 8 == 7:
                    p_next /= p_next.sum((1, 2), keepdims=True)
                over = t >= n
                if over.any():
                    p_next[over] = p[over]
                p = p_next
            product[at] = p / p.sum((1, 2), keepdims=True)
    before, behind = np.full((len(text), k), 1.0 / k), np.ones((len(text), k))
    head = np.flatnonzero(rank == 0)
    for i in range(1, int(per.max(initial=1))):
        c = head[per > i] + i
        before[c] = _normal((before[c - 1, None, :] @ product[c - 1])[:, 0])
        c = head[per > i] + per[per > i] - 1 - i
        behind[c] = _normal((product[c + 1] @ behind[c + 1, :, None])[:, :, 0])
    for at in slabs:
        b, n, fresh = local(at), size[at], rank[at] == 0
        ahead = np.empty_like(b)
        a = before[at]
        for t in range(int(n.max())):
            a = (a @ step) * b[t]
            if t == 0:
                a[fresh] = enter * b[0, fresh]
            a = ahead[t] = _normal(a)
        back = behind[at]
        for t in range(int(n.max()) - 1, -1, -1):
            ahead[t] *= back
            new = (b[t] * back) @ back_step
            new /= new.sum(1, keepdims=True)
            over = t >= n
            if over.any():
                new[over] = back[over]
            back = new
        inside = np.arange(CHUNK) < n[:, None]
        yield np.repeat(text[at], n), (first[at, None] + np.arange(CHUNK))[inside], _normal(ahead.swapaxes(0, 1)[inside])


class _Lazy:
    """Rows of a table of words by the numbers of the words in their texts."""

    def __init__(self, table: np.ndarray, numbers: np.ndarray):
        self.table, self.numbers = table, numbers

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.table[self.numbers[at]]


def gradient(e: np.ndarray, y: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the mean log-likelihood of sequences of one length, by scores, start and moves; and the likelihood itself."""
    s, n, k = e.shape
    peak = e.max(2, keepdims=True)
    b, step = np.exp(e - peak), np.exp(move)
    ahead, scale = np.empty_like(b), np.empty((s, n))
    for t in range(n):
        a = np.exp(start) * b[:, 0] if t == 0 else (ahead[:, t - 1] @ step) * b[:, t]
        scale[:, t] = a.sum(1)
        ahead[:, t] = a / scale[:, t, None]
    back = np.ones((s, k))
    pairs, p = np.zeros((k, k)), np.empty_like(b)
    for t in range(n - 1, -1, -1):
        p[:, t] = ahead[:, t] * back
        if t:
            seen = b[:, t] * back / scale[:, t, None]
            pairs += step * (ahead[:, t - 1].T @ seen)
            back = seen @ step.T
    truth = np.eye(k)[y]
    moves = np.zeros((k, k))
    np.add.at(moves, (y[:, :-1], y[:, 1:]), 1)
    there = np.take_along_axis(e, y[:, :, None], 2).sum() + start[y[:, 0]].sum() + (move * moves).sum()
    return truth - p, (truth - p)[:, 0].sum(0), moves - pairs, float(there - np.log(scale).sum() - peak.sum()) / s


def learn(spans: list[tuple[int, list[str]]], lexicon: dict, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, start and moves from spans of words, each of one language."""
    r = np.random.default_rng(11)
    number: dict[str, int] = {}
    stream, labels = [], []
    for _ in range(EPOCHS):
        for i in r.permutation(len(spans)):
            lang, span = spans[i]
            own = [number.setdefault(w.lower(), len(number)) for w in span[: int(r.integers(1, len(span) + 1))]]
            stream += own
            labels += [lang] * len(own)
    n = max(1, len(stream) // LENGTH)
    stream, labels = (np.resize(np.array(v), (n, LENGTH)) for v in (stream, labels))
    at, value, counts = features(list(number), lexicon, n_langs)
    ends = np.cumsum(counts)
    starts = np.concatenate([[0], ends[:-1]])
    weights, start, move = np.zeros((BUCKETS, n_langs)), np.zeros(n_langs), np.zeros((n_langs, n_langs))
    spent = [np.full_like(x, 1e-2) for x in (weights, start, move)]
    for i in range(0, n, STEP):
        seqs, y = stream[i : i + STEP], labels[i : i + STEP]
        own, where = np.unique(seqs, return_inverse=True)
        count = ends[own] - starts[own]
        places = np.repeat(starts[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        by_word = np.add.reduceat(value[places, None] * weights[at[places]], np.cumsum(count) - count)
        g, g_start, g_move, _ = gradient(by_word[where].reshape(*seqs.shape, n_langs), y, start, move)
        g_word = np.zeros((len(own), n_langs))
        np.add.at(g_word, where.ravel(), g.reshape(-1, n_langs))
        buckets, to = np.unique(at[places], return_inverse=True)
        g_weights = np.zeros((len(buckets), n_langs))
        np.add.at(g_weights, to, value[places, None] * np.repeat(g_word, count, 0))
        for x, own_spent, where_x, d in ((weights, spent[0], buckets, g_weights), (start, spent[1], slice(None), g_start), (move, spent[2], slice(None), g_move)):
            d = d / len(seqs)
            own_spent[where_x] += d * d
            x[where_x] += RATE * d / np.sqrt(own_spent[where_x])
    return weights, start, move


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by language, counted within the task as far as these fit."""
    held: dict[str, Counter[str]] = {}

    def packed() -> pa.RecordBatch:
        rows = Counter()
        for lang, counts in held.items():
            for w, n in counts.items():
                if lettered(w):
                    rows[lang, w.lower()] += n
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words(text))
        if sum(map(len, held.values())) > COUNTED:
            yield packed()
    if held:
        yield packed()


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One span of each text, at a place that its id decides."""
    for batch in batches:
        out = []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = [w for w in words(text) if lettered(w)]
            at = h % max(1, len(found) - SPAN + 1)
            out.append(found[at : at + SPAN])
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(out, pa.list_(pa.string()))], ["h", "lang", "words"])


def train(docs: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> dict:
    """A model from docs (doc_id, text, lang): langs, lexicon, weights, start, move. Rows without a lang or an id aren't learnt from."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    with Scratch(spark) as tmp:
        # texts are read once for the counts; a task hands on each word that it holds once
        counts = tmp.table(docs.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        # one row for each language
        langs = sorted(r.lang for r in totals.select("lang").collect())
        if not langs:
            return {"langs": []}
        # the least count from which on a language's words fit its lexicon: from the number of words of each count
        sizes = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
        down = Window.partitionBy("lang").orderBy(F.desc("n"))
        least = sizes.withColumn("words", F.sum("words").over(down)).where(F.col("words") <= max(1, lexicon // len(langs))).groupBy("lang").agg(F.min("n").alias("least"))
        listed = counts.join(F.broadcast(least), "lang").where(F.col("n") >= F.col("least"))
        rows = listed.join(F.broadcast(totals), "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share")).collect()
        index = {lang: i for i, lang in enumerate(langs)}
        words_of: dict[str, tuple[int, int]] = {}
        for word, of in groupby(sorted(rows, key=lambda r: r.word), key=lambda r: r.word):
            of = list(of)
            words_of[word] = (sum(1 << index[r.lang] for r in of), index[max(of, key=lambda r: (r.share, r.lang)).lang])
        all_ids = tmp.table(docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct())
        share = all_ids.groupBy("lang").agg((F.lit(sample / len(langs)) / F.count("*")).alias("share"))
        # hashes are spread evenly: those below a language's share of their range are about as many as asked for
        picked = all_ids.join(F.broadcast(share), "lang").where(F.shiftrightunsigned("h", 12) < F.col("share") * float(1 << 52))
        ids = tmp.table(picked.select("lang", "doc_id", "h"))
        texts = docs.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
        spans = tmp.table(texts.select("h", "lang", "text").mapInArrow(_spans, "h long, lang string, words array<string>").where(F.size("words") > 0))

        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sorted((h, index[lang], w) for b in batches for h, lang, w in zip(*(b.column(c).to_pylist() for c in ("h", "lang", "words")), strict=True))
            weights, start, move = learn([(lang, w) for _, lang, w in found], words_of, len(langs))
            at = np.flatnonzero(weights.any(1))
            rows = [(int(i), weights[i].tolist()) for i in at] + [(-1, start.tolist())] + [(-2 - i, m.tolist()) for i, m in enumerate(move)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.list_(pa.float64()))], ["at", "w"])

        # the one learning task: at most sample spans of SPAN words
        learnt = tmp.table(spans.repartition(1).mapInArrow(fitted, "at long, w array<double>")).toArrow()
    at, w = learnt["at"].to_numpy(), np.array(learnt["w"].to_pylist()).reshape(-1, len(langs))
    weights, start, move = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)), np.zeros((len(langs), len(langs)))
    weights[at[at >= 0]] = w[at >= 0]
    for i, x in zip(at[at < 0], w[at < 0], strict=True):
        if i == -1:
            start[:] = x
        else:
            move[-2 - i] = x
    return {"langs": langs, "lexicon": words_of, "weights": weights, "start": start, "move": move}


def _numbered(texts: list[str | None], scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of the texts, end to end, and how many words each text has."""
    found = [np.fromiter(map(scores.__getitem__, words(t)), np.int32) for t in texts]
    found = [f[f >= 0] if len(f) and f.min() < 0 else f for f in found]
    lengths = np.array([len(f) for f in found], np.int64)
    return (np.concatenate(found) if len(found) else np.empty(0, np.int32)), lengths


def identify(docs: DataFrame, model: dict, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of each whole text and its mean probability, in place of columns of these names."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<label:string,score:double>")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs = np.array(held.value["langs"], object)
        scores = Scores(held.value) if len(langs) else None
        for batch in batches:
            label, sure = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if scores is not None:
                numbers, lengths = _numbered(batch.to_pylist(), scores)
                some = np.flatnonzero(lengths)
                if len(some):
                    total = np.zeros((len(some), len(langs)))
                    for text, _, p in probabilities(_Lazy(scores.table(), numbers), lengths[some], held.value["start"], held.value["move"]):
                        for k in range(len(langs)):
                            total[:, k] += np.bincount(text, p[:, k], len(some))
                    total /= lengths[some, None]
                    label[some] = langs[total.argmax(1)]
                    sure[some] = np.clip(total.max(1), 0, 1)
                scores.forget()
            yield pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(sure)], ["label", "score"])

    (own,) = spare(docs, "found")
    out = docs.withColumn(own, labelled(F.col("text")))
    return out.withColumns({label: F.col(own)["label"], score: F.col(own)["score"]}).drop(own)


def code_switches(docs: DataFrame, model: dict, col: str = "runs") -> DataFrame:
    """docs with runs of words of one language: lang, first and last word (from 0), least probability; words are those of words()."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<lang:string,first:long,last:long,score:double>>")
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs = held.value["langs"]
        scores = Scores(held.value) if langs else None
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            if scores is not None:
                numbers, lengths = _numbered(batch.to_pylist(), scores)
                some = np.flatnonzero(lengths)
                begin = np.concatenate([[0], np.cumsum(lengths[some])])
                for text, word, p in probabilities(_Lazy(scores.table(), numbers), lengths[some], held.value["start"], held.value["move"]) if len(some) else ():
                    best = p.argmax(1)
                    cut = np.flatnonzero(np.diff(text, prepend=-1).astype(bool) | np.diff(best, prepend=-1).astype(bool))
                    for a, b in zip(cut, [*cut[1:], len(best)], strict=True):
                        own, t = out[some[text[a]]], begin[text[a]]
                        run = {"lang": langs[best[a]], "first": int(word[a] - t), "last": int(word[b - 1] - t), "score": float(p[a:b].max(1).min())}
                        if own and own[-1]["lang"] == run["lang"]:  # a run that a slab's end has cut
                            own[-1] |= {"last": run["last"], "score": min(own[-1]["score"], run["score"])}
                        else:
                            own.append(run)
                scores.forget()
            yield pa.array(out, kind)

    return docs.withColumn(col, runs(F.col("text")))


def is_held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from; null ids aren't in it (nor learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang), learnt from the rows that aren't held out."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
