"""Ranked lexical search by branch and bound over maximum trees of document ranges.

Documents are taken in blocks as they are read, whole texts, and ordered within a block so that
like documents are neighbours. For every term a block holds a tree: a leaf is the term's impact on
one document, a node the largest impact within a range of FAN nodes below it. A node's bound for a
query is the sum of its terms' largest impacts times their weights; on a leaf it is the document's
score itself, in 64-bit integers. From the root the node of the highest bound is opened first, and
only nodes whose bound reaches the last of the best k scores so far; those that equal it are opened
too, since an equal score with a smaller id goes before. A task keeps its best k over its blocks,
and all tasks start from the k-th best score that a share of the blocks has, so what is shuffled
is a few rows for each query. Nothing is cut off: the results are those of scoring everything.

Terms are maximal runs of characters other than ASCII signs, white space and controls, with A to Z
in lower case. Null and empty texts have no terms: such documents aren't counted, such queries have
no rows. Repeated rows are documents (or items) of their own; of equal scores the smaller id goes
first, null ids last. An empty table of either kind gives an empty result. Very long texts are read
in pieces. Queries are collected in chunks of bounded size, distinct texts only; each chunk makes an
index of its own terms. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, arrow_batches, written

TOP = 20
#: Queries of one chunk, on average: rows and bytes. More are searched in further chunks.
CHUNK_ROWS, CHUNK_BYTES = 2048, 8 << 20
#: Documents and words after which a block ends.
BLOCK_DOCS, BLOCK_WORDS = 8192, 4_000_000
#: Bits of a range's fan-out.
SHIFT = 4
FAN = 1 << SHIFT
#: One of so many blocks is searched before the others, for a score to start from.
PROBE = 16
#: Bytes of a text that are split at a time.
PIECE = 1 << 20

#: Every byte of a term as it counts, others as a space; bytes of characters beyond ASCII are kept.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def query_terms(text: str | None) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for words in pieces((text or "").encode("utf-8", "surrogatepass")):
        found.update(words)
    return found


def _block(seq: int, ids: list[pa.Array], lengths: list[int], words: list[np.ndarray], n_terms: int) -> list:
    """One block: its documents in the order of their commonest term and length, and its postings by term."""
    n = np.array(lengths, np.int64)
    doc = np.repeat(np.arange(len(n)), [len(w) for w in words])
    key, tf = np.unique(doc * n_terms + np.concatenate(words), return_counts=True)
    doc, term = key // n_terms, key % n_terms
    main = np.full(len(n), -1)
    if len(tf):
        by_tf = np.lexsort((-term, tf))
        main[doc[by_tf]] = term[by_tf]  # the last assignment stays: the largest tf
    order = np.lexsort((n, main))
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    by_term = np.lexsort((place[doc], term))
    terms, df = np.unique(term, return_counts=True)
    part = TaskContext.get().partitionId()
    probe = zlib.crc32(f"{part}:{seq}".encode()) % PROBE == 0
    return [probe, int((n > 0).sum()), int(n.sum()), pa.concat_arrays(ids).take(pa.array(order)), n[order], terms.astype(np.int32), df.astype(np.int32), place[doc][by_term].astype(np.int32), tf[by_term].astype(np.int32)]


_BLOCK = "probe boolean, n_docs long, n_words long, ids array<{id}>, lengths array<long>, terms array<int>, df array<int>, doc array<int>, tf array<int>"
_NAMES = ["probe", "n_docs", "n_words", "ids", "lengths", "terms", "df", "doc", "tf"]


def _blocks(lexicon):
    """Documents as they come to blocks."""

    def packed(block: list) -> pa.RecordBatch:
        columns = [pa.array([v]) for v in block[:3]]
        for v in block[3:]:
            v = v if isinstance(v, pa.Array) else pa.array(v)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        return pa.RecordBatch.from_arrays(columns, _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lexicon.value
        seq = held = 0
        ids: list[pa.Array] = []
        lengths: list[int] = []
        words: list[np.ndarray] = []
        for batch in batches:
            done = 0
            texts = batch.column("text").cast(pa.large_binary())
            for i, text in enumerate(texts):
                n, found = 0, []
                for some in pieces(text.as_py() or b""):
                    n += len(some)
                    at = np.fromiter((number.get(w, -1) for w in some), np.int64, len(some))
                    found.append(at[at >= 0])
                lengths.append(n)
                words.append(np.concatenate(found) if found else np.empty(0, np.int64))
                held += len(words[-1])
                if len(lengths) >= BLOCK_DOCS or held >= BLOCK_WORDS:
                    ids.append(batch.column("doc_id").slice(done, i + 1 - done))
                    yield packed(_block(seq, ids, lengths, words, len(number)))
                    ids, lengths, words, held, seq, done = [], [], [], 0, seq + 1, i + 1
            if done < batch.num_rows:
                ids.append(batch.column("doc_id").slice(done))
        if lengths:
            yield packed(_block(seq, ids, lengths, words, len(number)))

    return run


class Tree:
    """The maximum trees of all terms of one block.

    A level holds an entry for each term and range where the term occurs, by term and range:
    range, largest impact, and where the entries below begin and how many they are. Level 0 are
    the documents; the last level has one entry for each term.
    """

    def __init__(self, df: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        term = np.repeat(np.arange(len(df)), df)
        self.levels = [(doc, impact, None, None)]
        node = doc
        while True:
            node = node >> SHIFT
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (term[1:] != term[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(node)))
            impact = np.maximum.reduceat(impact, start)
            node, term = node[start], term[start]
            self.levels.append((node, impact, start, size))
            if len(node) == len(df) and not node.any():
                return

    def opened(self, level: int, node: int, entries: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The FAN bounds of the nodes below one, and the entries below: their places, weights and nodes (from 0)."""
        _, _, start, size = self.levels[level]
        below, impact, _, _ = self.levels[level - 1]
        count = size[entries]
        ends = np.cumsum(count)
        places = np.repeat(start[entries] - ends + count, count) + np.arange(ends[-1])
        weights = np.repeat(weights, count)
        child = below[places] - (node << SHIFT)
        bounds = np.zeros(FAN, np.int64)
        np.add.at(bounds, child, weights * impact[places])
        return bounds, places, weights, child


class Best:
    """The best k of (score, id) seen; floor: the score that another has to reach."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.rows, self.floor = k, [], floor

    def offer(self, rows: list[tuple]) -> None:
        self.rows = heapq.nsmallest(self.k, self.rows + rows, key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[-1][0])


def search(tree: Tree, ids: pa.Array, entries: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offers best all documents of the tree that can be among the best; gives the number of opened nodes."""
    level = len(tree.levels) - 1
    bound = int((tree.levels[level][1][entries] * weights).sum())
    heap = [(-bound, 0, level, 0, entries, weights)]
    pushed = opened = 0
    while heap and -heap[0][0] >= best.floor:
        _, _, level, node, entries, weights = heapq.heappop(heap)
        opened += 1
        bounds, places, weights, child = tree.opened(level, node, entries, weights)
        good = np.flatnonzero(bounds >= best.floor)
        if level == 1:
            if len(good):
                best.offer([(int(bounds[c]), ids[(node << SHIFT) + int(c)].as_py()) for c in good])
            continue
        for c in good.tolist():
            of = child == c
            pushed += 1
            heapq.heappush(heap, (-int(bounds[c]), pushed, level - 1, (node << SHIFT) + c, places[of], weights[of]))
    return opened


def measure(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """A document's m: 75 and 25 times its length over the mean length, rounded down."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 2**63:
        return 75 + 25 * lengths * n_docs // n_words
    return np.array([75 + 25 * int(n) * n_docs // n_words for n in lengths], np.int64)


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _searched(shared, k: int):
    """Blocks to the best k documents of each query within the task: q, score, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_words, weight, queries, floors = shared.value
        best = [Best(k, f) for f in floors]
        for batch in batches:
            for row in range(batch.num_rows):
                id_type = batch.column("ids").type.value_type
                own = {c: batch.column(c)[row].values for c in ("ids", "lengths", "terms", "df", "doc", "tf")}
                terms, df, doc, tf = (own[c].to_numpy() for c in ("terms", "df", "doc", "tf"))
                if not len(terms):
                    continue
                tf = tf.astype(np.int64)
                m = measure(own["lengths"].to_numpy(), n_docs, n_words)
                tree = Tree(df, doc.astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                place = np.full(len(weight), -1)
                place[terms] = np.arange(len(terms))
                for q, (at, times) in enumerate(queries):
                    entries = place[at]
                    here = entries >= 0
                    if here.any():
                        search(tree, own["ids"], entries[here], (weight[at] * times)[here], best[q])
        rows = [(q, s, i) for q, b in enumerate(best) for s, i in b.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], id_type)], ["q", "score", "doc_id"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query, with their rank; Spark cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chunk(docs: DataFrame, texts: list[str], k: int, tmp: Scratch) -> DataFrame:
    """q (number of the text), rank, doc_id, score for the texts of one chunk."""
    spark = docs.sparkSession
    id_kind = dict(docs.dtypes)["doc_id"]
    counts = [query_terms(t) for t in texts]
    lexicon = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    known = spark.sparkContext.broadcast(lexicon)
    blocks = tmp.table(docs.mapInArrow(_blocks(known), _BLOCK.format(id=id_kind)))
    n_docs, n_words = blocks.agg(F.sum("n_docs"), F.sum("n_words")).first()
    columns = f"q int, score long, doc_id {id_kind}"
    if not n_docs or not lexicon:
        return spark.createDataFrame([], f"{columns}, rank int")
    # a row for each term of the chunk's queries at most
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect()
    weight = np.zeros(len(lexicon), np.int64)
    for r in df:
        weight[r.terms] = term_weight(r.df, n_docs)
    queries = [(np.array([lexicon[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
    floors, rounds = [1] * len(texts), []
    for probe in (True, False):
        held = spark.sparkContext.broadcast((n_docs, n_words, weight, queries, floors))
        some = blocks.where(F.col("probe") == probe).select("ids", "lengths", "terms", "df", "doc", "tf")
        rounds.append(tmp.table(some.mapInArrow(_searched(held, k), columns)))
        if probe:  # one row for each query at most
            for r in _first(rounds[0], k).where(F.col("rank") == k).collect():
                floors[r.q] = max(1, r.score)
    return _first(rounds[0].unionByName(rounds[1]), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    asked = items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text"), F.sha2("text", 256).alias("digest"))
    with Scratch(spark) as tmp:
        texts = tmp.table(asked.where("text is not null").groupBy("digest").agg(F.first("text").alias("text")))
        n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        chunks = max(1, -(-n // CHUNK_ROWS), -(-size // CHUNK_BYTES))
        out = []
        for c in range(chunks):
            part = texts.where(F.pmod(F.xxhash64("digest"), F.lit(chunks)) == c).collect()
            names = spark.createDataFrame([(q, r.digest) for q, r in enumerate(part)], "q int, digest string")
            out.append(tmp.table(_chunk(docs, [r.text for r in part], k, tmp).join(F.broadcast(names), "q").select("digest", "rank", "doc_id", "score")))
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        return written(asked.join(found, "digest").select("item_id", "rank", "doc_id", "score"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM sized),
asked AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY term),
scored AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (row), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
