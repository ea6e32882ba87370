"""Conversations repaired at the least cost: each distinct sequence of roles and faults is solved once.

A row is blank (no character but white space), duplicate (role and text seen earlier), truncated
(its last other character is none of . ! ?) or sound; its first fault counts. A conversation's
rows, in the order of their turns (nulls first, then role and the text's digest), become a
signature: D for rows that have to go, else s, u, a or o for the role's initial, as a capital if
truncated. Edits are Keep (0), Rerole to user or assistant (3), Delete (4) and Insert of an empty
user or assistant turn (3); a truncated row that stays costs 3 more. Roles have to end as
s?(ua)+ or nothing. A signature's costs between states are the minimum-plus product of those of
its halves, its audit (of the cheapest the ASCII-least) the audits of its halves, both remembered;
so a signature of any length is solved once, and recursion is as deep as its length's logarithm.

Audits are joined back by signature and replayed on the rows as these stream by in order. Equal
rows are counted before they are ordered; rows are ordered by range over all columns, so that a
conversation of any length is spread over tasks and cut into segments of at most SEGMENT rows, which
are solved apart and put together by their states. Only the audit itself and the digest of the
repaired text pass through one task by conversation, as a stream.

Nulls of role and text are one space, and so are nulls in the damage's key; a null conv_id is a
conversation. Rows without any conversation don't exist; an empty table gives none. Other columns
are not read. Very long texts are digested once and streamed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, arrow_batches, written

#: Rows of one segment at most.
SEGMENT = 4096
#: Signatures and halves remembered by a task.
REMEMBERED = 1 << 16
_BLANK = " \t\n\x0b\f\r"

#: What the last kept role was: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Behind the last row: the inserts that complete the last pair, by state.
CLOSING = ["", "II", "I", ""]
CLOSED = tuple(INSERT * len(c) for c in CLOSING)
NEVER = 1 << 40


def after(state: int) -> int:
    """The state behind a rerole or an insert: an assistant follows a user, else a user comes."""
    return ASSISTANT if state == USER else USER


def edits(sign: str, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: edit, cost, state behind it."""
    found = [("D", DELETE, state)]
    if sign != "D":
        more = TRUNCATED if sign.isupper() else 0
        kept = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(sign.lower())
        if kept is not None:
            found.append(("K", KEEP + more, kept))
        found.append(("R", REROLE + more, after(state)))
    return found


def row_edits(sign: str, state: int) -> list[tuple[str, int, int]]:
    """edits(), each also behind one insert; more than one is never cheaper."""
    return edits(sign, state) + [("I" + e, INSERT + c, s) for e, c, s in edits(sign, after(state))]


@lru_cache(REMEMBERED)
def costs(signature: str) -> tuple[tuple[int, ...], ...]:
    """The least cost from each state before the signature's rows to each state behind them."""
    if len(signature) == 1:
        out = [[NEVER] * 4 for _ in STATES]
        for s in STATES:
            for _, c, t in row_edits(signature, s):
                out[s][t] = min(out[s][t], c)
        return tuple(map(tuple, out))
    a, b = costs(signature[: len(signature) // 2]), costs(signature[len(signature) // 2 :])
    return tuple(tuple(min(a[s][m] + b[m][t] for m in STATES) for t in STATES) for s in STATES)


def ahead(matrix, rest: tuple[int, ...]) -> tuple[int, ...]:
    """What is still to pay from each state, when rest is to pay behind the matrix's rows; the least is taken off."""
    total = [min(matrix[s][t] + rest[t] for t in STATES) for s in STATES]
    return tuple(x - min(total) for x in total)


@lru_cache(REMEMBERED)
def audit(signature: str, state: int, rest: tuple[int, ...]) -> tuple[str, int, int]:
    """The cheapest edits from a state (of equal cost the ASCII-least), their cost, and the state behind."""
    if len(signature) == 1:
        least = min(c + rest[t] for _, c, t in row_edits(signature, state))
        return min(x for x in row_edits(signature, state) if x[1] + rest[x[2]] == least)
    first, second = signature[: len(signature) // 2], signature[len(signature) // 2 :]
    a, c, middle = audit(first, state, ahead(costs(second), rest))
    b, d, last = audit(second, middle, rest)
    return a + b, c + d, last


def solved(signature: str) -> tuple[str, int]:
    """The audit of a whole conversation and its cost."""
    if not signature:
        return "", 0
    a, c, s = audit(signature, START, CLOSED)
    return a + CLOSING[s], c + CLOSED[s]


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_INT, _TEXT = pa.int64(), pa.string()
_INTS = pa.list_(_INT)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> tuple[pa.DataType | None, Iterator[tuple]]:
    """The type of conv_id, and the rows of the named columns as they come."""
    first = next(batches, None)
    if first is None:
        return None, iter(())
    rows = (r for b in chain([first], batches) for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
    return first.column("conv_id").type, rows


def _packed(rows: Iterator[tuple], fields: dict[str, pa.DataType], most: int = 1000, nbytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded length; strings count for the bytes."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), fields.values(), strict=True)], list(fields))

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size > nbytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (conv_id, initial, sign, copies) to segments. Only a segment that may have a neighbour gets its costs."""
    number = TaskContext.get().partitionId() << 32
    kind, rows = _columns(batches, ["conv_id", "initial", "sign", "copies"])

    def signs(of: Iterator[tuple]) -> Iterator[tuple[str, str]]:
        for _, initial, sign, copies in of:
            yield initial, sign
            for _ in range(copies - 1):
                yield initial, "D"  # equal rows: the first may be sound

    def segments() -> Iterator[tuple]:
        for conv, of in groupby(rows, key=lambda r: r[0]):
            stream, part = signs(of), 0
            held = next(stream, None)
            while held is not None:
                signature, first, last, illegal = [held[1]], held[0], held[0], 0
                held = None
                for initial, sign in stream:
                    if len(signature) == SEGMENT:
                        held = (initial, sign)
                        break
                    signature.append(sign)
                    illegal += not legal(last, initial)
                    last = initial
                yield conv, "".join(signature), first, last, illegal, part > 0 or held is not None
                part += 1

    def numbered() -> Iterator[tuple]:
        waiting, seq = None, 0
        for segment in chain(segments(), [None]):
            if waiting:  # the partition's first and last conversation may go on in another one
                conv, signature, first, last, illegal, split = waiting
                matrix = [x for row in costs(signature) for x in row] if split or not seq or not segment else None
                yield conv, number + seq, signature, matrix, first, last, illegal
                seq += 1
            waiting = segment

    return _packed(numbered(), {"conv_id": kind, "at": _INT, "signature": _TEXT, "matrix": _INTS, "first": _TEXT, "last": _TEXT, "illegal": _INT})


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by conversation to what is to pay behind each of them."""
    kind, rows = _columns(batches, ["conv_id", "at", "signature", "matrix", "first", "last", "illegal"])

    def found() -> Iterator[tuple]:
        for _, of in groupby(rows, key=lambda r: r[0]):
            rest = CLOSED
            for conv, at, signature, matrix, first, last, illegal in reversed(list(of)):
                yield conv, at, signature, list(rest), first, last, illegal
                if matrix:
                    rest = ahead([matrix[i : i + 4] for i in range(0, 16, 4)], rest)

    return _packed(found(), {"conv_id": kind, "at": _INT, "signature": _TEXT, "rest": _INTS, "first": _TEXT, "last": _TEXT, "illegal": _INT})


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct signatures, with what is to pay behind them, to audits from each state."""
    for b in batches:
        found = [[audit(s, e, tuple(r)) for e in STATES] for s, r in zip(b.column("signature").to_pylist(), b.column("rest").to_pylist(), strict=True)]
        columns = [pa.array([[f[i] for f in fs] for fs in found], pa.list_(t)) for i, t in enumerate((_TEXT, _INT, _INT))]
        yield pa.RecordBatch.from_arrays([b.column("signature"), b.column("rest"), *columns], ["signature", "rest", "audits", "prices", "states"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solved segments to one audit for each conversation, its cost and its illegal pairs of roles."""
    kind, rows = _columns(batches, ["conv_id", "audits", "prices", "states", "first", "last", "illegal"])

    def found() -> Iterator[tuple]:
        for conv, of in groupby(rows, key=lambda r: r[0]):
            state, cost, illegal, before, parts = START, 0, 0, None, []
            for _, audits, prices, states, first, last, inner in of:
                parts.append(audits[state])
                cost += prices[state]
                state = states[state]
                illegal += inner + (before is not None and not legal(before, first))
                before = last
            yield conv, "".join(parts) + CLOSING[state], cost + CLOSED[state], illegal

    return _packed(found(), {"conv_id": kind, "audit": _TEXT, "cost": _INT, "illegal": _INT})


def _edited(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of one conversation: rows are its audit's row and its own, in order."""
    state = START
    for edit in next(rows)[1]:
        if edit == "I":
            state = after(state)
            yield ("assistant" if state == ASSISTANT else "user"), ""
            continue
        _, _, role, text = next(rows)
        if edit == "R":
            state = after(state)
            yield ("assistant" if state == ASSISTANT else "user"), text
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield role, text


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each repaired conversation, line by line."""
    kind, rows = _columns(batches, ["conv_id", "audit", "role", "text"])

    def found() -> Iterator[tuple]:
        for conv, of in groupby(rows, key=lambda r: r[0]):
            h, between = hashlib.sha256(), ""
            for role, text in _edited(of):
                h.update(f"{between}{role}:{text}".encode())
                between = "\n"
            yield conv, h.hexdigest()

    return _packed(found(), {"conv_id": kind, "repaired_sha256": _TEXT})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows, numbered by conversation."""
    kind, rows = _columns(batches, ["conv_id", "audit", "role", "text"])
    found = ((conv, i, role, text) for conv, of in groupby(rows, key=lambda r: r[0]) for i, (role, text) in enumerate(_edited(of)))
    return _packed(found, {"conv_id": kind, "turn": _INT, "role": _TEXT, "text": _TEXT})


def cleaned(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a space for a null role or text."""
    space = F.lit(" ")
    return rows.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """cleaned() rows after the damage that their conversation's id and turn decide."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = cleaned(rows).withColumn("how", F.crc32(key.cast("binary")) % 20).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _signs(rows: DataFrame) -> DataFrame:
    """Equal rows as one: conv_id, turn, role, digest, copies, initial, sign, and how many are blank, duplicate, truncated."""
    end = F.rtrim("text", F.lit(_BLANK))
    facts = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), (end == "").alias("empty"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    facts = facts.groupBy("conv_id", "turn", "role", "digest").agg(F.first("empty").alias("empty"), F.first("open").alias("open"), F.count("*").alias("copies"))
    seen = facts.where("not empty").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest")
    facts = facts.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    late = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    open_ = ~F.col("empty") & ~late & F.col("open")
    sign = F.when(F.col("empty") | late, "D").when(F.col("open"), F.upper(initial)).otherwise(initial)
    zero = F.lit(0).cast("long")
    return facts.select(
        "conv_id", "turn", "role", "digest", "copies", initial.alias("initial"), sign.alias("sign"),
        F.when(F.col("empty"), F.col("copies")).otherwise(zero).alias("blank"),
        F.when(F.col("empty"), zero).otherwise(F.col("copies") - F.when(late, 0).otherwise(1)).alias("duplicate"),
        open_.cast("long").alias("truncated"),
    )


def audits(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for cleaned() rows."""
    conv = f"conv_id {dict(rows.dtypes)['conv_id']}"
    facts = tmp.table(_signs(rows))
    ordered = facts.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    segments = tmp.table(ordered.select("conv_id", "initial", "sign", "copies").mapInArrow(_segments, f"{conv}, at long, signature string, matrix array<long>, first string, last string, illegal long"))
    by_conv = segments.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    rests = tmp.table(by_conv.mapInArrow(_rests, f"{conv}, at long, signature string, rest array<long>, first string, last string, illegal long"))
    answers = rests.select("signature", "rest").distinct().mapInArrow(_solve, "signature string, rest array<long>, audits array<string>, prices array<long>, states array<long>")
    back = rests.join(tmp.table(answers), ["signature", "rest"]).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    chosen = back.select("conv_id", "audits", "prices", "states", "first", "last", "illegal").mapInArrow(_chosen, f"{conv}, audit string, cost long, illegal long")
    turns = facts.groupBy("conv_id", "turn").agg(F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = counts.withColumnRenamed("conv_id", "c")
    return counts.join(chosen, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _streams(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and, behind it, its rows in order."""
    none = F.lit(None)
    head = found.select("conv_id", F.lit(0).alias("part"), none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), "audit", none.cast("string").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", _digest(F.col("text")).alias("digest"), none.cast("string").alias("audit"), "text")
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits of rows (conv_id, turn, role, text), and the repaired rows, numbered anew from 0."""
    spark = rows.sparkSession
    arrow_batches(spark)
    rows = cleaned(rows)
    with Scratch(spark) as tmp:
        found = written(audits(rows, tmp))
    turns = _streams(rows, found).mapInArrow(_turns, f"conv_id {dict(rows.dtypes)['conv_id']}, turn long, role string, text string")
    return found, written(turns)


def damage_audits(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of the table: what its damaged rows lack, the cheapest repair, and the digest of the repaired text."""
    spark = conversations.sparkSession
    arrow_batches(spark)
    rows = damaged(conversations)
    name = dict(rows.dtypes)["conv_id"]
    with Scratch(spark) as tmp:
        found = tmp.table(audits(rows, tmp))
        digests = tmp.table(_streams(rows, found).mapInArrow(_digests, f"conv_id {name}, repaired_sha256 string"))
        all_ids = conversations.select(F.col("conv_id").alias("id")).distinct()
        out = all_ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = F.lit(hashlib.sha256().hexdigest())
        return written(out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))
