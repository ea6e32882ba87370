"""Spans of identifiers in texts: what the PII and the secret scan share.

Spans are (kind, start, end) in code points of the source text, end exclusive.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]
#: Spark's type of a list of spans.
SPANS = "array<struct<kind:string,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    """By start, then in the order of the kinds."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def as_arrow(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], _TYPE)


def added(base: list[Span], more: list[Span]) -> list[Span]:
    """The spans of more that touch no base span of their kind; base spans of a kind don't overlap."""
    taken: dict[str, list[tuple[int, int]]] = {}
    for k, a, b in sorted(base, key=lambda s: s[1]):
        taken.setdefault(k, []).append((a, b))
    out = []
    for k, a, b in more:
        own = taken.get(k, [])
        i = bisect_left(own, (b, b)) - 1  # the last that starts before b
        if i < 0 or own[i][1] <= a:
            out.append((k, a, b))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def by_text(find: Callable[[str], tuple[list[Span], list[Span]]]):
    """A UDF from texts to a struct of the base spans and all spans; null texts are empty."""

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [find(t.as_py() or "") for t in batch]
            yield pa.StructArray.from_arrays([as_arrow([f[0] for f in found]), as_arrow([f[1] for f in found])], ["base", "spans"])

    return run


def redacted(text: str, spans: list[Span]) -> str:
    """The text with <KIND> in place of each span; of overlapping spans the union is replaced, named after the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    out.append(text[at:])
    return "".join(out)
