"""Spans found in texts: rows, digests and redaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(docs: DataFrame, make: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]]) -> DataFrame:
    """``doc_id, base, added``: spans of whole texts in code points, end exclusive. ``make`` builds the finder in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            found = [find(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], _ARROW) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "added"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id bigint, base {SPANS}, added {SPANS}")


def joined(spans: Column, by: list[str], kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans, comma-joined, ordered by ``by`` (of ``place``, the kind's place in ``kinds``, and ``start``)."""
    place = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(
        *({"place": place[s["kind"]], "start": s["start"]}[k].alias(k) for k in by),
        s["end"].alias("end"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("shown"),
    ))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["shown"]), ",")


def _same(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x == kind, 1)


def digest(found: DataFrame, counted: list[str], by: list[str], kinds: list[str]) -> DataFrame:
    """``doc_id``, a count of base spans per kind, the digest of the base spans and all spans as text."""
    kind_of = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kind_of, _same(k)))).cast("bigint").alias(f"n_{k}") for k in counted]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base"), by, kinds), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), by, kinds).alias("spans"),
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced together."""
    out, at, end = [], 0, -1
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= max(end, at) or end < 0:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = stop
        at = end = max(at, stop)
    return "".join(out) + text[at:]
