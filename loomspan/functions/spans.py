"""Column builders for half-open spans in code points.

Offsets of all matches need a scan with state, which the built-in functions cannot express: one Arrow batch function per pattern reads every text once. All else
stays in the JVM.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
CHUNK = "array<struct<chunk:int,char_start:int,char_end:int,own_start:int,own_end:int,word_count:int>>"
#: words as runs of word characters, joined by single hyphens, or any other visible character
WORD = r"\w+(?:[-_]\w+)*|\S"
WORD_CHARACTER = r"[\p{L}\p{N}_]"
TOKEN = r"<PII_([A-Z_]+):[0-9a-f]{32}>"
PORTION = 4 << 20  # bytes of text that a worker takes out of an Arrow batch at a time


def nested_array(rows: list[list[tuple] | None], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.Array:
    """Lists of tuples as an Arrow array of structs; None gives null."""
    offsets, flat = [0], []
    for row in rows:
        flat.extend(row or ())
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(names)
    items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=pa.array([r is None for r in rows], pa.bool_()))


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[tuple[int, int]]:
    """(begin, stop) of runs of rows with at most ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, stop
        at = stop


def in_portions(scan: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``scan`` of Arrow columns, of which the first holds the texts, run by run: a batch may hold 64 MB of text, which as Python objects are several times that."""

    @functools.wraps(scan)  # Spark reads the kind of a function from its annotations
    def whole(*columns: pa.Array) -> pa.Array:
        parts = [scan(*(c.slice(begin, stop - begin) for c in columns)) for begin, stop in portions(columns[0])]
        return pa.concat_arrays(parts) if parts else scan(*columns)

    return whole


@functools.cache
def span_function(find: Callable[[str], Iterable[tuple[int, int]]], repeatable: bool = True):
    """A column function from texts to all spans (start, end, value) that ``find`` yields.

    Where the spans are also filtered, ``repeatable=False`` keeps the optimiser from a scan for the filter and another one, in a worker of its own, for the column.
    """

    @in_portions
    def scan(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [(s, e, t[s:e]) for s, e in find(t)] for t in texts.to_pylist()]
        return nested_array(rows, ("start", "end", "value"), (pa.int32(), pa.int32(), pa.string()))

    found = F.arrow_udf(scan, SPAN)
    return found if repeatable else found.asNondeterministic()


@functools.cache
def finder(pattern: str) -> Callable[[str], Iterable[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: ((m.start(), m.end()) for m in compiled.finditer(text) if m.end() > m.start())


def regex_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern without empty matches, as (start, end, value): one scan per text. Null texts give null."""
    return span_function(finder(pattern))(text)


@functools.cache
def _digest_function(pattern: str):
    compiled = re.compile(pattern)

    @in_portions
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            at = [m.span() for m in compiled.finditer(t or "") if m.end() > m.start()]
            out.append({"n": len(at), "starts": sum(s for s, _ in at), "ends": sum(e for _, e in at)})
        return pa.array(out, pa.struct([("n", pa.int64()), ("starts", pa.int64()), ("ends", pa.int64())]))

    return F.arrow_udf(scan, "n long, starts long, ends long")


def span_sums(text: Column, pattern: str) -> Column:
    """Number of matches and the sums of their starts and ends, where the matches themselves would only be counted."""
    return _digest_function(pattern)(text)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Adjacent spans do not overlap."""
    return (a_start < b_end) & (b_start < a_end)


def nested(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Either span contains the other; equal spans count."""
    return ((a_start <= b_start) & (b_end <= a_end)) | ((b_start <= a_start) & (a_end <= b_end))


def valid_span(start: Column, end: Column, length: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & (end <= length), F.lit(False))


def select_non_overlapping(spans: Column, text: Column) -> Column:
    """Greedy choice by (start, longest first, type): a span is kept if it begins at or after the end of the last one kept.

    Spans out of range or whose value is not the text's slice are dropped first. Elements need start, end, value, entity_type.
    """
    fits = F.filter(spans, lambda s: valid_span(s["start"], s["end"], F.length(text)) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["value"]))
    order = lambda a, b: (
        F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1))
        .when(a["entity_type"] < b["entity_type"], -1).when(a["entity_type"] > b["entity_type"], 1).otherwise(0)
    )
    ordered = F.array_sort(fits, order)
    zero = F.struct(F.lit(0).cast("int").alias("cursor"), F.filter(spans, lambda s: F.lit(False)).alias("kept"))
    step = lambda acc, s: F.when(s["start"] < acc["cursor"], acc).otherwise(F.struct(s["end"].cast("int").alias("cursor"), F.concat(acc["kept"], F.array(s)).alias("kept")))
    return F.aggregate(ordered, zero, step, lambda acc: acc["kept"])


def replace_spans(text: Column, spans: Column) -> Column:
    """Text with every (sorted, disjoint) span replaced by its ``token``."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].cast("int").alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["token"]).alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def find_tokens(text: Column) -> Column:
    """Distinct tokens in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def token_type(token: Column, known: tuple[str, ...]) -> Column:
    """Entity type of a well-formed token of a known type, else null."""
    kind = F.regexp_extract(token, f"^{TOKEN}$", 1)
    return F.when(kind.isin(*known), kind)


def detokenize(text: Column, values: Column) -> Column:
    """Single pass over the tokens; those without a value stay, and restored values are not scanned again."""
    gaps, hits = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.element_at(values, h), h, F.lit(""))))
    return F.array_join(pairs, "")


def at_boundary(text: Column, position: Column) -> Column:
    """Whether the character at a 1-based position is no word character; outside the text is a boundary."""
    char = F.substring(text, position, F.lit(1))
    return (position < 1) | (position > F.length(text)) | ~char.rlike(WORD_CHARACTER)


def reasons_of(text: str, spans: list[tuple[int, int]], words: re.Pattern, max_width: int) -> list[str | None]:
    """Why each span cannot be predicted from whole words; None if it can."""
    bounds = [m.span() for m in words.finditer(text)] if spans else []
    starts, ends = [s for s, _ in bounds], [e for _, e in bounds]
    out = []
    for start, end in spans:
        first, last = bisect_left(starts, start), bisect_left(ends, end)
        fits = first < len(starts) and starts[first] == start and last < len(ends) and ends[last] == end
        out.append(None if fits and last - first < max_width else "wider_than_max_width" if fits else "misaligned_word_boundary")
    return out


@functools.cache
def _reason_function(pattern: str, max_width: int):
    compiled = re.compile(pattern)

    @in_portions
    def scan(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        out = [None if wanted is None else reasons_of(text or "", [(x["start"], x["end"]) for x in wanted], compiled, max_width) for text, wanted in rows]
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(scan, "array<string>")


@functools.cache
def reasoned_span_function(find: Callable[[str], Iterable[tuple[int, int]]], max_width: int, pattern: str = WORD):
    """A column function from texts to all spans that ``find`` yields with their ``unreachable_reasons`` (start, end, value, reason): one scan in one worker."""
    compiled = re.compile(pattern)

    @in_portions
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            at = [] if t is None else list(find(t))
            rows.append(None if t is None else [(s, e, t[s:e], r) for (s, e), r in zip(at, reasons_of(t, at, compiled, max_width), strict=True)])
        return nested_array(rows, ("start", "end", "value", "reason"), (pa.int32(), pa.int32(), pa.string(), pa.string()))

    return F.arrow_udf(scan, "array<struct<start:int,end:int,value:string,reason:string>>")


def unreachable_reasons(text: Column, spans: Column, max_width: int, pattern: str = WORD) -> Column:
    """For every span why it cannot be predicted from whole words: a boundary inside a word, more words than ``max_width``; null if it can."""
    return _reason_function(pattern, max_width)(text, spans)


def plan_chunks(words: list[tuple[int, int]], length: int, max_words: int, margin: int) -> list[tuple[int, ...]]:
    """(chunk, char_start, char_end, own_start, own_end, word_count) of every window over the words of one text."""
    n = len(words)
    if n <= max_words:
        return [(0, 0, length, 0, length, n)]
    firsts = [*range(0, n - max_words, max_words - 2 * margin), n - max_words]
    hand_over = [0, *(words[f + margin][0] for f in firsts[1:]), length]
    return [(i, words[f][0], words[f + max_words - 1][1], hand_over[i], hand_over[i + 1], max_words) for i, f in enumerate(firsts)]


@functools.cache
def _chunk_function(pattern: str, max_words: int, margin: int):
    compiled = re.compile(pattern)
    names = ("chunk", "char_start", "char_end", "own_start", "own_end", "word_count")

    @in_portions
    def scan(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else plan_chunks([m.span() for m in compiled.finditer(t)], len(t), max_words, margin) for t in texts.to_pylist()]
        return nested_array(rows, names, (pa.int32(),) * len(names))

    return F.arrow_udf(scan, CHUNK)


def chunk_plan(text: Column, max_words: int, margin: int, pattern: str = WORD) -> Column:
    """Windows of at most ``max_words`` words, overlapping by ``2 * margin``: chunk, char_start, char_end, own_start, own_end, word_count.

    The owned regions partition the text, and a hand-over lies ``margin`` words inside both windows. Null texts give null.
    """
    if not max_words > 2 * margin >= 0:
        raise ValueError("max_words must exceed twice the margin")
    return _chunk_function(pattern, max_words, margin)(text)
