"""Substrings of texts that may equal one of many values: rolling hashes against a bit map, block by block.

Work and memory per character depend on the number of distinct lengths of the values, not on how many values there are or what they share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import nested_array, portions

BASE, LENGTH_FACTOR, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
BLOCK = 1 << 18  # characters hashed at a time; longer texts are cut, with what a value can reach beyond the cut
LEAST_BITS, MOST_BITS, BITS_PER_VALUE = 1 << 20, 1 << 30, 64  # of the bit map; MOST_BITS are 128 MB
OUTSIDE = 0x110000  # no character: stands between texts


@functools.cache
def word_table() -> np.ndarray:
    """Whether a code point is a word character."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(OUTSIDE)] + [False])


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    of = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
    return of(BASE), of(pow(BASE, -1, 1 << 64))


class Block:
    """Hashes of any substring of a run of code points after one pass over them."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(1 << max(1 << 16, len(codes)).bit_length())
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        h = (self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + np.asarray(lengths).astype(np.uint64) * np.uint64(LENGTH_FACTOR)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
        return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def contained(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of a hash are set."""
    top, out = np.uint64(64 * len(bits) - 1), np.ones(len(h), bool)
    for slot in (h & top, (h >> np.uint64(32)) & top):
        out &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


@functools.cache
def _key_function(prefix: int):
    def keys(values: pa.Array) -> pa.Array:
        parts = [np.zeros((0, 2), np.uint64)]
        for begin, stop in portions(values, BLOCK):
            texts = values.slice(begin, stop - begin).to_pylist()
            sizes = np.array([len(t) for t in texts])
            starts, block = np.cumsum(sizes) - sizes, Block(code_points("".join(texts)))
            parts.append(np.stack([block.hashes(starts, prefix), ~block.hashes(starts, sizes)], axis=1))  # the second kind inverted: no prefix passes for a whole
        each = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(each) + 1, 2), pa.int32()), pa.array(each.reshape(-1).view(np.int64)))

    return F.arrow_udf(keys, "array<long>")


def bit_map(values: DataFrame, rows: int, prefix: int) -> np.ndarray:
    """Bit map of the first ``prefix`` characters and of the whole of every value, as 64-bit words: only words that are not zero come to the driver."""
    bits = LEAST_BITS
    while bits < min(rows * BITS_PER_VALUE, MOST_BITS):
        bits *= 2
    keys = values.select(F.explode(_key_function(prefix)(F.col("value"))).alias("v"))
    slots = keys.select(F.explode(F.expr(f"array(v & {bits - 1}L, shiftrightunsigned(v, 32) & {bits - 1}L)")).alias("slot"))
    found = slots.select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint64)
    return out


def blocks(texts: list[str | None], longest: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """Pieces (row, offset, first position that counts, characters) in lists of about BLOCK characters.

    A cut piece begins with the character before its first position and goes on as far as a value and the character after it can reach.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        for begin in range(0, len(text or ""), BLOCK):
            at = max(0, begin - 1)
            held.append((row, at, begin - at, text[at : begin + BLOCK + longest + 1]))
            size += len(held[-1][3])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def likely(pieces: list[tuple[int, int, int, str]], bits: np.ndarray, lengths: list[int], prefix: int) -> Iterator[tuple[int, int, str]]:
    """(row, offset, substring) of what may be a whole-token occurrence of a value, and of nearly nothing else."""
    gap = chr(0)
    codes = code_points(gap + gap.join(p[3] for p in pieces) + gap).copy()
    sizes = np.array([len(p[3]) for p in pieces])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes
    codes[np.concatenate([begins - 1, ends[-1:]])] = OUTSIDE
    word, block = word_table()[codes], Block(codes)
    starts = np.flatnonzero(~word[: max(0, len(codes) - prefix - 1)]) + 1
    starts = starts[contained(bits, block.hashes(starts, prefix))]
    of = np.searchsorted(begins, starts, "right") - 1
    place = starts - begins[of]
    first, cut = np.array([p[2] for p in pieces]), np.array([p[2] + BLOCK for p in pieces])
    own = (place >= first[of]) & (place < cut[of])
    starts, of = starts[own], of[own]
    for n in lengths:
        fits = starts + n <= ends[of]
        s, piece = starts[fits], of[fits]
        whole = ~word[s + n]
        s, piece = s[whole], piece[whole]
        hit = contained(bits, ~block.hashes(s, n))
        for i, k in zip((s[hit] - begins[piece[hit]]).tolist(), piece[hit].tolist(), strict=True):
            row, offset, _, text = pieces[k]
            yield row, offset + i, text[i : i + n]


def likely_occurrences(text: Column, values: DataFrame, rows: int, prefix: int) -> Column:
    """array<struct<offset,value>>: every whole-token occurrence of the values in a text, and perhaps substrings that are no value, which a join tells.

    The values are distinct, have ``prefix`` characters at least, and are ``rows`` many.
    """
    lengths = sorted(r[0] for r in values.select(F.length("value")).distinct().collect())
    held = values.sparkSession.sparkContext.broadcast((bit_map(values, rows, prefix), lengths))

    def scan(texts: pa.Array) -> pa.Array:
        bits, lengths = held.value
        parts = []
        for begin, stop in portions(texts):
            found = [[] for _ in range(begin, stop)]
            for pieces in blocks(texts.slice(begin, stop - begin).to_pylist(), lengths[-1] if lengths else 0):
                for row, offset, value in likely(pieces, bits, lengths, prefix):
                    found[row].append((offset, value))
            parts.append(nested_array(found, ("offset", "value"), (pa.int64(), pa.string())))
        return pa.concat_arrays(parts) if parts else nested_array([], ("offset", "value"), (pa.int64(), pa.string()))

    return F.arrow_udf(scan, "array<struct<offset:long,value:string>>")(text)
