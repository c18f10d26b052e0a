"""Benchmark decontamination by a prefix-filtered set join (operator 5).

1. Every item yields its windows of 13 words, and every window the set of its shingles of up to 5 words.
2. One pass over the documents keeps the positions whose shingle may be one of the benchmark's: a bit map of fixed size says so, and a run of at
   least as many such positions as a window has. With each of them go the words around it, as many as a window can reach.
3. Shingles are ordered by rarity, counted over the documents. As the whole of a window must be contained, a prefix of its one rarest shingle is
   necessary; a window with a shingle that no document has is given up.
4. Documents and windows are joined on that shingle. Positional and length bounds fix where the window would have to lie, and its words
   are compared exactly with those around the position.
5. Ranges are united per text, so that copies of a text are looked at once.

Nothing of the benchmark but the bit map and counts passes through the driver.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_partitions, materialise, table, text_of

WINDOW = 13
SHINGLE = 5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30  # of the bit map; MOST_BITS are 128 MB
BITS_PER_SHINGLE = 32
WORD_CACHE = 300_000
BROADCAST_KEYS = 500_000  # text keys (16 bytes each) up to which a filter of documents is broadcast

#: ASCII letters and digits and everything from 0x80 make words; A-Z are lower-cased.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_hashes(ws: list[bytes], cache: dict) -> np.ndarray:
    if len(cache) > WORD_CACHE:
        cache.clear()
    out = []
    for w in ws:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every position on, the size included."""
    n = max(0, len(hashes) - size + 1)
    acc = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n else 0):
            acc = (acc ^ hashes[k : k + n]) * _MIX[0]
            acc ^= acc >> np.uint64(29)
            acc *= _MIX[1]
            acc ^= acc >> np.uint64(32)
    return acc


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item, words, n, shingles) of every window of every item; items without an id or without words have none."""

    def run(batches):
        cache: dict = {}
        for b in batches:
            out: dict[str, list] = {"item": [], "words": [], "n": [], "shingles": []}
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                hashes = word_hashes(ws, cache)
                for i in range(max(1, len(ws) - size + 1) if ws else 0):
                    part = ws[i : i + size]
                    out["item"].append(item)
                    out["words"].append([w.decode() for w in part])
                    out["n"].append(len(part))
                    out["shingles"].append(shingles(hashes[i : i + size], min(len(part), SHINGLE)).astype(np.int64))
            yield out

    named = items[0].where(F.col(items[1]).isNotNull()).select(F.col(items[1]).cast("string"), text_of(items[2]).cast("binary"))
    return map_partitions(named, run, "item string, words array<string>, n int, shingles array<long>")


def bit_map(windows: DataFrame) -> np.ndarray:
    """Bit map of all shingles, as 64-bit words: one row per word that is not zero comes to the driver, whatever the size of the benchmark."""
    each = windows.select(F.explode("shingles").alias("v")).distinct()
    bits = LEAST_BITS
    wanted = each.count() * BITS_PER_SHINGLE
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = F.col("v").bitwiseAND(F.lit(bits - 1))
    found = each.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast((v & {bits - 1}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint64)
    return out


def candidates(docs: DataFrame, held, shapes: dict[int, int], size: int, keep: str) -> DataFrame:
    """A row per document (row, key, n_words) and one per position that may lie in a window (key, n_words, pos, shingle, left, right).

    ``shapes``: shingle length to the least number of shingles that a window of that shingle length has.
    """

    def run(batches):
        cache: dict = {}
        bits = held.value
        top = np.uint64(64 * len(bits) - 1)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("row", "key", "n_words", "pos", "shingle", "left", "right")}

            def add(row, key, n, pos=None, shingle=None, left=None, right=None, out=out):
                for c, v in zip(out, (row, key, n, pos, shingle, left, right), strict=True):
                    out[c].append(v)

            for row, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = words(text)
                add(row, key, len(ws))
                hashes = word_hashes(ws, cache)
                for length, run_of in shapes.items():
                    values = shingles(hashes, length)
                    slots = values & top
                    hit = (bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
                    for pos in np.flatnonzero(in_runs(hit, run_of)).tolist():
                        before = ws[max(0, pos - size + 1) : pos]
                        add(None, key, len(ws), pos, int(values[pos : pos + 1].view(np.int64)[0]), b" ".join(before).decode(), b" ".join(ws[pos : pos + size]).decode())
                if len(out["key"]) > 20_000:
                    yield dict(out)
                    for column in out.values():
                        column.clear()
            yield out

    types = dict(docs.dtypes)["__row"]
    return map_partitions(docs.select("__row", "__key", text_of(keep).cast("binary")), run, f"row {types}, key binary, n_words long, pos int, shingle long, left string, right string")


def in_runs(hit: np.ndarray, least: int) -> np.ndarray:
    """The true positions that lie in runs of at least ``least``."""
    if least <= 1 or not hit.any():
        return hit
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    out = np.zeros(len(hit) + 1, np.int64)
    long = end - begin >= least
    np.add.at(out, begin[long], 1)
    np.add.at(out, end[long], -1)
    return np.cumsum(out)[:-1] > 0


def occurrences(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, start, end, window) of every occurrence of a window in a text."""
    tokens = tokens.groupBy("key", "pos", "shingle").agg(F.first("n_words").alias("n_words"), F.first("left").alias("left"), F.first("right").alias("right"))
    tokens = materialise(tokens)
    rarity = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    each = windows.select("window", F.posexplode("shingles").alias("at", "shingle")).join(rarity, "shingle", "left")
    prefix = each.groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "shingle")).alias("p")).where("p.df > 0")
    prefix = prefix.join(windows, "window").select(
        "window", "n", F.col("p.at").alias("at"), F.col("p.shingle").alias("shingle"),
        F.array_join(F.slice("words", 1, F.col("p.at")), " ").alias("head"), F.array_join(F.expr("slice(words, p.at + 1, n)"), " ").alias("tail"),
    )
    inside = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("n") <= F.col("n_words"))
    equal = ((F.col("at") == 0) | F.concat(F.lit(" "), "left").endswith(F.concat(F.lit(" "), "head"))) & F.concat("right", F.lit(" ")).startswith(F.concat("tail", F.lit(" ")))
    found = tokens.alias("t").join(prefix.alias("w"), (F.col("t.shingle") == F.col("w.shingle")) & inside & equal)
    start = F.col("pos") - F.col("at")
    return found.select("key", start.alias("start"), (start + F.col("n")).alias("end"), "window").distinct()


def united(found: DataFrame) -> DataFrame:
    """(key, n_hit, spans) of overlapping or touching ranges (key, start, end), united per key."""
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = found.select("key", "start", "end").distinct().withColumn("fresh", F.when(reach >= F.col("start"), 0).otherwise(1))
    numbered = flagged.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = numbered.groupBy("key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ranges.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, row) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row per document: row, key, n_words), (key, n_hit, spans), (key, items)."""
    all_windows = materialise(windows_of((items, item_id, item_text), window).withColumn("window", F.unhex(F.md5(F.array_join("words", " ").cast("binary")))))
    shapes = {int(r["length"]): int(r["least"]) for r in all_windows.groupBy(F.least("n", F.lit(SHINGLE)).alias("length")).agg(F.min(F.size("shingles")).alias("least")).collect()}  # SHINGLE rows at most
    held = docs.sparkSession.sparkContext.broadcast(bit_map(all_windows))
    prepared = docs.select(row.alias("__row"), F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("__key"), text_of(text_col).alias("__text"))
    seen = materialise(candidates(prepared, held, shapes, window, "__text"))
    windows = all_windows.groupBy("window").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    found = materialise(occurrences(seen.where("pos is not null"), windows))
    named = found.select("key", "window").distinct().join(all_windows.select("window", "item").distinct(), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return seen.where("pos is null").select("row", "key", "n_words"), united(found), named


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document the words inside any occurrence of any item window.

    Returns id, n_words, n_hit, spans (united word ranges), items (ids found, as text, sorted). Null or empty texts have no words and no
    hits; repeated rows give repeated results; items with a null id are ignored, items without words have no window. Empty tables on either side give no hits.
    Other columns of ``docs`` are not read and may have any names.
    """
    rows, ranges, named = find(docs, items, text_col, item_id, item_text, window, F.struct(F.col(id_col).alias("id")))
    out = rows.join(ranges, "key", "left").join(named, "key", "left")
    none = "cast(array() as array<{}>)"
    return out.select(
        F.col("row.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.expr(none.format("struct<start:int,end:int>"))).alias("spans"),
        F.coalesce("items", F.expr(none.format("string"))).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text holds a whole window's worth of benchmark words, or one word in twenty of them.

    A text that merely has a short item's few words is left alone unless they are a twentieth of it. Null and empty texts stay, repeated rows share
    their fate, an empty benchmark drops nothing, and other columns may have any names.
    """
    rows, ranges, _ = find(docs, items, text_col, item_id, item_text, window, F.lit(True))
    bad = ranges.join(rows.select("key", "n_words").distinct(), "key").where(f"n_hit >= {window} or 20 * n_hit >= n_words").select("key")
    bad = materialise(bad)
    few = bad.count() <= BROADCAST_KEYS
    key = F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")))
    return docs.join(F.broadcast(bad) if few else bad, key == bad["key"], "left_anti")


def with_digest(found: DataFrame) -> DataFrame:
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return with_digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
