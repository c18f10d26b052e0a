"""Shared plumbing of the corpus operators: table access, deterministic splits and Arrow row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.store import materialise, shared_folder

__all__ = ["bucket", "distinct_name", "labelled_rows", "labelled_sample", "map_batches", "map_partitions", "materialise", "pieces", "shared_folder", "table", "text_of", "whole"]

#: Rows and bytes of the pieces in which workers look at an Arrow batch: documents may be megabytes long.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
BROADCAST_IDS = 1_000_000  # ids shipped to the documents; more are joined by shuffle, behind a bit map of FILTER_WORDS 64-bit words
FILTER_WORDS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def text_of(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def whole(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of every row of a string or binary column; zeros for other kinds."""
    if len(column) and (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
        return np.diff(offsets.astype(np.int64))
    return np.zeros(len(column), np.int64)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes of text (one row at least), without copies."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(sum((row_bytes(c) for c in b.columns), np.zeros(b.num_rows, np.int64)))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, stop - at)
            at = stop


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to every piece of the Arrow batches of ``df``; it returns columns (lists or arrays) of ``schema``."""
    return map_partitions(df, lambda batches: (fn(b) for b in batches), schema)


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """As map_batches, for functions that keep state over the batches of a partition."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in fn(pieces(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else whole(out[f.name]).cast(f.type) for f in target],
                schema=target,
            )

    return df.mapInArrow(run, schema)


def distinct_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name (whatever its case)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text"):
    """At most ``limit`` labelled training rows as (text, label) lists, in an order fixed by the id's hash.

    Rows whose bucket is ``remainder`` are held out. Null labels are ignored; of several labels of one id the largest counts, and of several texts
    the least. Twice the limit of ids are looked up, so that up to as many labels without a document do not shorten the sample.
    """
    order = F.xxhash64("__id")
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (bucket(id_col, modulus) != remainder))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
        .orderBy(order, "__id").limit(2 * limit)
    )
    found = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = found.groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__y").alias("__y")).orderBy(order, "__id").limit(limit).toArrow()
    kept = sorted(range(rows.num_rows), key=lambda i: rows["__id"][i].as_py())
    return [rows["__text"][i].as_py() for i in kept], [rows["__y"][i].as_py() for i in kept]


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All labelled training rows (__id, __text, __y), one per id, under the rules of ``labelled_sample`` for held-out rows, null labels and ids that repeat."""
    hint = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    labelled = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (bucket(id_col, modulus) != remainder))
    chosen = materialise(labelled.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y")))
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    if chosen.count() <= BROADCAST_IDS:
        found = texts.join(F.broadcast(chosen), "__id")
    else:
        # most texts without a label stay where they are
        word, bit = F.pmod(F.xxhash64("__id"), F.lit(FILTER_WORDS)).alias("__word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(__id), 58) as int))")
        bits = chosen.groupBy(word).agg(F.bit_or(bit).alias("__bits"))
        likely = texts.withColumn("__word", word).join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
        found = materialise(likely.select("__id", "__text").join(chosen, "__id"))
    # only the texts of ids that repeat are brought together
    repeated = materialise(found.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"))
    if repeated.isEmpty():
        return found
    least = found.join(hint(repeated), "__id", "left_semi").groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__y").alias("__y"))
    return found.join(hint(repeated), "__id", "left_anti").unionByName(least)
