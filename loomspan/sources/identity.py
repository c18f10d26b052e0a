"""Identities of runs, files and models: digests, differences by path, and the fields that state may hold."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What labels, types and failure groups may look like.
NATIVE_LABEL = r"^[a-z][a-z0-9_]{0,63}$"
ENTITY_TYPE = r"^[A-Z][A-Z0-9_]{0,63}$"
FAILURE_GROUP = r"^[a-z][a-z0-9_]{0,63}$"


class StateError(ValueError):
    """Saved state that does not fit, or is damaged. Messages never show values."""


def leaves(value, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], str]:
    """A nested value as a flat table from paths to JSON scalars; an empty object or a list is a leaf."""
    if not isinstance(value, dict) or not value:
        return {path: json.dumps(value, sort_keys=True)}
    return {p: v for key, inner in value.items() for p, v in leaves(inner, (*path, str(key))).items()}


def digest(value) -> str:
    """One hash for equal values, whatever the order of their keys: over the sorted rows of the flat table."""
    rows = sorted((json.dumps(list(p)), v) for p, v in leaves(value).items())
    return hashlib.sha256("\n".join(f"{p} {v}" for p, v in rows).encode()).hexdigest()


def differing_paths(a, b) -> list[str]:
    """Dotted paths at which two identities differ, never what they hold. A path that only one has counts where the other one ends."""
    left, right = leaves(a), leaves(b)
    changed = {p for p in left.keys() | right.keys() if left.get(p) != right.get(p)}
    # of an object against a scalar only the shorter path is told
    return sorted({".".join(p) for p in changed if not any(p[:n] in changed for n in range(1, len(p)))})


def require_equal(held, now, what: str) -> None:
    if differing := differing_paths(held, now):
        raise StateError(f"{what} differs in: " + ", ".join(differing))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def lines_before(spark: SparkSession, path: str, offset: int, piece: int = 1 << 20) -> int:
    """Newlines in the first ``offset`` bytes of a file, read in pieces of bounded size."""
    from .store import file_system

    fs, at = file_system(spark, path)
    stream, left, found = fs.open(at), offset, 0
    try:
        while left > 0:
            block = bytes(stream.readNBytes(min(piece, left)))
            if not block:
                break
            found, left = found + block.count(b"\n"), left - len(block)
    finally:
        stream.close()
    return found


def invalid_totals() -> Column:
    """Whether a row (entity_type, tp, fp, fn) may not enter a run's state."""
    counts = [F.col(c).isNull() | (F.col(c) < 0) for c in ("tp", "fp", "fn")]
    bad = ~F.coalesce(F.col("entity_type").rlike(ENTITY_TYPE), F.lit(False))
    for c in counts:
        bad = bad | c
    return bad


def invalid_samples() -> Column:
    """Whether a row (example_index, entity_type, start, end, failure_group) may not enter a run's state."""
    bad = ~F.coalesce(F.col("entity_type").rlike(ENTITY_TYPE) & F.col("failure_group").rlike(FAILURE_GROUP), F.lit(False))
    for c in ("example_index", "start", "end"):
        bad = bad | F.col(c).isNull() | (F.col(c) < 0)
    return bad | (F.col("end") <= F.col("start"))


def checked_rows(df: DataFrame, bad: Column) -> DataFrame:
    """The rows, failing the query at the first that ``bad`` is true of, without showing it."""
    return df.where(F.when(bad, F.raise_error(F.lit("a row of the state is invalid")).cast("boolean")).otherwise(F.lit(True)))
