"""Scan of artifacts for sensitive strings: an equi-join on substrings that hashes pick out instead of a product of strings and texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.substrings import likely_occurrences
from ..sources.store import materialise

MIN_LENGTH = 6
TEXT_PREFIX = 40
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
SUFFIXES = ("json", "md", "txt", "log", "yaml", "csv")
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20  # larger sets of values are joined by shuffle


def sensitive_values(texts: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entity values and the first 40 characters of every text, of at least six characters; repeats are counted in ``copies``."""
    values = spans.select("value").union(texts.select(F.substring(text_col, 1, TEXT_PREFIX)))
    return values.where(F.length("value") >= MIN_LENGTH).groupBy("value").agg(F.count(F.lit(1)).alias("copies"))


def index_size(values: DataFrame) -> DataFrame:
    """Distinct values, and how many there are with repeats."""
    return values.agg(F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("values"))


def read_artifacts(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Text artifacts below ``path`` but those that ``skip`` names (ends of paths): artifact, content."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").text(path, wholetext=True).select(F.input_file_name().alias("artifact"), F.col("value").alias("content"))
    for name in skip:
        found = found.where(~F.col("artifact").endswith("/" + name.lstrip("/")))
    return found


def hardware_words(value) -> list[str]:
    """Strings below every ``hardware`` object of a report: device names that a report may print."""
    out, todo = [], [(value, False)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, dict):
            todo.extend((v, k == "hardware" and isinstance(v, dict)) for k, v in x.items())
            out += [v for v in x.values() if inside and isinstance(v, str)]
        elif isinstance(x, list):
            todo.extend((v, False) for v in x)
    return sorted(out)


def report_vocabulary(spark: SparkSession, sources: DataFrame, reports: list[str]) -> DataFrame:
    """Words of the sources and of the hardware that the JSON ``reports`` name."""
    extra = [(w,) for text in reports for w in hardware_words(json.loads(text))]
    return vocabulary(sources.select("content").union(spark.createDataFrame(extra, "content string")))


def vocabulary(sources: DataFrame, text_col: str = "content") -> DataFrame:
    """Lower-cased words that templates and configurations may print."""
    return sources.select(F.explode(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()


def leaks(artifacts: DataFrame, values: DataFrame, words: DataFrame | None = None, id_col: str = "artifact", content_col: str = "content") -> DataFrame:
    """Whole-token occurrences, overlapping ones included: artifact, offset, length, kind (numeric, template_vocabulary, leak).

    One pass over the texts keeps the substrings that a bit map of the values lets through, and an equi-join tells the values among them. Neither
    depends on how many values share a token.
    """
    wanted = materialise(values.select("value").where(F.length("value") >= MIN_LENGTH).distinct())
    rows, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    way = scanned if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else joined
    return way(artifacts, materialise(classified(wanted, words)), id_col, content_col).select(id_col, "offset", "length", "kind")


def occurrences(artifacts: DataFrame, wanted: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Every occurrence of the distinct values, and perhaps substrings that are no value: id, offset, length, value."""
    found = likely_occurrences(F.col(content_col), wanted.select("value"), wanted.count(), MIN_LENGTH)
    return artifacts.select(id_col, F.explode(found).alias("h")).select(id_col, "h.offset", F.length("h.value").cast("long").alias("length"), "h.value")


def scanned(artifacts: DataFrame, wanted: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """The occurrences with what is known of their values: for value sets of a checked size."""
    return occurrences(artifacts, wanted, id_col, content_col).join(F.broadcast(wanted), "value")


def joined(artifacts: DataFrame, wanted: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """The same for value sets of any size."""
    return occurrences(artifacts, wanted, id_col, content_col).join(wanted, "value")


def hit_kind(value: Column, all_known: Column) -> Column:
    template = all_known & ~value.rlike("[^A-Za-z0-9_ ]")
    return F.when(~value.rlike(r"\p{L}"), "numeric").when(template, "template_vocabulary").otherwise("leak")


def classified(values: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """value, kind. A value is template vocabulary if there is a vocabulary and none of the value's words is outside it."""
    if words is None:
        return values.select("value", hit_kind(F.col("value"), F.lit(False)).alias("kind"))
    parts = values.select("value", F.explode_outer(F.regexp_extract_all("value", F.lit(WORD), F.lit(0))).alias("w")).withColumn("word", F.lower("w"))
    outside = parts.where("word is not null").join(words, "word", "left_anti").select("value").distinct().withColumn("foreign", F.lit(True))
    return values.join(outside, "value", "left").select("value", hit_kind(F.col("value"), F.col("foreign").isNull()).alias("kind"))


def leak_counts(hits: DataFrame, id_col: str = "artifact") -> DataFrame:
    return hits.groupBy(id_col, "kind").agg(F.count(F.lit(1)).alias("hits"))


def first_leaks(hits: DataFrame, id_col: str = "artifact", limit: int = 10) -> DataFrame:
    """The first real leaks of every artifact by offset: where they are, never what they are."""
    order = Window.partitionBy(id_col).orderBy("offset", "length")
    return hits.where("kind = 'leak'").withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= limit).select(id_col, "position", "offset", "length")
