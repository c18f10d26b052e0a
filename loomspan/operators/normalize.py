"""Normalisation of annotated records and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ontology import ONTOLOGY, evaluation_type, gateway_type
from ..functions.spans import valid_span

SPANS = "array<struct<start:int,end:int,label:string>>"


def parse_spans(column: Column) -> Column:
    """Annotations given as a Python literal. Elements that are no ints or strings come out null, which ``span_violations`` reports."""
    return F.from_json(column, SPANS, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"})


def normalise(records: DataFrame, ontology: dict[str, str] = ONTOLOGY, on_unknown: str = "unmapped") -> DataFrame:
    """(example_index, text, spans) to (example_index, text, entities), entities sorted by start, end and mapped type."""
    typed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), gateway_type(s["label"], ontology, on_unknown).alias("type")))
    return records.select("example_index", "text", F.coalesce(F.array_sort(typed), F.expr("cast(array() as array<struct<start:int,end:int,type:string>>)")).alias("entities"))


def exploded(records: DataFrame, column: str = "entities") -> DataFrame:
    return records.select("example_index", F.explode(column).alias("e")).select("example_index", "e.*")


def span_violations(records: DataFrame) -> DataFrame:
    """One row per annotation that breaks a rule, never its text: example_index, position, reason."""
    text = F.coalesce(F.length("text"), F.lit(-1))
    each = records.select("example_index", text.alias("n"), F.posexplode("spans").alias("position", "s"))
    reason = (
        F.when(F.col("n") < 0, "text").when(F.col("s").isNull() | F.col("s.start").isNull() | F.col("s.end").isNull(), "annotation")
        .when(F.col("s.label").isNull() | (F.col("s.label") == ""), "label").when(~valid_span(F.col("s.start"), F.col("s.end"), F.col("n")), "bounds")
    )
    broken = each.select("example_index", F.col("position").cast("long").alias("position"), reason.alias("reason")).where("reason is not null")
    whole = records.where(F.col("spans").isNull()).select("example_index", F.lit(-1).cast("long").alias("position"), F.lit("annotation").alias("reason"))
    return broken.union(whole)


def checked(records: DataFrame) -> DataFrame:
    """The records, failing the query at the first invalid annotation without showing it."""
    bad = F.exists("spans", lambda s: s["start"].isNull() | s["end"].isNull() | s["label"].isNull() | (s["label"] == "") | ~valid_span(s["start"], s["end"], F.length("text")))
    ok = F.when(F.col("text").isNull() | F.col("spans").isNull() | F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a record has an invalid annotation")).cast("boolean")).otherwise(F.lit(True))
    return records.where(ok)


def for_evaluation(normalised: DataFrame) -> DataFrame:
    """Normalised records checked again, with evaluation types (dates and times merged), entities sorted by start, end and type."""
    ok = checked(normalised.select("example_index", "text", F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("label"))).alias("spans")))
    typed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), evaluation_type(s["label"]).alias("type")))
    return ok.select("example_index", "text", F.array_sort(typed).alias("entities"))


def aligned(normalised: DataFrame, raw: DataFrame, predictions: DataFrame) -> DataFrame:
    """The three inputs joined on example_index; texts and mapped entities must agree, unknown labels are errors."""
    again = normalise(raw, on_unknown="error").select("example_index", F.col("text").alias("raw_text"), F.col("entities").alias("raw_entities"))
    both = normalised.join(again, "example_index").join(predictions, "example_index")
    same = (F.col("text") == F.col("raw_text")) & (F.array_sort("entities") == F.col("raw_entities"))
    fine = F.when(~F.coalesce(same, F.lit(False)), F.raise_error(F.lit("inputs disagree")).cast("boolean")).otherwise(F.lit(True))
    return both.where(fine).drop("raw_text", "raw_entities")


def inspect_split(records: DataFrame) -> DataFrame:
    """Rows of every native label, and the number of records (null label), in one pass."""
    labels = records.select(F.explode_outer("spans").alias("s"), "example_index")
    return labels.groupBy(F.col("s.label").alias("label")).agg(F.count("s").alias("spans"), F.countDistinct("example_index").alias("records"))
