"""Readers and writers of annotated records, predictions and reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .identity import StateError, checked_rows, digest, require_equal

RAW = "uid string, text string, spans string, document_format string"
NORMALISED = "example_index long, text string, entities array<struct<type:string,start:int,end:int>>"
PREDICTION = "i long, c int, d int, p array<array<string>>"
FORMAT, VERSION = "loomspan-predictions", 1


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw annotated records; only the four columns are read."""
    return spark.read.schema(RAW).parquet(path)


def read_normalised(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Normalised JSON lines with an explicit index; malformed lines fail the query."""
    df = spark.read.schema(NORMALISED).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.where(F.col("example_index") < limit)


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without an index: the 0-based line number becomes ``example_index``, files in the order of their names.

    A line's place is its file and its position in the file's read order. Pieces of files are read from their begin to their end, so that ids of a piece's lines
    follow each other: only one row per piece, its count and first id, is added up in one place and sent to the lines, which stay where they are.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = store.materialise(lines)
    pieces = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    numbered = lines.join(F.broadcast(offsets), ["file", "block"])
    record = F.from_json("value", "text string, entities array<struct<type:string,start:int,end:int>>", {"mode": "FAILFAST"})
    return numbered.select((F.col("offset") + F.col("at")).alias("example_index"), record.alias("r")).select("example_index", "r.*")


def write_normalised(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    entity = F.transform("entities", lambda e: F.struct(e["end"].alias("end"), e["start"].alias("start"), e["type"].alias("type")))
    df.select(entity.alias("entities"), "example_index", "text").write.json(path)


def selected(df: DataFrame, indices: DataFrame) -> DataFrame:
    """The rows whose example_index is listed."""
    return df.join(indices.select("example_index").distinct(), "example_index", "left_semi")


def source(spark: SparkSession, folder: str, name: str, dev_size: int = 10_000, seed: int = 13) -> DataFrame:
    """``test``: all rows of the test split. ``dev``: a keyed sample of the training split only."""
    from ..operators.predictions import keyed_sample

    if name == "test":
        return read_normalised(spark, f"{folder}/test")
    if name == "dev":
        return keyed_sample(read_normalised(spark, f"{folder}/train"), "example_index", dev_size, seed)
    raise ValueError("the source is dev or test")


def encoded(df: DataFrame) -> DataFrame:
    """Prediction records (i, c, d, p) in their stored form, p as arrays [label, start, end, score]; a malformed label fails the query."""
    named = F.forall("p", lambda x: F.coalesce(x["label"].rlike(r"^[a-z][a-z0-9_]{0,63}$"), F.lit(False)))
    values = F.transform("p", lambda x: F.array(x["label"], x["start"].cast("string"), x["end"].cast("string"), x["score"].cast("string")))
    return checked_rows(df, ~F.coalesce(named, F.lit(False))).select("c", "d", "i", values.alias("p"))


def write_predictions(df: DataFrame, path: str, identity: dict) -> None:
    """All records at once; the identity goes to a sidecar beside the data."""
    encoded(df).write.json(path)
    write_header(df.sparkSession, path, identity)


def write_header(spark: SparkSession, path: str, identity: dict) -> None:
    store.write_json(spark, f"{path}.header", {"format": FORMAT, "version": VERSION, "identity": identity, "identity_sha256": digest(identity)})


def read_header(spark: SparkSession, path: str) -> dict:
    head = store.read_json(spark, f"{path}.header")
    if head.get("format") != FORMAT or head.get("version") != VERSION or head.get("identity_sha256") != digest(head.get("identity")):
        raise StateError("the predictions header is invalid")
    return head


class PredictionSink:
    """Predictions written part by part, each durable before the next begins.

    A part covers a range of example indices and is published by renaming its folder, so that a crash leaves whole parts and drafts; drafts are
    removed on resume. Parts must follow each other, and the identity must be that of the first run.
    """

    def __init__(self, spark: SparkSession, path: str, identity: dict, resume: bool = False, restart: bool = False):
        if resume and restart:
            raise StateError("a run either resumes or restarts")
        there = store.exists(spark, f"{path}.header")
        if there and not (resume or restart):
            raise StateError("there are predictions already; resume or restart")
        if resume and not there:
            raise StateError("there are no predictions to resume")
        self.spark, self.path, self.completed = spark, path, 0
        if resume:
            require_equal(read_header(spark, path)["identity"], identity, "the predictions' run")
            for name in store.names(spark, path):
                if name.startswith("_"):
                    store.remove(spark, f"{path}/{name}")
                    continue
                first, _, last = name.removeprefix("part=").partition("-")
                if int(first) != self.completed:
                    raise StateError("the parts of the predictions do not follow each other")
                self.completed = int(last)
        else:
            store.remove(spark, path)
            write_header(spark, path, identity)

    def append(self, df: DataFrame, last: int) -> None:
        """The records of the examples from ``completed`` up to, not including, ``last``; others are an error."""
        if last <= self.completed:
            raise StateError("a part must go beyond what is there")
        draft = f"{self.path}/_draft"
        store.remove(self.spark, draft)
        outside = F.col("i").isNull() | (F.col("i") < self.completed) | (F.col("i") >= last)
        encoded(checked_rows(df, outside)).write.json(draft)
        store.rename(self.spark, draft, f"{self.path}/part={self.completed:015d}-{last:015d}")
        self.completed = last


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """example_index, chunks, duplicates_removed, predictions; a torn or malformed line fails the query."""
    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    typed = F.transform("p", lambda x: F.struct(x[0].alias("label"), x[1].cast("int").alias("start"), x[2].cast("int").alias("end"), x[3].cast("double").alias("score")))
    return rows.select(F.col("i").alias("example_index"), F.col("c").alias("chunks"), F.col("d").alias("duplicates_removed"), typed.alias("predictions"))


def outside_repository(path: str, repository: str) -> str:
    """Outputs with texts must not land in the repository."""
    if Path(path).resolve().is_relative_to(Path(repository).resolve()):
        raise ValueError("the output lies inside the repository")
    return path


def report(overall: DataFrame, metrics: DataFrame, groups: DataFrame) -> dict:
    """Small aggregates as one nested value."""
    return {
        "overall": overall.first().asDict(), "per_entity": {r["entity_type"]: {k: v for k, v in r.asDict().items() if k != "entity_type"} for r in metrics.collect()},
        "failure_groups": {f"{r['kind']}:{r['failure_group']}": r["n"] for r in groups.collect()},
    }


def render_markdown(value: dict) -> str:
    rows = ["| type | support | precision | recall | F1 |", "|---|---:|---:|---:|---:|"]
    rows += [f"| {t} | {m['support']:,} | {m['precision']:.4f} | {m['recall']:.4f} | {m['f1']:.4f} |" for t, m in sorted(value["per_entity"].items())]
    o = value["overall"]
    head = f"Precision {o['precision']:.4f}, recall {o['recall']:.4f}, F1 {o['f1']:.4f}; {o['tp']:,} exact matches, {o['fp']:,} false positives, {o['fn']:,} false negatives."
    groups = [f"- {k}: {n:,}" for k, n in sorted(value["failure_groups"].items())]
    return "\n".join(["# Span evaluation", "", head, "", *rows, "", "## Failure groups", "", *groups, ""])


def signed(value: float) -> str:
    return f"{value:+.4f}"


def percent(value: float) -> str:
    return f"{value:.1%}"


def render_comparison(rows: list[dict]) -> str:
    """The rows of a detector comparison as a Markdown table, by type."""
    lines = ["| type | support | share | A F1 | B F1 | difference | stronger |", "|---|---:|---:|---:|---:|---:|---|"]
    total = max(1, sum(r["support"] for r in rows))
    for r in sorted(rows, key=lambda r: r["entity_type"]):
        lines.append(f"| {r['entity_type']} | {r['support']:,} | {percent(r['support'] / total)} | {r['a_f1']:.4f} | {r['b_f1']:.4f} | {signed(r['delta_f1'])} | {r['strength']} |")
    return "\n".join(["# Detector comparison", "", *lines, ""])


def write_report(spark: SparkSession, value: dict, path: str) -> None:
    """The report as JSON and as Markdown, each file published whole."""
    store.write_json(spark, f"{path}.json", value)
    store.write_text(spark, f"{path}.md", render_markdown(value))


def comparable(a: dict, b: dict) -> None:
    """Two reports may be compared if they are of the same examples."""
    for key in ("examples", "support"):
        if a["overall"].get(key) != b["overall"].get(key):
            raise ValueError(f"the reports differ in {key}")


def read_label_map(value: dict, ontology: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """(model, revision, labels) of a detector's label map.

    It pins a model and its revision and maps native labels to gateway types. Where the ontology maps a label otherwise, a written reason
    must stand under ``deviations``; types must exist, and reasons may only name labels that are there.
    """
    model, revision, labels, reasons = value.get("model_id"), value.get("model_revision"), value.get("labels"), value.get("deviations") or {}
    rules = {
        "a pinned model and revision are missing": all(isinstance(x, str) and x for x in (model, revision)),
        "labels are missing": isinstance(labels, dict) and bool(labels),
        "deviations need written reasons": isinstance(reasons, dict) and all(isinstance(r, str) and r.strip() for r in reasons.values()),
    }
    if isinstance(labels, dict):
        known = {*ontology.values(), "UNMAPPED"}
        rules |= {
            "a label is empty": all(isinstance(x, str) and x for x in labels), "a type is unknown": all(t in known for t in labels.values()),
            "a label departs from the ontology without a reason": all(ontology.get(x, t) == t or x in reasons for x, t in labels.items()),
            "a reason names no label": isinstance(reasons, dict) and reasons.keys() <= labels.keys(),
        }
    if broken := [rule for rule, holds in rules.items() if not holds]:
        raise StateError("the label map is invalid: " + "; ".join(broken))
    return model, revision, dict(labels)
