"""Resumable evaluation over a stream of records.

Spark's checkpoint holds the offsets; a sidecar holds the identity of the run (ontology, evaluation map, detector) and its limit, because Spark does not
notice when the logic changes. Every micro-batch writes its totals and the files it has read under its batch id, so a replayed batch replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ontology import EVALUATION_TYPES, ONTOLOGY
from ..operators.detect import PATTERN, candidates, detected
from ..operators.scoring import mapped, match_counts, strict_counts
from ..sources import store
from ..sources.identity import StateError, checked_rows, digest, invalid_totals, require_equal

VERSION = 2
TOTALS = "entity_type string, tp long, fp long, fn long, batch string"


def run_identity(detector: str = PATTERN, ontology: dict[str, str] = ONTOLOGY) -> dict:
    return {"version": VERSION, "detector": {"sha256": digest(detector)}, "ontology": {"sha256": digest(ontology)}, "evaluation_types": EVALUATION_TYPES}


@dataclass(frozen=True)
class Run:
    """Where a run keeps its state, and how it may begin: afresh, resuming what is there, or starting over."""

    spark: SparkSession
    folder: str
    resume: bool = False
    restart: bool = False
    limit: int | None = None

    def begin(self, identity: dict) -> int | None:
        """Checks the rules and the saved identity, and returns the limit of the state that is resumed."""
        if self.resume and self.restart:
            raise StateError("a run either resumes or restarts")
        if self.limit is not None and self.limit < 1:
            raise StateError("the limit must be positive")
        path = f"{self.folder}/identity.json"
        there = store.exists(self.spark, path)
        if there and not (self.resume or self.restart):
            raise StateError("the folder has the state of an earlier run; resume or restart it, or choose another")
        if self.resume and not there:
            raise StateError("there is no state to resume")
        before = None
        if self.resume:
            held = store.read_json(self.spark, path)
            if held.get("sha256") != digest(held.get("identity")):
                raise StateError("the state's identity is damaged")
            require_equal(held["identity"], identity, "the run")
            self.check_position()
            before = held.get("limit")
            if self.limit is not None and (before is None or before > self.limit) and self.examples() > self.limit:
                raise StateError("the state covers more examples than the limit")
        else:
            store.remove(self.spark, self.folder)
        store.write_json(self.spark, path, {"identity": identity, "sha256": digest(identity), "limit": self.limit})
        return before

    def check_position(self) -> None:
        """Every batch that Spark has committed must have its totals."""
        committed = {n for n in store.names(self.spark, f"{self.folder}/offsets/commits") if n.isdigit()}
        scored = {n.removeprefix("batch=") for n in store.names(self.spark, f"{self.folder}/totals")}
        if not committed <= scored:
            raise StateError("the state's totals do not reach its position")

    def examples(self) -> int:
        path = f"{self.folder}/files"
        return self.spark.read.schema("file string, examples long").parquet(path).agg(F.coalesce(F.sum("examples"), F.lit(0))).first()[0] if store.exists(self.spark, path) else 0


def score_batch(docs: DataFrame) -> DataFrame:
    """tp, fp, fn by type of one batch: candidates are the predictions, those with valid check digits the truth."""
    truth, predicted = mapped(detected(docs)), mapped(candidates(docs))
    return strict_counts(match_counts(truth, predicted))


def evaluate(
    spark: SparkSession, source: str, folder: str, schema, resume: bool = False, files_per_batch: int = 1, identity: dict | None = None, scorer=score_batch, restart: bool = False,
    limit: int | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """Evaluate all files of ``source`` that the state in ``folder`` has not seen, and return the totals so far.

    ``limit`` keeps the examples with a smaller id. A resumed run may raise it: the examples between the old limit and the new one that lie in files read
    before are scored first.
    """
    run = Run(spark, folder, resume, restart, limit)
    before = run.begin(identity or run_identity())

    def write(rows: DataFrame, name: str) -> None:
        checked_rows(scorer(rows), invalid_totals()).write.mode("overwrite").parquet(f"{folder}/totals/batch={name}")

    within = F.lit(True) if limit is None else F.col(id_col) < limit
    if before is not None and (limit is None or limit > before):
        seen = spark.read.schema("file string, examples long").parquet(f"{folder}/files").select("file").distinct()
        late = spark.read.schema(schema).parquet(source).where((F.col(id_col) >= before) & within).withColumn("__file", F.input_file_name())
        late = late.join(seen, F.col("__file") == F.col("file"), "left_semi").drop("__file")
        write(late, f"from{before}to{limit or 'end'}")
    fields = [f.name for f in schema.fields]

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(within)
        write(rows.select(*fields), str(batch_id))
        # every file counts as read, also where the limit leaves nothing of it
        read = batch.groupBy(F.col("__file").alias("file")).agg(F.count_if(within).alias("examples"))
        read.write.mode("overwrite").parquet(f"{folder}/files/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).withColumn("__file", F.input_file_name())
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return totals(spark, folder)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    held = spark.read.schema(TOTALS).parquet(f"{folder}/totals")
    return held.groupBy("entity_type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def running_counts(stream: DataFrame) -> DataFrame:
    """Entities of a stream of documents by label, as a streaming aggregate (complete or update mode)."""
    return detected(stream).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
