"""Raw predictions: validation, canonical order, deduplication, overlaps, thresholds, sampling, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ontology import UNMAPPED
from ..functions.spans import overlaps, valid_span
from ..sources.store import materialise
from .scoring import above, with_prf

SPAN = ("example_index", "label", "start", "end")
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
TIE = 1e-4
MATERIAL_GAP = 0.05


def violations(predictions: DataFrame, lengths: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Predictions that no model may emit, with the reason; the value itself is never part of the row."""
    score = F.col("score")
    reason = (
        F.when(F.col("label").isNull() | ~F.col("label").isin(*labels), "label").when(~valid_span(F.col("start"), F.col("end"), F.col("length")), "bounds")
        .when(score.isNull() | F.isnan(score) | (score < 0) | (score > 1), "score")
    )
    return predictions.join(lengths, "example_index", "left").withColumn("reason", reason).where("reason is not null").select("example_index", "start", "end", "reason")


def deduplicated(predictions: DataFrame) -> DataFrame:
    """Best score of every (label, start, end), and how many rows it stands for."""
    return predictions.groupBy(*SPAN).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("copies"))


def canonical(predictions: DataFrame) -> DataFrame:
    """Position of every prediction in its example: by start, end, label, then best score first."""
    order = Window.partitionBy("example_index").orderBy("start", "end", "label", F.col("score").desc())
    return predictions.withColumn("position", F.row_number().over(order).cast("long"))


def overlap_pairs(predictions: DataFrame) -> DataFrame:
    """Pairs of predictions of an example that overlap: an equi-join with the range as residual."""
    a = canonical(predictions).select("example_index", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("position").alias("a_at"))
    b = a.select(F.col("example_index").alias("b_example"), F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"), F.col("a_at").alias("b_at"))
    joined = a.join(b, (F.col("example_index") == F.col("b_example")) & (F.col("a_at") < F.col("b_at")) & overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return joined.groupBy("example_index").agg(F.count(F.lit(1)).alias("pairs"))


def threshold_sweep(truth: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Totals at every threshold in one pass: a span above the k-th threshold counts for all thresholds up to it.

    ``truth`` and ``predictions`` carry entity_type. A span's score array is its predictions' scores; matched counts follow by
    comparing how many of them pass with how often truth has the span.
    """
    key = ("example_index", "entity_type", "start", "end")
    both = truth.select(*key, F.lit(1).alias("t"), F.lit(None).cast("double").alias("score")).union(predictions.where(F.col("entity_type") != UNMAPPED).select(*key, F.lit(0), "score"))
    passing = [F.sum(F.when(F.col("score") > t, 1).otherwise(0)).alias(f"p{i}") for i, t in enumerate(thresholds)]
    spans = both.groupBy(*key).agg(F.sum("t").alias("t"), *passing)
    sums = spans.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(f"{n}{i}") for i in range(len(thresholds)) for n, e in (("tp", F.least("t", f"p{i}")), ("fp", F.greatest(F.col(f"p{i}") - F.col("t"), F.lit(0))), ("fn", F.greatest(F.col("t") - F.col(f"p{i}"), F.lit(0))))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *(F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn"))) for i, t in enumerate(thresholds)]))
    return with_prf(sums.select(rows.alias("r")).select("r.*"))


def selected_threshold(sweep: DataFrame, tie: float = TIE) -> DataFrame:
    """The best F1; among those within ``tie`` of it the lowest threshold. The sweep has a row per candidate only."""
    return sweep.withColumn("best", F.max("f1").over(Window.partitionBy())).where(F.col("f1") >= F.col("best") - tie).orderBy("threshold").limit(1).select("threshold", "f1")


def keyed_sample(df: DataFrame, index: str, size: int, seed: int | str) -> DataFrame:
    """The ``size`` rows with the smallest sha256 of "seed:index"; a top-k, not a full sort."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")), 256)
    return df.withColumn("__rank", rank).orderBy("__rank", index).limit(size).drop("__rank")


def agreement(reference: DataFrame, candidate: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Two runs over the same texts: identical examples, spans in one only, shared ones and the largest score difference.

    Repeated spans of a run count once, with their last-listed (here: best) score.
    """
    side = lambda d, n: d.groupBy(*SPAN).agg(F.max("score").alias(n))
    both = side(reference, "r").join(side(candidate, "c"), list(SPAN), "full")
    per = both.groupBy("example_index").agg(F.count_if(F.col("c").isNull()).alias("only_r"), F.count_if(F.col("r").isNull()).alias("only_c"), F.count_if(F.col("r").isNotNull() & F.col("c").isNotNull()).alias("shared"), F.max(F.abs(F.col("r") - F.col("c"))).alias("delta"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = per.agg(
        F.count_if((F.col("only_r") == 0) & (F.col("only_c") == 0)).alias("identical_examples"), F.count(F.lit(1)).alias("examples"), n("only_r").alias("only_reference"),
        n("only_c").alias("only_candidate"), n("shared").alias("shared"), F.round(F.coalesce(F.max("delta"), F.lit(0.0)), 6).alias("max_score_delta"),
    )
    return out.withColumn("within_tolerance", (F.col("only_reference") == 0) & (F.col("only_candidate") == 0) & (F.col("max_score_delta") <= tolerance))


def post_filter_check(stored: DataFrame, direct: DataFrame, threshold: float) -> DataFrame:
    """Predictions stored at a low threshold and filtered later against a run made at the higher one."""
    out = agreement(above(stored, threshold), direct)
    return out.select("examples", "identical_examples", F.col("only_reference").alias("only_post_filtered"), F.col("only_candidate").alias("only_direct"))


def detector_comparison(a: DataFrame, b: DataFrame, gap: float = MATERIAL_GAP) -> DataFrame:
    """Two detectors' metric rows by type: F1 of both, the difference and who is stronger by at least ``gap``."""
    side = lambda d, n: d.select("entity_type", F.col("f1").alias(f"{n}_f1"), F.col("support").alias(f"{n}_support"), F.col("predictions").alias(f"{n}_predictions"))
    both = side(a, "a").join(side(b, "b"), "entity_type", "full")
    rows = both.select("entity_type", *(F.coalesce(c, F.lit(0.0) if c.endswith("f1") else F.lit(0)).alias(c) for c in both.columns if c != "entity_type"))
    delta = F.round(F.col("b_f1") - F.col("a_f1"), 6)
    bucket = F.when(F.col("entity_type") == UNMAPPED, "excluded").when(delta >= gap, "b_stronger").when(delta <= -gap, "a_stronger").otherwise("similar")
    return rows.select("entity_type", F.greatest("a_support", "b_support").alias("support"), "a_f1", "b_f1", delta.alias("delta_f1"), bucket.alias("strength"), (F.col("a_predictions") > 0).alias("a_emits"), (F.col("b_predictions") > 0).alias("b_emits"))


def recall_without_unmapped(metrics: DataFrame) -> DataFrame:
    """Exact matches over the support that has a gateway type."""
    hits, support = F.sum("tp"), F.sum(F.when(F.col("entity_type") != UNMAPPED, F.col("support")).otherwise(0))
    return metrics.agg(F.round(F.when(support > 0, hits / support).otherwise(0.0), 6).alias("recall"), support.cast("long").alias("support"))


def percentile(df: DataFrame, column: str, fractions: tuple[float, ...]) -> DataFrame:
    """sorted[min(n - 1, floor(f * n))] without collecting the column: ranges are counted, then only the wanted ranks are looked up.

    Rows are range-partitioned by value; a rank is a partition's offset plus a position in it.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value"))
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    parts = materialise(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()))  # read twice: the ids must be the same
    offsets = parts.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy()))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("upto", F.sum("n").over(inside)).join(offsets, "part").withColumns({"last": F.col("offset") + F.col("upto")}).withColumn("first", F.col("last") - F.col("n"))
    wanted = ranked.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    rank = F.least(F.floor(F.col("fraction") * F.col("total")), F.col("total") - 1)
    return wanted.where((rank >= F.col("first")) & (rank < F.col("last"))).select("fraction", "value")


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """The column's rows with ``line``, their 0-based rank: positions within range partitions plus the sizes of those before."""
    parts = materialise(df.select(column).repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return parts.withColumn("inside", inside).join(offsets, "part").select(column, (F.col("offset") + F.col("inside")).alias("line"))


def summary(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean and largest value of every metric, nulls skipped, metrics without values left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*").where("value is not null")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 1).alias("mean"), F.round(F.max("value"), 1).alias("max"))

