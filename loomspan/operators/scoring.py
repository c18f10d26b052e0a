"""Strict exact-span scoring of predictions against truth, with error taxonomies.

Spans are rows (example_index, entity_type, start, end), repeated rows counting as often as they appear. Both sides are
united and grouped once; every metric derives from that one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ontology import UNMAPPED, adapter_category, evaluation_type, gateway_type
from ..functions.spans import nested, overlaps

KEY = ("example_index", "entity_type", "start", "end")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; an empty denominator gives 0."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def with_prf(df: DataFrame) -> DataFrame:
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def mapped(df: DataFrame, ontology=None, on_unknown: str = "unmapped") -> DataFrame:
    """Native labels to evaluation types; the label stays."""
    kind = gateway_type(F.col("label"), on_unknown=on_unknown) if ontology is None else gateway_type(F.col("label"), ontology, on_unknown)
    return df.withColumn("entity_type", evaluation_type(kind))


def above(predictions: DataFrame, threshold: float) -> DataFrame:
    """Strictly above the threshold."""
    return predictions.where(F.col("score") > threshold)


def match_counts(truth: DataFrame, predicted: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per distinct span: how often it is in truth and in predictions, and tp, fp, fn (multiset semantics)."""
    both = truth.select(*key, F.lit(1).alias("t"), F.lit(0).alias("p")).union(predicted.select(*key, F.lit(0), F.lit(1)))
    sums = both.groupBy(*key).agg(F.sum("t").alias("truth"), F.sum("p").alias("predicted"))
    return sums.withColumns({"tp": F.least("truth", "predicted"), "fp": F.greatest(F.col("predicted") - F.col("truth"), F.lit(0)), "fn": F.greatest(F.col("truth") - F.col("predicted"), F.lit(0))})


def totals() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]


def strict_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("entity_type").agg(*totals())


def strict_metrics(counts: DataFrame) -> DataFrame:
    """One row per type that is in truth or predictions."""
    rows = with_prf(strict_counts(counts))
    return rows.withColumns({"support": F.col("tp") + F.col("fn"), "predictions": F.col("tp") + F.col("fp")})


def strict_overall(counts: DataFrame) -> DataFrame:
    zero = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    return with_prf(counts.agg(*zero))


def strict_rollup(counts: DataFrame) -> DataFrame:
    """Types and, with a null type, all of them, in one pass."""
    return with_prf(counts.rollup("entity_type").agg(*totals()))


def strict_by_set_operations(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same totals from multiset intersection and difference; a cross-check of ``strict_counts``."""
    t, p = truth.select(*KEY), predicted.select(*KEY)
    parts = [d.groupBy("entity_type").agg(F.count(F.lit(1)).alias(n)) for d, n in ((t.intersectAll(p), "tp"), (p.exceptAll(t), "fp"), (t.exceptAll(p), "fn"))]
    joined = reduce(lambda a, b: a.join(b, "entity_type", "full"), parts)
    return joined.select("entity_type", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))


def with_overlaps(side: DataFrame, other: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows of ``side`` with a flag per test over the overlapping rows of ``other`` (columns prefixed o_); equal example, then the range."""
    renamed = other.select(F.col("example_index").alias("o_example"), F.col("entity_type").alias("o_type"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    condition = (F.col("example_index") == F.col("o_example")) & overlaps(F.col("o_start"), F.col("o_end"), F.col("start"), F.col("end"))
    flags = [F.coalesce(F.max(F.when(F.col("o_example").isNotNull(), test)), F.lit(False)).alias(n) for n, test in tests.items()]
    return side.join(renamed, condition, "left").groupBy(*side.columns).agg(*flags)


def _same_type() -> Column:
    return F.col("o_type") == F.col("entity_type")


def _same_span() -> Column:
    return (F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end"))


def failures(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Distinct unmatched spans with kind (fn or fp) and failure group; duplicates of a span are one failure."""
    counts = match_counts(truth, predicted)
    lost = counts.where("predicted = 0").select(*KEY)
    extra = counts.where("truth = 0").select(*KEY)
    fn = with_overlaps(lost, predicted, {"same": _same_type()}).select(F.lit("fn").alias("kind"), *KEY, F.when(F.col("same"), "span_mismatch").otherwise(adapter_category(F.col("entity_type"))).alias("failure_group"))
    fp = with_overlaps(extra, truth, {"same": _same_type()}).select(F.lit("fp").alias("kind"), *KEY, F.when(F.col("same"), "span_mismatch").otherwise(F.lit("detector_recognizer")).alias("failure_group"))
    return fn.union(fp)


def failure_groups(failed: DataFrame) -> DataFrame:
    return failed.groupBy("kind", "failure_group").agg(F.count(F.lit(1)).alias("n"))


def first_samples(failed: DataFrame, kind: str, limit: int = 25) -> DataFrame:
    """The first failures in example order; a bounded top-k that needs no global sort of all rows."""
    order = ("example_index", "start", "end", "entity_type")
    top = failed.where(F.col("kind") == kind).orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).select("position", *KEY, "failure_group")


def false_negatives(truth: DataFrame, predicted: DataFrame, removed: DataFrame) -> DataFrame:
    """Unmatched truth with its multiplicity (n) and category: unmapped label, wrong type, wrong boundaries, overlap, removed prediction, missed."""
    lost = match_counts(truth, predicted).where("fn > 0").select(*KEY, F.col("fn").alias("n"))
    flagged = with_overlaps(lost, predicted, {"any_kept": F.lit(True), "span": _same_span(), "same": _same_type()})
    flagged = with_overlaps(flagged, removed, {"any_removed": F.lit(True)})
    category = (
        F.when(F.col("entity_type") == UNMAPPED, "unmapped_ground_truth_label").when(F.col("span"), "wrong_entity_type").when(F.col("same"), "wrong_boundaries")
        .when(F.col("any_kept"), "overlapping_prediction").when(F.col("any_removed"), "unmapped_prediction_label").otherwise("missed_entity")
    )
    return flagged.select(*KEY, "n", category.alias("category"))


def false_positives(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Unmatched predictions with multiplicity, category, and whether an overlapping truth span is nested with them."""
    extra = match_counts(truth, predicted).where("fp > 0").select(*KEY, F.col("fp").alias("n"))
    inside = nested(F.col("o_start"), F.col("o_end"), F.col("start"), F.col("end"))
    flagged = with_overlaps(extra, truth, {"any_truth": F.lit(True), "span": _same_span(), "same": _same_type(), "nested": inside})
    category = F.when(F.col("span"), "wrong_entity_type").when(F.col("same"), "wrong_boundaries").when(F.col("any_truth"), "overlapping_prediction").otherwise("false_positive")
    return flagged.select(*KEY, "n", category.alias("category"), "nested")


def taxonomy(errors: DataFrame) -> DataFrame:
    return errors.groupBy("category").agg(F.sum("n").cast("long").alias("n"))


def taxonomy_by_type(errors: DataFrame) -> DataFrame:
    """Counts by (type, category) and, with a null type, by category."""
    grouped = errors.cube("entity_type", "category").agg(F.sum("n").cast("long").alias("n"), F.grouping("category").alias("g"))
    return grouped.where("g = 0").drop("g")


def category_samples(errors: DataFrame, limit: int = 5) -> DataFrame:
    """The first spans of every category in example order, with their position."""
    order = Window.partitionBy("category").orderBy("example_index", "start", "end", "entity_type")
    return errors.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= limit).select("category", "position", *KEY)


def top_overlapping_labels(errors: DataFrame, native: DataFrame, limit: int = 5) -> DataFrame:
    """Native labels that took the place of lost spans, the most frequent per type; ties by label."""
    other = native.select(F.col("example_index").alias("o_example"), F.col("label").alias("native_label"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    condition = (F.col("example_index") == F.col("o_example")) & overlaps(F.col("o_start"), F.col("o_end"), F.col("start"), F.col("end"))
    hits = errors.where("category <> 'unmapped_ground_truth_label'").join(other, condition).groupBy("entity_type", "native_label").agg(F.sum("n").cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.col("n").desc(), "native_label"))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def native_counts(truth: DataFrame, native: DataFrame) -> DataFrame:
    """Match counts on native labels, before the ontology."""
    return match_counts(truth, native, ("example_index", "label", "start", "end"))


def native_metrics(counts: DataFrame) -> DataFrame:
    return with_prf(counts.groupBy("label").agg(*totals()))


def removed_by_ontology(counts: DataFrame) -> DataFrame:
    """Predictions whose label has no gateway type, and how many of them match native truth exactly."""
    gone = counts.where(gateway_type(F.col("label")) == UNMAPPED).groupBy("label").agg(F.sum("predicted").cast("long").alias("removed"), F.sum("tp").cast("long").alias("removed_exact"))
    return gone.where("removed > 0")


def unmapped_outcomes(truth: DataFrame, native: DataFrame) -> DataFrame:
    """What the predictions did at truth spans that the ontology cannot express: exact, same span, overlap, none, and the total."""
    rows = truth.where(gateway_type(F.col("label")) == UNMAPPED).select("example_index", F.col("label").alias("entity_type"), "start", "end")
    numbered = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    flagged = with_overlaps(numbered, native.select("example_index", F.col("label").alias("entity_type"), "start", "end"), {"any": F.lit(True), "span": _same_span(), "exact": _same_span() & _same_type()})
    outcome = F.when(F.col("exact"), "exact_native_match").when(F.col("span"), "exact_span_other_native_label").when(F.col("any"), "overlapping_prediction").otherwise("no_prediction")
    named = flagged.select(F.explode(F.array(outcome, F.lit("total"))).alias("outcome"), "n")
    nothing = truth.sparkSession.range(1).select(F.lit("total").alias("outcome"), F.lit(0).cast("long").alias("n"))  # the total is there without spans, too
    return named.union(nothing).groupBy("outcome").agg(F.sum("n").cast("long").alias("n"))


def per_example(counts: DataFrame, key: str = "example_index") -> DataFrame:
    return counts.groupBy(key).agg(*totals())


def slices(examples: DataFrame, scores: DataFrame, *dimensions: str) -> DataFrame:
    """Metrics by every dimension alone: (dimension, value, examples, tp, fp, fn, precision, recall, f1). ``examples`` has all of them."""
    rows = examples.join(scores, "example_index", "left").select(*dimensions, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("s"), "tp", "fp", "fn")
    return with_prf(pairs.groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias("examples"), *totals()))


def greedy_matches(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact matches when the exact ones are listed first, next to those of an order-dependent matcher.

    The second lets predictions in (start, end, type) order consume the first unconsumed truth span of their type that they overlap, right or wrong; a
    diagnostic only. Per example the lists are folded; an example's spans are bounded by its text.
    """
    span = lambda d: d.groupBy("example_index").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type"))).alias("spans"))
    both = span(truth).withColumnRenamed("spans", "t").join(span(predicted).withColumnRenamed("spans", "p"), "example_index")
    zero = F.struct(F.col("t").alias("open"), F.lit(0).cast("long").alias("hits"))

    def step(acc, p):
        at = F.array_position(F.transform(acc["open"], lambda t: (t["entity_type"] == p["entity_type"]) & overlaps(t["start"], t["end"], p["start"], p["end"])), True)
        found = F.get(acc["open"], (at - 1).cast("int"))
        rest = F.filter(acc["open"], lambda t, i: i != at - 1)
        return F.when(at == 0, acc).otherwise(F.struct(rest.alias("open"), (acc["hits"] + ((found["start"] == p["start"]) & (found["end"] == p["end"])).cast("long")).alias("hits")))

    greedy = both.select(F.aggregate("p", zero, step, lambda acc: acc["hits"]).alias("hits")).agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("in_detector_order"))
    exact = match_counts(truth, predicted).agg(F.coalesce(F.sum("tp"), F.lit(0)).cast("long").alias("exact_first"))
    return exact.crossJoin(greedy)  # one row each
