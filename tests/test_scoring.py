"""Goldens of strict scoring, taxonomies and prediction handling."""

import pytest

from loomspan.functions import ontology
from loomspan.operators import predictions, scoring

KEY = "example_index long, entity_type string, start int, end int"


def spans(spark, rows):
    return spark.createDataFrame(rows, KEY)


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_strict_counts_golden(spark):
    truth = spans(spark, [(0, "PERSON", 0, 5), (1, "PERSON", 0, 3), (2, "EMAIL", 0, 7), (2, "PERSON", 9, 12), (3, "EMAIL", 1, 8), (4, "DATE_TIME", 0, 4), (5, "UNMAPPED", 0, 4), (5, "PERSON", 5, 8)])
    predicted = spans(spark, [(0, "PERSON", 0, 5), (1, "PERSON", 0, 3), (2, "EMAIL", 0, 7), (2, "PERSON", 9, 12), (3, "EMAIL", 1, 8), (3, "PERSON", 20, 23)])
    counts = scoring.match_counts(truth, predicted)
    assert as_set(scoring.strict_counts(counts), "entity_type", "tp", "fp", "fn") == {("DATE_TIME", 0, 0, 1), ("EMAIL", 2, 0, 0), ("PERSON", 3, 1, 1), ("UNMAPPED", 0, 0, 1)}
    assert as_set(scoring.strict_overall(counts), "tp", "fp", "fn") == {(5, 1, 3)}
    assert as_set(scoring.strict_by_set_operations(truth, predicted), "entity_type", "tp", "fp", "fn") == as_set(scoring.strict_counts(counts), "entity_type", "tp", "fp", "fn")


def test_multiset_semantics(spark):
    truth = spans(spark, [(0, "A", 0, 2)] * 3)
    predicted = spans(spark, [(0, "A", 0, 2)] * 2 + [(0, "B", 0, 2)])
    assert as_set(scoring.strict_overall(scoring.match_counts(truth, predicted)), "tp", "fp", "fn") == {(2, 1, 1)}


def test_empty_sides_give_zero(spark):
    empty = spans(spark, [])
    row = scoring.strict_overall(scoring.match_counts(empty, empty)).first()
    assert (row.tp, row.precision, row.recall, row.f1) == (0, 0.0, 0.0, 0.0)


def test_nested_same_type(spark):
    truth, predicted = spans(spark, [(0, "P", 235, 255)]), spans(spark, [(0, "P", 235, 242), (0, "P", 235, 255)])
    assert as_set(scoring.strict_overall(scoring.match_counts(truth, predicted)), "tp", "fp", "fn") == {(1, 1, 0)}
    assert as_set(scoring.greedy_matches(truth, predicted), "exact_first", "in_detector_order") == {(1, 0)}


def test_failure_groups(spark):
    truth, predicted = spans(spark, [(0, "PERSON", 1, 5), (1, "PERSON", 0, 5)]), spans(spark, [(0, "EMAIL_ADDRESS", 1, 5), (1, "PERSON", 0, 4)])
    got = as_set(scoring.failures(truth, predicted), "kind", "example_index", "failure_group")
    assert got == {("fn", 0, "supported_direct"), ("fp", 0, "detector_recognizer"), ("fn", 1, "span_mismatch"), ("fp", 1, "span_mismatch")}


@pytest.mark.parametrize("predicted, removed, category", [
    ([("ORG", 0, 3)], [], "wrong_entity_type"), ([("PERSON", 0, 2)], [], "wrong_boundaries"), ([("ORG", 1, 5)], [], "overlapping_prediction"),
    ([], [("UNMAPPED", 0, 3)], "unmapped_prediction_label"), ([], [], "missed_entity"),
])
def test_false_negative_categories(spark, predicted, removed, category):
    truth = spans(spark, [(0, "PERSON", 0, 3)])
    rows = lambda xs: spans(spark, [(0, *x) for x in xs])
    assert as_set(scoring.false_negatives(truth, rows(predicted), rows(removed)), "category", "n") == {(category, 1)}


@pytest.mark.parametrize("prediction, expected", [(("ORG", 0, 3), ("wrong_entity_type", True)), (("PERSON", 0, 5), ("wrong_boundaries", True)), (("ORG", 2, 6), ("overlapping_prediction", False)), (("PERSON", 10, 12), ("false_positive", False))])
def test_false_positive_categories(spark, prediction, expected):
    truth = spans(spark, [(0, "PERSON", 0, 3)])
    assert as_set(scoring.false_positives(truth, spans(spark, [(0, *prediction)])), "category", "nested") == {expected}


def test_unknown_labels(spark):
    df = spark.createDataFrame([("email",), ("future_label",)], "label string")
    assert [r[0] for r in df.select(ontology.gateway_type(df.label)).collect()] == ["EMAIL_ADDRESS", "UNMAPPED"]
    with pytest.raises(Exception) as e:
        df.select(ontology.gateway_type(df.label, on_unknown="error")).collect()
    assert "missing from the ontology" in str(e.value)


def test_ontology_file_round_trip():
    text = "# note\nlabels:\n" + "".join(f"  {k}: {v}\n" for k, v in ontology.ONTOLOGY.items())
    assert ontology.parse_ontology(text) == ontology.ONTOLOGY and len(ontology.ONTOLOGY) == 55
    with pytest.raises(ValueError):
        ontology.parse_ontology("labels:\n  Bad Label: X\n")


def test_dedup_overlap_threshold(spark):
    raw = spark.createDataFrame([(0, "email", 15, 23, 0.4), (0, "email", 15, 23, 0.8), (0, "x", 0, 7, 0.5), (0, "y", 4, 7, 0.51), (0, "z", 6, 10, 0.9), (0, "w", 23, 26, 0.9)], "example_index long, label string, start int, end int, score double")
    best = predictions.deduplicated(raw)
    assert (0, "email", 0.8, 2) in as_set(best, "example_index", "label", "score", "copies")
    assert predictions.overlap_pairs(best).first().pairs == 3
    assert as_set(scoring.above(raw, 0.5), "label") == {("email",), ("y",), ("z",), ("w",)}


def test_threshold_choice(spark):
    rows = lambda f: spark.createDataFrame(f, "threshold double, f1 double")
    assert predictions.selected_threshold(rows([(0.3, 0.8), (0.4, 0.80004), (0.5, 0.79)])).first().threshold == 0.3
    assert predictions.selected_threshold(rows([(0.3, 0.8), (0.4, 0.81), (0.5, 0.79)])).first().threshold == 0.4


def test_malformed_predictions_are_named_not_shown(spark):
    rows = [(0, "email", 0, 3, 0.5), (0, "nope", 0, 3, 0.5), (0, "email", -1, 3, 0.5), (0, "email", 3, 3, 0.5), (0, "email", 0, 99, 0.5), (0, "email", 0, 3, float("nan")), (0, "email", 0, 3, 1.5), (0, None, 0, 3, 0.1), (0, "email", 0, 3, None)]
    df = spark.createDataFrame(rows, "example_index long, label string, start int, end int, score double")
    lengths = spark.createDataFrame([(0, 10)], "example_index long, length int")
    got = predictions.violations(df, lengths, ("email",))
    assert sorted(r.reason for r in got.collect()) == ["bounds"] * 3 + ["label"] * 2 + ["score"] * 3
    assert "label" not in got.columns


def test_percentile_rule(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.fraction: r.value for r in predictions.percentile(df, "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    s = sorted(v for v in values if v is not None)
    assert got == {f: s[min(len(s) - 1, int(f * len(s)))] for f in (0.0, 0.5, 0.9, 1.0)}


def test_metrics_do_not_depend_on_partitions(spark):
    truth = spans(spark, [(i, "A", 0, i + 1) for i in range(50)])
    predicted = spans(spark, [(i, "A", 0, i + 1 + i % 2) for i in range(50)])
    results = {tuple(scoring.strict_overall(scoring.match_counts(truth.repartition(n), predicted.repartition(n))).first()) for n in (1, 3, 7)}
    assert len(results) == 1
