"""Candidates that cannot be scored are listed, and the others' scores do not change."""

from pyspark.sql import functions as F

from kinmatch.plans.reported import NO_VALUES, NOT_FINITE, OTHER_LENGTH, search_reported
from kinmatch.plans.search import search_exact

VECTOR = "company_id string, field_name string, embedding array<double>, seq int"
NAN = float("nan")


def test_failures_are_reported_and_the_rest_survives(spark):
    good = [(f"c{i}", "icp", [1.0, i / 10], 0) for i in range(6)]
    bad = [
        ("lost", "icp", None, 0),
        ("lost", "product_form", [1.0], 0),
        ("empty", "icp", [], 0),
        ("nan", "icp", [1.0, NAN], 0),
        ("hole", "icp", [None, 1.0], 0),
        ("far", "icp", [1.0, float("inf")], 0),
        ("long", "icp", [1.0, 2.0, 3.0], 0),
        ("worse", "icp", [1.0, 0.0], 0),
        ("worse", "icp", [NAN], 1),
    ]
    fine = [
        ("mended", "icp", [NAN, NAN], 0),
        ("mended", "icp", [1.0, 0.05], 1),
        ("other", "customer_list", [NAN], 0),
        ("unasked", "product_form", None, 0),
    ]
    nameless = [(None, "icp", [NAN, 1.0], 0), ("", "icp", None, 0), ("c0", None, [1.0, 1.0], 0)]
    query = spark.createDataFrame([("c0", "icp", [1.0, 0.0])], "query_id string, field_name string, embedding array<double>")
    best, failures = search_reported(spark.createDataFrame(good + bad + fine + nameless, VECTOR), query, 20)
    assert {(r.company_id, r.reason) for r in failures.collect()} == {
        ("lost", NO_VALUES), ("empty", NO_VALUES), ("nan", NOT_FINITE), ("hole", NOT_FINITE), ("far", NOT_FINITE),
        ("long", OTHER_LENGTH), ("worse", NOT_FINITE),
    }
    assert {(r.stage, r.field_name) for r in failures.collect()} == {("score", "icp")}
    sound = search_exact(spark.createDataFrame(good + fine, VECTOR), query, 20)
    assert best.collect() == sound.collect()
    assert {r.company_id for r in best.collect()} == {f"c{i}" for i in range(1, 6)} | {"mended", "other"}


def test_nothing_to_report(spark):
    query = spark.createDataFrame([("q", "icp", [1.0, 0.0])], "query_id string, field_name string, embedding array<double>")
    for rows in ([], [("a", "icp", [0.0, 1.0], 0)]):
        best, failures = search_reported(spark.createDataFrame(rows, VECTOR), query)
        assert failures.count() == 0 and best.count() == len(rows)
    unasked = query.filter(F.lit(False))
    best, failures = search_reported(spark.createDataFrame([("a", "icp", [NAN], 0)], VECTOR), unasked)
    assert failures.count() == 0 and best.count() == 0
