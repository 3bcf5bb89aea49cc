"""Strict validation: what a document may and may not hold."""

import json

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import documents as D
from kinmatch.operators import details as O
from kinmatch.schemas import ANALYSIS_DEFAULTS, ANALYSIS_RESPONSE, COMPANY_DESCRIPTION, COMPANY_PROFILE


def check(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    return [r.v for r in rows.select("i", column(F.col("j")).alias("v")).orderBy("i").collect()]


PROFILES = [
    ("{}", True),
    ('{"icp": null, "extra": [1]}', True),
    ('{"icp": "x", "customer_list": ["a"]}', True),
    ('{"customer_list": []}', True),
    ('{"icp": 5}', False),
    ('{"icp": ["x"]}', False),
    ('{"customer_list": "a"}', False),
    ('{"customer_list": ["a", 1]}', False),
    ('{"customer_list": [null]}', False),
    ("[]", False),
    ('"text"', False),
    ("null", False),
    ("junk", False),
    ('{"icp": "x"', False),
    (None, False),
]


def test_profiles(spark):
    got = check(spark, [t for t, _ in PROFILES], lambda c: D.validate(c, COMPANY_PROFILE).isNotNull())
    assert list(zip([t for t, _ in PROFILES], got)) == PROFILES


def description(**changes):
    base = dict(
        target_audience="a", problem_solved="b", solution_approach="c", uses_ai_automation=True,
        description_summary="d", market_universe="e", universe_boundaries="f",
    )
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "absent"})


@pytest.mark.parametrize(
    "changes, good",
    [
        ({}, True),
        ({"uses_ai_automation": "yes"}, True),
        ({"uses_ai_automation": 1}, True),
        ({"uses_ai_automation": "maybe"}, False),
        ({"uses_ai_automation": None}, False),
        ({"target_audience": None}, False),
        ({"target_audience": "absent"}, False),
        ({"unique_features": None}, True),
        ({"unique_features": ["x"]}, True),
    ],
)
def test_required_and_boolean(spark, changes, good):
    assert check(spark, [description(**changes)], lambda c: D.is_valid(c, COMPANY_DESCRIPTION)) == [good]


def analysis(score=2, **top):
    body = {
        "summary": "s", "segments": [{"segment_name": "n", "pain_points": []}], "market_map": "m", "features": "f",
        "differentiators": [], "competitors": [{"name": "n", "description": "d", "overlap_score": score}],
        "matrix": [], "positioning_analysis": "p",
    }
    return json.dumps({"search_query_used": "q", "comprehensive_analysis": body, **top})


def test_numbers_in_nested_lists(spark):
    scores = [2, 2.0, "3", True, 2.5, "two", None]
    got = check(spark, [analysis(s) for s in scores], lambda c: D.is_valid(c, ANALYSIS_RESPONSE))
    assert got == [True, True, True, True, False, False, False]
    document = check(spark, [analysis("3")], lambda c: D.validate(c, ANALYSIS_RESPONSE))[0]
    assert document.comprehensive_analysis.competitors[0].overlap_score == 3
    assert document.comprehensive_analysis.competitors[0].link is None


def test_default_only_when_absent(spark):
    texts = [analysis(), analysis(search_confidence=None), analysis(search_confidence="low")]
    got = check(spark, texts, lambda c: D.validate(c, ANALYSIS_RESPONSE, ANALYSIS_DEFAULTS)["search_confidence"])
    assert got == ["medium", None, "low"]


SITES = [
    ('{"name": "A", "website": {"url": "u"}}', "A", "u"),
    ('{"website": {"url": null}}', "Unknown Company", None),
    ('{"name": null, "website": {}}', None, "No website found"),
    ('{"website": "w"}', "Unknown Company", "w"),
    ('{"website": ""}', "Unknown Company", "No website found"),
    ('{"website": null}', "Unknown Company", "No website found"),
    ("{}", "Unknown Company", "No website found"),
]


def test_names_and_sites(spark):
    rows = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(SITES)], "i int, json string")
    got = [(r.json, r["name"], r.website) for r in O.names_and_sites(rows).orderBy("i").collect()]
    assert got == SITES


def test_flat_table(spark):
    rows = spark.createDataFrame([('{"b": {"x": 1}, "a": true}',), ('{"c": null, "b": 2.5}',)], "json string")
    table = O.flat_table(rows)
    assert table.columns == ["a", "b", "c"]
    assert sorted(map(tuple, table.collect())) == [("", "2.5", ""), ("True", '{"x":1}', "")]


def test_flat_table_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "json string")
    assert not O.write_flat_table(rows, str(tmp_path / "out")) and not (tmp_path / "out").exists()


def test_batch_kinds(spark):
    ids = ["1", "2", "urn:a", "3", "4", "x", "5"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "pos int, id string")
    batched = O.id_batches(rows, [F.asc("pos")], size=2)
    kinds = {r.batch: r.kind for r in O.batch_kinds(batched).collect()}
    assert kinds == {0: "ids", 1: "urns", 2: "urns", 3: "ids"}


def test_envelopes(spark):
    texts = ['[{"a": 1}, {"a": 2}]', '{"companies": [{"a": 3}]}', '{"other": 1}', "junk", '{"companies": []}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "batch int, answer string")
    got = [tuple(r) for r in O.unwrap(rows, "answer", "batch").orderBy("batch", "pos").collect()]
    assert got == [(0, 0, '{"a":1}'), (0, 1, '{"a":2}'), (1, 0, '{"a":3}')]
