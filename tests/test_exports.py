from __future__ import annotations

import json

import pytest
from tempolith.sources.exports import markdown_table, write_json


def test_json_lines_keep_nulls_and_nesting(spark, tmp_path):
    rows = [("A", 0.5, None, [("x", 1.0)], {"k": 2.0}), ('B"\n', None, 3, [], {})]
    df = spark.createDataFrame(rows, "key string, risk double, n int, reasons array<struct<feature: string, points: double>>, themes map<string, double>")
    write_json(df, f"{tmp_path}/out")
    found = sorted((json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()), key=lambda r: r["key"])
    assert found == [
        {"key": "A", "risk": 0.5, "n": None, "reasons": [{"feature": "x", "points": 1.0}], "themes": {"k": 2.0}},
        {"key": 'B"\n', "risk": None, "n": 3, "reasons": [], "themes": {}},
    ]
    write_json(df.limit(0), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 0


@pytest.mark.parametrize("kind", ["author string", "x struct<author: string>", "x array<struct<y: map<string, struct<author: int>>>>"])
def test_people_are_refused_at_any_depth(spark, tmp_path, kind):
    with pytest.raises(ValueError, match="author"):
        write_json(spark.createDataFrame([], kind), f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


@pytest.mark.parametrize("value", [(float("nan"), None, None), (1.0, [1.0, float("inf")], None), (1.0, None, {"a": (float("-inf"),)})])
def test_numbers_that_are_not_finite_fail(spark, tmp_path, value):
    df = spark.createDataFrame([value], "a double, b array<double>, c map<string, struct<d: float>>")
    with pytest.raises(Exception, match="not finite"):
        write_json(df, f"{tmp_path}/out")


def test_markdown():
    assert markdown_table([{"name": "a|b", "ap": 0.12345, "n": 3}, {"name": None, "ap": None, "n": 4}]) == "| name | ap | n |\n| - | - | - |\n| a\\|b | 0.123 | 3 |\n|  |  | 4 |\n"
    assert markdown_table([]) == ""
