from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tempolith.functions.scalar import display_probability, poisson_steps, sigmoid
from tempolith.plans import checks, models, reports
from tempolith.plans.model_frames import NEVER, allowed_columns, leaks
from tempolith.sources import documents, tables


def test_orphans_follow_not_in(spark):
    issues = spark.createDataFrame([("A",), ("B",)], "issue_key string")
    children = spark.createDataFrame([("A",), ("C",), (None,)], "issue_key string")
    assert [r["issue_key"] for r in checks.orphans(children, issues).collect()] == ["C"]
    assert checks.orphans(children, issues.union(spark.createDataFrame([(None,)], "issue_key string"))).collect() == []
    assert checks.orphans(children, issues.limit(0)).count() == 2


def test_quantile_bins_drop_equal_edges(spark):
    rows = spark.createDataFrame([(float(x), 1.0 * x) for x in [0] * 50 + list(range(1, 51))] + [(None, 7.0)], "x double, y double")
    found = {r["bin"]: (r["n"], r["mean"]) for r in reports.quantile_bins(rows, "x", "y", 4).collect()}
    # edges 0, 0, 0.5, 25.25, 50 without the second 0
    assert found == {-1: (1, 7.0), 0: (50, 0.0), 1: (25, 13.0), 2: (25, 38.0)}


def test_top_features_and_themes(spark):
    rows = [(k, p, f, v) for k, p, v0 in ((1, "P", 1.0), (2, "P", -3.0), (3, "Q", 2.0)) for f, v in (("link_count", v0), ("project_open", -v0 / 2), ("title_length", 0.0))]
    parts = spark.createDataFrame(rows, "issue_key int, project_key string, feature string, contribution double")
    top = {(r["project_key"], r["rank"]): (r["feature"], r["theme"], r["mean_abs"]) for r in reports.top_features(parts, "project_key", 2).collect()}
    assert top == {("P", 1): ("link_count", "Scope", 2.0), ("P", 2): ("project_open", "Workload", 1.0), ("Q", 1): ("link_count", "Scope", 2.0), ("Q", 2): ("project_open", "Workload", 1.0)}
    themes = {r["theme"]: (r["place"], r["mean_abs"]) for r in reports.theme_importance(parts, ["issue_key"]).collect()}
    assert themes == {"Scope": (2, 2.0), "Workload": (3, 1.0)}


def test_samples_are_repeatable(spark):
    rows = spark.range(200)
    one, two, other = (sorted(r["id"] for r in reports.sample(rows.repartition(n), F.col("id"), 20, seed).collect()) for n, seed in ((1, 5), (7, 5), (1, 6)))
    assert one == two != other and len(one) == 20


def test_top_flag_is_the_linear_quantile(spark):
    rows = spark.createDataFrame([("creation", i / 100) for i in range(101)], "point string, score double")
    flagged = reports.flag_top(rows, rows)
    assert flagged.filter("top").count() in (10, 11) and abs(flagged.first()["cutoff"] - 0.9) < 1e-9


def test_small_functions(spark):
    row = spark.range(1).select(sigmoid(F.lit(0.0)).alias("a"), display_probability(F.lit(0.99)).alias("b"), display_probability(F.lit(0.0)).alias("c")).first()
    assert tuple(row) == (0.5, 0.95, 0.05)
    assert poisson_steps(3) == pytest.approx([0.36788, 0.73576, 0.91970], abs=1e-5)


def test_leaks_are_named(spark):
    frame = spark.createDataFrame([("A", 1, True)], "issue_key string, odd int, is_late boolean")
    assert leaks(frame) == {"never": {"is_late"}, "unknown": {"odd", "is_late"}} and not NEVER & allowed_columns()


def test_extraction_is_skipped_once_complete(spark, tmp_path):
    lines = [{"key": "P-1", "fields": {"priority": {"name": "Major"}}, "changelog": {"histories": [{"id": "1", "items": [{"field": "status", "toString": "Done"}, {"field": "status"}]}]}}, {"key": "P-2"}]
    source, folder = tmp_path / "docs.json", f"{tmp_path}/raw"
    source.write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    probe = documents.extract(spark, str(source), folder, limit=1)
    assert probe["complete"] is False
    whole = documents.extract(spark, str(source), folder)
    assert whole["complete"] and (whole["documents"], whole["unreadable"]) == (3, 1)
    assert whole["rows"] == {"issues": 2, "changelog": 2, "comments": 0, "issue_text": 2, "fields": 1} and whole["presence"]["priority"] == 1
    source.write_text("")
    assert documents.extract(spark, str(source), folder) == whole
    assert documents.extract(spark, str(source), folder, force=True)["documents"] == 0


def test_stamps_follow_the_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    before = tables.stamp(spark, [path])
    spark.range(3).write.parquet(path)
    after = tables.stamp(spark, [path])
    assert before != after == tables.stamp(spark, [path])
    df = spark.read.parquet(path)
    assert tables.present(df)
