from __future__ import annotations

import json
from dataclasses import fields
from datetime import datetime

import pytest
from tempolith.params import Params
from tempolith.plans.load import load
from tempolith.sources.documents import extract, flatten, read_documents, write_raw
from tempolith.sources.relations import RAW_SCHEMAS, read_lookup, read_raw
from tempolith.sources.surrogate import PARAMS
from tempolith.sources.versions import current

def ticket(key, summary=None, **more):
    return {"key": key, "id": key[-1], "fields": {"summary": summary, **more.pop("fields", {})}, **more}


def change(number, *items, by=None):
    return {"id": str(number), "created": f"2031-05-{number:02d}T09:30:00.250-0300", "author": by, "items": [dict(zip(("field", "fromString", "toString"), i, strict=True)) for i in items]}


#: One ticket with all that is read, given twice; one with nothing but a key; lines that are no tickets.
RICH = ticket(
    "NORTH-SEA-4", "Pumps stall at low tide", changelog={"total": "5", "histories": [change(3, ("status", "New", "In review"), ("labels", None, "wet")), change(4, ("status", "In review", "New"), by={"displayName": "Ines"})]},
    fields={"project": {"key": "  ", "name": "Tides"}, "priority": {"name": "Minor"}, "status": {"name": "New"}, "created": "2031-04-30T23:15:00.000-0300", "duedate": "2031-06-31", "reporter": {"name": "", "displayName": "Ines"}, "components": [{"name": ""}, {"name": "pump"}, {"name": "valve"}], "issuelinks": [{"id": "a"}], "comments": [{"id": "1", "body": "seen", "author": {"name": "olu"}}, {"id": "2", "body": None}], "timespent": "7200"},
)
BARE = {"key": "X9", "fields": {}}


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "docs.json"
    path.write_text("\n".join([*map(json.dumps, (RICH, BARE, RICH, {"fields": {"summary": "no key"}})), "no json", ""]))
    return str(path)


@pytest.fixture
def raw(spark, tmp_path, lines):
    write_raw(flatten(read_documents(spark, lines)), str(tmp_path / "raw"))
    return read_raw(spark, str(tmp_path / "raw"))


def test_flatten(raw):
    issues = {r["issue_key"]: r for r in raw["issues"].collect()}
    rich, bare = issues["NORTH-SEA-4"], issues["X9"]
    assert (rich["project_key"], rich["project_name"], rich["reporter"], rich["components"], rich["link_count"], rich["comment_count"], rich["time_spent_s"]) == ("NORTH-SEA", "Tides", "Ines", ["pump", "valve"], 1, 2, 7200)
    assert (bare["project_key"], bare["comment_count"], bare["changelog_loaded"], bare["changelog_total"]) == (None, 0, 0, None)
    assert {n: raw[n].count() for n in RAW_SCHEMAS} == {"issues": 3, "changelog": 6, "comments": 4, "issue_text": 3}


def test_doubled_documents_load_once(raw):
    rel = load(raw)
    assert (rel.issues.count(), rel.changelog.count(), rel.comments.count()) == (2, 3, 2)
    rich = rel.issues.filter("issue_key = 'NORTH-SEA-4'").first()
    assert (rich["created"], rich["due_date"]) == (datetime(2031, 5, 1, 2, 15), None)
    assert load(raw, ("OTHER",)).changelog.count() == 0 and load(raw, ("OTHER",)).issues.count() == 2


def test_extraction_is_counted_where_it_is_written(spark, tmp_path, lines):
    folder = str(tmp_path / "raw")
    probe = extract(spark, lines, folder, limit=1)
    assert (probe["complete"], probe["documents"]) == (False, 1)
    found = extract(spark, lines, folder)
    assert found["complete"] and (found["documents"], found["unreadable"]) == (5, 2) and found["rows"] == {"issues": 3, "changelog": 6, "comments": 4, "issue_text": 3, "fields": 2}
    assert "no json" in found["samples"] and len(found["samples"]) <= 2
    assert found["truncated"] == {"tickets": 2, "changes": 6} and (found["presence"]["project_key"], found["presence"]["priority"], found["presence"]["assignee"]) == (2, 2, 0)
    fields = current(spark, folder).read(spark, "fields")
    assert {r["field"]: r["n"] for r in fields.collect()} == {"status": 4, "labels": 2}
    # a complete extraction is left as it is, unless asked for again
    before = current(spark, folder).number
    assert extract(spark, "nowhere", folder) == found and current(spark, folder).number == before
    assert extract(spark, lines, folder, force=True)["rows"] == found["rows"] and current(spark, folder).number == before + 1


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="issues, changelog"):
        read_raw(spark, str(tmp_path))


def test_lookups_and_parameters_from_files(spark, tmp_path):
    (tmp_path / "ranks.csv").write_text("priority,rank\n Blocker ,1\nTrivial,4.5\n")
    assert {r["priority_key"]: r["rank"] for r in read_lookup(spark, str(tmp_path / "ranks.csv"), "priority", "rank", "double").collect()} == {"blocker": 1.0, "trivial": 4.5}
    rest = {f.name: getattr(PARAMS, f.name) for f in fields(Params) if f.name not in ("projects", "peer_window", "snapshot")}
    (tmp_path / "own.toml").write_text('[scope]\nprojects = ["P1", "P2"]\nsnapshot = "2031-01-01"\n[features]\npeer_window = 50\nunknown = 1\n')
    assert Params.from_toml(tmp_path / "own.toml", **rest) == PARAMS.but(projects=("P1", "P2"), peer_window=50, snapshot=datetime(2031, 1, 1))
