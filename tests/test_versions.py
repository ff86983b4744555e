from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F
from tempolith.queries import Layers, queries
from tempolith.sources import tables, versions


def pair(spark, n):
    one = spark.range(n).withColumn("x", F.lit(float(n)))
    return {"one": one, "two": spark.createDataFrame([(n, "two")] * n, "a long, b string")}


def test_a_set_changes_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "set")
    assert versions.current(spark, root) is None
    first = versions.publish(pair(spark, 3), root, {"one": [F.max("x").alias("most"), F.count_if(F.col("id") > 0).alias("above")]}, lambda found: {"all": sum(t["rows"] for t in found.values())})
    assert (first.number, first.rows("one"), first.rows("two"), first.facts) == (1, 3, 3, {"all": 6})
    assert first.tables["one"]["measures"] == {"most": 3.0, "above": 2} and first.read(spark, "two").schema == pair(spark, 3)["two"].schema
    pinned = first.read(spark, "one")
    second = versions.publish(pair(spark, 5), root)
    assert versions.current(spark, root) == second and second.number == 2 and second.read(spark, "one").count() == 5
    # who reads the former version is not disturbed
    assert pinned.count() == 3 and versions.version(spark, root, 1).read(spark, "two").count() == 3


def test_a_killed_run_leaves_the_old_set(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    old = versions.publish(pair(spark, 3), root)
    broken = pair(spark, 4) | {"two": spark.range(4).select(F.raise_error(F.lit("stop")).cast("long").alias("a"))}
    with pytest.raises(Exception, match="stop"):
        versions.publish(broken, root)
    assert versions.current(spark, root) == old and len(os.listdir(f"{root}/versions")) == 2

    # killed after all tables, before the entry; and while the entry's draft is written
    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_enter", killed)
        with pytest.raises(KeyboardInterrupt):
            versions.publish(pair(spark, 6), root)
    with open(f"{root}/log/draft-0", "w") as half:
        half.write('{"name": "x", "tab')
    assert versions.current(spark, root) == old and old.read(spark, "one").count() == 3
    # what was left is young, so it may be another run's work; later it goes
    assert versions.retire(spark, root) == []
    assert len(versions.retire(spark, root, grace=-60)) == 3
    assert os.listdir(f"{root}/versions") == [old.name] and versions.current(spark, root).read(spark, "one").count() == 3


def test_two_publishers_get_two_numbers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    versions.publish(pair(spark, 1), root)
    numbers = versions._numbers
    stale = [[1], [1]]
    versions.publish(pair(spark, 2), root)
    # another run took number 2 after this one looked
    monkeypatch.setattr(versions, "_numbers", lambda *a: stale.pop() if stale else numbers(*a))
    third = versions.publish(pair(spark, 3), root)
    assert third.number == 3 and versions.version(spark, root, 2).rows("one") == 2


def test_old_versions_retire(spark, tmp_path):
    root = str(tmp_path / "set")
    made = [versions.publish(pair(spark, n), root) for n in (1, 2, 3)]
    assert versions.retire(spark, root, keep=2) == [made[0].name]
    assert sorted(os.listdir(f"{root}/versions")) == sorted(v.name for v in made[1:])
    assert versions.version(spark, root, 2).read(spark, "one").count() == 2


def test_a_table_made_of_those_before_it(spark, tmp_path):
    made = versions.publish(pair(spark, 4) | {"sums": lambda written: written("one").agg(F.sum("id").alias("s"))}, str(tmp_path / "set"))
    assert made.read(spark, "sums").first()["s"] == 6 and made.rows("sums") == 1


def test_scratch_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))
    with tables.scratch():
        assert tables.settle(spark.range(4), "a").count() == 4 and len(os.listdir(tmp_path)) == 1
        with pytest.raises(ZeroDivisionError), tables.scratch():
            tables.settle(spark.range(4), "b")
            raise ZeroDivisionError
        assert len(os.listdir(tmp_path)) == 1
        kept = tables.settle(spark.range(2), "c")
        tables.discard(kept)
        assert len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []
    (tmp_path / "tempolith-left").mkdir()
    (tmp_path / "other").mkdir()
    assert tables.sweep(spark) == []
    time.sleep(0.1)
    assert len(tables.sweep(spark, older_than=0)) == 1 and os.listdir(tmp_path) == ["other"]


def test_layers_are_closed_by_their_owner(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))
    with Layers(spark, "/root/testdata/sf0.001") as layers:
        assert queries(layers)["late_labels"](spark, "").count() > 0 and os.listdir(tmp_path)
    assert os.listdir(tmp_path) == []
    queries()["tickets"](spark, "/root/testdata/sf0.001").collect()
    assert os.listdir(tmp_path)
    Layers.close_shared(spark)
    assert os.listdir(tmp_path) == []
