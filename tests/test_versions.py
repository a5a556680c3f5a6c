"""Versioned tables, merges, lasting keys and audits across tables."""

import json
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regioprofile.sources import relations, versions
from regioprofile.sources import tables as t


def failing(spark, n=10):
    """Rows of which one raises while they are written."""
    return spark.range(n).select(F.when(F.col("id") == n - 1, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_a_load_that_fails_leaves_the_old_rows(spark, tmp_path):
    root, plain = str(tmp_path / "v"), str(tmp_path / "p")
    assert versions.load(spark.range(10), root) == 10 and t.full_load(spark.range(10), plain) == 10
    for load, path in ((versions.load, root), (t.full_load, plain)):
        with pytest.raises(PySparkException):
            load(failing(spark), path)
    assert versions.versions(spark, root) == [1]
    assert versions.current(spark, root).count() == spark.read.parquet(plain).count() == 10


def test_a_load_may_read_its_own_target(spark, tmp_path):
    root, plain = str(tmp_path / "v"), str(tmp_path / "p")
    versions.load(spark.range(3), root)
    assert versions.load(versions.current(spark, root).union(spark.range(3, 5)), root) == 5
    t.full_load(spark.range(3), plain)
    assert t.full_load(spark.read.parquet(plain).union(spark.range(3, 5)), plain) == 5
    for df in (versions.current(spark, root), spark.read.parquet(plain)):
        assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p", "v"]


def test_old_versions_are_read_until_they_are_dropped(spark, tmp_path):
    root = str(tmp_path / "v")
    for n in (1, 2, 3, 0):
        versions.load(spark.range(n).withColumn("x", F.lit(float("nan"))), root)
    assert [versions.current(spark, root, v).count() for v in (1, 2, 3, 4)] == [1, 2, 3, 0]
    assert versions.current(spark, root, 3).filter("x is not null").count() == 0
    assert versions.drop_versions(spark, root, keep=2) == 2 and versions.versions(spark, root) == [3, 4]
    assert versions.current(spark, root).count() == 0 and versions.current(spark, root, 3).count() == 3
    assert len(list((tmp_path / "v/data").iterdir())) == 2
    with pytest.raises(ValueError, match="no version 1"):
        versions.current(spark, root, 1)
    with pytest.raises(ValueError, match="no version"):
        versions.current(spark, str(tmp_path / "none"))


def test_of_two_loads_at_once_the_second_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    versions.load(spark.range(1), root)
    seen = versions.versions
    monkeypatch.setattr(versions, "versions", lambda s, r: [x for x in seen(s, r) if x < 1])
    with pytest.raises(versions.LoadConflict):
        versions.load(spark.range(2), root)
    monkeypatch.undo()
    assert versions.versions(spark, root) == [1] and versions.current(spark, root).count() == 1
    assert [p.name for p in (tmp_path / "v/manifests").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def changes(spark, rows):
    return spark.createDataFrame(rows, "k string, at int, x string, gone boolean, arrived int")


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_three_increments_equal_one_full_load(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.03 else f"k{rng.randrange(60)}", None if rng.random() < 0.05 else rng.randrange(40), f"x{i}", None if rng.random() < 0.1 else rng.random() < 0.2, i) for i in range(400)]
    last = {}
    for r in rows:
        order = (r[1] is not None, r[1] or 0, r[3] is not None, bool(r[3]), r[0] or "", r[2])
        if r[0] not in last or order > last[r[0]][0]:
            last[r[0]] = order, r
    want = sorted((r[:3] for _, r in last.values() if not r[3]), key=repr)
    got = []
    for name, cuts in (("a", [rows]), ("b", [rows[:150], rows[150:200], rows[200:]]), ("c", [rows[300:], rows[:300], rows[100:200], []])):
        root = str(tmp_path / name)
        for part in cuts:
            versions.merge(changes(spark, part), root, ["k"], ["at"], mark="arrived", deleted="gone", buckets=4)
        got.append(sorted(((r.k, r.at, r.x) for r in versions.current(spark, root).collect()), key=repr))
        assert versions.unseen(changes(spark, rows), root, "arrived").count() == 0
    assert got == [want] * 3
    assert versions.unseen(changes(spark, [("k", 1, "x", False, 400), ("k", 1, "x", False, 399), ("k", 1, "x", False, None)]), root, "arrived").count() == 2


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "m")
    versions.merge(changes(spark, [(f"k{i}", 1, "old", False, i) for i in range(100)]), root, ["k"], ["at"], mark="arrived", deleted="gone", buckets=8)
    before, old = files(root), versions.manifest(spark, root)
    versions.merge(changes(spark, [("k7", 2, "new", False, 100), ("k8", 0, "late", False, 101), ("k9", 2, "bye", True, 102)]), root, ["k"], ["at"], mark="arrived", deleted="gone")
    after, new = files(root), versions.manifest(spark, root)
    assert all(after[f] == m for f, m in before.items())  # nothing is rewritten in place
    same = [b for b in old["folders"] if new["folders"][b] == old["folders"][b]]
    assert len(same) >= 5 and new["buckets"] == 8 and new["mark"] == "102"
    rows = {r.k: r.x for r in versions.current(spark, root).collect()}
    assert len(rows) == 99 and rows["k7"] == "new" and rows["k8"] == "old" and "k9" not in rows
    assert versions.current(spark, root, raw=True).count() == 100
    # a late row does not bring a deleted key back
    versions.merge(changes(spark, [("k9", 1, "late", False, 103)]), root, ["k"], ["at"], mark="arrived", deleted="gone")
    assert "k9" not in {r.k for r in versions.current(spark, root).collect()}
    with pytest.raises(ValueError, match="other key"):
        versions.merge(changes(spark, []), root, ["x"], ["at"], deleted="gone")


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "m")
    df = spark.range(20).withColumn("at", F.lit(1))
    versions.merge(df, root, ["id"], ["at"], buckets=2)
    bad = failing(spark).withColumn("at", F.lit(2))
    with pytest.raises(PySparkException):
        versions.merge(bad, root, ["id"], ["at"])
    assert versions.versions(spark, root) == [1] and versions.current(spark, root).filter("at = 1").count() == 20


def test_keys_last_over_loads(spark, tmp_path):
    root = str(tmp_path / "k")
    df = lambda rows: spark.createDataFrame(rows, "name string, plz string, x int")
    first = df([("b", "1", 1), ("d", "1", 2), ("d", "1", 3), (None, "2", 4)])
    one = {(r.name, r.plz, r.x): r.id for r in versions.lasting_keys(first, root, ["name", "plz"], "id").collect()}
    assert sorted(one.values()) == [1, 2, 3, 4] and one[(None, "2", 4)] == 1 and one[("d", "1", 2)] == 3 and one[("d", "1", 3)] == 4
    more = first.unionByName(df([("a", "1", 0), ("c", "1", 0), ("d", "1", 9), (None, None, 0)]))
    two = {(r.name, r.plz, r.x): r.id for r in versions.lasting_keys(more, root, ["name", "plz"], "id").collect()}
    assert {k: two[k] for k in one} == one and sorted(two.values()) == list(range(1, 9))
    again = {(r.name, r.plz, r.x): r.id for r in versions.lasting_keys(more.filter("name = 'd'"), root, ["name", "plz"], "id").collect()}
    assert again == {k: v for k, v in two.items() if k[0] == "d"} and versions.versions(spark, root) == [1, 2, 3]
    assert versions.lasting_keys(more.limit(0), root, ["name", "plz"], "id").count() == 0


def test_relations_of_planted_damage(spark, tmp_path):
    kreise = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c"), (None, "d"), (None, "e")], "kreis_id string, n string")
    facts = spark.createDataFrame([("1", 1), ("2", 1), ("2", 1), ("2", 1), ("9", 1), ("9", 2), (None, 1)], "kreis_id string, jahr int")
    tables = {"dim_kreis": kreise, "fact_bauland": facts, "other": kreise}
    got = {r.check_name: (r.n_bad, r.passed) for r in relations.relational_audit(tables).collect()}
    assert got == {"dim_kreis.grain": (2, False), "dim_kreis.key_missing": (2, False), "fact_bauland.grain": (2, False), "fact_bauland.key_missing": (1, False), "fact_bauland.kreis_id": (2, False)}
    root = str(tmp_path)
    failed = versions.publish_all(tables, root, relations.relational_audit)
    assert failed == {k: n for k, (n, _) in got.items()} and not versions.versions(spark, f"{root}/dim_kreis")
    good = {"dim_kreis": kreise.filter("n in ('a', 'b')"), "fact_bauland": facts.filter("kreis_id in ('1', '2')").distinct(), "dim_jahr": spark.createDataFrame([(1, 0)], "jahr int, jahrzehnt int")}
    assert versions.publish_all(good, root, relations.relational_audit) == {} and versions.current(spark, f"{root}/fact_bauland").count() == 2
    assert all(r.passed and r.n_bad == 0 for r in relations.relational_audit({k: df.limit(0) for k, df in good.items()}).collect())
    with pytest.raises(ValueError, match="grain"):
        relations.relational_audit({"other": kreise})


def test_fan_out_is_counted_without_the_join(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "l string")
    right = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "r string")
    assert tuple(relations.fan_out(left, right, [("l", "r")]).first()) == (5, 3, 7, 3)
    assert tuple(relations.fan_out(left.limit(0), right, [("l", "r")]).first()) == (0, 0, 0, 0)


def test_a_manifest_is_plain_json(spark, tmp_path):
    versions.load(spark.range(2), str(tmp_path))
    content = json.loads(next((tmp_path / "manifests").glob("0*.json")).read_text())
    assert content["version"] == 1 and content["rows"] == {"0": 2} and list(content["folders"]) == ["0"]
