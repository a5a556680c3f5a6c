"""Builds that resume where they stopped."""

import pytest
from pyspark.sql import functions as F

from regioprofile.plans import build, catalog, star
from regioprofile.sources import versions

SF = "/root/testdata/sf0.001"
BOUNDS = {"extra": catalog.EXTRA_YEARS, "base": catalog.BASE, "report": catalog.REPORT}


def raws(spark):
    return {"population": catalog.population(spark, SF), "land": catalog.land(spark, SF), "climate": catalog.climate(spark, SF), "municipality": catalog.municipality(spark, SF)}


def test_a_stopped_build_resumes(spark, tmp_path):
    root, own = str(tmp_path / "a"), raws(spark)
    plan = build.steps(**BOUNDS)
    broken = plan | {"fact_bauland": (["land"], lambda x: star.fact_bauland(x).withColumn("preis_pro_qm_eur", F.raise_error(F.lit("stopped")).cast("double")))}
    with pytest.raises(Exception, match="stopped"):
        build.build(own, root, broken, settings=BOUNDS)
    assert versions.manifest(spark, f"{root}/fact_bauland") is None and versions.manifest(spark, f"{root}/dim_kreis")
    first = {n: versions.manifest(spark, f"{root}/{n}") for n in plan}
    state = build.build(own, root, settings=BOUNDS)
    assert state["fact_bauland"] == state["fact_standortprofil_kpi"] == "built" and all(state[n] == "kept" for n, m in first.items() if m)
    assert set(build.build(own, root, settings=BOUNDS).values()) == {"kept"}
    want = star.build_all(own, str(tmp_path / "b"), **BOUNDS)
    for name, df in build.tables(spark, root).items():
        assert sorted(map(str, df.collect())) == sorted(map(str, spark.read.parquet(f"{tmp_path}/b/{name}").collect())) and df.count() == want[name]
    # a change of one raw table makes only what depends on it again
    state = build.build(own | {"land": own["land"].filter("jahr <> '1999'")}, root, settings=BOUNDS)
    assert {n for n, s in state.items() if s == "built"} == {"dim_jahr", "fact_bauland", "fact_standortprofil_kpi"}


def test_fingerprints_follow_the_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, s string")
    of = build.fingerprint
    assert of(df) == of(df.orderBy(F.desc("k")).repartition(3)) and of(df) != of(df.distinct()) and of(df) != of(df.fillna("")) and of(df) != of(df.withColumnRenamed("s", "t"))
    assert of(df.limit(0)) == of(df.filter("k > 9"))
    with pytest.raises(ValueError, match="need"):
        build.build({"x": df}, "/tmp/none", {"y": (["z", "y"], lambda a, b: a)} | {"z": (["y"], lambda a: a)})
