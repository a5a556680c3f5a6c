"""Scores kept up by increments, tables of the catalogue by year, and reads of a database in even pieces."""

import math
import random
import statistics
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regioprofile.operators import moments as m
from regioprofile.sources import tables as t
from regioprofile.sources import versions


def test_increments_give_the_scores_of_all_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(y, i, rng.gauss(1e9, 1e-3) if y == 1 else rng.gauss(y or 0, 2), None if i % 7 == 0 else float(i % 5)) for i in range(120) for y in (1, 2, None)]
    rows += [(3, 0, 5.0, math.nan), (4, 0, 2.0, 1.0), (4, 1, 2.0, math.inf), (5, 0, None, None)]
    rng.shuffle(rows)
    df = lambda part: spark.createDataFrame(part, "y int, i int, a double, b double")
    r, k = str(tmp_path / "rows"), str(tmp_path / "moments")
    for part in (rows[:100], rows[100:130], rows[130:]):
        m.keep_scores(df(part), r, k, ["y"], ["a", "b"])
    known = {x.y: x for x in versions.current(spark, k).collect()}
    assert len(known) == 6 and versions.current(spark, r).count() == len(rows)
    for y, x in known.items():
        for c, at in (("a", 2), ("b", 3)):
            own = [v[at] for v in rows if v[0] == y and v[at] is not None and math.isfinite(v[at])]
            assert x[f"{c}_n"] == len(own)
            if own:
                mean = statistics.fmean(own)
                assert abs(x[f"{c}_mean"] - mean) <= 1e-9 * max(1, abs(mean)) * 1e-3 + 1e-9
                assert math.isclose(x[f"{c}_m2"], sum((v - mean) ** 2 for v in own), rel_tol=1e-6, abs_tol=1e-9)
    got = {(x.y, x.i): x for x in m.scored(versions.current(spark, r), versions.current(spark, k), ["y"], ["a", "b"]).collect()}
    own = [v[2] for v in rows if v[0] == 2]
    assert all(math.isclose(got[(2, v[1])].a_z, (v[2] - statistics.fmean(own)) / statistics.stdev(own), abs_tol=1e-9) for v in rows if v[0] == 2)
    assert got[(3, 0)].a_z is None and got[(4, 0)].a_z is None and got[(5, 0)].b_z is None
    # only the touched year's rows come back, and only its moments are written again
    again = m.keep_scores(df([(4, 2, 5.0, 1.0)]), r, k, ["y"], ["a", "b"])
    assert sorted(x.i for x in again.collect()) == [0, 1, 2] and {x.y: x._at for x in versions.current(spark, k).collect()}[2] < 4


def test_reloading_a_year_leaves_the_others(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS years")
    assert t.create_year_tables(spark, "years") == t.create_year_tables(spark, "years") == ["fact_bevoelkerung", "fact_bauland", "fact_klima", "fact_standortprofil_kpi"]
    df = spark.createDataFrame([("a", 1995, 1.0, 0.5), ("b", 1995, float("nan"), 0.1), ("a", 1996, 2.0, 0.2)], t.CONTRACTS["fact_klima"])
    assert t.load_years(df, "years.fact_klima") == 3
    place = Path(spark.sql("DESCRIBE FORMATTED years.fact_klima").filter("col_name = 'Location'").first()[1].removeprefix("file:"))
    files = lambda y: {p.name: p.stat().st_mtime_ns for p in (place / f"jahr={y}").glob("*.parquet")}
    old = files(1996)
    assert t.load_years(df.filter("jahr = 1995 and stadt_name = 'b'").select("jahr", "stadt_name", "temperatur_abweichung_grad", "avg_temperatur"), "years.fact_klima") == 1
    assert files(1996) == old and old
    assert sorted((r.stadt_name, r.jahr, r.avg_temperatur) for r in spark.table("years.fact_klima").collect()) == [("a", 1996, 2.0), ("b", 1995, None)]
    assert t.load_years(df.limit(0), "years.fact_klima") == 0 and spark.table("years.fact_klima").count() == 2
    t.truncate_table(spark, "years.fact_klima")
    assert spark.table("years.fact_klima").count() == 0 and spark.table("years.fact_klima").columns[-1] == "jahr"


@pytest.mark.parametrize("kind", ["long", "double"])
def test_a_database_is_read_in_even_pieces(spark, kind):
    url = f"jdbc:derby:memory:{Path(tempfile.mkdtemp()).name};create=true"
    keys = [i if i < 3000 else 10_000_000 + i * 1000 for i in range(4000)] + [7] * 150 + [None] * 20 + [-5_000_000_000 if kind == "long" else -5e9]
    df = spark.createDataFrame([(k if k is None or kind == "long" else float(k), i) for i, k in enumerate(keys)], f"k {kind}, v int")
    options = {"url": url, "dbtable": "t", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df.coalesce(1).write.format("jdbc").options(**options).save()
    got = t.read_split(spark, options, '"k"', 8)
    assert sorted(r.V if "V" in got.columns else r.v for r in got.collect()) == list(range(len(keys)))
    sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert 6 <= len(sizes) <= 12 and max(sizes) < 2 * len(keys) / len(sizes)
    assert t.split_predicates(spark, options, '"k"', 1) == ["1 = 1"]
    spark.createDataFrame([], df.schema).write.format("jdbc").options(**options | {"dbtable": "bare"}).save()
    assert t.read_split(spark, options | {"dbtable": "bare"}, '"k"', 8).count() == 0
