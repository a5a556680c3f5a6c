"""Edge cases of the operators on small frames, and the tables' contracts."""

import math
import random

from pyspark.sql import functions as F

from regioprofile.functions import values as v
from regioprofile.operators import match, reshape
from regioprofile.plans import catalog, star
from regioprofile.sources import tables as t


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()]).select(column.alias("x")).first()[0]


def test_division_and_rounding(spark):
    assert one(spark, v.safe_div("n", "d"), n=1.0, d=0.0) is None
    assert one(spark, v.safe_div("n", "d"), n=0, d=0) is None
    assert one(spark, v.safe_div("n", "d"), n=1, d=4) == 0.25
    assert one(spark, v.round_to("x", 2), x=19.435) == 19.44 and one(spark, v.round_to("x", 2), x=-0.125) == -0.13
    assert one(spark, v.round_to("x", 2), x=0.0049999999) == 0.0 and one(spark, v.round_to("x", 2), x=1e21) == 1e21
    assert math.isnan(one(spark, v.round_to("x", 2), x=math.nan)) and one(spark, v.round_to("x", 2), x=-math.inf) == -math.inf


def test_nonfinite_numbers_become_null(spark):
    df = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, -math.inf), (4, 1.5), (5, None)], "id int, x double")
    assert [r.x for r in v.sanitize(df).orderBy("id").collect()] == [None, None, None, 1.5, None]


def test_tolerant_parsing(spark):
    assert one(spark, v.compass("x"), x="5.63S") == -5.63
    assert one(spark, v.compass("x"), x="106.55E") == 106.55
    assert one(spark, v.compass("x"), x="far") is None
    assert one(spark, v.decimal_comma("x"), x="9,43") == 9.43
    assert one(spark, v.decimal_comma("x"), x='"9') is None
    assert one(spark, v.lenient_double("x"), x=" 7.5 ") == 7.5
    assert one(spark, v.year_of("x"), x="n/a") is None
    assert one(spark, v.looked_up("x", star.STATES), x="99") is None
    assert one(spark, v.clean_name("x"), x=' "" ') is None


def test_matching_of_empty_null_and_unmatched_names(spark):
    left = spark.createDataFrame([("a", "1", ""), ("b", "1", None), ("c", "1", "zzz"), ("c", "1", "zzz"), ("d", "1", "Ber"), ("d", "1", "ber")], "name string, plz string, part string")
    right = spark.createDataFrame([("01", "Berg"), ("02", "Bergheim"), ("03", "Berghaus")], "kid string, kname string")
    got = sorted((r.name, r.kid) for r in match.best_containing(left, right, "part", "kname", "kid", ["name", "plz"]).collect() if r.kid) 
    assert got == [("a", "02"), ("d", "02")]
    assert match.best_containing(left, right, "part", "kname", "kid", ["name", "plz"]).filter("kid IS NULL").count() == 3


def test_numbering_is_dense_with_repeated_rows(spark):
    df = spark.createDataFrame([(i % 7, "x") for i in range(200)] + [(None, "x")], "k int, s string")
    got = match.numbered(df, ["k"], "nr").orderBy("nr").collect()
    assert [r.nr for r in got] == list(range(1, 202))
    assert got[0].k is None and [r.k for r in got[1:]] == sorted(r.k for r in got[1:])


def test_scores_of_one_row_and_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0), (None, 1.0), (None, 2.0)], "y int, x double")
    got = {(r.y, r.x): r.z for r in reshape.with_group_stats(df, "y", ["x"]).select("y", "x", reshape.z("x").alias("z")).collect()}
    assert got[(1, 5.0)] is None and got[(2, 3.0)] is None and got[(None, 1.0)] < 0


def test_growth_spans_gaps(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 15)], "k string, y int, n long")
    assert [r.g for r in reshape.growth(df, "k", "y", "n", "g").orderBy("y").collect()] == [None, 50.0]


def test_nearest_takes_the_first_name_on_ties(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "id int, latitude double, longitude double")
    right = spark.createDataFrame([("b", 1.0, 0.0), ("a", -1.0, 0.0), ("c", 5.0, 0.0)], "name string, latitude double, longitude double")
    assert match.nearest(left, right, "name").first()["name"] == "a"


def test_loading_twice_gives_the_same_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    raws = {"population": catalog.population(spark, sf), "land": catalog.land(spark, sf), "climate": catalog.climate(spark, sf), "municipality": catalog.municipality(spark, sf)}
    bounds = {"extra": catalog.EXTRA_YEARS, "base": catalog.BASE, "report": catalog.REPORT}
    first = star.build_all(raws, str(tmp_path / "a"), **bounds)
    assert first == star.build_all(raws, str(tmp_path / "a"), **bounds)
    assert first["dim_gemeinde"] == 138 and first["fact_standortprofil_kpi"] == 67 and first["dim_jahr"] == 12
    for name, schema in t.CONTRACTS.items():
        assert [(f.name, f.dataType) for f in spark.read.parquet(str(tmp_path / "a" / name)).schema] == [(f.name, f.dataType) for f in schema]


def test_tables_of_the_catalog(spark, tmp_path):
    assert t.create_tables(spark) == t.create_tables(spark) == list(t.CONTRACTS)
    assert set(t.CONTRACTS) <= set(t.list_tables(spark))
    path = str(tmp_path / "x")
    assert t.full_load(spark.range(5).withColumn("y", F.lit(float("nan"))), path) == 5
    assert spark.read.parquet(path).filter("y IS NOT NULL").count() == 0
    t.truncate(spark, path, spark.range(1).schema)
    assert spark.read.parquet(path).count() == 0


def test_seed_and_increment(spark):
    empty, seed = spark.createDataFrame([], "id long"), spark.range(3)
    assert t.seed_if_empty(empty, seed).count() == 3 and t.seed_if_empty(seed, seed).count() == 3
    assert t.newer_rows(spark.range(5), spark.range(3), "id").count() == 2 and t.newer_rows(spark.range(5), empty, "id").count() == 5


def test_all_states_have_names_and_no_year_is_dropped(spark):
    wide = spark.createDataFrame([(f"{k:02d}001", "x", 10, 4, 6, 20, 9, 11) for k in range(1, 18)], "id string, kreis string, insgesamt_01 long, maennlich_01 long, weiblich_01 long, insgesamt_24 long, maennlich_24 long, weiblich_24 long")
    names = {r.bundesland_id: r.bundesland_name for r in star.dim_kreis(wide).collect()}
    assert names["17"] is None and names["05"] == "Nordrhein-Westfalen" and names["16"] == "Thueringen" and len(set(names.values())) == 17
    assert {r.jahr for r in star.fact_bevoelkerung(wide).collect()} == {2001, 2024}


def test_year_bounds_by_default(spark):
    rows = [(f"{y}-06-01", float(y % 10), "A", "Germany") for y in range(1955, 2027)]
    klima = spark.createDataFrame(rows, "dt string, averagetemperature double, city string, country string")
    got = {r.jahr: r.temperatur_abweichung_grad for r in star.fact_klima(klima).collect()}
    assert sorted(got) == list(range(1995, 2025)) and got[1995] == 0.5  # 5 - the mean 4.5 of 1961-1990
    land = spark.createDataFrame([("1990",), ("x",), (None,), ("2024",)], "jahr string")
    assert sorted((r.jahr, r.jahrzehnt) for r in star.dim_jahr(land).collect()) == [(1990, 1990)] + [(y, y // 10 * 10) for y in range(1995, 2025)]
    wide = spark.createDataFrame([("01001", "x", 1, 2, 3, 4, 5, 6)], "id string, kreis string, insgesamt_94 long, maennlich_94 long, weiblich_94 long, insgesamt_24 long, maennlich_24 long, weiblich_24 long")
    assert [r.jahr for r in star.fact_bevoelkerung(wide, (1995, 2024)).collect()] == [2024]


def test_many_names_and_points_give_what_few_do(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    left = spark.createDataFrame([(i, "p", None if i % 13 == 0 else word(rng.randint(0, 5)).upper()) for i in range(150)], "id int, plz string, part string")
    right = spark.createDataFrame([(f"{i:03d}", word(rng.randint(1, 9))) for i in range(80)], "kid string, kname string")
    place = lambda k: (rng.gauss(0, 1) ** k, rng.gauss(0, 5))
    here = spark.createDataFrame([(i, *place(3)) for i in range(200)] + [(900, None, 1.0), (901, 300.0, -200.0)], "id int, latitude double, longitude double")
    there = spark.createDataFrame([(f"n{i}", *place(1)) for i in range(60)] + [("x", None, None), ("n99", 0.0, 0.0), ("n98", 0.0, 0.0)], "name string, latitude double, longitude double")
    results = []
    for few in (5000, 10):
        monkeypatch.setattr(match, "FEW", few)
        joined = match.contains_join(left, right, "part", "kname")
        best = match.best_containing(left, right, "part", "kname", "kid", ["id", "plz"])
        near = match.nearest(here, there, "name")
        results.append([sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (joined, best, near)])
    assert results[0] == results[1]
    assert len(results[0][2]) == 202


def test_tables_staged_audited_and_inspected(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    staged = t.stage_all({"x": df, "none": df.limit(0)}, str(tmp_path / "s"))
    assert [n for _, n in staged.values()] == [2, 0] and all(copy.schema == df.schema for copy, _ in staged.values())
    checks, target = {"name_missing": "s IS NULL"}, str(tmp_path / "t")
    assert t.publish(str(tmp_path / "s/none"), target, checks, spark) == {} and spark.read.parquet(target).count() == 0
    assert t.publish(str(tmp_path / "s/x"), target, checks, spark) == {"name_missing": 1} and spark.read.parquet(target).count() == 0
    found, bad = t.inspected({"x": lambda: df, "gone": lambda: spark.read.parquet(str(tmp_path / "gone"))})
    assert [(r.column_name, r.column_type, r.n_rows, r.n_nulls) for r in found.orderBy("position").collect()] == [("k", "int", 2, 0), ("s", "string", 2, 1)] and list(bad) == ["gone"]
    assert [r.row for r in t.sample_rows(df, ["k"]).collect()] == ['{"k":1,"s":"a"}', '{"k":2}']
    more = t.with_missing(df, spark.createDataFrame([(2, "z"), (3, "c")], df.schema), "k")
    assert sorted((r.k, r.s or "") for r in more.collect()) == [(1, "a"), (2, ""), (3, "c")]
    assert [(r.k, r.s) for r in t.latest_rows(spark.createDataFrame([(1, "a"), (1, "b")], df.schema), "k", ["s"]).collect()] == [(1, "b")]


def test_jdbc_reads_are_split(spark, monkeypatch):
    """Without a database, what the reader is given is looked at: the splits are Spark's own options."""
    given = {}

    class Reader:
        def format(self, f):
            given["format"] = f
            return self

        def options(self, **o):
            given.update(o)
            return self

        def load(self, *where):
            given["where"] = where
            return spark.range(1)

    class Session:
        read = Reader()

    t.read_table(Session(), "unused", "jdbc", url="jdbc:x", dbtable="t", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4")
    assert given == {"format": "jdbc", "url": "jdbc:x", "dbtable": "t", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4", "where": ()}


def test_many_names_meet_by_equal_keys_only(spark, monkeypatch):
    """Parts of every length, empty and absent ones, and runs that nearly all names hold: no nested loop, equal rows."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abÄ") for _ in range(n))
    names = [(i, "Kreis " + word(rng.randint(0, 7))) for i in range(300)] + [(900, None), (901, ""), (902, "İx"), (903, "a")]
    parts = [(i, p) for i, p in enumerate(["", "K", "kr", "KREIS", "kreis a", "äb", "bäÄ", "zzz", "kzq", None, "a", "is ", "i̇x", "reis bbb"])]
    right, left = spark.createDataFrame(names, "kid int, kname string"), spark.createDataFrame(parts, "id int, part string")
    few = match.contains_join(left, right, "part", "kname").collect()
    monkeypatch.setattr(match, "FEW", 3)
    many = match.contains_join(left, right, "part", "kname")
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, many.collect())) == sorted(map(str, few)) and len(few) > 1000


def test_cells_are_bounded_however_points_lie(spark):
    rng = random.Random(2)
    shapes = {
        "cloud and a far point": [(rng.gauss(50, 1), rng.gauss(10, 1)) for _ in range(2000)] + [(5e6, -5e6)],
        "one line": [(50.0, rng.gauss(10, 1)) for _ in range(2000)],
        "half on a line": [(50.0 if i % 2 else rng.gauss(50, 1), rng.gauss(10, 1)) for i in range(2000)],
        "grid": [(float(i % 40), float(i // 40)) for i in range(2000)],
    }
    ask = [(i, rng.gauss(50, 2), rng.gauss(10, 2)) for i in range(150)] + [(900, -4e6, 3e6), (901, 50.0, 1e4), (902, None, 1.0), (903, 20.5, 20.5)]
    asked = spark.createDataFrame([*ask, ask[0]], "id int, latitude double, longitude double")
    for shape, places in shapes.items():
        points = spark.createDataFrame([(f"n{i:04d}", *p) for i, p in enumerate(places)], "n string, a double, o double")
        sizes = [r.k for r in match._cells(points, len(places)).select(F.size("points").alias("k")).collect()]
        assert sum(sizes) == len(places) and max(sizes) <= 4 * match.CELL_POINTS, shape
        got = match.nearest_by_cells(asked, points, len(places), "n", "latitude", "longitude").collect()
        want = {i: None if a is None else min(((a - x) ** 2 + (o - y) ** 2, f"n{k:04d}") for k, (x, y) in enumerate(places))[1] for i, a, o in ask}
        assert len(got) == len(ask) + 1 and {r.id: r.n for r in got} == want, shape
