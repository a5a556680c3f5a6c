"""Names with lost letters and rows with shifted fields."""

from pyspark.sql import functions as F

from regioprofile.operators import match, repair

COLUMNS = {"name": ".+", "plz": "[0-9]{5}", "kreis": "[^0-9]+", "lat": "[0-9]{1,2}(,[0-9]+)?", "n": "[0-9]+"}


def test_lost_letters_are_found_again_or_reported(spark):
    intact = spark.createDataFrame([("Lübeck",), (" Düren",), ("Döbeln",), ("Münster",), ("Minster",), ("Köln",), (None,), ("",), ("A?B",), ("Ö",), ("Ä",)], "full string")
    names = ["L?beck", ' "L�beck" ', "D?ren", "M?nster", "K??ln", "Kln", "?", "A?B", "Z?beck", "Lübeck", None, "  ", "??", "l?beck", "D?be?n", "Kö?", "(?+"]
    got = {r.damaged: (r["repair"].name, r["repair"].status, r["repair"].candidates) for r in repair.repaired_names(spark.createDataFrame([(n,) for n in names], "damaged string"), "damaged", intact, "full").collect()}
    assert got["L?beck"] == got[' "L�beck" '] == ("Lübeck", "repaired", 1) and got["D?ren"] == ("Düren", "repaired", 1) and got["D?be?n"] == ("Döbeln", "repaired", 1)
    assert got["K??ln"] == ("Köln", "repaired", 1)  # two marks for the two bytes of one letter
    assert got["Kö?"] == ("Köln", "repaired", 1)
    assert got["M?nster"] == ("M?nster", "ambiguous", 2) and got["?"] == ("?", "ambiguous", 2)
    assert got["Z?beck"] == ("Z?beck", "unknown", 0) and got["l?beck"][1] == "unknown" and got["(?+"][1] == "unknown"
    assert got["A?B"] == ("A?B", "intact", 0) and got["Lübeck"] == ("Lübeck", "intact", 0) and got["Kln"] == ("Kln", "intact", 0) and got[None] == got["  "] == (None, "intact", 0)
    assert len(got) == len(names)


def test_the_match_rate_rises_with_repaired_names(spark):
    kreise = spark.createDataFrame([("1", "Lübeck, Hansestadt"), ("2", "Düren, Kreis")], "kreis_id string, kreis_name string")
    towns = spark.createDataFrame([("a", "1", "L?beck"), ("b", "2", "D�ren"), ("c", "3", "Düren"), ("d", "4", "X?")], "name string, plz string, district string")
    short = kreise.select(F.split("kreis_name", ",")[0].alias("short"))
    fixed = repair.repaired_names(towns, "district", short, "short").withColumn("district", F.col("repair.name")).drop("repair")
    rate = lambda df: match.best_containing(df, kreise, "district", "kreis_name", "kreis_id", ["name", "plz"]).filter("kreis_id is not null").count()
    assert (rate(towns), rate(fixed)) == (1, 3)


def test_shifted_fields_are_put_back_or_quarantined(spark):
    rows = [
        (1, "Berg", "01234", "Kreis", "54,78", "10"),  # intact
        (2, "Berg", " Bad", "01234", "Kreis", "54,78"),  # the name was cut once
        (3, "Berg", "Bad", "Ort", "01234", "Kreis"),  # twice
        (4, "Berg", "01234", "Kreis", "54", "78"),  # suits as it is: 54 and 78 are numbers
        (5, "Berg", "01234", "Land", "Kreis", "54,78"),  # the district was cut
        (6, "Berg", "x", "y", "z", "w"),  # no alignment
        (7, "Berg", None, "Kreis", " ", None),  # missing fields
        (8, None, None, None, None, None),
        (9, "Berg", "01234", "Kreis", "54,78", "10"),
        (9, "Berg", "01234", "Kreis", "54,78", "10"),
        (10, "Berg", "12345", "01234", "Kreis", "9"),  # the name ends in digits
    ]
    df = spark.createDataFrame(rows, "id int, name string, plz string, kreis string, lat string, n string").withColumn("own", F.lit("x"))
    good, rest = repair.realigned(df, COLUMNS)
    assert good.columns == [*df.columns, "alignment"] and rest.columns == [*df.columns, "reason"]
    got = sorted((tuple(r)[:6], r.alignment) for r in good.filter("id not in (7, 8)").collect())
    assert got == [
        ((1, *rows[0][1:]), "intact"), ((2, "Berg, Bad", "01234", "Kreis", "54,78", None), "repaired"), ((3, "Berg,Bad,Ort", "01234", "Kreis", None, None), "repaired"), ((4, *rows[3][1:]), "intact"),
        ((5, "Berg", "01234", "Land,Kreis", "54,78", None), "repaired"), ((9, *rows[8][1:]), "intact"), ((9, *rows[8][1:]), "intact"), ((10, "Berg,12345", "01234", "Kreis", "9", None), "repaired"),
    ]
    assert {r.id: tuple(r)[1:6] for r in good.filter("id in (7, 8) and alignment = 'intact'").collect()} == {7: rows[6][1:], 8: rows[7][1:]}
    assert [(r.id, r.reason) for r in rest.collect()] == [(6, "unsuitable: plz, lat, n")]
    two = spark.createDataFrame([("a", "b", "c", "1")], "x string, y string, z string, k string")
    _, rest = repair.realigned(two, {"x": "[a-z,]+", "y": "[a-z,]+", "z": "[0-9]", "k": "[a-z]"})
    assert [r.reason for r in rest.collect()] == ["ambiguous"]
    good, rest = repair.realigned(df.limit(0), COLUMNS)
    assert good.count() == rest.count() == 0
