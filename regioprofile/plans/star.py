"""The nine tables of the star schema, built from the raw tables by the library's operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import category, compass, decade, decimal_comma, lenient_double, looked_up, round_to, safe_div, unquoted, year_of
from ..operators.match import best_containing, nearest, numbered
from ..operators.reshape import anomaly, at_level, growth, pivoted, unpivot_years, with_group_stats, z
from ..sources.tables import conform, full_load

#: Names of the states whose code is known; patterns of feature labels, of which umlauts are damaged.
STATES = {
    "01": "Schleswig-Holstein", "02": "Hamburg", "03": "Niedersachsen", "04": "Bremen", "05": "Nordrhein-Westfalen", "06": "Hessen", "07": "Rheinland-Pfalz", "08": "Baden-Wuerttemberg",
    "09": "Bayern", "10": "Saarland", "11": "Berlin", "12": "Brandenburg", "13": "Mecklenburg-Vorpommern", "14": "Sachsen", "15": "Sachsen-Anhalt", "16": "Thueringen",
}
FEATURES = [("erungsf.lle", "faelle"), ("erte Bauland", "flaeche"), ("^Kaufsumme", "kaufsumme")]
ALL_FEATURES = [*FEATURES, ("^Durchschnittlicher Kaufwert", "kaufwert")]
LEVEL, COUNTRY = 5, "Germany"
#: First and last years of the climate baseline, of the reported years, and of the year dimension's own rows.
BASE, REPORT, EXTRA_YEARS = (1961, 1990), (1995, 2024), (1995, 2024)


def dim_kreis(population: DataFrame, states: dict[str, str] = STATES) -> DataFrame:
    state = F.substring("id", 1, 2)
    x = at_level(population, "id", LEVEL)
    return conform(x.select(F.col("id").alias("kreis_id"), F.col("kreis").alias("kreis_name"), state.alias("bundesland_id"), looked_up(state, states).alias("bundesland_name")), "dim_kreis")


def year_rows(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("jahr"))


def dim_jahr(land: DataFrame, extra: tuple[int, int] = EXTRA_YEARS) -> DataFrame:
    found = land.select(F.col("jahr").try_cast("int").alias("jahr")).filter(F.col("jahr").isNotNull())
    years = found.distinct().unionByName(year_rows(land.sparkSession, *extra)).distinct()
    return conform(years.withColumn("jahrzehnt", decade("jahr")), "dim_jahr")


def dim_klimastadt(climate: DataFrame) -> DataFrame:
    x = climate.filter(F.col("country") == COUNTRY).select("city", "latitude", "longitude").distinct()
    return conform(x.select(F.col("city").alias("stadt_name"), compass("latitude").alias("latitude"), compass("longitude").alias("longitude")).distinct(), "dim_klimastadt")


def intact(municipality: DataFrame) -> DataFrame:
    """Rows that aren't shifted: those whose area is a number."""
    return municipality.withColumn("area_km2", lenient_double("area_km2")).filter(F.col("area_km2").isNotNull())


def dim_gemeinde(municipality: DataFrame, kreise: DataFrame) -> DataFrame:
    rows = intact(municipality).select("municipality_name", "postal_code", "state_land", "latitude", "longitude", unquoted("district_kreis").alias("district"))
    x = best_containing(rows, kreise.select("kreis_id", "kreis_name"), "district", "kreis_name", "kreis_id", ["municipality_name", "postal_code"])
    x = x.select(F.col("municipality_name").alias("gemeinde_name"), "kreis_id", F.col("state_land").alias("bundesland_name"), "postal_code", decimal_comma("latitude").alias("latitude"), decimal_comma("longitude").alias("longitude"))
    order = ["gemeinde_name", "postal_code", "kreis_id", "bundesland_name", "latitude", "longitude"]
    return conform(numbered(x, order, "gemeinde_id"), "dim_gemeinde")


def years_of(population: DataFrame) -> list[int]:
    """The years of the columns insgesamt_<last two digits>, which are those of 1950 to 2049."""
    found = [int(c[-2:]) for c in population.columns if re.fullmatch("insgesamt_[0-9]{2}", c)]
    return sorted(y + (1900 if y >= 50 else 2000) for y in found)


def fact_bevoelkerung(population: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """years: first and last one; all that there are columns of by default."""
    suffixes = {str(y)[2:]: y for y in years_of(population) if years is None or years[0] <= y <= years[1]}
    x = unpivot_years(at_level(population, "id", LEVEL), ["id"], ["insgesamt", "maennlich", "weiblich"], suffixes, "insgesamt")
    x = growth(x, "id", "jahr", "insgesamt", "g")
    return conform(
        x.select(
            F.col("id").alias("kreis_id"), "jahr", F.col("insgesamt").alias("einwohner_insgesamt"), F.col("maennlich").alias("einwohner_maennlich"), F.col("weiblich").alias("einwohner_weiblich"),
            round_to(safe_div("maennlich", "weiblich"), 4).alias("geschlechterquotient"), round_to("g", 3).alias("wachstum_vorjahr_pct"),
        ),
        "fact_bevoelkerung",
    )


def land_features(land: DataFrame) -> DataFrame:
    x = at_level(land, "kreis_id", LEVEL).withColumn("kategorie", category("merkmal", FEATURES)).filter(F.col("kategorie").isNotNull())
    return pivoted(x, ["kreis_id", "jahr"], "kategorie", "insgesamt", ["faelle", "flaeche", "kaufsumme"], {"baureif": ("flaeche", "baureifes_land")})


def fact_bauland(land: DataFrame) -> DataFrame:
    return conform(
        land_features(land).select(
            "kreis_id", F.col("jahr").try_cast("int").alias("jahr"), F.col("faelle").alias("anzahl_veraeusserungsfaelle"), F.col("flaeche").alias("veraeusserte_flaeche_1000qm"), F.col("kaufsumme").alias("kaufsumme_tsd_eur"),
            round_to(safe_div("kaufsumme", "flaeche"), 2).alias("preis_pro_qm_eur"), round_to(safe_div(100.0 * F.col("baureif"), "flaeche"), 2).alias("anteil_baureif_pct"),
            round_to(safe_div(1000.0 * F.col("flaeche"), "faelle"), 2).alias("durchschnittsfall_qm"),
        ),
        "fact_bauland",
    )


def fact_klima(climate: DataFrame, base: tuple[int, int] = BASE, report: tuple[int, int] = REPORT) -> DataFrame:
    x = climate.filter((F.col("country") == COUNTRY) & F.col("averagetemperature").isNotNull()).select(F.col("city").alias("stadt_name"), year_of("dt").alias("jahr"), "averagetemperature")
    x = anomaly(x, "stadt_name", "jahr", "averagetemperature", base, report)
    return conform(x.select("stadt_name", "jahr", round_to("mean", 2).alias("avg_temperatur"), round_to("anomaly", 2).alias("temperatur_abweichung_grad")), "fact_klima")


def fact_gemeinde_stamm(municipality: DataFrame, gemeinden: DataFrame) -> DataFrame:
    g = gemeinden.select("gemeinde_id", "gemeinde_name", F.col("postal_code").alias("plz"))
    x = intact(municipality).join(g, (F.col("municipality_name") == F.col("gemeinde_name")) & (F.col("postal_code") == F.col("plz")))
    return conform(
        x.select(
            "gemeinde_id", F.col("population_total").alias("einwohner_total"), F.col("male").alias("einwohner_maennlich"), F.col("female").alias("einwohner_weiblich"),
            round_to(safe_div(100.0 * F.col("female"), "population_total"), 2).alias("anteil_weiblich_pct"), "area_km2", round_to(safe_div("population_total", "area_km2"), 2).alias("einwohner_pro_km2"),
        ),
        "fact_gemeinde_stamm",
    )


def nearest_city(gemeinden: DataFrame, staedte: DataFrame) -> DataFrame:
    there = gemeinden.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("kreis_id").isNotNull())
    return nearest(there.select("gemeinde_id", "kreis_id", "latitude", "longitude"), staedte, "stadt_name").select("gemeinde_id", "kreis_id", "stadt_name")


def climate_by_kreis(gemeinden: DataFrame, staedte: DataFrame, klima: DataFrame) -> DataFrame:
    """Mean anomaly of the municipalities' nearest cities; municipalities are counted by city before the years multiply them."""
    counts = nearest_city(gemeinden, staedte).groupBy("kreis_id", "stadt_name").agg(F.count("*").alias("w"))
    x = counts.join(klima.filter(F.col("temperatur_abweichung_grad").isNotNull()), "stadt_name")
    return x.groupBy("kreis_id", "jahr").agg((F.sum(F.col("temperatur_abweichung_grad") * F.col("w")) / F.sum("w")).alias("temperatur_abweichung_grad"))


def density_by_kreis(stamm: DataFrame, gemeinden: DataFrame) -> DataFrame:
    x = stamm.join(gemeinden.filter(F.col("kreis_id").isNotNull()).select("gemeinde_id", "kreis_id"), "gemeinde_id")
    return x.groupBy("kreis_id").agg(F.avg("einwohner_pro_km2").alias("mittel"), F.max("einwohner_pro_km2").alias("hoechste"))


def kpi_base(bevoelkerung: DataFrame, bauland: DataFrame, klima_kreis: DataFrame, dichte: DataFrame) -> DataFrame:
    bau = growth(bauland, "kreis_id", "jahr", "anzahl_veraeusserungsfaelle", "faelle_wachstum").select("kreis_id", "jahr", "kaufsumme_tsd_eur", "veraeusserte_flaeche_1000qm", "preis_pro_qm_eur", "faelle_wachstum")
    bev = bevoelkerung.select("kreis_id", "jahr", "einwohner_insgesamt", "wachstum_vorjahr_pct")
    x = bev.join(bau, ["kreis_id", "jahr"]).join(klima_kreis, ["kreis_id", "jahr"], "left").join(dichte, "kreis_id", "left")
    return x.fillna({"temperatur_abweichung_grad": 0.0})


def fact_standortprofil_kpi(base: DataFrame) -> DataFrame:
    g, t, e = "wachstum_vorjahr_pct", "temperatur_abweichung_grad", "einwohner_insgesamt"
    x = with_group_stats(base, "jahr", [g, "preis_pro_qm_eur", t])
    pressure = safe_div(g, "faelle_wachstum")
    return conform(
        x.select(
            "kreis_id", "jahr", round_to(pressure, 3).alias("wohnraumdruck_index"), round_to(safe_div(1000.0 * F.col("kaufsumme_tsd_eur"), e), 2).alias("baulandpreis_pro_kopf_eur"),
            round_to(safe_div(1000.0 * F.col("veraeusserte_flaeche_1000qm"), e), 4).alias("freiflaeche_pro_einwohner_qm"), round_to(pressure * (1 + F.col(t) / 10), 3).alias("klima_angepasstes_wohnraumrisiko"),
            round_to(safe_div("hoechste", "mittel"), 3).alias("verstaedterung_index"), round_to(z(g) - z("preis_pro_qm_eur") - F.coalesce(F.abs(z(t)), F.lit(0.0)), 3).alias("standortattraktivitaets_score"),
        ),
        "fact_standortprofil_kpi",
    )


def build_all(
    raws: dict[str, DataFrame], root: str, states: dict[str, str] = STATES, years: tuple[int, int] | None = None,
    extra: tuple[int, int] = EXTRA_YEARS, base: tuple[int, int] = BASE, report: tuple[int, int] = REPORT,
) -> dict[str, int]:
    """Builds and loads all nine tables under root; each is read back for the next ones. Returns their row counts."""
    spark = next(iter(raws.values())).sparkSession
    counts: dict[str, int] = {}

    def load(name: str, df: DataFrame) -> DataFrame:
        counts[name] = full_load(df, f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    kreise = load("dim_kreis", dim_kreis(raws["population"], states))
    load("dim_jahr", dim_jahr(raws["land"], extra))
    staedte = load("dim_klimastadt", dim_klimastadt(raws["climate"]))
    gemeinden = load("dim_gemeinde", dim_gemeinde(raws["municipality"], kreise))
    bev, bau, klima = load("fact_bevoelkerung", fact_bevoelkerung(raws["population"], years)), load("fact_bauland", fact_bauland(raws["land"])), load("fact_klima", fact_klima(raws["climate"], base, report))
    stamm = load("fact_gemeinde_stamm", fact_gemeinde_stamm(raws["municipality"], gemeinden))
    load("fact_standortprofil_kpi", fact_standortprofil_kpi(kpi_base(bev, bau, climate_by_kreis(gemeinden, staedte, klima), density_by_kreis(stamm, gemeinden))))
    return counts
