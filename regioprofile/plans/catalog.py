"""Queries by key, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import match, moments, repair, reshape
from ..sources import relations, versions
from ..sources import tables as t
from ..sources.fixtures import BASE, EXTRA_YEARS, FIXTURES, REPORT, YEARS, needed, raw
from . import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# ---- SQL parts: the same tables as text --------------------------------------------------------------------------


def _r(x: str, k: int) -> str:
    """Half up, away from zero; what is within 1e-9 of a last place below a tie counts as the tie."""
    return f"(sign({x}) * floor(abs({x}) * 1e{k} + 0.5 + 1e-9) / 1e{k} + 0.0)"


def _div(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN NULL ELSE CAST({n} AS DOUBLE) / ({d}) END)"


def _z(c: str) -> str:
    return _div(f"({c} - avg({c}) OVER w)", f"stddev_samp({c}) OVER w")


_NUM = "TRY_CAST(trim(area_km2) AS DOUBLE)"
_COMPASS = "TRY_CAST(regexp_replace({0}, '[NSEW]', '', 'g') AS DOUBLE) * CASE WHEN {0} LIKE '%S' OR {0} LIKE '%W' THEN -1 ELSE 1 END"
_CASES = "CASE WHEN regexp_matches(merkmal, 'erungsf.lle') THEN 'faelle' WHEN regexp_matches(merkmal, 'erte Bauland') THEN 'flaeche' WHEN starts_with(merkmal, 'Kaufsumme') THEN 'kaufsumme' {0} END"
_CATEGORY, _CATEGORY4 = _CASES.format(""), _CASES.format("WHEN starts_with(merkmal, 'Durchschnittlicher Kaufwert') THEN 'kaufwert'")
_STATE = "CASE substring(id, 1, 2) " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in star.STATES.items()) + " END"
_MUNI = "municipality_name, postal_code, state_land, latitude, longitude, trim(replace(district_kreis, '\"', '')) AS district"

PARTS: dict[str, tuple[tuple[str, ...], str]] = FIXTURES | {
    "dim_kreis": (("raw_population_wide",), f"SELECT id AS kreis_id, kreis AS kreis_name, substring(id, 1, 2) AS bundesland_id, {_STATE} AS bundesland_name FROM raw_population_wide WHERE length(id) = 5"),
    "dim_jahr": (("raw_land_long",), f"""
      SELECT jahr, CAST(floor(jahr / 10) * 10 AS INT) AS jahrzehnt FROM (SELECT DISTINCT TRY_CAST(jahr AS INT) AS jahr FROM raw_land_long
      UNION SELECT CAST(unnest(generate_series({EXTRA_YEARS[0]}, {EXTRA_YEARS[1]})) AS INT)) AS y WHERE jahr IS NOT NULL"""),
    "dim_klimastadt": (("raw_climate",), f"SELECT DISTINCT city AS stadt_name, {_COMPASS.format('latitude')} AS latitude, {_COMPASS.format('longitude')} AS longitude FROM raw_climate WHERE country = 'Germany'"),
    "intact": (("raw_municipality",), f"SELECT * REPLACE ({_NUM} AS area_km2) FROM raw_municipality WHERE {_NUM} IS NOT NULL"),
    "matched": (("intact", "dim_kreis"), f"""
      SELECT * FROM (SELECT m.*, kreis_id, kreis_name, row_number() OVER (PARTITION BY municipality_name, postal_code ORDER BY length(kreis_name) DESC NULLS LAST, kreis_id) AS rn
        FROM (SELECT {_MUNI} FROM intact) AS m LEFT JOIN dim_kreis ON contains(lower(kreis_name), lower(district))) AS x WHERE rn = 1 OR kreis_id IS NULL"""),
    "dim_gemeinde": (("matched",), """
      SELECT CAST(row_number() OVER (ORDER BY municipality_name NULLS FIRST, postal_code NULLS FIRST, kreis_id NULLS FIRST, state_land NULLS FIRST, latitude NULLS FIRST, longitude NULLS FIRST) AS VARCHAR) AS gemeinde_id,
        municipality_name AS gemeinde_name, kreis_id, state_land AS bundesland_name, postal_code, latitude, longitude
      FROM (SELECT * REPLACE (TRY_CAST(replace(latitude, ',', '.') AS DOUBLE) AS latitude, TRY_CAST(replace(longitude, ',', '.') AS DOUBLE) AS longitude) FROM matched) AS m"""),
    "long_population": (("raw_population_wide",), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, {y} AS jahr, insgesamt_{str(y)[2:]} AS insgesamt, maennlich_{str(y)[2:]} AS maennlich, weiblich_{str(y)[2:]} AS weiblich FROM raw_population_wide WHERE length(id) = 5" for y in YEARS) + ") AS u WHERE insgesamt IS NOT NULL"),
    "grown": (("long_population",), f"SELECT *, {_div('100.0 * (insgesamt - lag(insgesamt) OVER k)', 'lag(insgesamt) OVER k')} AS g FROM long_population WINDOW k AS (PARTITION BY id ORDER BY jahr)"),
    "fact_bevoelkerung": (("grown",), f"SELECT id AS kreis_id, CAST(jahr AS INT) AS jahr, insgesamt AS einwohner_insgesamt, maennlich AS einwohner_maennlich, weiblich AS einwohner_weiblich, {_r(_div('maennlich', 'weiblich'), 4)} AS geschlechterquotient, {_r('g', 3)} AS wachstum_vorjahr_pct FROM grown"),
    "features": (("raw_land_long",), f"""
      SELECT kreis_id, jahr, max(CASE WHEN k = 'faelle' THEN insgesamt END) AS faelle, max(CASE WHEN k = 'flaeche' THEN insgesamt END) AS flaeche, max(CASE WHEN k = 'kaufsumme' THEN insgesamt END) AS kaufsumme, max(CASE WHEN k = 'flaeche' THEN baureifes_land END) AS baureif
      FROM (SELECT *, {_CATEGORY} AS k FROM raw_land_long WHERE length(kreis_id) = 5) AS c WHERE k IS NOT NULL GROUP BY kreis_id, jahr"""),
    "fact_bauland": (("features",), f"""
      SELECT kreis_id, CAST(jahr AS INT) AS jahr, faelle AS anzahl_veraeusserungsfaelle, flaeche AS veraeusserte_flaeche_1000qm, kaufsumme AS kaufsumme_tsd_eur, {_r(_div('kaufsumme', 'flaeche'), 2)} AS preis_pro_qm_eur,
        {_r(_div('100.0 * baureif', 'flaeche'), 2)} AS anteil_baureif_pct, {_r(_div('1000.0 * flaeche', 'faelle'), 2)} AS durchschnittsfall_qm FROM features"""),
    "climate_years": (("raw_climate",), "SELECT city AS stadt_name, TRY_CAST(substring(dt, 1, 4) AS INT) AS jahr, averagetemperature AS temp FROM raw_climate WHERE country = 'Germany' AND averagetemperature IS NOT NULL"),
    "anomalies": (("climate_years",), f"SELECT y.stadt_name, y.jahr, m, m - b AS a FROM (SELECT stadt_name, jahr, avg(temp) AS m FROM climate_years GROUP BY 1, 2) AS y JOIN (SELECT stadt_name, avg(temp) AS b FROM climate_years WHERE jahr BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY 1) AS b USING (stadt_name) WHERE y.jahr BETWEEN {REPORT[0]} AND {REPORT[1]}"),
    "fact_klima": (("anomalies",), f"SELECT stadt_name, jahr, {_r('m', 2)} AS avg_temperatur, {_r('a', 2)} AS temperatur_abweichung_grad FROM anomalies"),
    "fact_gemeinde_stamm": (("intact", "dim_gemeinde"), f"""
      SELECT gemeinde_id, population_total AS einwohner_total, male AS einwohner_maennlich, female AS einwohner_weiblich, {_r(_div('100.0 * female', 'population_total'), 2)} AS anteil_weiblich_pct, area_km2, {_r(_div('population_total', 'area_km2'), 2)} AS einwohner_pro_km2
      FROM intact AS m JOIN dim_gemeinde AS g ON m.municipality_name = g.gemeinde_name AND m.postal_code = g.postal_code"""),
    "nearest_city": (("dim_gemeinde", "dim_klimastadt"), """
      SELECT gemeinde_id, kreis_id, stadt_name FROM (SELECT gemeinde_id, kreis_id, stadt_name, row_number() OVER (PARTITION BY gemeinde_id ORDER BY pow(g.latitude - k.latitude, 2) + pow(g.longitude - k.longitude, 2), stadt_name) AS rn
      FROM dim_gemeinde AS g CROSS JOIN dim_klimastadt AS k WHERE g.latitude IS NOT NULL AND g.longitude IS NOT NULL AND kreis_id IS NOT NULL) AS d WHERE rn = 1"""),
    "climate_kreis": (("nearest_city", "fact_klima"), "SELECT kreis_id, jahr, avg(temperatur_abweichung_grad) AS temperatur_abweichung_grad FROM nearest_city JOIN fact_klima USING (stadt_name) GROUP BY 1, 2"),
    "density": (("fact_gemeinde_stamm", "dim_gemeinde"), "SELECT kreis_id, avg(einwohner_pro_km2) AS mittel, max(einwohner_pro_km2) AS hoechste FROM fact_gemeinde_stamm JOIN dim_gemeinde USING (gemeinde_id) WHERE kreis_id IS NOT NULL GROUP BY 1"),
    "kpi_base": (("fact_bevoelkerung", "fact_bauland", "climate_kreis", "density"), f"""
      SELECT kreis_id, jahr, einwohner_insgesamt, wachstum_vorjahr_pct, kaufsumme_tsd_eur, veraeusserte_flaeche_1000qm, preis_pro_qm_eur, faelle_wachstum, coalesce(temperatur_abweichung_grad, 0.0) AS temperatur_abweichung_grad, mittel, hoechste
      FROM fact_bevoelkerung JOIN (SELECT *, {_div('100.0 * (anzahl_veraeusserungsfaelle - lag(anzahl_veraeusserungsfaelle) OVER k)', 'lag(anzahl_veraeusserungsfaelle) OVER k')} AS faelle_wachstum FROM fact_bauland WINDOW k AS (PARTITION BY kreis_id ORDER BY jahr)) AS b USING (kreis_id, jahr)
      LEFT JOIN climate_kreis USING (kreis_id, jahr) LEFT JOIN density USING (kreis_id)"""),
    "fact_standortprofil_kpi": (("kpi_base",), f"""
      SELECT kreis_id, jahr, {_r(_div('wachstum_vorjahr_pct', 'faelle_wachstum'), 3)} AS wohnraumdruck_index, {_r(_div('1000.0 * kaufsumme_tsd_eur', 'einwohner_insgesamt'), 2)} AS baulandpreis_pro_kopf_eur,
        {_r(_div('1000.0 * veraeusserte_flaeche_1000qm', 'einwohner_insgesamt'), 4)} AS freiflaeche_pro_einwohner_qm, {_r(_div('wachstum_vorjahr_pct', 'faelle_wachstum') + ' * (1 + temperatur_abweichung_grad / 10)', 3)} AS klima_angepasstes_wohnraumrisiko,
        {_r(_div('hoechste', 'mittel'), 3)} AS verstaedterung_index, {_r(_z('wachstum_vorjahr_pct') + ' - ' + _z('preis_pro_qm_eur') + ' - coalesce(abs(' + _z('temperatur_abweichung_grad') + '), 0.0)', 3)} AS standortattraktivitaets_score
      FROM kpi_base WINDOW w AS (PARTITION BY jahr)"""),
}


def _sql(select: str, *parts: str) -> str:
    own = needed(list(parts), PARTS)
    return ("WITH " + ", ".join(f"{p} AS ({PARTS[p][1]})" for p in own) + " " if own else "") + select


def query(sql: str, *parts: str):
    """Registers a function under its name, with its SQL; parts: names of PARTS that the SQL uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = _sql(sql, *parts)
        return f

    return add


# ---- the raw tables and the star schema ---------------------------------------------------------------------------


def population(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d, "raw_population_wide")


def land(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d, "raw_land_long")


def climate(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d, "raw_climate")


def municipality(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d, "raw_municipality")


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


@query("SELECT * FROM dim_kreis", "dim_kreis")
def dim_kreis(s, d):
    return star.dim_kreis(population(s, d))


@query("SELECT * FROM dim_jahr", "dim_jahr")
def dim_jahr(s, d):
    return star.dim_jahr(land(s, d), EXTRA_YEARS)


@query("SELECT * FROM dim_klimastadt", "dim_klimastadt")
def dim_klimastadt(s, d):
    return star.dim_klimastadt(climate(s, d))


@query("SELECT * FROM dim_gemeinde", "dim_gemeinde")
def dim_gemeinde(s, d):
    return star.dim_gemeinde(municipality(s, d), dim_kreis(s, d))


@query("SELECT * FROM fact_bevoelkerung", "fact_bevoelkerung")
def fact_bevoelkerung(s, d):
    return star.fact_bevoelkerung(population(s, d))


@query("SELECT * FROM fact_bauland", "fact_bauland")
def fact_bauland(s, d):
    return star.fact_bauland(land(s, d))


@query("SELECT * FROM fact_klima", "fact_klima")
def fact_klima(s, d):
    return star.fact_klima(climate(s, d), BASE, REPORT)


@query("SELECT * FROM fact_gemeinde_stamm", "fact_gemeinde_stamm")
def fact_gemeinde_stamm(s, d):
    return star.fact_gemeinde_stamm(municipality(s, d), dim_gemeinde(s, d))


def _kpi_base(s: SparkSession, d: str) -> DataFrame:
    """The KPIs' inputs, as a table; each raw table is made once, and the municipalities are numbered once."""
    wide, weather, places = t.materialized(population(s, d)), t.materialized(climate(s, d)), t.materialized(municipality(s, d))
    gemeinden = star.dim_gemeinde(places, star.dim_kreis(wide))
    klima = star.climate_by_kreis(gemeinden, star.dim_klimastadt(weather), star.fact_klima(weather, BASE, REPORT))
    dichte = star.density_by_kreis(star.fact_gemeinde_stamm(places, gemeinden), gemeinden)
    return t.materialized(star.kpi_base(star.fact_bevoelkerung(wide), fact_bauland(s, d), klima, dichte))


@query("SELECT * FROM fact_standortprofil_kpi", "fact_standortprofil_kpi")
def fact_standortprofil_kpi(s, d):
    return star.fact_standortprofil_kpi(_kpi_base(s, d))


# ---- sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def scan_project(s, d):
    return t.read_table(s, f"{d}/nation.parquet").filter("n_regionkey = 1").select("n_nationkey", "n_name")


@query("SELECT municipality_name, postal_code, area_km2 FROM intact", "intact")
def scan_lenient_numeric(s, d):
    return star.intact(municipality(s, d)).select("municipality_name", "postal_code", "area_km2")


@query("SELECT y.jahr, coalesce(n, 0) AS n_orders FROM (SELECT CAST(unnest(generate_series(1990, 2001)) AS INT) AS jahr) AS y LEFT JOIN (SELECT CAST(year(o_orderdate) AS INT) AS jahr, count(*) AS n FROM orders GROUP BY 1) AS o USING (jahr)")
def generate_years(s, d):
    n = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("jahr")).agg(F.count("*").alias("n"))
    return star.year_rows(s, 1990, 2001).join(n, "jahr", "left").select("jahr", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT * FROM fact_bauland", "fact_bauland")
def full_load_roundtrip(s, d):
    t.full_load(fact_bauland(s, d), path := t.shared_path(s, "fact_bauland"))
    return s.read.parquet(path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def sanitize_nonfinite(s, d):
    k, nan, inf = F.col("c_custkey"), F.lit(float("nan")), F.lit(float("inf"))
    broken = F.when(k % 9 == 0, nan).when(k % 9 == 3, inf).when(k % 9 == 6, -inf).otherwise(F.col("c_acctbal"))
    return v.sanitize(table(s, d, "customer").select("c_custkey", broken.alias("c_acctbal")))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, (SELECT count(*) FROM supplier) AS n_staged FROM supplier")
def stage_copy(s, d):
    n = t.stage(table(s, d, "supplier"), path := t.shared_path(s, "staging"))
    return s.read.parquet(path).withColumn("n_staged", F.lit(n).cast("long"))


_STAGED = ("region", "nation", "supplier", "customer")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_source, count(*) AS n_staged, true AS same FROM {n}" for n in _STAGED) + " UNION ALL SELECT 'none', 0, 0, true")
def stage_several(s, d):
    source = {n: table(s, d, n) for n in _STAGED}
    source["none"] = source["region"].filter("r_regionkey < 0")
    out = None
    for name, (copy, n) in t.stage_all(source, t.shared_path(s, "staging")).items():
        same = F.lit(copy.schema == source[name].schema and n == copy.count())
        own = source[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_source")).withColumns({"n_staged": F.lit(n).cast("long"), "same": same})
        out = own if out is None else out.unionByName(own)
    return out


_PROFILED = (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]))


@query(
    " UNION ALL ".join(
        f"SELECT '{tab}' AS table_name, '{c}' AS column_name, (SELECT CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END FROM {tab} LIMIT 1) AS column_type, CAST({i} AS INT) AS position, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {tab}"
        for tab, cols in _PROFILED
        for i, c in enumerate(cols)
    )
)
def profile_tables(s, d):
    own = {n: (lambda n=n: table(s, d, n)) for n in ("region", "nation", "supplier")}
    found, bad = t.inspected(own | {"missing": lambda: s.read.parquet(f"{d}/no_such_table.parquet")})
    assert list(bad) == ["missing"]
    return found


@query("SELECT row FROM (SELECT format('{{\"n_nationkey\":{},\"n_name\":\"{}\",\"n_regionkey\":{}}}', n_nationkey, n_name, n_regionkey) AS row FROM nation ORDER BY n_nationkey LIMIT 3) AS x")
def profile_samples(s, d):
    return t.sample_rows(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3")
def preview_limit(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(3)


@query("SELECT r_regionkey AS id, r_name AS name, 'kept' AS origin FROM region UNION ALL SELECT n_nationkey, n_name, 'seeded' FROM nation")
def seed_if_empty(s, d):
    full = table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("kept").alias("origin"))
    seed = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("seeded").alias("origin"))
    return t.seed_if_empty(full, seed).unionByName(t.seed_if_empty(full.filter("id < 0"), seed))


_SEEDS = [("A1", "9.90", "2024-01-15 08:30:00"), ("A2", "1234.50", "2024-02-29 23:59:59"), ("Customer#000000001", "0.05", "1999-12-31 00:00:00")]


@query(
    "SELECT c_name AS code, CAST(c_acctbal AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS since FROM customer UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', CAST({b} AS DOUBLE), '{c}')" for a, b, c in _SEEDS) + ") AS v(code, amount, since) WHERE code NOT IN (SELECT c_name FROM customer)"
)
def seed_missing_keys(s, d):
    """Literal rows of DECIMAL(10,2) and TIMESTAMP, added where their key is missing; a second run adds nothing."""
    rows = " UNION ALL ".join(f"SELECT '{a}' AS code, CAST({b} AS DECIMAL(10,2)) AS amount, TIMESTAMP '{c}' AS since" for a, b, c in _SEEDS)
    have = table(s, d, "customer").select(F.col("c_name").alias("code"), F.col("c_acctbal").cast("decimal(10,2)").alias("amount"), F.lit(None).cast("timestamp").alias("since"))
    x = t.with_missing(t.with_missing(have, s.sql(rows), "code"), s.sql(rows), "code")
    return x.select("code", F.col("amount").cast("double").alias("amount"), F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def incremental_load(s, d):
    o = table(s, d, "orders")
    return t.newer_rows(o, o.filter("o_orderdate < timestamp '1998-01-01'"), "o_orderdate").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) AS x WHERE rn = 1")
def incremental_latest(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    old = o.filter("o_orderdate < timestamp '1998-01-01'")
    now = old.unionByName(t.newer_rows(o, old, "o_orderdate"))
    return t.latest_rows(now, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


# ---- versioned tables ---------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation")
def versioned_reload(s, d):
    """A load that reads the table that it replaces: the first version's rows and more."""
    n, root = table(s, d, "nation").select("n_nationkey", "n_name"), t.shared_path(s, "versioned")
    versions.load(n.filter("n_nationkey % 2 = 0"), root)
    versions.load(versions.current(s, root).unionByName(n.filter("n_nationkey % 2 = 1")), root)
    return versions.current(s, root)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) AS x WHERE rn = 1 AND o_orderstatus <> 'P'")
def merge_increments(s, d):
    """Three increments with late rows and deletions by flag, merged into a stored table: as one full load gives it."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", (F.col("o_orderstatus") == "P").alias("gone"))
    root = t.shared_path(s, "merged")
    for part in (2, 0, 1):
        versions.merge(o.filter(F.col("o_orderkey") % 3 == part), root, ["o_custkey"], ["o_orderdate", "o_orderkey"], mark="o_orderkey", deleted="gone", buckets=8)
    return versions.current(s, root).drop("o_orderdate")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS jahr, " + _r("(o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w", 6) + " AS z FROM orders WINDOW w AS (PARTITION BY year(o_orderdate))")
def scores_by_increments(s, d):
    """Scores of all orders by year, from moments that three increments were merged into."""
    o = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("jahr"), "o_totalprice")
    root = t.shared_path(s, "scores")
    for part in range(3):
        moments.keep_scores(o.filter(F.col("o_orderkey") % 3 == part), f"{root}/rows", f"{root}/moments", ["jahr"], ["o_totalprice"])
    x = moments.scored(versions.current(s, f"{root}/rows"), versions.current(s, f"{root}/moments"), ["jahr"], ["o_totalprice"])
    return x.select("o_orderkey", "jahr", v.round_to("o_totalprice_z", 6).alias("z"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey % 2, o_custkey, o_orderkey) AS nr FROM orders")
def surrogate_key_lasting(s, d):
    """Numbers of a second load, whose new rows lie between those of the first: old ones keep theirs."""
    o, root = table(s, d, "orders").select("o_orderkey", "o_custkey"), t.shared_path(s, "keys")
    versions.lasting_keys(o.filter("o_orderkey % 2 = 0"), root, ["o_custkey", "o_orderkey"], "nr")
    return versions.lasting_keys(o, root, ["o_custkey", "o_orderkey"], "nr")


# ---- filters and joins --------------------------------------------------------------------------------------------


@query("SELECT id, kreis FROM raw_population_wide WHERE length(id) = 5", "raw_population_wide")
def filter_level(s, d):
    return reshape.at_level(population(s, d), "id", star.LEVEL).select("id", "kreis")


@query("SELECT * FROM raw_climate WHERE country = 'Germany'", "raw_climate")
def filter_equality(s, d):
    return climate(s, d).filter(F.col("country") == star.COUNTRY)


@query("SELECT dt, city, averagetemperature FROM raw_climate WHERE averagetemperature IS NOT NULL", "raw_climate")
def filter_not_null(s, d):
    return climate(s, d).filter(F.col("averagetemperature").isNotNull()).select("dt", "city", "averagetemperature")


@query(f"SELECT * FROM climate_years WHERE jahr BETWEEN {BASE[0]} AND {BASE[1]}", "climate_years")
def filter_range(s, d):
    x = climate(s, d).filter("country = 'Germany' AND averagetemperature IS NOT NULL")
    return x.select(F.col("city").alias("stadt_name"), v.year_of("dt").alias("jahr"), F.col("averagetemperature").alias("temp")).filter(F.col("jahr").between(*BASE))


@query("SELECT city, country, averagetemperature FROM raw_climate WHERE (country = 'Germany' AND averagetemperature > 20) OR averagetemperature IS NULL", "raw_climate")
def filter_compound(s, d):
    temp = F.col("averagetemperature")
    return climate(s, d).filter(((F.col("country") == star.COUNTRY) & (temp > 20)) | temp.isNull()).select("city", "country", "averagetemperature")


@query(f"SELECT municipality_name, postal_code, district, kreis_id FROM (SELECT {_MUNI} FROM intact) AS m LEFT JOIN dim_kreis ON contains(lower(kreis_name), lower(district))", "intact", "dim_kreis")
def join_fuzzy_contains(s, d):
    m = star.intact(municipality(s, d)).select("municipality_name", "postal_code", v.unquoted("district_kreis").alias("district"))
    return match.contains_join(m, dim_kreis(s, d), "district", "kreis_name").select("municipality_name", "postal_code", "district", "kreis_id")


@query("SELECT municipality_name, postal_code, district, kreis_id, kreis_name FROM matched", "matched")
def fuzzy_best_match(s, d):
    m = star.intact(municipality(s, d)).select("municipality_name", "postal_code", v.unquoted("district_kreis").alias("district"))
    return match.best_containing(m, dim_kreis(s, d).select("kreis_id", "kreis_name"), "district", "kreis_name", "kreis_id", ["municipality_name", "postal_code"])


@query("SELECT stadt_name, jahr, avg_temperatur, latitude, longitude FROM fact_klima JOIN dim_klimastadt USING (stadt_name)", "fact_klima", "dim_klimastadt")
def join_inner_single(s, d):
    return fact_klima(s, d).join(dim_klimastadt(s, d), "stadt_name").select("stadt_name", "jahr", "avg_temperatur", "latitude", "longitude")


@query("SELECT kreis_id, jahr, einwohner_insgesamt, kaufsumme_tsd_eur FROM fact_bevoelkerung JOIN fact_bauland USING (kreis_id, jahr)", "fact_bevoelkerung", "fact_bauland")
def join_inner_multi(s, d):
    return fact_bevoelkerung(s, d).join(fact_bauland(s, d), ["kreis_id", "jahr"]).select("kreis_id", "jahr", "einwohner_insgesamt", "kaufsumme_tsd_eur")


@query("SELECT gemeinde_id, municipality_name, m.postal_code, population_total FROM intact AS m JOIN dim_gemeinde AS g ON m.municipality_name = g.gemeinde_name AND m.postal_code = g.postal_code", "intact", "dim_gemeinde")
def join_inner_renamed(s, d):
    m, g = star.intact(municipality(s, d)).alias("m"), dim_gemeinde(s, d).alias("g")
    on = (F.col("m.municipality_name") == F.col("g.gemeinde_name")) & (F.col("m.postal_code") == F.col("g.postal_code"))
    return m.join(g, on).select("gemeinde_id", "municipality_name", "m.postal_code", "population_total")


@query("SELECT kreis_id, jahr, einwohner_insgesamt, mittel FROM fact_bevoelkerung LEFT JOIN density USING (kreis_id)", "fact_bevoelkerung", "density")
def join_left_equi(s, d):
    g = dim_gemeinde(s, d)
    density = star.density_by_kreis(star.fact_gemeinde_stamm(municipality(s, d), g), g)
    x = fact_bevoelkerung(s, d).join(density, "kreis_id", "left")
    return x.select("kreis_id", "jahr", "einwohner_insgesamt", "mittel")


@query("SELECT kreis_id, stadt_name FROM dim_kreis CROSS JOIN dim_klimastadt", "dim_kreis", "dim_klimastadt")
def join_cross(s, d):
    return dim_kreis(s, d).select("kreis_id").crossJoin(dim_klimastadt(s, d).select("stadt_name"))


@query("SELECT * FROM nearest_city", "nearest_city")
def join_nearest(s, d):
    return star.nearest_city(dim_gemeinde(s, d), dim_klimastadt(s, d))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, " + _r("sum(o_totalprice)", 2) + " AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) AS o ON c_custkey = o_custkey")
def join_left_fill(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), v.round_to(F.sum("o_totalprice"), 2).alias("total"))
    return table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna({"n_orders": 0, "total": 0.0})


# ---- aggregates and reshaping -------------------------------------------------------------------------------------


@query("SELECT * FROM features", "features")
def pivot_with_extra_measure(s, d):
    return star.land_features(land(s, d))


@query("SELECT kreis_id, jahr, faelle, flaeche, kaufsumme FROM features", "features")
def pivot_features(s, d):
    x = reshape.at_level(land(s, d), "kreis_id", star.LEVEL).withColumn("k", v.category("merkmal", star.FEATURES))
    return reshape.pivoted(x.filter("k IS NOT NULL"), ["kreis_id", "jahr"], "k", "insgesamt", ["faelle", "flaeche", "kaufsumme"])


@query(f"SELECT kreis_id, jahr, max(CASE WHEN k = 'faelle' THEN insgesamt END) AS faelle, max(CASE WHEN k = 'flaeche' THEN insgesamt END) AS flaeche, max(CASE WHEN k = 'kaufsumme' THEN insgesamt END) AS kaufsumme, max(CASE WHEN k = 'kaufwert' THEN insgesamt END) AS kaufwert FROM (SELECT *, {_CATEGORY4} AS k FROM raw_land_long WHERE length(kreis_id) = 5) AS c GROUP BY 1, 2", "raw_land_long")
def pivot_features_all(s, d):
    x = reshape.at_level(land(s, d), "kreis_id", star.LEVEL).withColumn("k", v.category("merkmal", star.ALL_FEATURES))
    return reshape.pivoted(x, ["kreis_id", "jahr"], "k", "insgesamt", ["faelle", "flaeche", "kaufsumme", "kaufwert"])


@query("SELECT city AS stadt_name, TRY_CAST(substring(dt, 1, 4) AS INT) AS jahr, " + _r("avg(averagetemperature)", 4) + " AS avg_temp FROM raw_climate GROUP BY 1, 2", "raw_climate")
def agg_avg(s, d):
    return climate(s, d).groupBy(F.col("city").alias("stadt_name"), v.year_of("dt").alias("jahr")).agg(v.round_to(F.avg("averagetemperature"), 4).alias("avg_temp"))


@query("SELECT kreis_id, " + _r("mittel", 4) + " AS mittel, hoechste FROM density", "density")
def agg_avg_max(s, d):
    g = dim_gemeinde(s, d)
    return star.density_by_kreis(star.fact_gemeinde_stamm(municipality(s, d), g), g).withColumn("mittel", v.round_to("mittel", 4))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY 1")
def agg_first_value(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"))


@query("SELECT kreis_id, jahr, flaeche, baureif FROM features", "features")
def agg_filtered(s, d):
    return star.land_features(land(s, d)).select("kreis_id", "jahr", "flaeche", "baureif")


@query("SELECT DISTINCT city, latitude, longitude FROM raw_climate", "raw_climate")
def distinct_rows(s, d):
    return climate(s, d).select("city", "latitude", "longitude").distinct()


@query("SELECT stadt_name, jahr, " + _r("m", 4) + " AS mean, " + _r("a", 4) + " AS anomaly FROM anomalies", "anomalies")
def baseline_anomaly(s, d):
    x = climate(s, d).filter("country = 'Germany' AND averagetemperature IS NOT NULL").select(F.col("city").alias("stadt_name"), v.year_of("dt").alias("jahr"), "averagetemperature")
    x = reshape.anomaly(x, "stadt_name", "jahr", "averagetemperature", BASE, REPORT)
    return x.select("stadt_name", "jahr", v.round_to("mean", 4).alias("mean"), v.round_to("anomaly", 4).alias("anomaly"))


@query("SELECT kreis_id, jahr, " + _r("temperatur_abweichung_grad", 4) + " AS temperatur_abweichung_grad FROM climate_kreis", "climate_kreis")
def rollup_nearest_measure(s, d):
    x = star.climate_by_kreis(dim_gemeinde(s, d), dim_klimastadt(s, d), fact_klima(s, d))
    return x.withColumn("temperatur_abweichung_grad", v.round_to("temperatur_abweichung_grad", 4))


@query("SELECT id, CAST(jahr AS INT) AS jahr, insgesamt, maennlich, weiblich FROM long_population", "long_population")
def unpivot_years(s, d):
    return reshape.unpivot_years(reshape.at_level(population(s, d), "id", star.LEVEL), ["id"], ["insgesamt", "maennlich", "weiblich"], {str(y)[2:]: y for y in YEARS}, "insgesamt")


@query("SELECT CAST(jahr AS INT) AS jahr FROM raw_land_long UNION SELECT CAST(jahr AS INT) FROM long_population", "raw_land_long", "long_population")
def union_distinct(s, d):
    a = land(s, d).select(F.col("jahr").try_cast("int").alias("jahr"))
    return a.distinct().unionByName(unpivot_years(s, d).select("jahr")).distinct()


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name")))


# ---- windows ------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) AS x WHERE rn = 1")
def window_top1(s, d):
    return reshape.top1(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.asc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS nr FROM orders")
def surrogate_key(s, d):
    return match.numbered(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], "nr")


@query("SELECT kreis_id, jahr, einwohner_insgesamt, wachstum_vorjahr_pct FROM fact_bevoelkerung", "fact_bevoelkerung")
def lag_growth(s, d):
    return fact_bevoelkerung(s, d).select("kreis_id", "jahr", "einwohner_insgesamt", "wachstum_vorjahr_pct")


@query("SELECT id, CAST(jahr AS INT) AS jahr, g FROM grown", "grown")
def lag_growth_raw(s, d):
    return reshape.growth(unpivot_years(s, d), "id", "jahr", "insgesamt", "g").select("id", "jahr", "g")


@query("SELECT kreis_id, jahr, " + _r("preis_pro_qm_eur - avg(preis_pro_qm_eur) OVER (PARTITION BY jahr)", 4) + " AS dev FROM fact_bauland", "fact_bauland")
def window_mean_dev(s, d):
    x = reshape.with_group_stats(fact_bauland(s, d), "jahr", ["preis_pro_qm_eur"])
    return x.select("kreis_id", "jahr", v.round_to(F.col("preis_pro_qm_eur") - F.col("preis_pro_qm_eur_avg"), 4).alias("dev"))


@query("SELECT kreis_id, jahr, " + _r(_z("preis_pro_qm_eur"), 4) + " AS z FROM fact_bauland WINDOW w AS (PARTITION BY jahr)", "fact_bauland")
def zscore(s, d):
    x = reshape.with_group_stats(fact_bauland(s, d), "jahr", ["preis_pro_qm_eur"])
    return x.select("kreis_id", "jahr", v.round_to(reshape.z("preis_pro_qm_eur"), 4).alias("z"))


@query("SELECT kreis_id, jahr, standortattraktivitaets_score FROM fact_standortprofil_kpi", "fact_standortprofil_kpi")
def zscore_composite(s, d):
    return fact_standortprofil_kpi(s, d).select("kreis_id", "jahr", "standortattraktivitaets_score")


# ---- scalar functions ---------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, " + _div("l_extendedprice", "(l_orderkey % 5)") + " AS ratio FROM lineitem")
def safe_div(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", v.safe_div("l_extendedprice", F.col("l_orderkey") % 5).alias("ratio"))


@query("SELECT kreis_id, jahr, preis_pro_qm_eur, anteil_baureif_pct, durchschnittsfall_qm FROM fact_bauland", "fact_bauland")
def ratio_kpis(s, d):
    return fact_bauland(s, d).select("kreis_id", "jahr", "preis_pro_qm_eur", "anteil_baureif_pct", "durchschnittsfall_qm")


@query("SELECT o_orderkey, CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS jahrzehnt FROM orders")
def decade(s, d):
    return table(s, d, "orders").select("o_orderkey", v.decade(F.year("o_orderdate")).alias("jahrzehnt"))


@query("SELECT id, substring(id, 1, 2) AS bundesland_id, CAST(length(id) AS INT) AS level FROM raw_population_wide", "raw_population_wide")
def key_prefix(s, d):
    return population(s, d).select("id", F.substring("id", 1, 2).alias("bundesland_id"), F.length("id").alias("level"))


@query("SELECT municipality_name, postal_code, lower(trim(replace(district_kreis, '\"', ''))) AS district FROM raw_municipality", "raw_municipality")
def string_normalize(s, d):
    return municipality(s, d).select("municipality_name", "postal_code", F.lower(v.unquoted("district_kreis")).alias("district"))


@query(f"SELECT dt, city, {_COMPASS.format('latitude')} AS lat, {_COMPASS.format('longitude')} AS lon FROM raw_climate", "raw_climate")
def parse_coordinates(s, d):
    return climate(s, d).select("dt", "city", v.compass("latitude").alias("lat"), v.compass("longitude").alias("lon"))


@query("SELECT municipality_name, TRY_CAST(replace(latitude, ',', '.') AS DOUBLE) AS lat, TRY_CAST(replace(area_km2, ',', '.') AS DOUBLE) AS area FROM raw_municipality WHERE area_km2 IS NULL OR area_km2 NOT LIKE ' %'", "raw_municipality")
def parse_decimal_comma(s, d):
    x = municipality(s, d).filter("area_km2 IS NULL OR area_km2 NOT LIKE ' %'")
    return x.select("municipality_name", v.decimal_comma("latitude").alias("lat"), v.decimal_comma("area_km2").alias("area"))


@query(f"SELECT kreis_id, jahr, merkmal, {_CATEGORY} AS kategorie FROM raw_land_long", "raw_land_long")
def categorize_labels(s, d):
    return land(s, d).select("kreis_id", "jahr", "merkmal", v.category("merkmal", star.FEATURES).alias("kategorie"))


@query(f"SELECT id, {_STATE} AS bundesland_name FROM raw_population_wide", "raw_population_wide")
def map_lookup(s, d):
    return population(s, d).select("id", v.looked_up(F.substring("id", 1, 2), star.STATES).alias("bundesland_name"))


@query("SELECT dt, city, TRY_CAST(substring(dt, 1, 4) AS INT) AS jahr FROM raw_climate", "raw_climate")
def year_of_text(s, d):
    return climate(s, d).select("dt", "city", v.year_of("dt").alias("jahr"))


@query("SELECT DISTINCT municipality_name, nullif(trim(translate(district_kreis, '\"?', '')), '') AS district FROM raw_municipality", "raw_municipality")
def clean_names(s, d):
    return municipality(s, d).select("municipality_name", v.clean_name("district_kreis").alias("district")).distinct()


_DAMAGED = "CASE WHEN c_custkey % 5 = 0 THEN 'Nowh?re' WHEN c_custkey % 5 = 1 THEN replace(n_name, 'A', '?') WHEN c_custkey % 5 = 2 THEN n_name || '?' WHEN c_custkey % 5 = 3 THEN replace(n_name, 'TI', chr(65533) || chr(65533)) ELSE ' ' || n_name END"


@query(f"""SELECT c_custkey, CASE WHEN status = 'repaired' THEN hit ELSE clean END AS name, status, candidates FROM (
  SELECT c_custkey, clean, hit, CASE WHEN clean NOT LIKE '%?%' AND clean NOT LIKE '%' || chr(65533) || '%' THEN 'intact' WHEN fits = 1 THEN 'repaired' WHEN fits > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN clean NOT LIKE '%?%' AND clean NOT LIKE '%' || chr(65533) || '%' THEN 0 ELSE fits END AS candidates
  FROM (SELECT c_custkey, clean, CASE WHEN count(*) FILTER (WHERE e) > 0 THEN count(*) FILTER (WHERE e) ELSE count(*) FILTER (WHERE l) END AS fits, CASE WHEN count(*) FILTER (WHERE e) > 0 THEN min(full_name) FILTER (WHERE e) ELSE min(full_name) FILTER (WHERE l) END AS hit
    FROM (SELECT c_custkey, clean, n.n_name AS full_name, regexp_full_match(n.n_name, translate(clean, '?' || chr(65533), '..')) AS e, regexp_full_match(n.n_name, replace(replace(clean, '?', '.{{0,2}}'), chr(65533), '.{{0,2}}')) AS l
      FROM (SELECT c_custkey, trim({_DAMAGED}) AS clean FROM customer JOIN nation ON c_nationkey = n_nationkey) AS d CROSS JOIN nation AS n) AS m GROUP BY c_custkey, clean) AS f) AS s""")
def repair_names(s, d):
    """Names with lost letters, found again among intact ones, or reported as ambiguous or unknown."""
    n = table(s, d, "nation")
    x = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_DAMAGED.replace("chr(65533)", "decode(unhex('EFBFBD'), 'UTF-8')")).alias("damaged"))
    return repair.repaired_names(x, "damaged", n, "n_name").select("c_custkey", "repair.*")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || ', Stadt' ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN 'x' ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS plz, n_name AS district,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5000 AS VARCHAR) END AS population, CASE WHEN c_custkey % 7 = 0 THEN 'repaired' WHEN c_custkey % 11 = 0 THEN 'unsuitable: plz' ELSE 'intact' END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def realign_rows(s, d):
    """Rows that a separator within a name has shifted are put back; those that can't be are quarantined with a reason."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cut, wrong = F.col("c_custkey") % 7 == 0, F.col("c_custkey") % 11 == 0
    own = [F.col("c_name"), F.when(wrong & ~cut, "x").otherwise(F.lpad((F.col("c_custkey") % 100_000).cast("string"), 5, "0")), F.col("n_name"), (F.col("c_custkey") % 5000).cast("string")]
    shifted = [own[0], F.lit(" Stadt"), *own[1:3]]
    names = ["name", "plz", "district", "population"]
    rows = c.select("c_custkey", *[F.when(cut, b).otherwise(a).alias(k) for k, a, b in zip(names, own, shifted, strict=True)])
    good, rest = repair.realigned(rows, {"name": ".+", "plz": "[0-9]{5}", "district": "[^0-9]+_[0-9]+", "population": "[0-9]{1,4}"}, into="state")
    return good.unionByName(rest.withColumnRenamed("reason", "state"))


# ---- audits -------------------------------------------------------------------------------------------------------

_AUDITS = {
    "gemeinde_id_missing": "gemeinde_id IS NULL",
    "kreis_unmatched": "kreis_id IS NULL",
    "coordinates_missing": "latitude IS NULL OR longitude IS NULL",
    "latitude_implausible": "latitude NOT BETWEEN 47 AND 54",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {c}) AS n_bad, count(*) FILTER (WHERE {c}) = 0 AS passed FROM dim_gemeinde" for k, c in _AUDITS.items()), "dim_gemeinde")
def audit_checks(s, d):
    return t.audit(dim_gemeinde(s, d), _AUDITS)


_PLAUSIBLE = {
    "year_missing": "jahr IS NULL",
    "price_negative": "baulandpreis_pro_kopf_eur < 0",
    "land_negative": "freiflaeche_pro_einwohner_qm < 0",
    "urbanisation_below_one": "verstaedterung_index < 1",
    "score_extreme": "abs(standortattraktivitaets_score) > 30",
    "risk_without_pressure": "klima_angepasstes_wohnraumrisiko IS NOT NULL AND wohnraumdruck_index IS NULL",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {c}) AS n_bad, count(*) FILTER (WHERE {c}) = 0 AS passed FROM fact_standortprofil_kpi" for k, c in _PLAUSIBLE.items()), "fact_standortprofil_kpi")
def plausibility_kpi(s, d):
    return t.audit(fact_standortprofil_kpi(s, d), _PLAUSIBLE)


@query("SELECT c_custkey, c_name FROM customer")
def audit_then_publish(s, d):
    """A staged table is published where its audit passes; the second, which doesn't, leaves the target as it is."""
    own = table(s, d, "customer").select("c_custkey", "c_name")
    root, target = t.shared_path(s, "staging"), t.shared_path(s, "published")
    t.stage_all({"good": own, "bad": own.withColumn("c_name", F.when(F.col("c_custkey") > 3, F.col("c_name")))}, root)
    checks = {"key_missing": "c_custkey IS NULL", "name_missing": "c_name IS NULL"}
    failed = [t.publish(f"{root}/{k}", target, checks, s) for k in ("good", "bad")]
    assert not failed[0] and list(failed[1]) == ["name_missing"]
    return s.read.parquet(target)


@query("SELECT count(*) AS n_rows, count(kreis_id) AS n_matched, " + _r(_div("100.0 * count(kreis_id)", "count(*)"), 2) + " AS pct FROM matched", "matched")
def bridge_match_rate(s, d):
    x = fuzzy_best_match(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count("kreis_id").alias("n_matched"))
    return x.withColumn("pct", v.round_to(v.safe_div(100.0 * F.col("n_matched"), "n_rows"), 2))


_COVERED = ["wohnraumdruck_index", "baulandpreis_pro_kopf_eur", "verstaedterung_index", "standortattraktivitaets_score"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS kpi, count({c}) AS n_filled, count(*) AS n_rows, {_r(_div(f'100.0 * count({c})', 'count(*)'), 2)} AS pct FROM fact_standortprofil_kpi" for c in _COVERED), "fact_standortprofil_kpi")
def coverage_report(s, d):
    one = fact_standortprofil_kpi(s, d).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in _COVERED])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(c).alias("n_filled")) for c in _COVERED]))
    x = one.select("n", rows.alias("r"))
    return x.select("r.kpi", "r.n_filled", F.col("n").alias("n_rows"), v.round_to(v.safe_div(100.0 * F.col("r.n_filled"), "n"), 2).alias("pct"))


_RELATED = ("dim_kreis", "dim_jahr", "dim_gemeinde", "dim_klimastadt", "fact_bevoelkerung", "fact_bauland", "fact_klima", "fact_gemeinde_stamm")


def _related_sql() -> str:
    rows = []
    for name in _RELATED:
        key = relations.GRAINS[name]
        own = {"grain": f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(key)} FROM {name})) AS n FROM {name}", "key_missing": f"SELECT count(*) AS n FROM {name} WHERE " + " OR ".join(f"{k} IS NULL" for k in key)}
        own |= {c: f"SELECT count(*) AS n FROM {name} AS x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} AS y WHERE y.{k} = x.{c}{' AND jahr <= 1999' if p == 'dim_jahr' else ''})" for c, p, k in relations.FOREIGN.get(name, [])}
        if name == "dim_jahr":
            own = {k: f"{q}{' AND' if 'WHERE' in q else ' WHERE'} jahr <= 1999".replace("FROM dim_jahr))", "FROM dim_jahr WHERE jahr <= 1999))").replace("WHERE jahr IS NULL AND jahr <= 1999", "WHERE jahr IS NULL") for k, q in own.items()}
        rows += [f"SELECT '{name}.{k}' AS check_name, n AS n_bad, n = 0 AS passed FROM ({q}) AS q" for k, q in own.items()]
    return " UNION ALL ".join(rows)


@query(_related_sql(), *_RELATED)
def audit_relations(s, d):
    """Grains and foreign keys of the star schema's tables, with a year dimension that ends too early."""
    places, kreise, weather = t.materialized(municipality(s, d)), t.materialized(dim_kreis(s, d)), t.materialized(climate(s, d))
    gemeinden = t.materialized(star.dim_gemeinde(places, kreise))
    own = {
        "dim_kreis": kreise, "dim_jahr": dim_jahr(s, d).filter("jahr <= 1999"), "dim_gemeinde": gemeinden, "dim_klimastadt": star.dim_klimastadt(weather), "fact_bevoelkerung": fact_bevoelkerung(s, d),
        "fact_bauland": fact_bauland(s, d), "fact_klima": star.fact_klima(weather, BASE, REPORT), "fact_gemeinde_stamm": star.fact_gemeinde_stamm(places, gemeinden),
    }
    return relations.relational_audit(own)


@query("""SELECT (SELECT count(*) FROM intact) AS n_left, count(DISTINCT rid) AS n_matched, count(*) AS n_joined, max(k) AS largest
  FROM (SELECT rid, count(*) OVER (PARTITION BY rid) AS k FROM (SELECT row_number() OVER () AS rid, * FROM intact) AS m JOIN dim_gemeinde AS g ON m.municipality_name = g.gemeinde_name AND m.postal_code = g.postal_code) AS x""", "intact", "dim_gemeinde")
def audit_fan_out(s, d):
    """What the join of municipalities with their dimension multiplies."""
    return relations.fan_out(star.intact(municipality(s, d)), dim_gemeinde(s, d), [("municipality_name", "gemeinde_name"), ("postal_code", "postal_code")])


_RATED = ("wohnraumdruck_index", "baulandpreis_pro_kopf_eur", "freiflaeche_pro_einwohner_qm", "verstaedterung_index")


@query(
    "SELECT kreis_id, jahr, kpi, value, CASE WHEN value > high THEN 'high' ELSE 'low' END AS side FROM (SELECT *, q3 + 3 * (q3 - q1) AS high, q1 - 3 * (q3 - q1) AS low FROM ("
    + " UNION ALL ".join(f"SELECT kreis_id, jahr, '{c}' AS kpi, {c} AS value, quantile_disc({c}, 0.25) OVER () AS q1, quantile_disc({c}, 0.75) OVER () AS q3 FROM fact_standortprofil_kpi WHERE {c} IS NOT NULL" for c in _RATED)
    + ") AS u) AS f WHERE value > high OR value < low",
    "fact_standortprofil_kpi",
)
def extreme_kpis(s, d):
    """Which district has an extreme value of which figure in which year: beyond three quartile distances."""
    return reshape.extremes(fact_standortprofil_kpi(s, d), ["kreis_id", "jahr"], list(_RATED))
