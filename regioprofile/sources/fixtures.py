"""The raw tables' shapes, damage included, as SQL over the supplied tables; both Spark and DuckDB run the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

YEARS = range(1995, 2002)
BASE, REPORT, EXTRA_YEARS = (1995, 1997), (1998, 2001), (1990, 1998)

_KEY = "lpad(CAST(n_regionkey + 1 AS STRING), 2, '0') || lpad(CAST(n_nationkey AS STRING), 3, '0')"


def _wide() -> str:
    def columns(region: bool) -> str:
        out = []
        for y in YEARS:
            n, f, p = (f"count(*) FILTER (WHERE y = {y}{c})" for c in ("", " AND o_orderstatus = 'F'", " AND o_orderstatus = 'P'"))
            s = str(y)[2:]
            out += [f"CASE WHEN {n} % 11 = 0 THEN NULL ELSE {n} END AS insgesamt_{s}", f"nullif({f}, 0) AS maennlich_{s}", f"nullif({p}, 0) AS weiblich_{s}"]
        return ", ".join(out)

    return f"""
      SELECT {_KEY} AS id, n_name || ', district' AS kreis, {columns(False)} FROM pop_orders GROUP BY n_regionkey, n_nationkey, n_name
      UNION ALL
      SELECT lpad(CAST(r_regionkey + 1 AS STRING), 2, '0') AS id, r_name AS kreis, {columns(True)}
      FROM pop_orders JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""


#: Name: (other fixtures that it needs, SQL).
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "pop_orders": ((), "SELECT n_nationkey, n_name, n_regionkey, year(o_orderdate) AS y, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "raw_population_wide": (("pop_orders",), _wide()),
    "land_base": ((), f"""
      SELECT {_KEY} AS kreis_id, lpad(CAST(n_regionkey + 1 AS STRING), 2, '0') AS land, CAST(year(l_shipdate) AS STRING) AS jahr, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q,
        CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS BIGINT) AS qa, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, year(l_shipdate)"""),
    "raw_land_long": (("land_base",), """
      SELECT kreis_id, jahr, 'Ver?u?erungsf?lle von Bauland' AS merkmal, n AS insgesamt, CAST(NULL AS BIGINT) AS baureifes_land FROM land_base
      UNION ALL SELECT kreis_id, jahr, 'Ver?u?erte Baulandfl?che', (q % 7) * 100, CAST(floor((q % 7) * 100 * qa / q) AS BIGINT) FROM land_base
      UNION ALL SELECT kreis_id, jahr, 'Kaufsumme', CAST(floor(cents / 100000) AS BIGINT), CAST(NULL AS BIGINT) FROM land_base
      UNION ALL SELECT kreis_id, jahr, 'Durchschnittlicher Kaufwert je qm', n % 300, CAST(NULL AS BIGINT) FROM land_base
      UNION ALL SELECT land, jahr, 'Kaufsumme', CAST(7 AS BIGINT), CAST(NULL AS BIGINT) FROM land_base"""),
    "raw_climate": ((), """
      SELECT substring(CAST(o_orderdate AS STRING), 1, 10) AS dt,
        CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (CAST(round(o_totalprice * 100) AS BIGINT) % 3000) / 100 END AS averagetemperature,
        'CITY_' || CAST(k AS STRING) AS city, CASE WHEN k < 30 THEN 'Germany' ELSE 'Elsewhere' END AS country,
        CAST(47 + k % 8 AS STRING) || '.' || lpad(CAST((k * 37) % 100 AS STRING), 2, '0') || CASE WHEN k % 10 = 9 THEN 'S' ELSE 'N' END AS latitude,
        CAST(6 + k % 9 AS STRING) || '.' || lpad(CAST((k * 53) % 100 AS STRING), 2, '0') || CASE WHEN k % 10 = 8 THEN 'W' ELSE 'E' END AS longitude
      FROM (SELECT *, o_custkey % 40 AS k FROM orders) AS o"""),
    "raw_municipality": ((), """
      SELECT c_name AS municipality_name, lpad(CAST(m % 100000 AS STRING), 5, '0') AS postal_code, CASE WHEN m % 17 = 0 THEN 'Nowhere' ELSE '"' || n_name || '"' END AS district_kreis, r_name AS state_land,
        CAST(47 + m % 8 AS STRING) || ',' || lpad(CAST((m * 29) % 100 AS STRING), 2, '0') AS latitude, CAST(6 + m % 9 AS STRING) || ',' || lpad(CAST((m * 31) % 100 AS STRING), 2, '0') AS longitude,
        CASE WHEN m % 23 = 0 THEN NULL WHEN m % 29 = 0 THEN '"9' WHEN m % 31 = 0 THEN '0' ELSE ' ' || CAST(5 + m % 300 AS STRING) || '.5 ' END AS area_km2,
        100 + (m * 131) % 5000 AS population_total, 50 + (m * 61) % 2400 AS male, 50 + (m * 70) % 2600 AS female
      FROM (SELECT c_custkey AS m, c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 41 = 0) AS c
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
}
_TABLES = ("orders", "customer", "nation", "region", "lineitem", "supplier")


def needed(names: list[str], known: dict[str, tuple[tuple[str, ...], str]]) -> list[str]:
    """The named parts and all that they need, in an order in which each follows what it needs."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*needed(list(known[n][0]), known), n] if x not in out]
    return out


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table as a DataFrame."""
    parts = needed([name], FIXTURES)
    text = "WITH " + ", ".join(f"{p} AS ({FIXTURES[p][1]})" for p in parts) + f" SELECT * FROM {name}"
    used = [t for t in _TABLES if f" {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if f"{{{t}}}" in text})
