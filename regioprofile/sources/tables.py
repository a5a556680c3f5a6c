"""Reading, writing, staging, profiling and loading of tables, and the contracts of the star schema."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


#: Fixed contracts of the nine tables.
CONTRACTS = {
    "dim_kreis": _schema(kreis_id=_S, kreis_name=_S, bundesland_id=_S, bundesland_name=_S),
    "dim_jahr": _schema(jahr=_I, jahrzehnt=_I),
    "dim_gemeinde": _schema(gemeinde_id=_S, gemeinde_name=_S, kreis_id=_S, bundesland_name=_S, postal_code=_S, latitude=_D, longitude=_D),
    "dim_klimastadt": _schema(stadt_name=_S, latitude=_D, longitude=_D),
    "fact_bevoelkerung": _schema(kreis_id=_S, jahr=_I, einwohner_insgesamt=_L, einwohner_maennlich=_L, einwohner_weiblich=_L, geschlechterquotient=_D, wachstum_vorjahr_pct=_D),
    "fact_bauland": _schema(kreis_id=_S, jahr=_I, anzahl_veraeusserungsfaelle=_L, veraeusserte_flaeche_1000qm=_L, kaufsumme_tsd_eur=_L, preis_pro_qm_eur=_D, anteil_baureif_pct=_D, durchschnittsfall_qm=_D),
    "fact_klima": _schema(stadt_name=_S, jahr=_I, avg_temperatur=_D, temperatur_abweichung_grad=_D),
    "fact_gemeinde_stamm": _schema(gemeinde_id=_S, einwohner_total=_L, einwohner_maennlich=_L, einwohner_weiblich=_L, anteil_weiblich_pct=_D, area_km2=_D, einwohner_pro_km2=_D),
    "fact_standortprofil_kpi": _schema(kreis_id=_S, jahr=_I, wohnraumdruck_index=_D, baulandpreis_pro_kopf_eur=_D, freiflaeche_pro_einwohner_qm=_D, klima_angepasstes_wohnraumrisiko=_D, verstaedterung_index=_D, standortattraktivitaets_score=_D),
}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, in a temporary one, if the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a table in shared storage, with their partitions' order of computation fixed."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialized_with_count(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """materialized() rows and their number, which is taken while they are written."""
    seen = Observation()
    return materialized(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def read_table(spark: SparkSession, where: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table of any source Spark reads. A JDBC read is split by partitionColumn, lowerBound, upperBound, numPartitions."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "jdbc" else reader.load(where)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a contract, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTRACTS[table]])


def _replace(df: DataFrame, path: str) -> int:
    """Writes the rows beside the folder at path and puts them in its place at the end; until then the old ones are read.

    df may read the folder itself. Between the two renames at the end there is no folder for a moment; where readers can't
    have that, use versions.load().
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    aside, old = f"{path}.loading-{mark}", f"{path}.replaced-{mark}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(aside)
    n = seen.get["n"]
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(as_path(path))
    if there and not fs.rename(as_path(path), as_path(old)):
        raise OSError(f"{path} can't be renamed")
    if not fs.rename(as_path(aside), as_path(path)):
        if there:
            fs.rename(as_path(old), as_path(path))
        raise OSError(f"{aside} can't be renamed")
    if there:
        fs.delete(as_path(old), True)
    return n


def full_load(df: DataFrame, path: str) -> int:
    """Replaces the table at path once all rows are written; non-finite numbers become NULL. Returns the row count."""
    from ..functions.values import sanitize

    return _replace(sanitize(df), path)


def stage(df: DataFrame, path: str) -> int:
    """A copy as it is, with its row count."""
    return _replace(df, path)


def stage_all(tables: dict[str, DataFrame], root: str) -> dict[str, tuple[DataFrame, int]]:
    """Copies of several tables under root, each with its source's columns and types, even without rows, and its count."""
    out = {}
    for name, df in tables.items():
        n = stage(df, path := f"{root}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path), n
    return out


def audit(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """check_name, n_bad, passed: by one aggregation, how many rows meet each condition that no row should meet."""
    one = df.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n_bad")) for k in checks]))
    return one.select(rows.alias("r")).select("r.*", (F.col("r.n_bad") == 0).alias("passed"))


def publish(staged: str, target: str, checks: dict[str, str], spark: SparkSession) -> dict[str, int]:
    """Loads a staged table into its target if its audit passes; else the target stays. Returns the failed checks' rows."""
    df = spark.read.parquet(staged)
    failed = {r["check_name"]: r["n_bad"] for r in audit(df, checks).filter("not passed").collect()}  # a row for each check
    if not failed:
        full_load(df, target)
    return failed


def truncate(spark: SparkSession, path: str, schema: T.StructType) -> None:
    _replace(spark.createDataFrame([], schema), path)


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates the nine tables where they are missing; running it again changes nothing."""
    for name, schema in CONTRACTS.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return list(CONTRACTS)


def list_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, column_type, position, n_rows, n_nulls for each column, by one aggregation of each table."""
    out = None
    for name, df in tables.items():
        stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("column_type"), F.lit(i).alias("position"), F.col(f"_{i}").alias("n_nulls")) for i, (c, k) in enumerate(df.dtypes)])
        own = stats.select(F.lit(name).alias("table_name"), F.col("n").alias("n_rows"), F.explode(rows).alias("c")).select("table_name", "c.column_name", "c.column_type", "c.position", "n_rows", "c.n_nulls")
        out = own if out is None else out.unionByName(own)
    return out


def sample_rows(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows in an order, each as text."""
    return df.orderBy(*order).limit(n).select(F.to_json(F.struct(*df.columns)).alias("row"))


def inspected(tables: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """profile() of the tables that can be read, and what was wrong with the others; one broken table stops no other."""
    good, bad = {}, {}
    for name, read in tables.items():
        try:
            df = read()
            df.limit(1).collect()
            good[name] = df
        except (AnalysisException, Py4JJavaError, SparkRuntimeException) as e:
            bad[name] = str(e).splitlines()[0]
    return (profile(good) if good else None), bad


def with_missing(target: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The target and the seed rows whose key it lacks; running it again adds nothing."""
    return target.unionByName(seed.join(target.select(key), key, "left_anti").select(*target.columns))


def latest_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in an order: of what a target has and what came later, the current state."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """The target, or the seed rows where it has none."""
    none = target.limit(1).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(1).alias("_e"))
    return target.unionByName(seed.crossJoin(F.broadcast(none)).drop("_e"))  # at most one row is broadcast


def newer_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows above the target's largest key; all where the target is empty."""
    mark = target.agg(F.max(key).alias("_mark"))
    return source.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(key) > F.col("_mark"))).drop("_mark")


def create_year_tables(spark: SparkSession, database: str = "default", by: str = "jahr") -> list[str]:
    """Creates the fact tables that have years where they are missing, in a folder for each year."""
    made = [name for name, schema in CONTRACTS.items() if name.startswith("fact_") and by in schema.names]
    for name in made:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(CONTRACTS[name], key=lambda f: f.name == by))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY ({by})")
    return made


def load_years(df: DataFrame, table: str, by: str = "jahr") -> int:
    """Replaces the years of a catalogue table that df has rows of; other years' files stay. Returns the row count.

    Columns are matched by name; non-finite numbers become NULL; without rows nothing is replaced. Rows are balanced over
    tasks by year, so that a small year is one file and a large one several. df may not read the table itself.
    """
    from ..functions.values import sanitize

    spark, mode = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    seen = Observation()
    x = sanitize(df.select(*spark.table(table).columns)).hint("rebalance", F.col(by)).observe(seen, F.count(F.lit(1)).alias("n"))
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # insertInto() takes it from the session alone
    try:
        x.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    return seen.get["n"]


def truncate_table(spark: SparkSession, table: str) -> None:
    """Empties a catalogue table, which keeps its columns."""
    spark.sql(f"TRUNCATE TABLE {table}")


def split_predicates(spark: SparkSession, options: dict[str, str], key: str, parts: int, bins: int = 200, rounds: int = 3) -> list[str]:
    """Conditions on a numeric key that cut a database table in about `parts` pieces of equal size, however its values lie.

    The database counts rows by bins of equal width; bins with more than a quarter of a piece are counted again in finer
    bins, up to `rounds` times, and neighbouring bins are put together until a piece is full. Each row, also one of null
    key, meets exactly one condition. Rows of a single key stay together. At most parts * 8 * bins counts reach the driver.
    """

    def asked(sql: str) -> list:
        given = {k: v for k, v in options.items() if k != "dbtable"}
        return spark.read.format("jdbc").options(**given, query=sql).load().collect()

    table = options["dbtable"]
    low, high, total = asked(f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n FROM {table}")[0]
    if not total or parts <= 1 or low == high:
        return ["1 = 1"]
    whole = isinstance(low, int)
    fine = total / parts / 4

    def counted(a, b, last: bool, rest: int) -> list[tuple]:
        """(lower bound, rows) of bins of [a, b), or [a, b] for the last one."""
        width = max(1, -(-(b - a + 1) // bins)) if whole else (float(b) - float(a)) / bins
        if width <= 0:
            return [(a, None)]
        place = f"({key} - ({a!r})) / {width!r}" if whole else f"CAST(FLOOR(({key} - ({a!r})) / {width!r}) AS BIGINT)"
        rows = asked(f"SELECT b, COUNT(*) AS n FROM (SELECT {place} AS b FROM {table} WHERE {key} >= {a!r} AND {key} {'<=' if last else '<'} {b!r}) q GROUP BY b")
        out = []
        for k, n in sorted((int(r[0]), int(r[1])) for r in rows):
            begin, end = a + k * width, a + (k + 1) * width
            if n > fine and rest and not (whole and width == 1):
                out += counted(begin, min(end, b), last and end > b, rest - 1)
            else:
                out.append((begin, n))
        return out

    if not whole:
        low, high = float(low), float(high)
    cuts, size, done = [], 0, 0
    for begin, n in counted(low, high, True, rounds):
        if size and size + n > (total - done) / max(1, parts - len(cuts)) + fine:
            cuts.append(begin)
            done, size = done + size, 0
        size += n
    bounds = [f"{key} < {cuts[0]!r} OR {key} IS NULL", *[f"{key} >= {a!r} AND {key} < {b!r}" for a, b in zip(cuts, cuts[1:])], f"{key} >= {cuts[-1]!r}"] if cuts else ["1 = 1"]
    return bounds


def read_split(spark: SparkSession, options: dict[str, str], key: str, parts: int) -> DataFrame:
    """A database table in about `parts` partitions of equal size, each read over its own connection."""
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=split_predicates(spark, options, key, parts), properties=rest)
