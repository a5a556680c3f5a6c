"""Wide to long, long to wide, filters on key levels, growth, anomalies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import safe_div


def at_level(df: DataFrame, key: str, length: int) -> DataFrame:
    """Rows whose hierarchical key has a level's length."""
    return df.filter(F.length(key) == length)


def unpivot_years(df: DataFrame, keep: list[str], measures: list[str], suffixes: dict[str, int], needed: str) -> DataFrame:
    """One row for each year from columns <measure>_<suffix>; rows without the `needed` measure go."""
    years = [F.struct(F.lit(y).alias("jahr"), *[F.col(f"{m}_{s}").alias(m) for m in measures]) for s, y in suffixes.items()]
    return df.select(*keep, F.explode(F.array(*years)).alias("y")).select(*keep, "y.*").filter(F.col(needed).isNotNull())


def pivoted(df: DataFrame, by: list[str], label: str, value: str, names: list[str], more: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A column for each label, by conditional maxima in one aggregation; more: column -> (label, other value)."""
    wanted = {n: (n, value) for n in names} | (more or {})
    return df.groupBy(*by).agg(*[F.max(F.when(F.col(label) == lab, F.col(v))).alias(c) for c, (lab, v) in wanted.items()])


def growth(df: DataFrame, key: str, order: str, value: str, into: str) -> DataFrame:
    """Percent over the key's previous existing row."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_before", before).withColumn(into, safe_div(100.0 * (F.col(value) - F.col("_before")), "_before")).drop("_before")


def anomaly(df: DataFrame, key: str, year: str, value: str, base: tuple[int, int], report: tuple[int, int]) -> DataFrame:
    """key, year, mean, anomaly: yearly means and their distance from the mean of the base years; keys without base go.

    One aggregation: the rows' sums and counts by key and year give both means.
    """
    yearly = df.groupBy(key, year).agg(F.avg(value).alias("mean"), F.sum(value).alias("s"), F.count(value).alias("n"))
    within = F.col(year).between(*base)
    baseline = yearly.filter(within).groupBy(key).agg((F.sum("s") / F.sum("n")).alias("_base"))
    joined = yearly.filter(F.col(year).between(*report)).join(baseline, key)
    return joined.select(key, year, "mean", (F.col("mean") - F.col("_base")).alias("anomaly"))


def with_group_stats(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Adds <c>_avg and <c>_std of each group: one aggregation joined back, so that a large group isn't one task's."""
    stats = df.groupBy(F.col(by).alias("_by")).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "avg"), (F.stddev, "std"))])
    return df.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def z(column: str) -> Column:
    """z-score after with_group_stats(); NULL where the spread is 0 or unknown."""
    return safe_div(F.col(column) - F.col(f"{column}_avg"), f"{column}_std")


def top1(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def extremes(df: DataFrame, key: list[str], columns: list[str], fence: float = 3.0) -> DataFrame:
    """key, kpi, value, side: values of the columns more than `fence` quartile distances below or above their quartiles.

    Nulls are never extreme; a column without spread has no extremes but what differs from its quartiles. The quartiles are
    values of the rows, by one aggregation of sketches, exact up to a million rows; a single row of them goes to all tasks.
    """
    bounds = df.agg(*[F.percentile_approx(c, [0.25, 0.75], 1_000_000).alias(f"_q{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(c).cast("double").alias("value"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)]))
    x = df.crossJoin(F.broadcast(bounds)).select(*key, rows.alias("r")).select(*key, "r.*").filter("value is not null")
    low, high = F.col("q")[0], F.col("q")[1]
    side = F.when(F.col("value") > high + fence * (high - low), "high").when(F.col("value") < low - fence * (high - low), "low")
    return x.withColumn("side", side).filter("side is not null").drop("q")
