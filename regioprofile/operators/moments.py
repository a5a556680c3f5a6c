"""Means and deviations by group that are kept up by increments instead of being made again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import safe_div
from ..sources import versions


def moments(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, then for each column <c>_n, <c>_mean and <c>_m2: number, mean and sum of squared deviations of its values in a group.

    Null and non-finite values don't count; a group without values has n 0, a null mean and m2 0; null is a group.
    """
    aggregates = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        aggregates += [F.count(x).alias(f"{c}_n"), F.avg(x).alias(f"{c}_mean"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias(f"{c}_m2")]
    return df.groupBy(*[F.col(f"`{k}`") for k in by]).agg(*aggregates)


def merged(parts: list[DataFrame], by: list[str], columns: list[str]) -> DataFrame:
    """The moments of the rows of all parts together, from the parts' moments.

    Deviations are taken between the parts' means and the mean of all, not between squares of sums, so that means far from
    zero cost no digits.
    """
    x = reduce(DataFrame.unionByName, parts)
    group = Window.partitionBy(*[F.col(f"`{k}`") for k in by])  # a row for each part and group
    for c in columns:
        n, mean = F.col(f"`{c}_n`"), F.col(f"`{c}_mean`")
        # from the first part's mean on, which is near: the weighted mean of differences
        near = F.min(mean).over(group)
        x = x.withColumn(f"_{c}", near + safe_div(F.sum(n * (mean - near)).over(group), F.sum(n).over(group)))
    aggregates = []
    for c in columns:
        n, mean, m2, whole = (F.col(f"`{k}`") for k in (f"{c}_n", f"{c}_mean", f"{c}_m2", f"_{c}"))
        aggregates += [F.sum(n).alias(f"{c}_n"), F.max(whole).alias(f"{c}_mean"), F.sum(m2 + F.coalesce(n * F.pow(mean - whole, F.lit(2)), F.lit(0.0))).alias(f"{c}_m2")]
    return x.groupBy(*[F.col(f"`{k}`") for k in by]).agg(*aggregates)


def scored(df: DataFrame, known: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Adds <c>_z: (value - mean) / sample deviation of its group; null where the deviation is 0 or unknown."""
    own = known.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(by)], *[F.col(f"`{c}_{m}`").alias(f"_{c}_{m}") for c in columns for m in ("n", "mean", "m2")])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)])
    z = {f"{c}_z": safe_div(F.col(f"`{c}`") - F.col(f"_{c}_mean"), F.sqrt(safe_div(F.col(f"_{c}_m2"), F.col(f"_{c}_n") - 1))) for c in columns}
    return df.join(own, same, "left").withColumns(z).select(*[F.col(f"`{c}`") for c in df.columns], *z)


def keep_scores(new: DataFrame, rows_root: str, moments_root: str, by: list[str], columns: list[str]) -> DataFrame:
    """Takes new rows into the stored ones, merges their moments into the stored ones, and returns the touched groups' rows with scores.

    Rows and moments are versioned tables; only the moments of groups with new rows are written again, and only rows of
    these groups get other scores. Both tables hold the same rows after each call; the first call makes them.
    """
    spark = new.sparkSession
    grown = moments(new, by, columns)
    before = versions.manifest(spark, moments_root)
    touched = grown.select(*by)
    if before:
        stored = versions.current(spark, moments_root).drop("_at")
        same = reduce(lambda a, b: a & b, [stored[k].eqNullSafe(touched[k]) for k in by])
        grown = merged([grown, stored.join(touched, same, "left_semi")], by, columns)
    versions.append(new, rows_root)
    versions.merge(grown.withColumn("_at", F.lit(before["version"] + 1 if before else 1)), moments_root, by, ["_at"])
    known = versions.current(spark, moments_root).drop("_at")
    rows = versions.current(spark, rows_root)
    some = materialized_keys(new, by)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(some[f"_t{i}"]) for i, k in enumerate(by)])
    return scored(rows.join(some, same, "left_semi"), known, by, columns)


def materialized_keys(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(f"_t{i}") for i, k in enumerate(by)]).distinct()
