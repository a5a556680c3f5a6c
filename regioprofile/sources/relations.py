"""Audits across rows and tables: the grain of a table, its foreign keys, and what a join multiplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a row of each table stands for, and which columns name a row of another one.
GRAINS = {
    "dim_kreis": ["kreis_id"], "dim_jahr": ["jahr"], "dim_gemeinde": ["gemeinde_id"], "dim_klimastadt": ["stadt_name", "latitude", "longitude"],
    "fact_bevoelkerung": ["kreis_id", "jahr"], "fact_bauland": ["kreis_id", "jahr"], "fact_klima": ["stadt_name", "jahr"], "fact_gemeinde_stamm": ["gemeinde_id"], "fact_standortprofil_kpi": ["kreis_id", "jahr"],
}
FOREIGN = {
    "dim_gemeinde": [("kreis_id", "dim_kreis", "kreis_id")],
    "fact_bevoelkerung": [("kreis_id", "dim_kreis", "kreis_id"), ("jahr", "dim_jahr", "jahr")],
    "fact_bauland": [("kreis_id", "dim_kreis", "kreis_id"), ("jahr", "dim_jahr", "jahr")],
    "fact_klima": [("stadt_name", "dim_klimastadt", "stadt_name"), ("jahr", "dim_jahr", "jahr")],
    "fact_gemeinde_stamm": [("gemeinde_id", "dim_gemeinde", "gemeinde_id")],
    "fact_standortprofil_kpi": [("kreis_id", "dim_kreis", "kreis_id"), ("jahr", "dim_jahr", "jahr")],
}


def _stacked(one: DataFrame, checks: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("n_bad")) for i, c in enumerate(checks)]))
    return one.select(rows.alias("r")).select("r.*", (F.col("r.n_bad") == 0).alias("passed"))


def relational_audit(tables: dict[str, DataFrame], grains: dict[str, list[str]] = GRAINS, foreign: dict[str, list[tuple[str, str, str]]] = FOREIGN) -> DataFrame:
    """check_name, n_bad, passed: for each table rows that repeat its grain, rows with a null in it, and foreign keys without a row.

    `<table>.grain` counts the rows beyond the first of each grain, nulls being equal; `<table>.key_missing` rows with a null
    in it; `<table>.<column>` rows whose value isn't null and names no row. Each table is read once: parents' different
    keys are joined to it, and one aggregation by the grain gives all of its counts. Tables without a grain, and foreign
    keys into tables that aren't given, are left out; a table without rows passes.
    """
    out = None
    for name, df in tables.items():
        if name not in grains:
            continue
        key, x, lost = grains[name], df, []
        checks = [f"{name}.grain", f"{name}.key_missing"]
        for i, (column, parent, parent_key) in enumerate(foreign.get(name, [])):
            if parent in tables:
                there = tables[parent].select(F.col(parent_key).alias(f"_p{i}")).filter(f"_p{i} is not null").distinct()
                x = x.join(there, F.col(column) == F.col(f"_p{i}"), "left")
                lost.append(F.count_if(F.col(column).isNotNull() & F.col(f"_p{i}").isNull()))
                checks.append(f"{name}.{column}")
        null: Column = F.lit(False)
        for k in key:
            null = null | F.col(k).isNull()
        by = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(null).alias("c1"), *[c.alias(f"c{i + 2}") for i, c in enumerate(lost)])
        own = _stacked(by.agg(F.sum(F.col("n") - 1).alias("c0"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(1, len(checks))]), checks)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no table has a grain")
    return out


def fan_out(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """n_left, n_matched, n_joined, largest: rows of left, those with a partner, rows of the join, and most rows from one.

    Rows are counted by key on both sides before the counts are joined, so that nothing is multiplied. Null matches nothing.
    """
    a = left.groupBy(*[F.col(x).alias(f"_k{i}") for i, (x, _) in enumerate(on)]).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(*[F.col(y).alias(f"_k{i}") for i, (_, y) in enumerate(on)]).agg(F.count(F.lit(1)).alias("r"))
    x = a.join(b, [f"_k{i}" for i in range(len(on))], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return x.agg(zero(F.sum("l")).alias("n_left"), zero(F.sum(F.when(F.col("r").isNotNull(), F.col("l")))).alias("n_matched"), zero(F.sum(F.col("l") * F.col("r"))).alias("n_joined"), zero(F.max("r")).alias("largest"))
