"""Builds of the star schema that resume: tables whose inputs are unchanged are not made again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from . import star

Step = tuple[list[str], Callable[..., DataFrame]]


def steps(states: dict[str, str] = star.STATES, years: tuple[int, int] | None = None, extra: tuple[int, int] = star.EXTRA_YEARS, base: tuple[int, int] = star.BASE, report: tuple[int, int] = star.REPORT) -> dict[str, Step]:
    """The nine tables: what each is made of, raw tables or tables, and how."""

    def kpi(bev: DataFrame, bau: DataFrame, klima: DataFrame, gemeinden: DataFrame, staedte: DataFrame, stamm: DataFrame) -> DataFrame:
        return star.fact_standortprofil_kpi(star.kpi_base(bev, bau, star.climate_by_kreis(gemeinden, staedte, klima), star.density_by_kreis(stamm, gemeinden)))

    return {
        "dim_kreis": (["population"], lambda p: star.dim_kreis(p, states)),
        "dim_jahr": (["land"], lambda x: star.dim_jahr(x, extra)),
        "dim_klimastadt": (["climate"], star.dim_klimastadt),
        "dim_gemeinde": (["municipality", "dim_kreis"], star.dim_gemeinde),
        "fact_bevoelkerung": (["population"], lambda p: star.fact_bevoelkerung(p, years)),
        "fact_bauland": (["land"], star.fact_bauland),
        "fact_klima": (["climate"], lambda c: star.fact_klima(c, base, report)),
        "fact_gemeinde_stamm": (["municipality", "dim_gemeinde"], star.fact_gemeinde_stamm),
        "fact_standortprofil_kpi": (["fact_bevoelkerung", "fact_bauland", "fact_klima", "dim_gemeinde", "dim_klimastadt", "fact_gemeinde_stamm"], kpi),
    }


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows, in any order and with repeated ones, and of the columns: by one aggregation."""
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])  # which hashes leave out
    digest = lambda seed: F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns], nulls)
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(digest(1).cast("decimal(38,0)")).cast("string"), F.bit_xor(digest(2))).first()
    return hashlib.sha256(json.dumps([df.dtypes, n, a, b]).encode()).hexdigest()


def build(raws: dict[str, DataFrame], root: str, plan: dict[str, Step] | None = None, settings: dict | None = None, at_once: int = 4) -> dict[str, str]:
    """Builds the tables of a plan under root as versioned tables, each as soon as what it needs is there. Returns `built` or `kept` for each.

    A table's manifest keeps the fingerprint of its inputs and settings. Where that is unchanged the table is kept, so that
    a build that was stopped resumes at the first table that isn't finished, and a change of one raw table makes only what
    depends on it again. Up to `at_once` tables that don't need each other are built side by side. The first error is
    raised once the tables that are under way are done; finished ones stay. settings: parameters of steps(), by name.
    """
    spark = next(iter(raws.values())).sparkSession
    plan = steps(**(settings or {})) if plan is None else plan
    known: dict[str, str] = {}
    state: dict[str, str] = {}
    asked = sorted({x for inputs, _ in plan.values() for x in inputs} - set(plan))

    def make(name: str, inputs: list[str], of: Callable[..., DataFrame], mark: str) -> str:
        old = versions.manifest(spark, f"{root}/{name}")
        if old and old.get("note", {}).get("fingerprint") == mark:
            return "kept"
        versions.load(of(*[raws[x] if x in raws else versions.current(spark, f"{root}/{x}") for x in inputs]), f"{root}/{name}", note={"fingerprint": mark})
        return "built"

    with ThreadPoolExecutor(at_once) as pool:
        known |= dict(zip(asked, pool.map(lambda x: fingerprint(raws[x]), asked), strict=True))
        running: dict[Future, str] = {}
        waiting, failed = dict(plan), None
        while waiting or running:
            for name, (inputs, of) in list(waiting.items()) if failed is None else ():
                if all(x in known for x in inputs):
                    own = sorted((settings or {}).items())
                    mark = hashlib.sha256(json.dumps([name, [known[x] for x in inputs], repr(own)]).encode()).hexdigest()
                    running[pool.submit(make, name, inputs, of, mark)] = name
                    known[f"?{name}"] = mark
                    del waiting[name]
            if not running:
                break
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in done:
                name = running.pop(f)
                if f.exception():
                    failed = failed or f.exception()
                else:
                    state[name] = f.result()
                    known[name] = known[f"?{name}"]  # its rows follow from its inputs
    if failed is not None:
        raise failed
    if waiting:
        raise ValueError(f"nothing gives what {sorted(waiting)} need")
    return state


def tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: versions.current(spark, f"{root}/{n}") for n in names or list(steps())}
