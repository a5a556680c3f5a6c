"""Matching by contained names and by distance, and dense surrogate keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized, materialized_with_count


#: Rows of the right side up to which names or points are sent whole to all tasks; beyond, keys lead to candidates.
FEW = 5_000
#: Parts that the names are dealt over where an empty text is looked for.
SALTS = 64
#: Points of a cell, about; beyond MOST_CELLS cells they get more, as all tasks hold the cells' boxes.
CELL_POINTS, MOST_CELLS = 64, 16_384


def _grams(c: Column, n: int) -> Column:
    """The different runs of n characters of a text in lower case; none if it is shorter."""
    every = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(F.lower(c), i, F.lit(n)))
    return F.when(F.length(F.lower(c)) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _containing(left: DataFrame, right: DataFrame, part: str, name: str) -> DataFrame:
    """_part with the columns of right: each distinct part of left with the rows whose name contains it, in any case.

    Beyond FEW names, parts meet names by what both must have: a part of one or two characters by itself, a longer one by
    the rarest pair of its runs of three characters (or by the only one). A name of n such runs has n * (n - 1) / 2 pairs,
    so only pairs that some part asks for are made, by joining the part's rarest run to names first and its second
    rarest as a filter on what that finds. An empty part is in every name that isn't null. All joins are by equal keys,
    which AQE splits where a run is in many names.
    """
    parts = left.select(F.col(part).alias("_part")).filter("_part is not null").distinct()
    holds = F.lower(F.col(name)).contains(F.lower(F.col("_part")))
    right, n = materialized_with_count(right)  # made once for its size and its rows
    if n <= FEW:
        return parts.join(F.broadcast(right), holds)
    names = right.filter(F.col(name).isNotNull())
    grams = names.select(*right.columns, F.explode(F.concat(*[_grams(F.col(name), k) for k in (1, 2, 3)])).alias("_gram"))
    often = materialized(grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")), "grams")
    small = F.lower("_part")
    wanted = parts.filter("_part <> ''").select("_part", F.explode(F.when(F.length(small) < 3, F.array(small)).otherwise(_grams(F.col("_part"), 3))).alias("_gram"))
    ranked = wanted.join(often, "_gram").groupBy("_part").agg(F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_list(F.struct("_n", "_gram"))).alias("g"))
    # a run that is in no name has no count: then the part is in none
    asked = wanted.groupBy("_part").agg(F.count(F.lit(1)).alias("all"))
    keys = ranked.join(asked, "_part").filter("m = all").select("_part", F.col("g")[0]["_gram"].alias("_gram"), F.get("g", F.lit(1))["_gram"].alias("_second"))
    second = F.col("_second").isNull() | F.lower(F.col(name)).contains(F.col("_second"))
    found = keys.join(grams, "_gram").filter(second & holds).select("_part", *right.columns)
    # of equal keys, a constant: the rows of all names, dealt over salts, for the only part that is empty
    empty = parts.filter("_part = ''").select("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    every = names.withColumn("_salt", F.pmod(F.xxhash64(F.col(name)), F.lit(SALTS)).cast("int")).join(F.broadcast(empty), "_salt")  # at most SALTS rows
    return found.unionByName(every.select("_part", *right.columns))


def contains_join(left: DataFrame, right: DataFrame, part: str, name: str) -> DataFrame:
    """Left outer join where right's name contains left's part, in any case. Only distinct parts are compared."""
    return left.join(_containing(left, right, part, name), F.col(part) == F.col("_part"), "left").drop("_part")


def best_containing(left: DataFrame, right: DataFrame, part: str, name: str, key: str, by: list[str]) -> DataFrame:
    """The row of each group `by` with the longest containing name (ties: smallest key), and every unmatched row.

    Each distinct part's best name decides first; the best of a group is the best among its rows' bests.
    """
    hits = _containing(left, right, part, name)
    best = hits.groupBy("_part").agg(F.min_by(F.struct(*right.columns), F.struct(-F.length(name), F.col(key))).alias("_hit"))
    found = left.join(best, F.col(part) == F.col("_part"), "left").select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in right.columns])
    rest = [F.asc_nulls_first(c) for c in left.columns if c not in by]
    order = Window.partitionBy(*by).orderBy(F.length(name).desc_nulls_last(), F.asc_nulls_last(key), *rest)
    return found.withColumn("_rn", F.row_number().over(order)).filter((F.col("_rn") == 1) | F.col(key).isNull()).drop("_rn")


def _distance(lat: str, lon: str, p: Column) -> Column:
    """Squared distance to a point, then its name, in the order of nearness."""
    return F.struct((F.pow(F.col(lat) - p["a"], F.lit(2)) + F.pow(F.col(lon) - p["o"], F.lit(2))).alias("d"), p["n"].alias("n"))


def nearest(left: DataFrame, right: DataFrame, name: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Adds the name of right's nearest point by squared distance (ties: first name).

    Up to FEW points are one row, whose place in the plan is a broadcast, so that left is neither shuffled nor multiplied;
    more are searched by cells. Rows and points without coordinates: a row's name is null, a point is left out.
    """
    points = right.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(lat).alias("a"), F.col(lon).alias("o"), F.col(name).alias("n"))
    points, n = materialized_with_count(points.groupBy("a", "o").agg(F.min("n").alias("n")))
    if n > FEW:
        return nearest_by_cells(left, points, n, name, lat, lon)
    whole = points.agg(F.collect_list(F.struct("a", "o", "n")).alias("_points"))
    found = left.crossJoin(F.broadcast(whole)).withColumn(name, F.array_min(F.transform("_points", lambda p: _distance(lat, lon, p)))["n"])
    return found.withColumn(name, F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.col(name))).drop("_points")


def _cells(points: DataFrame, n: int) -> DataFrame:
    """cell, slab, points: points (a, o, n) in cells of about as many points, however they lie.

    Quantiles of the first coordinate cut slabs, and in each slab quantiles of the second one cut as many cells as its
    number of points calls for. So dense places get small cells and empty ones large, and one far point changes no cut
    but its own. Points are of different places, hence a slab whose first coordinates are all equal is cut too.
    """
    k = max(1, min(MOST_CELLS, n // CELL_POINTS))
    slabs = max(1, math.isqrt(k))
    cuts = points.agg(F.array_distinct(F.percentile_approx("a", [i / slabs for i in range(1, slabs)] or [1.0], 100 * slabs)).alias("_cuts"))
    placed = points.crossJoin(F.broadcast(cuts)).select("a", "o", "n", F.size(F.filter("_cuts", lambda c: c < F.col("a"))).alias("slab"))  # a single row
    fine = max(1, min(1024, 4 * slabs))
    own = placed.groupBy("slab").agg(F.percentile_approx("o", [i / fine for i in range(1, fine)] or [1.0], 100 * fine).alias("q"), F.count(F.lit(1)).alias("m"))
    # every so many of the fine quantiles, so that a slab has as many cells as it has points for
    step = F.greatest(F.lit(1), F.floor(F.lit(fine) / F.greatest(F.lit(1), F.floor(F.col("m") / F.lit(max(1, n // k)))))).cast("int")
    own = own.select(F.col("slab").alias("_s"), F.array_distinct(F.filter("q", lambda c, i: (i + 1) % step == 0)).alias("_cuts"))
    x = placed.join(own, F.col("slab") == F.col("_s")).withColumn("cell", F.size(F.filter("_cuts", lambda c: c < F.col("o"))))
    return x.groupBy("slab", "cell").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("o").alias("o0"), F.max("o").alias("o1"), F.collect_list(F.struct("a", "o", "n")).alias("points"))


def nearest_by_cells(left: DataFrame, points: DataFrame, n: int, name: str, lat: str, lon: str) -> DataFrame:
    """nearest() to n points (a, o, n) of different places, of any number and however they lie.

    A place asks the cell whose box is nearest, then all cells whose boxes are no farther than the nearest point there, so
    two rounds suffice and the result is exact. Different places are asked for once each, whatever rows they have.
    """
    cells = materialized(_cells(points, n), "cells")
    boxes = cells.groupBy("slab").agg(F.min("a0").alias("low"), F.max("a1").alias("high"), F.collect_list(F.struct("cell", "a0", "a1", "o0", "o1")).alias("cells"))
    boxes = boxes.agg(F.collect_list(F.struct("slab", "low", "high", "cells")).alias("_slabs"))  # a single row of about MOST_CELLS boxes
    asked = left.select(F.col(lat).alias("_a"), F.col(lon).alias("_o")).filter("_a is not null and _o is not null").distinct()
    gap = lambda x, low, high: F.greatest(low - x, x - high, F.lit(0.0))
    square = lambda d: F.pow(d, F.lit(2))
    a, o = F.col("_a"), F.col("_o")
    to_slab = lambda s: square(gap(a, s["low"], s["high"]))
    to_cell = lambda c: square(gap(a, c["a0"], c["a1"])) + square(gap(o, c["o0"], c["o1"]))
    boxed = asked.crossJoin(F.broadcast(boxes))
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  # computed once for a row
    in_slab = lambda s: F.array_min(F.transform(s["cells"], lambda c: F.struct(to_cell(c).alias("d"), s["slab"].alias("slab"), c["cell"].alias("cell"))))
    # the nearest box: of the slab that is nearest by the first coordinate, or of one no farther than that box
    slab = F.array_min(F.transform("_slabs", lambda s: F.struct(to_slab(s).alias("d"), s["slab"].alias("slab"), s["cells"].alias("cells"))))
    near = let(let(slab, in_slab), lambda h: F.array_min(F.transform(F.filter("_slabs", lambda s: to_slab(s) <= h["d"]), in_slab)))
    first = boxed.withColumn("_h", near).select("_a", "_o", "_h.slab", "_h.cell")
    held = cells.select("slab", "cell", "points")
    best = F.array_min(F.transform("points", lambda p: _distance("_a", "_o", p)))
    first = materialized(first.join(held, ["slab", "cell"]).select("_a", "_o", "slab", "cell", best.alias("_b")), "first-cells")
    # boxes are compared with a hair to spare, as their distances are rounded in other places than the points'
    within = F.col("_b.d") * (1 + 1e-9)
    others = F.flatten(
        F.transform(
            F.filter("_slabs", lambda s: to_slab(s) <= within),
            lambda s: F.transform(F.filter(s["cells"], lambda c: (to_cell(c) <= within) & ~((s["slab"] == F.col("slab")) & (c["cell"] == F.col("cell")))), lambda c: F.struct(s["slab"].alias("slab"), c["cell"].alias("cell"))),
        )
    )
    more = first.crossJoin(F.broadcast(boxes)).select("_a", "_o", F.explode(others).alias("_c")).select("_a", "_o", "_c.slab", "_c.cell")
    more = more.join(held, ["slab", "cell"]).select("_a", "_o", best.alias("_b"))
    found = first.select("_a", "_o", "_b").unionByName(more).groupBy("_a", "_o").agg(F.min("_b")["n"].alias(name))
    return left.join(found, (F.col(lat) == F.col("_a")) & (F.col(lon) == F.col("_o")), "left").drop("_a", "_o")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Dense numbers from 1 in the order of columns, without bringing the rows into one task.

    Rows are range-partitioned and sorted; a partition's numbers start after the rows of those before it.
    """
    by = [F.asc_nulls_first(c) for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written before, since the ranges are cut by a sample that would make the rows twice, and after, since a range
    # partitioning that is computed again may cut elsewhere
    placed = materialized(materialized(df).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    x = placed.join(before, F.col("_part") == F.col("_p"))
    return x.select(*df.columns, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).alias(into))
