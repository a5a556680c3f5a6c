"""Damaged rows and names: letters that were lost are found in intact names, fields that were shifted are put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What damage leaves in the place of a letter, the second one being U+FFFD.
MARKS = "?�"
_MARKS = f"[{MARKS}]"


def repaired_names(df: DataFrame, name: str, intact: DataFrame, intact_name: str, into: str = "repair") -> DataFrame:
    """Adds a struct `into` (name, status, candidates): names whose marks stand for letters, looked up among intact names.

    Blanks and quotes at the ends go first. status: `intact` without a mark, or if the name is itself among the intact ones;
    `repaired` if exactly one intact name (case kept) fits with one character for each mark, or else exactly one with
    each mark for up to two characters or none; `ambiguous` if several fit, `unknown` if none does: then the name stays as
    it is, and is reported, not changed. A null or empty name is null and `intact`. candidates counts the names that fit.

    Different damaged names are compared with the different intact ones by the letters around the marks: the text before
    the first mark and after the last one are cut to a key of equal length on both sides, so the join is by equal keys; a
    name that begins and ends with a mark meets those of its length or of up to two characters more or fewer for each mark.
    """
    clean = F.nullif(F.trim(F.replace(F.col(name), F.lit('"'), F.lit(""))), F.lit(""))
    x = df.withColumn("_clean", clean)
    names = intact.select(F.trim(F.col(intact_name)).alias("_full")).filter(f"_full <> '' and not _full rlike '{_MARKS}'").distinct()
    damaged = x.select("_clean").filter(F.col("_clean").rlike(_MARKS)).distinct()
    parts = F.split("_clean", _MARKS)
    marks = F.size(parts) - 1
    # KEY characters of the beginning or of the end, whichever has more before or after its mark; none if both are short
    head, tail = F.length(F.element_at(parts, 1)), F.length(F.element_at(parts, -1))
    side = F.when(head >= tail, F.lit("h")).otherwise(F.lit("t"))
    size = F.least(F.greatest(head, tail), F.lit(KEY))
    key = lambda c, side, k: F.when(side == "h", F.substring(c, F.lit(1), k)).otherwise(F.right(c, k))
    quoted = lambda one: F.concat(F.lit("^"), F.array_join(F.transform(F.col("_parts"), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), one), F.lit("$"))
    asked = damaged.select("_clean", parts.alias("_parts"), marks.alias("_marks"), side.alias("_side"), size.alias("_size"))
    asked = asked.withColumn("_key", key(F.col("_clean"), F.col("_side"), F.col("_size"))).withColumns({"_exact": quoted("."), "_loose": quoted(".{0,2}")})
    sides = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(KEY)), lambda k: F.array(F.struct(F.lit("h").alias("s"), k.alias("k")), F.struct(F.lit("t").alias("s"), k.alias("k"))))))
    keyed = names.select("_full", sides.alias("_at")).filter(F.length("_full") >= F.col("_at.k"))
    keyed = keyed.select("_full", F.col("_at.s").alias("_side"), F.col("_at.k").alias("_size"), key(F.col("_full"), F.col("_at.s"), F.col("_at.k")).alias("_key"))
    near = F.abs(F.length("_full") - F.length("_clean")) <= 2 * F.col("_marks")
    met = asked.join(keyed, ["_side", "_size", "_key"]).filter(near)
    met = met.select("_clean", "_full", F.expr("_full rlike _exact").alias("_e"), F.expr("_full rlike _loose").alias("_l")).filter("_l")
    found = met.groupBy("_clean").agg(F.count_if("_e").alias("e"), F.count(F.lit(1)).alias("l"), F.min(F.when(F.col("_e"), F.col("_full"))).alias("ef"), F.min("_full").alias("lf"))
    whole = intact.select(F.trim(F.col(intact_name)).alias("_same")).filter(f"_same rlike '{_MARKS}'").distinct()
    x = x.join(found.withColumnRenamed("_clean", "_c"), F.col("_clean") == F.col("_c"), "left").join(whole, F.col("_clean") == F.col("_same"), "left")
    fits = F.when(F.col("e") > 0, F.col("e")).otherwise(F.coalesce("l", F.lit(0)))
    status = F.when(F.col("_clean").isNull() | ~F.col("_clean").rlike(_MARKS) | F.col("_same").isNotNull(), "intact").when(fits == 1, "repaired").when(fits > 1, "ambiguous").otherwise("unknown")
    fixed = F.when(status == "repaired", F.when(F.col("e") > 0, F.col("ef")).otherwise(F.col("lf"))).otherwise(F.col("_clean"))
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(fixed.alias("name"), status.alias("status"), F.when(status == "intact", F.lit(0)).otherwise(fits).cast("long").alias("candidates")).alias(into))


#: Characters of a name's beginning or end by which it is looked up.
KEY = 4


#: Separators within fields of a row, at most, that are looked for.
SHIFTS = 2


def realigned(df: DataFrame, columns: dict[str, str], sep: str = ",", into: str = "alignment") -> tuple[DataFrame, DataFrame]:
    """Rows whose fields suit their columns or could be put back, and a table of the others with the reason.

    columns: name and pattern of each text column in the order of the source. A separator within a field cuts it in two, so
    that all fields behind it lie one column too far right and the last one is lost. By dynamic programming over columns and
    the number of cuts so far, each column takes one field, or several joined by `sep` again; as many columns at the end
    as there were cuts have lost theirs and become null. A value suits if it matches the column's pattern or is missing
    (null or blank); missing fields aren't joined. `into` is `intact` where all values suit as they are, and `repaired` where
    exactly one alignment with the fewest cuts, up to SHIFTS, suits. All other rows are quarantined as they are, with
    `reason`: `ambiguous` or `unsuitable: <columns>`. intact + repaired + quarantined are all rows, repeated ones too; other
    columns stay. Returned: (rows with `into`, quarantined rows with `reason`). Rows are never shuffled.
    """
    names, n = list(columns), len(columns)
    field = [F.col(f"`{c}`") for c in names]
    missing = lambda v: F.coalesce(F.trim(v), F.lit("")) == ""
    suits = lambda v, c: missing(v) | F.coalesce(F.trim(v).rlike(f"^(?:{columns[c]})$"), F.lit(False))
    wide = SHIFTS + 1

    def ok(c: int, before: int, taken: int) -> Column:
        """Whether column c may take so many fields after so many cuts."""
        k = c + before
        if before + taken > wide or k + taken > n:
            return F.lit(False)
        if taken == 1:
            return suits(field[k], names[c])
        out = suits(F.concat_ws(sep, *field[k : k + taken]), names[c])
        for f in field[k : k + taken]:
            out = out & ~missing(f)
        return out

    table = F.array(*[ok(c, before, taken) for c in range(n) for before in range(wide) for taken in range(1, wide + 1)])
    state = lambda ways, path: F.struct(ways.cast("int").alias("ways"), path.cast("string").alias("path"))

    def step(table: Column, x: Column, c: Column) -> Column:
        """For each number of cuts the alignments of the columns up to c, and the fields that each column takes in one of them."""
        out = []
        for s in range(wide):
            ways, path = F.lit(0), F.lit(None).cast("string")
            for taken in range(1, s + 2):
                before = s - taken + 1
                on = F.get(table, (c * wide + before) * wide + (taken - 1)) & (x[before]["ways"] > 0)
                ways = ways + F.when(on, x[before]["ways"]).otherwise(0)
                path = F.coalesce(path, F.when(on, F.concat(x[before]["path"], F.lit(str(taken)))))
            out.append(state(ways, F.coalesce(path, F.lit(""))))
        return F.array(*out)

    def found(table: Column) -> Column:
        begin = F.array(*[state(F.lit(int(s == 0)), F.lit("")) for s in range(wide)])
        ends = []
        for cuts in range(min(SHIFTS, n - 1) + 1):  # so many columns at the end have lost their field
            end = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1 - cuts)), begin, lambda x, c: step(table, x, c))[cuts]
            ends.append(F.struct(F.lit(cuts).alias("cuts"), end["ways"].alias("ways"), end["path"].alias("path")))
        return F.get(F.filter(F.array(*ends), lambda e: e["ways"] > 0), F.lit(0))

    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  # computed once for a row
    x = df.withColumns({"_fields": F.array(*field), "_best": let(table, found)})
    taken = lambda i: F.substring("_best.path", i, F.lit(1)).cast("int")
    place = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(1), lambda s, k: s + taken(k)) - taken(i)
    cells = F.transform(F.sequence(F.lit(1), F.length("_best.path")), lambda i: F.when(taken(i) == 1, F.get("_fields", place(i) - 1)).otherwise(F.array_join(F.slice("_fields", place(i), taken(i)), sep)))
    fine = F.coalesce(F.col("_best.ways") == 1, F.lit(False))
    good = x.filter(fine).withColumn("_cells", cells)
    at = {c: F.get("_cells", F.lit(i)) for i, c in enumerate(names)}
    good = good.select(*[at[c].alias(c) if c in at else F.col(f"`{c}`") for c in df.columns], F.when(F.col("_best.cuts") == 0, "intact").otherwise("repaired").alias(into))
    bad = F.concat_ws(", ", *[F.when(~suits(f, c), F.lit(c)) for f, c in zip(field, names, strict=True)])
    reason = F.when(F.col("_best.ways") > 1, F.lit("ambiguous")).otherwise(F.concat(F.lit("unsuitable: "), bad))
    return good, x.filter(~fine).select(*[F.col(f"`{c}`") for c in df.columns], reason.alias("reason"))
