"""Quality rules whose cutoffs come from quantile sketches of each language and source.

Native: the main path has DataFrame functions only. Every measure is computed inside its row with array functions, so
texts are never shuffled; only (language, source) sketches are. A sketch counts rows by steps of a fixed grid, so that
two runs give the same cutoffs at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed value: characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Base rule limits.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Shares are sketched in steps of 1 / STEPS, mean word lengths in steps of 1 / WORD_STEPS; of larger numbers this many
#: leading bits are kept.
STEPS, WORD_STEPS, WORD_BITS, COUNT_BITS = 10_000, 1000, 14, 8
#: To a group's sketch its language's is added with the weight of so many rows, and to that the one of all rows in the same way.
PRIOR_ROWS = 20
#: Measure: (lower and upper quantile q and r around the bulk, allowed factor of their distance, units, what they are a part of).
#: Upper cutoff = r + factor * (r - q) + units / median of the third; a measure that has a lower cutoff mirrors it below q.
#: So the slack follows the group's own resolution: `units` symbols, lines or words in its median text. Most texts repeat
#: nothing, so that the quartiles of the two shares of repetition are 0: their groups' upper quantiles decide. A
#: document's reason is the first of these measures beyond its cutoff.
CUTOFFS = {
    "symbol_share": (0.50, 0.75, 4.0, 4.0, "word_chars"),
    "upper_share": (0.25, 0.75, 4.0, 2.0, "word_chars"),
    "dup_line_share": (0.50, 0.99, 0.5, 0.5, "n_lines"),
    "repeat_share": (0.50, 0.99, 0.5, 3.0, "n_words"),
    "mean_word": (0.25, 0.75, 4.0, 0.0, "n_words"),
}
LOWER = ("mean_word",)
#: What each measure is: counted parts, of what, steps, leading bits (0: all).
SHARES = {
    "mean_word": ("word_chars", "n_words", WORD_STEPS, WORD_BITS), "symbol_share": ("n_symbols", "word_chars", STEPS, 0), "upper_share": ("n_upper", "word_chars", STEPS, 0),
    "dup_line_share": ("n_dup_lines", "n_lines", STEPS, 0), "repeat_share": ("n_repeat_words", "n_words", STEPS, 0),
}
COUNTS = ("n_words", "word_chars", "n_lines")
#: Where measures() has each count.
_AT = {"n_words": "of_words.", "word_chars": "of_words.", "n_repeat_words": "of_words.", "n_lines": "of_lines.", "n_dup_lines": "of_lines.", "n_symbols": "", "n_upper": ""}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for the row: the optimizer can't copy it into each of its uses."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more."""

    def counted(windows: Column) -> Column:
        # In the order of (hash, place), neighbours with equal words are the repeated ones.
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda i, j: (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])

        def found(o: Column) -> Column:
            like = lambda x, y: F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))
            hits = F.filter(o, lambda x, k: F.when(k > 0, like(x, F.get(o, k - 1))).otherwise(F.lit(False)) | like(x, F.get(o, k + 1)))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x
        )
        # Without two equal hashes no window repeats; only else the exact count is made.
        return F.when(F.size(windows) > F.size(F.array_distinct(windows)), _let(_let(order, found), covered)).otherwise(F.lit(0))

    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return _let(F.transform(places, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])), counted)


def measures(text: Column) -> Column:
    """Struct of a text's counts, all made inside the row; a null text counts as empty."""

    def of(t: Column) -> Column:
        # regular expressions, not translate(), which looks every character up in a hash table
        words = F.array_remove(F.split(t, r"[\x09-\x0D\x20]+"), "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
        without = lambda of: (F.length(t) - F.length(F.regexp_replace(t, of, ""))).cast("long")
        counts = lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")
        )
        return F.struct(
            _let(words, counts).alias("of_words"),
            without(SYMBOLS).alias("n_symbols"),
            without(r"\p{Lu}").alias("n_upper"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("of_lines"),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def _shares(df: DataFrame) -> DataFrame:
    of = lambda c: F.col(f"_m.{_AT[c]}{c}")
    share = {f"_{m}": F.coalesce(F.try_divide(of(n).cast("double"), of(d).cast("double")), F.lit(0.0)) for m, (n, d, _, _) in SHARES.items()}
    return df.withColumns(share | {"_base_failed": (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PCT * of("n_words"))})


def _leading(x: str, bits: int) -> str:
    """A whole number with only its leading bits, the others 0."""
    return f"({x}) - ({x}) % shiftleft(1L, greatest(length(bin({x})) - {bits}, 0))"


def _on_grid() -> dict[str, Column]:
    """The measures and counts as the whole numbers that are sketched."""
    at = lambda c: f"_m.{_AT[c]}{c}"
    out = {}
    for m, (n, d, steps, bits) in SHARES.items():
        x = f"({steps} * {at(n)}) div greatest({at(d)}, 1L)"
        out[m] = F.expr(_leading(x, bits) if bits else x)
    return out | {c: F.expr(_leading(at(c), COUNT_BITS)) for c in COUNTS}


def _limits(measured: DataFrame) -> DataFrame:
    """(_lang, _source, _low_<m>, _high_<m>): cutoffs of each group, from its own sketch merged with those above it.

    A sketch is the weight of rows by step of a fixed grid: its quantiles are right to a step, sketches are merged by sums,
    in any order to the same result, and each has as many rows as the grid has steps at most. The language's sketch counts
    PRIOR_ROWS rows at every size of a group, so that no verdict turns at a certain number of rows.
    """
    names = list(_on_grid())
    wanted = sorted({(m, q) for m, (low, high, *_) in CUTOFFS.items() for q in (low, high)} | {(of, 0.5) for *_, of in CUTOFFS.values()})
    good = measured.filter(~F.col("_base_failed"))
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), v.cast("long").alias("v")) for i, v in enumerate(_on_grid().values())]))
    sketch = good.select("_lang", "_source", values.alias("x")).groupBy("_lang", "_source", "x.m", "x.v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    sketch = sketch.checkpoint()  # at most a row for each step of each measure in each pair of language and source
    groups = measured.select("_lang", "_source").distinct()

    def shares(level: DataFrame, by: list[str]) -> DataFrame:
        """Weights as shares of their group's and measure's, of PRIOR_ROWS in all."""
        x = level.groupBy(*by, "m", "v").agg(F.sum("w").alias("w"))
        return x.withColumn("w", PRIOR_ROWS * F.col("w") / F.sum("w").over(Window.partitionBy(*by, "m")))

    of_all = shares(sketch, [])
    langs = groups.select("_lang").distinct().select("_lang", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("m"))
    by_lang = shares(sketch.select("_lang", "m", "v", "w").unionByName(langs.join(of_all, "m")), ["_lang"]).withColumnRenamed("_lang", "_of")
    merged = sketch.unionByName(groups.join(by_lang, F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of"))
    merged = merged.groupBy("_lang", "_source", "m", "v").agg(F.sum("w").alias("w"))
    group = Window.partitionBy("_lang", "_source", "m")
    merged = merged.withColumns({"upto": F.sum("w").over(group.orderBy("v")), "of": F.sum("w").over(group)})
    # weights are fractions: a hair below the share counts as the share
    reached = lambda q: F.col("upto") >= F.lit(q - 1e-9) * F.col("of")
    found = [F.min(F.when((F.col("m") == names.index(m)) & reached(q), F.col("v"))).cast("double").alias(f"{m}_{q}") for m, q in wanted]
    x = merged.groupBy("_lang", "_source").agg(*found)

    out = []
    for m, (lower, upper, factor, units, of) in CUTOFFS.items():
        low, high, steps = F.col(f"`{m}_{lower}`"), F.col(f"`{m}_{upper}`"), float(SHARES[m][2])
        slack = F.lit(units) / F.col(f"`{of}_0.5`")
        out.append(((high + factor * (high - low)) / steps + slack).alias(f"_high_{m}"))
        if m in LOWER:
            out.append(((low - factor * (high - low)) / steps - slack).alias(f"_low_{m}"))
    return x.select(F.col("_lang").alias("_lang1"), F.col("_source").alias("_source1"), *out).checkpoint()


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, into: str = "quality_rules") -> DataFrame:
    """The columns `keep` of docs (all by default) and a struct `into`: counts, base_failed, kept and the reason.

    A row fails the base rule, or lies beyond a cutoff of its (language, source) group. Null text counts as empty (no
    words, base_failed); null language or source is a group of its own; those of small groups lean to their language's sketch; equal rows
    get equal verdicts; a measure equal to its cutoff is within it; an empty table gives an empty one. Texts of any length
    are measured whole. Columns of docs may have any names; one that is called like `into` is replaced.

    The measures are written to the shared folder once, since both the sketches and the verdicts need them.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    # The input columns travel in a struct, so that no name of theirs can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    measured = _shares(written(docs.select(row, F.col(lang).alias("_lang"), F.col(source).alias("_source"), measures(F.col(text)).alias("_m")), "measures"))
    limits = _limits(measured)
    # Pairs of language and source are few, but nothing proves it: the join is left to the optimizer's size checks.
    x = measured.join(limits, F.col("_lang").eqNullSafe(F.col("_lang1")) & F.col("_source").eqNullSafe(F.col("_source1")), "left")
    reasons: list[Column] = [F.when(F.col("_base_failed"), F.lit("base"))]
    for m in CUTOFFS:
        reasons.append(F.when(F.col(f"_{m}") > F.col(f"_high_{m}"), F.lit(m)))
        if m in LOWER:
            reasons.append(F.when(F.col(f"_{m}") < F.col(f"_low_{m}"), F.lit(f"{m}_low")))
    reason = F.coalesce(*reasons)
    verdict = F.struct(
        "_m.of_words.n_words", "_m.of_words.word_chars", "_m.n_symbols", "_m.of_lines.n_dup_lines", "_m.of_words.n_repeat_words",
        F.col("_base_failed").alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"),
    )
    return x.select(*[F.col("_row")[c].alias(c) for c in keep], verdict.alias(into))
