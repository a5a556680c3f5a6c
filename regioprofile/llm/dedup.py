"""Near-duplicates by order MinHash: sketches that keep the text order of sampled shingles, then banded alignment.

Texts become sequences of five-word shingles, each labelled with how often it occurred before. For each of SKETCHES hash
functions the TOGETHER smallest labelled shingles are kept in their order in the text; two texts share such a sketch
with a chance that falls with the edit distance of their shingle sequences. Texts that share one are candidates; a link
needs an edit similarity of 0.8 or more between the two shingle sequences.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .wordhash import hashed_words, in_pieces, mix

#: Words in a shingle and least similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Sketches of a text, and shingles in each. At similarity 0.8 two texts share a sketch with a chance of about 0.44, so
#: that none of 20 is shared in one of 100,000 pairs.
SKETCHES, TOGETHER = 20, 2
#: A bucket of at most so many texts, some of which are still apart, is compared pair by pair; the texts of larger ones
#: are compared where they share one of their rarest shingles, which loses no similar pair (see _rarest).
BUCKET = 32
#: A bucket's members are dealt over so many salts by their class, 64 at most, as a long has a bit for each.
SALTS = 64
#: Characters of text that are hashed together.
PIECE_CHARS = 250_000
#: Counters of shingles, by fingerprint modulo this number, 16 bits each. They order the shingles and show those that occur
#: once; with more shingles than counters fewer of these are seen, at the same links.
COUNTERS = 1 << 22
#: Fixed table: ASCII bytes other than letters and digits separate words.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Odd multipliers: each orders the (well mixed) labelled shingles in its own way.
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sequences(texts: list[str | None]) -> list[np.ndarray]:
    """Fingerprints of each text's shingles in order; a text of fewer words is one shingle, one without words has none."""
    words, _, sizes = hashed_words([t.lower() if t else None for t in texts], _TABLE)

    def windows(w: np.ndarray, k: int) -> np.ndarray:
        x = np.full(max(0, len(w) - k + 1), k, np.uint64)
        for i in range(k):
            x = mix(x * np.uint64(0x100000001B3) + w[i : i + len(x)])
        return x

    # windows over all texts in turn; those that reach into the next text are left out
    every, ends = windows(words, SHINGLE), np.cumsum(sizes)
    return [
        (every[end - n : end - SHINGLE + 1] if n >= SHINGLE else windows(words[end - n : end], n) if n else words[:0])
        for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)
    ]


def labelled(x: np.ndarray) -> np.ndarray:
    """Shingles with the number of their earlier occurrences hashed in."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.empty(len(x), np.uint64)
    nth[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return mix(x + nth * np.uint64(0xD6E8FEB86659FD93))


def sketch(x: np.ndarray) -> np.ndarray:
    """The SKETCHES numbers of a shingle sequence: for each, the smallest labelled shingles in text order."""
    y = labelled(x)
    least = np.empty((SKETCHES, min(TOGETHER, len(y))), np.int64)
    step = max(1, 2_000_000 // len(y))  # hash functions at a time
    for j in range(0, SKETCHES, step):
        h = y[None, :] * _SEEDS[j : j + step, None]
        rows = np.arange(len(h))
        for k in range(least.shape[1]):
            at = h.argmin(1)
            least[j : j + step, k] = at
            h[rows, at] = _LAST
    least.sort(1)  # text order
    out = np.arange(SKETCHES, dtype=np.uint64)
    for k in range(least.shape[1]):
        out = mix(out * np.uint64(0x100000001B3) + y[least[:, k]])
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, by alignment within a band around the diagonal that doubles until it suffices.

    Exact if it is `most` at most, else some number above. Time and memory follow the length times the distance, so that
    very long texts that are alike cost little.
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = a[:n] == b[:n]
    front = n if same.all() else int(np.argmin(same))
    a, b = a[front:], b[front:]
    n = min(len(a), len(b))
    back = 0
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        back = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - back], b[: len(b) - back]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    places: dict[int, list[int]] = {}
    for i, v in enumerate(a.tolist()):
        places.setdefault(v, []).append(i)
    given, band = [places.get(v, ()) for v in b.tolist()], max(16, len(a) - len(b))
    while band < most and (d := _in_band(given, len(a), band)) > band:
        band *= 4
    return d if band < most else _in_band(given, len(a), most)


def _in_band(given: list, n: int, band: int) -> int:
    """Edit distance of a longer sequence of n and a shorter one, if it is at most `band`, else some number above.

    given: for each element of the shorter one its places in the longer one, in order. A column of the matrix is two
    integers with a bit for each of the 2 * band + 1 cells around the diagonal (vertical differences, after Myers and
    Hyyro); the window moves down by one cell with each column.
    """
    width = 2 * band + 1
    every = (1 << width) - 1
    last = 1 << (width - 1)  # the cell `band` below the diagonal, while the matrix reaches as far
    down, up, distance = every & (every << band), 0, min(band, n)
    columns = len(given)
    for j, own in enumerate(given):
        low = j - band  # row of the window's first cell
        match = 0
        if own:
            k = bisect_left(own, low) if own[0] < low else 0
            while k < len(own) and own[k] <= j + band:
                match |= 1 << (own[k] - low)
                k += 1
        d0 = ((((match & down) + down) ^ down) | match | up) & every
        right, left = up | (every & ~(d0 | down)), d0 & down
        if j + band < n:  # down the diagonal
            if not d0 & last:
                distance += 1
        else:  # along the last row, which moves up through the window
            bottom = 1 << (n - 1 - low)
            if right & bottom:
                distance += 1
            elif left & bottom:
                distance -= 1
        if distance - max(0, columns - 1 - max(j, n - 1 - band)) > band:  # it can fall in columns of the last row only
            return distance
        down, up = left | (every & ~(d0 >> 1 | right)), d0 >> 1 & right
    return distance


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """1 - edit distance / longer length; exact from `least` up, and 0 below it or if one has no shingle.

    Whatever an alignment keeps is in both, so only sequences that have enough labelled shingles in common are aligned.
    """
    longer = max(len(a), len(b))
    if not len(a) or not len(b):
        return 0.0
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most or longer - len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) > most:
        return 0.0
    d = edit_distance(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t, h, n, sketch: the text's hash, fingerprint and length of the shingle sequence, and its sketches.

    The last three are null, 0 and null for a text without words.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_pieces(batch.column(2).to_pylist(), PIECE_CHARS):
                seqs = shingle_sequences(texts)
                whole = [int(mix((x * (2 * np.arange(len(x), dtype=np.uint64) + np.uint64(1))).sum(keepdims=True)).view(np.int64)[0]) if len(x) else None for x in seqs]
                made = [sketch(x).view(np.int64).tolist() if len(x) else None for x in seqs]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, len(texts)) for k in (0, 1)), pa.array(whole, pa.int64()), pa.array([len(x) for x in seqs], pa.int32()), pa.array(made, pa.list_(pa.int64()))],
                    ["doc_id", "t", "h", "n", "sketch"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, t long, h long, n int, sketch array<long>")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs (lead, b) of classes whose texts are similar.

    A class follows few leaders, so its text is sent to them; leaders, who may have many, are dealt over salts.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(32)).cast("int"))
    heads = pairs.select("lead", "salt").distinct().join(texts.select(F.col("h").alias("lead"), F.col("text").alias("text_a")), "lead")
    joined = pairs.join(texts.select(F.col("h").alias("b"), F.col("text").alias("text_b")), "b").join(heads, ["lead", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # few pairs at a time, for the sake of memory
                left, right = (batch.column(k).slice(first, 64).to_pylist() for k in (2, 3))
                some = list(dict.fromkeys(left))
                known = dict(zip(some, shingle_sequences(some), strict=True))
                sims = [similarity(known[a], b) for a, b in zip(left, shingle_sequences(list(right)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, len(left)) for k in (0, 1)] + [pa.array(sims)], ["a", "b", "similarity"])

    found = joined.select(F.col("lead").alias("a"), "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")
    return found.filter(F.col("similarity") >= SIMILAR).select("a", "b")


def _pairs(found: DataFrame) -> DataFrame:
    """lo, hi, lead, b: each pair of the rows (lead, b) once, whichever of the two leads."""
    x = found.select(F.least("lead", "b").alias("lo"), F.greatest("lead", "b").alias("hi"), "lead").groupBy("lo", "hi").agg(F.min("lead").alias("lead"))
    return x.withColumn("b", F.when(F.col("lead") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))


def _near(n: str, m: str) -> Column:
    """Whether lengths allow a link."""
    return F.least(n, m) >= SIMILAR * F.greatest(n, m) - 1e-6


def _salt(h: str = "h") -> Column:
    return F.pmod(F.col(h), F.lit(SALTS)).cast("int")


def _salts_in(mask: str) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(mask, i) == 1))


def _by_bucket(keys: DataFrame, *sums: Column) -> DataFrame:
    """key, salts and sums over each bucket, made in each task before the shuffle; salts has a bit for each of its members' salts."""
    return keys.groupBy("key").agg(*sums, F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {SALTS}) as int)))").alias("salts"))


def _with_bucket(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """The rows whose bucket is in (key, salts, ...) with its other columns; salts stays.

    Members are dealt by key and salt, and their bucket's row is sent to the salts that occur, so that no task has a
    whole bucket, however many texts share its key.
    """
    sent = buckets.withColumn("salt", _salts_in("salts"))
    return keys.withColumn("salt", _salt()).join(sent, ["key", "salt"]).drop("salt")


def _led(keys: DataFrame) -> DataFrame:
    """(lead, b): each bucket's members b with two leaders, the smallest class and one that the bucket's key chooses.

    Only members of another component (c) than the leader's and of a length that allows a link.
    """
    second = F.min(F.struct(F.xxhash64("h", "key").alias("x"), "h", "n", "c")).alias("l2")
    lead = _by_bucket(keys, F.min(F.struct("h", "n", "c")).alias("l1"), second, F.count("*").alias("m")).filter("m > 1")
    lead = lead.select("key", "salts", F.array("l1", F.struct("l2.h", "l2.n", "l2.c")).alias("leads"))
    x = _with_bucket(keys.select("key", "h", "n", "c"), lead).withColumn("l", F.explode("leads"))
    x = x.filter((F.col("c") != F.col("l.c")) & _near("n", "l.n"))
    return x.select(F.col("l.h").alias("lead"), F.col("h").alias("b"))


def _with_component(keys: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with c, the component of their class."""
    label = components(links)
    keys = keys.drop("c")
    return keys.join(label, keys["h"] == label["node"], "left").select(*keys.columns, F.coalesce("component", "h").alias("c"))


def _apart(keys: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of buckets with members of different components, with `few` if a bucket has `most` members or fewer, and salts."""
    x = _by_bucket(keys, F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).filter("low <> high")
    few = [(F.col("m") <= most).alias("few")] if most else []
    return _with_bucket(keys.drop("salts"), x.select("key", "salts", *few))


def _pairs_apart(keys: DataFrame) -> DataFrame:
    """(lead, b): members of a bucket that are in different components and of lengths that allow a link.

    One side is dealt over the bucket's salts, to which the other is sent; that makes fewer rows than the pairs are.
    """
    other = keys.select("key", _salts_in("salts").alias("salt"), F.col("c").alias("c2"), F.col("h").alias("b"), F.col("n").alias("n2"))
    found = keys.withColumn("salt", _salt()).join(other, ["key", "salt"]).filter((F.col("c") < F.col("c2")) & _near("n", "n2"))
    return found.select(F.col("h").alias("lead"), "b")


def _counted(texts: DataFrame) -> np.ndarray:
    """COUNTERS sums over all labelled shingles of the texts, up to 65,535, and 0 for 1: of fixed size, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for _, some in in_pieces(batch.column(0).to_pylist(), PIECE_CHARS):
                if own := [labelled(x) for x in shingle_sequences(some) if len(x)]:
                    at, n = np.unique(np.concatenate(own) % np.uint64(COUNTERS), return_counts=True)
                    sums[at.astype(np.int64)] += n.astype(np.int32)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int32())], ["slot", "n"])

    # at most four tasks for each core, so that what they send does not grow with the texts and a lost one is soon made again
    bounded = texts.select("text").coalesce(4 * max(1, texts.sparkSession.sparkContext.defaultParallelism))
    made = bounded.mapInArrow(run, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
    got = made.select("slot", F.least("n", F.lit(0xFFFF)).cast("int").alias("n")).toArrow()
    sums = np.zeros(COUNTERS, np.uint16)
    sums[got["slot"].to_numpy()] = got["n"].to_numpy()
    return sums


def _rarest(texts: DataFrame) -> DataFrame:
    """key, h, n, c: the labelled shingles among the 0.2 n + 1 rarest of each text of n that others may have, as keys.

    Texts of similarity 0.8 share at least 0.8 of the longer one's labelled shingles; so, in any fixed order of all
    shingles, the first 0.2 n + 1 of both have one in common. With rare ones first, a passage that many texts share
    only comes up in texts that hardly have anything else. A shingle whose counter shows a single occurrence is in no
    second text, so it is no key.
    """
    spark = texts.sparkSession
    sums = spark.sparkContext.broadcast(_counted(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in in_pieces(batch.column(2).to_pylist(), PIECE_CHARS):
                own, sizes, lengths = [np.empty(0, np.uint64)], [], []
                for x in shingle_sequences(some):
                    y = labelled(x) if len(x) else x
                    times = sums.value[(y % np.uint64(COUNTERS)).astype(np.int64)]
                    order = np.lexsort((y, times))[: int((1 - SIMILAR) * len(y) + 1e-9) + 1]
                    own.append(y[order[times[order] > 0]])
                    sizes.append(len(own[-1]))
                    lengths.append(len(y))
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                own_h, c = (batch.column(k).slice(first, len(some)).take(at) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), own_h, pa.array(np.repeat(lengths, sizes), pa.int32()), c], ["key", "h", "n", "c"])

    return texts.select("h", "c", "text").mapInArrow(run, "key long, h long, n int, c long")


def _classes(made: DataFrame) -> DataFrame:
    """h, n, sketch, doc_id, t: a row for each class of equal shingle sequences, with one of the rows that have it."""
    return made.filter("h is not null").groupBy("h", "n").agg(F.min(F.struct("doc_id", "t", "sketch")).alias("x")).select("h", "n", "x.*")


def _links(made: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(a, b): links between classes of equal shingle sequences; see near_duplicates() for the steps."""
    classes = written(_classes(made), "classes")
    bands = classes.select("h", "n", F.posexplode("sketch").alias("band", "s")).select("h", "n", F.xxhash64("band", "s").alias("key"))
    shared = _by_bucket(bands, F.count("*").alias("m")).filter("m > 1").drop("m")
    keys = written(_with_bucket(bands, shared).select("h", "n", "key", F.col("h").alias("c")), "buckets")

    # the texts of classes that have any partner; of equal texts only the row that its class names is read
    needed = classes.join(keys.select("h").distinct(), "h", "left_semi").select("doc_id", "t", "h")
    own = docs.select(F.col(doc_id).alias("own_id"), _text_hash(text).alias("own_t"), F.col(text).alias("text"))
    texts = needed.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("t") == F.col("own_t")))
    texts = written(texts.select("h", "text").dropDuplicates(["h"]), "texts")

    # first one pair for each class: the smallest of all its buckets' leaders
    pairs = written(_pairs(_led(keys).groupBy("b").agg(F.min("lead").alias("lead"))), "pairs")
    links = written(_verified(pairs, texts), "links")
    # buckets with members that are still apart, with both leaders
    keys = _with_component(keys, links)
    keys = written(_apart(keys), "apart")
    more = written(_pairs(_led(keys)).join(pairs, ["lo", "hi"], "left_anti"), "pairs")
    links = written(links.unionByName(_verified(more, texts)), "links")
    pairs = pairs.unionByName(more)
    # those that are apart yet
    keys = _with_component(keys, links)
    keys = written(_apart(keys, BUCKET), "apart")
    more = _pairs_apart(keys.filter("few"))
    crowd = keys.filter("not few").select("h", "c").distinct()
    crowded = not crowd.isEmpty()
    if crowded:
        rare = _rarest(written(texts.join(crowd, "h"), "crowd"))
        rare = written(rare, "rare")
        rare = written(_apart(rare), "rare")
        more = more.unionByName(_led(rare))
    more = written(_pairs(more).join(pairs, ["lo", "hi"], "left_anti"), "pairs")
    links = written(links.unionByName(_verified(more, texts)), "links")
    if crowded:
        rare = written(_with_component(rare, links), "rare")
        rest = _pairs(_pairs_apart(_apart(rare)))
        rest = written(rest.join(pairs.unionByName(more), ["lo", "hi"], "left_anti"), "pairs")
        links = written(links.unionByName(_verified(rest, texts)), "links")
    return links


def _labelled(made: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """near_duplicates() from the texts' sketches, with h, the class of equal shingles, of texts without an id."""
    links = _links(made, docs, doc_id, text)
    # ids of several texts link these
    by_id = made.filter("doc_id is not null and h is not null").groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    several = by_id.groupBy("doc_id").agg(F.min("h").alias("low"), F.count("*").alias("m")).filter("m > 1").select("doc_id", "low")
    own = by_id.join(several, "doc_id").select(F.col("low").alias("a"), F.col("h").alias("b")).filter("a <> b")
    label = components(links.unionByName(own))

    rows = made.groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    rows = rows.join(label, rows["h"] == label["node"], "left").select("doc_id", "h", "n", F.coalesce("component", "h").alias("c"))
    rows = written(rows, "rows")
    lowest = rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min("h").alias("first"))
    rows = rows.join(lowest.withColumnRenamed("c", "c_"), F.col("c") == F.col("c_"), "left")
    with_id = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("n").alias("n"))
    component = F.coalesce("component_id", "doc_id")
    with_id = with_id.select("doc_id", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), F.col("n").alias("n_shingles"))
    kept = F.col("component_id").isNull() & F.coalesce(F.col("h") == F.col("first"), F.lit(True))
    without_id = rows.filter("doc_id is null").select("doc_id", "component_id", kept.alias("kept"), F.col("n").alias("n_shingles"), "h")
    return with_id.withColumn("h", F.lit(None).cast("long")).unionByName(without_id)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id, kept, n_shingles: a row for each distinct id, and for each class of texts of null id.

    component_id is the smallest id reachable over links; kept marks it. Texts of equal words (case and punctuation
    aside) are one class and are compared as one. Texts that are null or without words link with nothing. Rows that
    repeat an id are one document: all their texts take part, and what links with one of them links with the document;
    n_shingles is that of the longest. Texts without an id take part too; they are kept, one of each group, if nothing
    with an id is in their group, whose component_id then is null. Texts may be of any length, other columns of any
    name; an empty table gives an empty one.

    Steps: sketches; classes of equal sequences; buckets of equal sketches; a first comparison of each class with the
    smallest of its buckets' leaders; components; where a bucket's members are still apart, comparisons with two leaders
    each, so that a large group makes pairs in proportion to its size. Of the buckets with members that are apart yet,
    small ones are compared pair by pair. The texts of larger ones, which mostly share a passage only, meet
    again by their rarest shingles, first with leaders, then all that are still apart. So every pair that shares a
    sketch ends up in one component or has been found to be below the similarity, whatever its bucket's size.
    """
    made = written(sketches(docs, doc_id, text), "sketches")
    return _labelled(made, docs, doc_id, text).drop("h")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept: those of one document of each group.

    Of an id that is kept each different text stays once, with the columns of one of its rows. Of rows without an id one
    stays for each group that has no row with an id; those without words are copies of nothing and all stay.
    """
    made = written(sketches(docs, doc_id, text), "sketches")
    label = written(_labelled(made, docs, doc_id, text).filter("kept"), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no name of the input can clash
    packed = docs.select(F.col(doc_id).alias("id"), _text_hash(text).alias("t"), row.alias("row"))
    ids = label.filter("doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    some = packed.filter("id is not null").join(ids, F.col("id") == F.col("kept_id"), "left_semi").dropDuplicates(["id", "t"])
    classes = label.filter("doc_id is null and h is not null").select("h")
    texts = made.filter("doc_id is null").join(classes, "h").groupBy("h").agg(F.min("t").alias("t")).select("t")
    nameless = packed.filter("id is null")
    first = nameless.join(texts, "t", "left_semi").dropDuplicates(["t"]).select("row")
    wordless = made.filter("doc_id is null and h is null").select("t").distinct()
    return some.select("row").unionByName(first).unionByName(nameless.join(wordless, "t", "left_semi").select("row")).select("row.*")
