"""Spelling variants: pairs of words one edit apart, found by scanning sorted lists with a banded edit matrix.

Two words one edit apart share the first half of the shorter one or, read backwards, the rest of it. So each is looked
for in two sorted lists, of the words and of the reversed words, among those that begin with its half. The lists are
cut into blocks; a block's words are scanned in order: the rows of the edit matrix up to the prefix that a word shares
with the one before are used again, and once a prefix is more than one edit away, all words that share it are skipped.
A word also visits other blocks, but only those whose own shared prefix is within one edit.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .plainwords import in_slices

#: Letters of a word; a code point goes where this number divides the hash; bounds of words; how much more
#: frequent a form is.
LETTERS = "[A-Za-zÀ-ÿ]+"
DELETE_EVERY, MIN_CHARS, MIN_COUNT, FORM_FACTOR = 199, 6, 5, 5
#: Different words that a task counts before it passes them on; characters from which runs are not listed at once.
COUNTED_WORDS, LONG_TEXT = 200_000, 1_000_000
#: Words of a block; above MOST_BLOCKS blocks they grow, since the driver holds each block's first and last word.
BLOCK_WORDS, MOST_BLOCKS = 8192, 20_000
#: Words from elsewhere that visit a block together.
VISITORS = 8192
#: Characters of a block's first and last word that decide on visits.
EDGE_CHARS = 64
_LAST = "\U0010ffff"


def words_in(doc_id, text: str | None) -> Counter:
    """Words of at least MIN_CHARS in a text by count: runs of letters with A-Z in lower case, some with a code point deleted."""
    out: Counter = Counter()
    if not text:
        return out
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower() knows A-Z alone
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs = re.findall(LETTERS, low) if len(low) < LONG_TEXT else (m[0] for m in re.finditer(LETTERS, low))
    for w, n in Counter(runs).items():
        if len(w) >= MIN_CHARS:
            h = zlib.crc32(w.encode(), seed)
            if h % DELETE_EVERY == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
                if len(w) < MIN_CHARS:
                    continue
            out[w] += n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of whole texts that occur MIN_COUNT times or more; counts are summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in in_slices(batch, "text"):
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    counts.update(words_in(i, t))
                if len(counts) >= COUNTED_WORDS:
                    yield made()
        if counts:
            yield made()

    own = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).filter("text <> ''")
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    return len(commonprefix((a, b)))


class SortedList:
    """Different words in their order, with the prefix that each shares with the one before."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lcp = [0, *(shared(a, b) for a, b in zip(words, words[1:], strict=False))]

    def near(self, q: str, half: int) -> Iterator[int]:
        """Places of the words one edit from q and as long as q or longer by one that share its first `half` characters."""
        words, lcp, n, stem = self.words, self.lcp, len(q), q[:half]
        stop = bisect_left(words, stem + _LAST)
        i = bisect_left(words, stem, 0, stop)
        padded = q + "\0\0"
        # rows[d] = edits of a word's first d characters to the first d - 1, d and d + 1 of q, 2 standing for more
        rows = [(1, 0, 1)] * (half + 1) + [(2, 2, 2)] * (n + 1 - half)
        made = half
        while i < stop:
            w = words[i]
            m = len(w)
            if m != n and m != n + 1:
                i += 1
                if i < stop and lcp[i] < made:
                    made = max(lcp[i], half)
                continue
            d = made
            a, b, c = rows[d]
            while d < m:
                x = w[d]
                # band of d + 1 from that of d
                a1 = a if padded[d - 1] == x else a + 1
                if b + 1 < a1:
                    a1 = b + 1
                b1 = b if padded[d] == x else b + 1
                if c + 1 < b1:
                    b1 = c + 1
                if a1 + 1 < b1:
                    b1 = a1 + 1
                c1 = c if padded[d + 1] == x else c + 1
                if b1 + 1 < c1:
                    c1 = b1 + 1
                d += 1
                if a1 > 1 and b1 > 1 and c1 > 1:
                    break
                a, b, c = a1, b1, c1
                rows[d] = (a, b, c)
            else:
                if (a if m > n else b) == 1:
                    yield i
                i += 1
                made = max(min(lcp[i], m), half) if i < stop else half
                continue
            # the first d characters are more than one edit away: so are all words that share them
            i += 1
            if i < stop and lcp[i] >= d:
                i = bisect_left(words, w[:d] + _LAST, i, stop)
            made = max(min(lcp[i], d - 1), half) if i < stop else half


def reaches(prefix: str, q: str) -> bool:
    """Whether some prefix of q is within one edit of a prefix."""
    a, b, c = 2, 0, 1
    padded = q + "\0" * (len(prefix) + 2)
    for d, x in enumerate(prefix):
        a1 = min(a + (padded[d - 1] != x) if d else 2, b + 1)
        b1 = min(b + (padded[d] != x), c + 1, a1 + 1)
        a, b, c = a1, b1, min(c + (padded[d + 1] != x), b1 + 1)
        if min(a, b, c) > 1:
            return False
    return True


def _half(n: int, backwards: bool) -> int:
    return n - n // 2 if backwards else n // 2


def _blocks(vocab: DataFrame, size: int, parts: int) -> DataFrame:
    """block, low, high, words, ns: the sorted words in blocks of at most `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, ns = TaskContext.get().partitionId() << 32, [], []
        names = ["block", "low", "high", "words", "ns"]
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([words[0][:EDGE_CHARS]]), pa.array([words[-1][:EDGE_CHARS]]), pa.array([words]), pa.array([ns])], names)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.append(w)
                ns.append(n)
                if len(words) == size:
                    yield whole()
                    at, words, ns = at + 1, [], []
        if words:
            yield whole()

    placed = vocab.repartitionByRange(parts, "word").sortWithinPartitions("word")
    return written(placed.mapInArrow(run, "block long, low string, high string, words array<string>, ns array<long>"), "sorted-words")


def _visits(blocks: DataFrame, backwards: bool) -> DataFrame:
    """block, words, ns: words that look for near ones in another block than their own, at most about VISITORS in a row."""
    edges = sorted(blocks.select("low", "high", "block").collect())  # MOST_BLOCKS at most, but for what uneven cuts add
    sent = blocks.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = [e[0] for e in sent.value], [e[1] + (_LAST if len(e[1]) == EDGE_CHARS else "") for e in sent.value]
        common = [commonprefix(e[:2]) for e in sent.value]
        for batch in batches:
            for own, words, ns in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "ns")), strict=True):
                out: list[tuple] = []
                for w, n in zip(words, ns, strict=True):
                    stem = w[: _half(len(w), backwards)]
                    i = bisect_left(highs, stem)
                    while i < len(lows) and lows[i] <= stem + _LAST:
                        if sent.value[i][2] != own and reaches(common[i], w):
                            out.append((sent.value[i][2], w, n))
                        i += 1
                if out:
                    b, w, n = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(w), pa.array(n)], ["block", "word", "n"])

    found = written(blocks.select("block", "words", "ns").mapInArrow(run, "block long, word string, n long"), "visits")
    load = found.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("k"))
    split = found.join(load, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("k")))
    rows = split.groupBy("block", "part").agg(F.collect_list(F.struct("word", "n")).alias("v"))
    return rows.select("block", F.col("v.word").alias("visitors"), F.col("v.n").alias("visitor_ns"))


def _near_in(blocks: DataFrame, backwards: bool) -> DataFrame:
    """word, k, n, other: for each word the number of near words met in a block, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, ns, visitors, visitor_ns = (batch.column(c)[r].as_py() for c in ("words", "ns", "visitors", "visitor_ns"))
                listed = SortedList(words)
                found: dict[str, list] = {}

                def met(w: str, n: int, other: str) -> None:
                    e = found.setdefault(w, [0, 0, ""])  # noqa: B023
                    e[0] += 1
                    if n > e[1] or (n == e[1] and other < e[2]):
                        e[1:] = n, other

                for q, nq in zip(*((words, ns) if visitors is None else (visitors, visitor_ns)), strict=True):
                    # pairs that share the first half of the shorter word are those of the forward list
                    half, turned = _half(len(q), backwards), len(q) // 2
                    for i in listed.near(q, half):
                        w = words[i]
                        if backwards and q[::-1][:turned] == w[::-1][:turned]:
                            continue
                        met(q, ns[i], w[::-1] if backwards else w)
                        if len(w) > len(q):  # equally long words find each other
                            met(w, nq, q[::-1] if backwards else q)
                if found:
                    k, n, other = zip(*found.values(), strict=True)
                    own = [w[::-1] for w in found] if backwards else list(found)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(other)], ["word", "k", "n", "other"])

    none = [F.lit(None).cast("array<string>").alias("visitors"), F.lit(None).cast("array<long>").alias("visitor_ns")]
    at_home = blocks.select("words", "ns", *none)
    abroad = blocks.join(_visits(blocks, backwards), "block").select("words", "ns", "visitors", "visitor_ns")
    return at_home.unionByName(abroad).mapInArrow(run, "word string, k long, n long, other string")


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for each word of (word, n) that has near ones their number and the most frequent (ties: smallest).

    Near words differ by exactly one inserted, deleted or replaced code point. Words are different, not null, and have two
    characters at least.
    """
    total = vocab.count()
    size = max(BLOCK_WORDS, math.ceil(total / MOST_BLOCKS))
    parts = max(1, math.ceil(total / size))
    out = None
    for backwards in (False, True):
        x = vocab.select(F.reverse("word").alias("word") if backwards else "word", "n")
        own = _near_in(_blocks(x, size, parts), backwards)
        out = own if out is None else out.unionByName(own)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("w")))
    return out.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last. Each round doubles the steps; a form is always more frequent."""
    x = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = x.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(x.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        x = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return x


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, form, root, n_near, form_n for the words of whole texts that occur often enough.

    A word's form is its most frequent near word (ties: the smallest), if that is FORM_FACTOR times as frequent; root
    follows the forms to the last and is the word itself without a form. Null and empty texts have no words; a null id
    counts as empty text in the rule that deletes code points; repeated rows count again; without words there are no
    rows; texts of any length count whole; other columns don't matter.
    """
    vocab = written(vocabulary(docs, doc_id, text), "vocabulary")
    x = vocab.join(near_words(vocab), "word", "left")
    has = F.col("best_n") >= FORM_FACTOR * F.col("n")
    x = written(x.select("word", "n", F.when(has, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    end = roots(x.filter("form is not null"))
    return x.join(end, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
