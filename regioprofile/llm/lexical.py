"""Ranked lexical search without a document index: an automaton of all items' terms counts them in the texts.

Each term stands between blanks in the automaton, so that only whole words match; its outputs are term numbers, which
lead to the items that hold the term. Texts are scanned once for a block of items: counts are written, document
frequencies and lengths are summed over them, and a second pass scores and keeps each task's best.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .plainwords import in_slices, item_blocks, plain, words_of

#: The weight of a document's length in percent, the scale of a term's weight and of its saturated count.
LENGTH_PCT, WEIGHT_SCALE, TF_SCALE = 75, 1000, 1_000_000_000
#: Documents kept for each item.
TOP = 10
#: Sums of doubles hold whole numbers below this exactly.
EXACT_BELOW = 2**53
#: Documents that are scored together; an item's best rows so far that are held before the worse ones go.
SCORED_ROWS, HELD_ROWS = 128, 64
#: Sets of tasks whose best rows are merged first, so that no task merges those of all.
SALTS = 64

_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(terms: list[bytes], name: str) -> ahocorasick.Automaton:
    """The automaton of the terms between blanks; kept in the worker for the next task."""
    if name not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            a.add_word(f" {t.decode('latin-1')} ", i)
        a.make_automaton()
        _BUILT[name] = a
    return _BUILT[name]


def _counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tf: a text's number of words, and the numbers and counts of the terms that it holds.

    Bytes stand for characters, as those of a character beyond ASCII are all word bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # of items of at most 2 * BLOCK_CHARS characters
    kind, name = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(sent.value, name) if sent.value else None
        number = itemgetter(1)
        for batch in batches:
            for part in in_slices(batch, "text"):
                n, size, which, often = [], [], [], []
                for t in part.column("text").to_pylist():
                    b = plain(t)
                    n.append(len(b.split()))
                    c = Counter(map(number, found.iter(f" {b.decode('latin-1')} "))) if found else {}
                    size.append(len(c))
                    which += c.keys()
                    often += c.values()
                at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (which, often)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def _scored(counted: DataFrame, weight: np.ndarray, n_docs: int, n_words: int, queries: list[tuple[np.ndarray, np.ndarray]], top: int) -> DataFrame:
    """item, doc_id, score: the best `top` documents of each item in each task.

    queries: the term numbers of each item and how often it holds them. Scores are whole numbers below 2**53, which sums
    of doubles hold exactly; where a bound on an item's score is not below it, sums are made of 64-bit integers.
    """
    by_term = np.concatenate([q[0] for q in queries]) if queries else np.zeros(0, np.int64)
    order = np.argsort(by_term, kind="stable")
    item = np.repeat(np.arange(len(queries)), [len(q[0]) for q in queries])[order]
    times = (np.concatenate([q[1] for q in queries]) if queries else by_term)[order]
    first = np.searchsorted(by_term[order], np.arange(len(weight) + 1))
    exact = max((int((weight[q[0]] * q[1]).sum()) for q in queries), default=0) * (TF_SCALE // 1000) < EXACT_BELOW
    sent = counted.sparkSession.sparkContext.broadcast((weight, first, item, times))  # as many numbers as the block's items have terms
    n_items, doc_kind = len(queries), counted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, item, times = sent.value
        least = np.ones(n_items, np.int64)
        held: list[list[tuple]] = [[] for _ in range(n_items)]
        best = lambda rows: nsmallest(top, rows)
        kind = None
        for whole in batches:
            kind = whole.column("doc_id").type
            for low in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(low, SCORED_ROWS)
                terms, tf, n = batch.column("terms"), batch.column("tf"), batch.column("n").to_numpy()
                size = np.diff(terms.offsets.to_numpy())
                t, tf = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
                m = 100 - LENGTH_PCT + (LENGTH_PCT * n * n_docs) // max(1, n_words)
                worth = weight[t] * ((TF_SCALE * tf) // (1000 * tf + 8 * np.repeat(m, size)))
                fan = first[t + 1] - first[t]
                at = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan - first[t], fan)
                cell = np.repeat(np.repeat(np.arange(len(n)), size) * n_items, fan) + item[at]
                part = np.repeat(worth, fan) * times[at]
                if exact:
                    score = np.bincount(cell, weights=part, minlength=len(n) * n_items).astype(np.int64)
                else:
                    score = np.zeros(len(n) * n_items, np.int64)
                    np.add.at(score, cell, part)
                d, i = np.nonzero(score.reshape(len(n), n_items) >= least)
                ids = batch.column("doc_id").take(pa.array(d)).to_pylist()
                for x, q, s in zip(ids, i.tolist(), score[d * n_items + i].tolist(), strict=True):
                    held[q].append((-s, x is None, 0 if x is None else x))
                    if len(held[q]) >= HELD_ROWS:
                        held[q] = best(held[q])
                        if len(held[q]) == top:
                            least[q] = -held[q][-1][0]
        rows = [(q, None if none else x, -s) for q in range(n_items) for s, none, x in best(held[q])]
        if rows:
            q, x, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(x, kind), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, f"item int, doc_id {doc_kind}, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item with a score above 0, equal ones by doc_id.

    Document and item terms are runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased. All
    documents with a term count for the statistics. Null and empty texts have none; an item without terms, or whose terms
    no document holds, has no row. Each row of docs is a document of its own, also where ids repeat; a null id comes after
    all others. Items are the different (item_id, text), each ranked on its own, also where its id is null or repeats.
    Texts of any length count whole; without documents or items there are no rows; other columns don't matter.

    Items beyond BLOCK_CHARS characters are searched in several passes over the texts.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    item_kind, doc_kind = items.schema[item_id].dataType, own.schema["doc_id"].dataType.simpleString()
    out, schema = None, f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind}, score long"
    for block in item_blocks(items, item_id, item_text):
        counts = [Counter(words_of(r["text"])) for r in block]
        terms = sorted(set().union(*counts))
        place = {t: i for i, t in enumerate(terms)}
        counted = written(_counted(own, terms), "term-counts")
        n_docs, n_words = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for t, k in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a row for each term of the block
            df[t] = k
        weight = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)
        queries = [(np.array([place[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        best = _scored(counted, weight, n_docs, n_words, queries, top)
        ranked = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        # each task has `top` rows of an item at most; those of many tasks are merged over salts first
        few = best.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("rank", ranked(["item", "_s"])).filter(F.col("rank") <= top)
        final = few.withColumn("rank", ranked(["item"])).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {item_kind.simpleString()}")
        rows = final.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out
