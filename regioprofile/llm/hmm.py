"""Hidden Markov language model over words: Baum-Welch counts summed across partitions, exact scaled forward scores.

Symbols of the model are the most frequent training words, one class for each group of the rarer words (by their last
two bytes), and the end of a text. A rarer word's probability in a state is that of its class times its smoothed share of
the class in that state, as the last round expects it, so every training word has emissions of its own and the scores are probabilities over the same
words as the unigram base: V known ones and one for the rest. The rarer words' expected counts are a distributed table;
only the head and the classes, a model of fixed size, travel to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordhash import hashed_words, in_pieces

STATES, ROUNDS = 4, 4
#: Classes of the rarer words, and words with a symbol of their own: all symbols are 16-bit numbers, and the table sent to
#: tasks is bounded.
CLASSES = 512
HEAD = (1 << 16) - CLASSES - 1
#: Tokens that one piece of a batch holds.
PIECE_TOKENS = 1_500_000
#: How much of a rarer word's count is added to what a state expects of it: where a state expects nothing of a class, the
#: counts alone share it out.
LEAN = 1 / 64
#: Expected counts are summed as whole numbers of this fraction, so that no order of tasks changes the sums.
UNIT = 1 << 16
LOG10 = math.log(10)


@dataclass
class Vocabulary:
    head: np.ndarray  # fingerprints in rising order
    head_counts: np.ndarray
    class_tokens: np.ndarray  # of the rarer training words
    class_words: np.ndarray
    ends: int
    tokens: int  # N
    types: int  # V

    @property
    def size(self) -> int:
        return len(self.head) + CLASSES + 1

    def symbols(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Symbol of each word; one outside the head gets its class."""
        rare = len(self.head) + last % CLASSES
        if not len(self.head):
            return rare
        at = np.searchsorted(self.head, words)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == words, at, rare)


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, class, c): fingerprint, class and training count of each word, summed within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in in_pieces(batch.column(0).to_pylist()):
                words, last, _ = hashed_words(texts)
                own, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array((last[first] % CLASSES).astype(np.int32)), pa.array(n)], ["word", "class", "c"])

    counted = train.select(text).mapInArrow(count, "word long, class int, c long")
    return counted.groupBy("word").agg(F.first("class").alias("class"), F.sum("c").alias("c"))  # equal words have equal classes


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """The bounded head, and sums over all other words; counts: a written table.

    A histogram of the counts' logarithms, of a few hundred rows at any size, tells from which count on the words fit
    into the head; only those come to the driver.
    """
    level = F.floor(8 * F.log2("c"))
    n, v, taken, least = 0, 0, 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect(), reverse=True):
        n, v = n + r["tokens"], v + r["words"]
        if v <= HEAD:
            taken, least = v, r["level"]
    head = counts.filter(level >= least).select("word", "c").toArrow()
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    if taken < v:
        for r in counts.filter(level < least).groupBy("class").agg(F.sum("c"), F.count("*")).collect():
            tokens[r[0]], words[r[0]] = r[1], r[2]
    prints = head["word"].to_numpy().view(np.uint64)
    order = np.argsort(prints)
    return Vocabulary(prints[order], head["c"].to_numpy().astype(float)[order], tokens, words, n_docs, n + n_docs, v + (n_docs > 0))


def in_time_order(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """docs, longest first: all first symbols, then all second ones ...; each symbol's doc; docs and place of each time; where each went."""
    lengths = np.array([len(d) for d in docs])
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    off = np.concatenate([[0], np.cumsum(active)])
    doc = np.repeat(np.arange(len(docs)), lengths)
    time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = off[time] + doc
    flat, own = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    flat[place], own[place] = np.concatenate(docs), doc
    return flat, own, active, off, place


def pieces(docs: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Places and symbols of docs, the longest first, about PIECE_TOKENS tokens at a time."""
    at, size = [], 0
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        at.append(i)
        size += len(docs[i])
        if size >= PIECE_TOKENS:
            yield at, [docs[j] for j in at]
            at, size = [], 0
    if at:
        yield at, [docs[j] for j in at]


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray  # from row to column
    emit: np.ndarray  # a row for each state
    ratio: np.ndarray | None = None  # of symbols: training tokens of a class for each one expected in the state; 0 for others

    def emissions(self, flat: np.ndarray, rare: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """A column for each symbol; at the places `rare`, a word's expected counts `own` make its share of its class.

        Of a class with T tokens and W words, a word expected e times (with LEAN of its count) in a state that the class is
        expected A times in (with LEAN of T) has the share (e T / A + 1) / (T + W + 1) there, and an unknown word
        1 / (T + W + 1); the divisor is left out.
        """
        em = self.emit[:, flat]
        if own is not None:
            em[:, rare] *= own * self.ratio[:, flat[rare]] + 1
        return em

    def forward(self, em: np.ndarray, active: np.ndarray, off: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """The scale of every step; keep gets the scaled forward probabilities. A column for each symbol in time order."""
        scale, back = np.empty(em.shape[1]), np.ascontiguousarray(self.move.T)
        a = None
        for t, n in enumerate(active):
            i = off[t]
            a = (self.start[:, None] if a is None else back @ a[:, :n]) * em[:, i : i + n]
            s = a.sum(0)
            a /= s
            scale[i : i + n] = s
            if keep is not None:
                keep[:, i : i + n] = a
        return scale

    def log10_likelihoods(self, docs: list[np.ndarray], rare: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
        """rare: places of rarer words in the concatenated docs; own: their expected counts, a row for each state."""
        flat, of, active, off, place = in_time_order(docs)
        em = self.emissions(flat, place[:0] if rare is None else place[rare], own)
        return np.bincount(of, np.log(self.forward(em, active, off)), len(docs)) / LOG10

    def counts(self, docs: list[np.ndarray], rare: np.ndarray | None = None, at_rare: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions; log likelihood. at_rare gets the posteriors at the places `rare`."""
        flat, _, active, off, place = in_time_order(docs)
        em, k = self.emit[:, flat], len(self.start)
        gamma = np.empty((k, len(flat)))  # forward probabilities, turned into posteriors from the last time on
        scale = self.forward(em, active, off, gamma)
        em /= scale
        moves, beta = np.zeros((k, k)), np.ones((k, active[-1]))
        for t in range(len(active) - 2, -1, -1):
            n, i, j = active[t + 1], off[t], off[t + 1]
            ahead = beta * em[:, j : j + n]
            moves += gamma[:, i : i + n] @ ahead.T
            gamma[:, j : j + n] *= beta
            beta = np.ones((k, active[t]))
            beta[:, :n] = self.move @ ahead
        gamma[:, : active[0]] *= beta
        if at_rare is not None:
            at_rare.append(gamma[:, place[rare]])
        emitted = np.stack([np.bincount(flat, gamma[s], self.emit.shape[1]) for s in range(k)])
        return gamma[:, : active[0]].sum(1), moves * self.move, emitted, float(np.log(scale).sum())


def first_model(voc: Vocabulary, states: int = STATES) -> Model:
    """Near the unigram model; words lean to states by fixed noise, and states tend to stay."""
    share = np.concatenate([voc.head_counts, voc.class_tokens, [voc.ends]]) + 0.5
    noise = np.random.default_rng(1).random((voc.size, states)) + 0.2
    emit = (share[:, None] * noise).T
    move = np.full((states, states), 0.05 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def coded(docs: DataFrame, voc: Vocabulary, is_train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's symbols, as a written table: row, doc_id, train, codes, and fingerprints of words outside the head.

    Rows are numbered because ids may be null or repeat; ids travel as they are, whatever their type.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voc)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            for first, texts in in_pieces(batch.column(3).to_pylist()):
                words, last, sizes = hashed_words(texts)
                codes = v.symbols(words, last)
                rare = codes >= len(v.head)
                places = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                n_rare = np.bincount(np.repeat(np.arange(len(sizes)), sizes), rare, len(sizes)).astype(np.int64)
                ends = np.split(np.insert(codes, np.cumsum(sizes), v.size - 1).astype("<u2"), np.cumsum(sizes + 1)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, len(texts)) for k in range(3)), pa.array([x.tobytes() for x in ends], pa.binary()), pa.ListArray.from_arrays(places(n_rare), pa.array(words[rare].view(np.int64)))],
                    ["row", "doc_id", "train", "codes", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(is_train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    return written(rows.mapInArrow(encode, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, train boolean, codes binary, rare array<long>"), "coded")


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows' arrays, as views of one."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def symbols_of(column: pa.BinaryArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def with_words(codes: DataFrame, words: DataFrame | None, columns: list[str]) -> DataFrame:
    """doc_id, codes, n_rare; `at`, places among the row's rare words, and a list for each of columns: those that `words` has.

    The lists of a row are collected side by side, in one order. Two shuffle joins, by fingerprint and by row; no table
    of words is held in a task. No word outside the head is frequent enough to make a hot key. Without `words` they are null.
    """
    own = codes.select("row", "doc_id", "codes", F.size("rare").alias("n_rare"))
    if words is None:
        return own.withColumns({"at": F.lit(None).cast("array<int>")} | {c: F.lit(None).cast("array<long>") for c in columns})
    found = codes.select("row", F.posexplode("rare").alias("at", "word")).join(words, "word")
    found = found.groupBy("row").agg(*[F.collect_list(c).alias(c) for c in ("at", *columns)])
    return own.join(found, "row", "left")


def rare_words(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    """For each row of with_words(): counts and expected counts in each state, 0 for words that the table lacks.

    columns: those of the counts and of all states but the last, in UNITs.
    """
    at, values = batch.column("at"), [lists(batch.column(c)) for c in columns]
    places, null = lists(at), at.is_null().to_numpy(zero_copy_only=False)
    out = []
    for i, n in enumerate(batch.column("n_rare").to_pylist()):
        x = np.zeros((len(columns) + 1, n))
        if not null[i]:
            x[0, places[i]] = values[0][i]
            for k, own in enumerate(values[1:]):
                x[k + 1, places[i]] = own[i] / UNIT
            x[-1] = np.maximum(x[0] - x[1:-1].sum(0), 0)
        out.append(x)
    return out


def joined(parts: list[np.ndarray], at: list[int]) -> np.ndarray:
    return np.concatenate([parts[i] for i in at], axis=-1)


def train_model(codes: DataFrame, voc: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, DataFrame | None, list[float]]:
    """Baum-Welch over the coded training rows; the rarer words' expected counts; each round's log likelihood before it.

    A task sums its own expected counts; one row for each symbol and task is shuffled, and the sums, as many as the
    bounded model has symbols, come to the driver. The rarer words' emissions are tied to their classes until the last
    round, in which their expected counts are summed by word, too, and stay a table. Untying them in the last
    maximisation raises the likelihood as any other, and saves a join of all their occurrences in each round. The log
    likelihoods are those of symbols. Without rarer words, or without rounds, there is no table.
    """
    model, seen, words = first_model(voc, states), [], None
    columns = [f"s{k}" for k in range(states)]
    prior = np.concatenate([voc.head_counts, voc.class_tokens, [voc.ends]]) + 0.5
    prior /= prior.sum()
    head = len(voc.head)
    for turn in range(rounds):
        sent = codes.sparkSession.sparkContext.broadcast(model)
        with_rare = turn == rounds - 1 and bool(voc.class_words.sum())

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            k, size = m.emit.shape
            names = ["symbol", "word", *columns]
            total = np.zeros((k, size + k + 2))  # emissions, moves, starts, log likelihood
            for batch in batches:
                prints = lists(batch.column("rare")) if with_rare else []
                for at, docs in pieces(symbols_of(batch.column("codes"))):
                    rare, posteriors = None, None
                    if with_rare:
                        flat = np.concatenate(docs)
                        rare, posteriors = np.flatnonzero((flat >= head) & (flat < size - 1)), []
                    start, moves, emitted, ll = m.counts(docs, rare, posteriors)
                    total[:, :size] += emitted
                    total[:, size : size + k] += moves.T
                    total[:, -2] += start
                    total[0, -1] += ll / UNIT
                    if with_rare and len(rare):
                        one, of = np.unique(joined(prints, at), return_inverse=True)
                        sums = [np.rint(UNIT * np.bincount(of, g, len(one))).astype(np.int64) for g in posteriors[0]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), -1, np.int32)), pa.array(one), *map(pa.array, sums)], names)
            total = np.rint(UNIT * total).astype(np.int64)
            some = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.zeros(len(some), np.int64)), *[pa.array(total[s, some]) for s in range(k)]], names)

        x = codes.filter("train").select("codes", *["rare"] * with_rare)
        sums = x.mapInArrow(expect, "symbol int, word long, " + ", ".join(f"{c} long" for c in columns))
        sums = sums.groupBy("symbol", "word").agg(*[F.sum(c).alias(c) for c in columns])
        if with_rare:
            sums = written(sums, "expected")
            words = sums.filter("symbol < 0").select("word", F.round(sum(F.col(c) for c in columns) / UNIT).cast("long").alias("c"), *columns[:-1])
        total = np.zeros((states, voc.size + states + 2))
        for r in sums.filter("symbol >= 0").drop("word").collect():  # at most a row for each symbol
            total[:, r[0]] = np.array(r[1:]) / UNIT
        emit = total[:, : voc.size] + 0.1 * prior * states
        move, start = total[:, voc.size : voc.size + states].T + 0.1, total[:, -2] + 0.1
        seen.append(float(total[0, -1] * UNIT))
        ratio = np.zeros_like(emit)
        ratio[:, head:-1] = voc.class_tokens / np.maximum(total[:, head : voc.size - 1] + LEAN * voc.class_tokens, 1e-300)
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), ratio)
    return model, words, seen


def score(codes: DataFrame, counts: DataFrame, voc: Vocabulary, model: Model, words: DataFrame | None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for each coded row.

    A text of any length is one exact forward recursion. Words outside the head get their counts by a shuffle join.
    """
    sent = codes.sparkSession.sparkContext.broadcast((voc, model))
    kind = codes.schema["doc_id"].dataType.simpleString()
    columns = ["c", *(f"s{k}" for k in range(len(model.start) - 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = sent.value
        head, at_all = len(v.head), math.log10(v.tokens + v.types + 1)
        base_of = np.concatenate([np.log10(v.head_counts + 1), np.zeros(CLASSES), [math.log10(v.ends + 1)]]) - at_all
        within = np.concatenate([np.zeros(head), -np.log10(v.class_tokens + v.class_words + 1), [0.0]])
        known_of = np.concatenate([np.ones(head), np.zeros(CLASSES), [float(v.ends > 0)]])
        for batch in batches:
            owns = rare_words(batch, columns)
            for at, docs in pieces(symbols_of(batch.column("codes"))):
                sizes = np.array([len(d) for d in docs])
                flat, of = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
                rare, own = np.flatnonzero((flat >= head) & (flat < v.size - 1)), joined(owns, at)
                expected = own[1:] + LEAN * own[0]
                known, base, inner = (np.bincount(of, x[flat], len(docs)) for x in (known_of, base_of, within))
                known += np.bincount(of[rare], own[0] > 0, len(docs))
                base += np.bincount(of[rare], np.log10(own[0] + 1), len(docs))
                found = m.log10_likelihoods(docs, rare, expected if m.ratio is not None else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(found + inner)],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    if words is None and voc.class_words.sum():  # no round was made
        words = counts.select("word", "c", *[F.lit(0).cast("long").alias(c) for c in columns[1:]])
    # words that training lacks have no row there: they count 0, and their share of the class is the unknown word's
    x = with_words(codes, words, columns).drop("row")
    x = x.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return x.select("doc_id", "n_tokens", "n_known", F.lit(voc.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def fit_and_score(docs: DataFrame, is_train, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the rows where `is_train` holds (null counts as false) and scores all rows, one for one.

    A null text counts as empty: one token, the end. Repeated rows, equal ids too, each get their own row. A text of any
    length is one sequence; words of equal counts enter the head together or not at all. Without
    training rows nothing is known and the model is uniform. An empty table gives an empty one; other columns of docs,
    whatever their names, are left out.
    """
    train = docs.filter(F.coalesce(is_train, F.lit(False)))
    counts = written(count_words(train, text), "words")
    voc = vocabulary(counts, train.count())
    codes = coded(docs, voc, is_train, doc_id, text)
    model, words, _ = train_model(codes, voc, states, rounds)
    return score(codes, counts, voc, model, words)
