"""Packing tokenised documents into sequences by length patterns.

The pieces' lengths are a histogram of at most `capacity` bins. Patterns of a few lengths that fill a sequence are
enumerated from it, repeat counts are fitted to the histogram by non-negative least squares and rounded so that their
sums are kept; the same is done with what is left, and the residual that no pattern fits is packed by best fit on the
histogram. Pieces then find their places by their rank among those of equal length.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .wordhash import fingerprints, in_pieces

CAPACITY, END_ID = 4096, 1
#: Distinct words whose ids a Python worker keeps.
CACHED = 1_000_000
#: Tokens of a sequence that a pattern may leave free.
ROOM = 2
#: Second lengths tried for each first one, lengths in a pattern, times that patterns are fitted to what is left, steps of
#: a fit at most, and the relative change that ends it.
ALTERNATIVES, MOST_ITEMS, FITS, STEPS, SETTLED = 10, 16, 8, 1000, 2e-5
#: Parts that pieces of one length are dealt to when they are ranked.
SALTS = 64

_TOKENIZERS: dict[str, "WordTokenizer"] = {}
#: Bytes at which texts are cut, those of plain letters, and ASCII ones that are neither of these nor digits.
_GAP, _LETTER, _SIGN = (np.array([f(b) for b in range(256)]) for f in (lambda b: b in b" \t\n\r", lambda b: 97 <= b <= 122, lambda b: 32 < b < 127 and not chr(b).isalnum()))


class WordTokenizer:
    """Ids of whole texts from ids of their words, for tokenizers that lower-case texts and keep tokens within words.

    Texts are cut at white space and between a plain letter and a sign, where no token reaches across. Words are told
    apart by fingerprints in numpy; those that are new to the worker are encoded, and a table keeps their ids. Texts that
    hold a special token's string, and all texts of a tokenizer of another kind, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["The", "end", ".", "Of", "it", "'s", "(", "a", ")", "b", ",", "x", "-", "y", "3", "Été"]
        together = " ".join(probe).replace(" .", ".").replace(" 's", "'s").replace("a )", "a)").replace("b ,", "b,")
        plain = [i for w in probe for i in self._plain(w.replace("T", "t").replace("O", "o"))]
        self.by_words = plain == self._plain(together) == self._plain(together.replace(" ", "\n\t"))
        self._forget()

    def _forget(self) -> None:
        self.prints, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        apart = [bool(t) and (not self.by_words or any(s in t or s in t.lower() for s in self.special if s[:1] in t)) for t in texts]
        coded = [t.encode() if t and not x else b"" for t, x in zip(texts, apart, strict=True)]
        ids, ends = self._by_words(coded)
        out = [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i, x in enumerate(apart):
            if x:
                out[i] = np.array(self._plain(texts[i]), "<u4").tobytes()
        return out

    def _by_words(self, coded: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts in turn and where each text's end."""
        whole = (b" " + b" ".join(coded) + b" ").lower()
        b = np.frombuffer(whole, np.uint8)
        inside = ~_GAP[b]
        before = np.concatenate([[False], inside[:-1]])
        begins = inside & (~before | np.concatenate([[False], _LETTER[b[:-1]]]) & _SIGN[b])
        start = np.flatnonzero(begins)
        after = np.append(begins[1:], False) | ~np.append(inside[1:], False)
        end = np.flatnonzero(inside & after) + 1
        prints, at, of = np.unique(fingerprints(b, start, end), return_index=True, return_inverse=True)
        if len(self.prints) > CACHED:
            self._forget()
        place = np.searchsorted(self.prints, prints)
        new = place == len(self.prints)
        new[~new] = self.prints[place[~new]] != prints[~new]
        if new.any():
            self._learn(prints[new], [whole[i:j].decode() for i, j in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            place = np.searchsorted(self.prints, prints)
        place = place[of]
        count = self.count[place]
        upto = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[place] - (upto - count), count) + np.arange(count.sum())]
        text_ends = np.searchsorted(start, 1 + np.cumsum([len(c) + 1 for c in coded])) if coded else np.zeros(0, int)
        return ids, np.concatenate([[0], upto])[text_ends].tolist()

    def _learn(self, prints: np.ndarray, words: list[str]) -> None:
        """Words of plain letters are single entries of the model; others are encoded side by side and told apart by offsets."""
        plain = np.array([w.isascii() and w.isalpha() for w in words])
        order = [*np.flatnonzero(plain).tolist(), *np.flatnonzero(~plain).tolist()]
        ids: list[int] = []
        ends: list[int] = []
        tokenize = self.tokenizer.model.tokenize
        for i in order[: int(plain.sum())]:
            ids += [t.id for t in tokenize(words[i])]
            ends.append(len(ids))
        for a in range(len(ends), len(order), 64):
            part = [words[i] for i in order[a : a + 64]]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            cuts = np.searchsorted([o[0] for o in e.offsets], np.cumsum([len(w) + 1 for w in part]))
            ends += (cuts + len(ids)).tolist()
            ids += e.ids
        end = np.array(ends)
        first = np.concatenate([[0], end[:-1]])
        both = np.concatenate([self.prints, prints[order]])
        by = np.argsort(both, kind="stable")
        self.prints, self.first, self.count = both[by], np.concatenate([self.first, first + len(self.pool)])[by], np.concatenate([self.count, end - first])[by]
        self.pool = np.concatenate([self.pool, np.array(ids, "<u4")])


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: the documents cut into pieces of `capacity`.

    A null text counts as empty; every document ends in END_ID, so none is without a piece.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            for first, texts in in_pieces(batch.column(1).to_pylist()):
                rows, at = [], []
                for i, ids in enumerate(_tokenizer(tokenizer).encode(texts)):
                    ids += end
                    for k in range(0, len(ids), size):
                        part = ids[k : k + size]
                        rows.append((k // size, k // 4, len(part) // 4, zlib.crc32(part), part))
                        at.append(first + i)
                piece, start, length, crc, own = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    places = np.concatenate([[0], np.cumsum(length)])
                    columns.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.frombuffer(b"".join(own), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, how often in a sequence), ...), sequences of this kind


def patterns(have: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(room left, {length: times}) of a few lengths that exist: for each first length several second ones, then what fills up.

    A room is filled by one length or by two if any fill it exactly, else by the largest that fits.
    """
    capacity = len(have) - 1
    lengths, exists = np.flatnonzero(have), have > 0
    best = np.maximum.accumulate(np.where(exists, np.arange(capacity + 1), 0))  # the largest length that fits into a room
    halves: dict[int, np.ndarray] = {}  # the smaller ones of two lengths that fill a room

    def smaller(room: int) -> np.ndarray:
        if room not in halves:
            a = lengths[: np.searchsorted(lengths, room // 2, side="right")]
            a = a[exists[room - a]]
            halves[room] = a[(2 * a != room) | (have[a] > 1)]
        return halves[room]

    found: dict[tuple, tuple[int, dict[int, int]]] = {}
    for first in lengths[::-1].tolist():
        room = capacity - first
        fitting = lengths[: np.searchsorted(lengths, min(first, room), side="right")]
        seconds = {int(best[room]) if best[room] <= first else 0, *fitting[np.linspace(0, len(fitting) - 1, min(ALTERNATIVES, len(fitting))).astype(int)].tolist()}
        for k, take in enumerate(sorted(seconds)):
            items, left, n = {first: 1}, room, 1
            while take and n < MOST_ITEMS:
                items[take], left, n = items.get(take, 0) + 1, left - take, n + 1
                pairs = smaller(left) if left and not exists[left] else ()
                take = left if exists[left] else int(pairs[(7 * k + first) % len(pairs)]) if len(pairs) else int(best[left])
            if all(have[i] >= m for i, m in items.items()):
                found[tuple(sorted(items.items()))] = left, items
    return list(found.values())


def fitted(have: np.ndarray, pats: list[dict[int, int]]) -> np.ndarray:
    """Non-negative least squares of the patterns' counts to the histogram, by accelerated projected gradients.

    Each length's difference counts with its tokens, so that a few long pieces weigh as much as many short ones.
    """
    if not pats:
        return np.zeros(0)
    pat = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    length = np.array([k for p in pats for k in p])
    weight = np.arange(len(have)) / len(have)
    times = np.array([n for p in pats for n in p.values()]) * weight[length]
    h = have * weight
    made = lambda x: np.bincount(length, x[pat] * times, len(h))
    pulled = lambda r: np.bincount(pat, times * r[length], len(pats))
    v = np.ones(len(pats))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = pulled(made(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(y - step * pulled(made(y) - h), 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        back = (y - new) @ (new - x) > 0  # the momentum leads uphill
        y, t = (new, 1.0) if back else (new + (t - 1) / s * (new - x), s)
        moved = np.abs(new - x).sum()
        x = new
        if moved <= SETTLED * x.sum():
            break
    return x


def by_patterns(have: np.ndarray) -> tuple[list[Group], np.ndarray]:
    """Groups of equal sequences by fitted patterns, and the histogram of the pieces that are left.

    Counts are rounded along the patterns' order, the longest first, so that each stretch of patterns gets its sum: many
    patterns of less than one sequence still give whole ones. No piece is used twice; patterns are then enumerated and
    fitted again for what is left. Only patterns that leave next to no room take part, or those that leave the least at
    first, so that the rest isn't packed worse than best fit would.
    """
    left, out, room = have.astype(np.int64).copy(), [], None
    for _ in range(FITS):
        found = patterns(left)
        room = max(ROOM, min((r for r, _ in found), default=0)) if room is None else room
        pats = sorted((p for r, p in found if r <= room), key=lambda p: (-max(p), -min(p)))
        upto = np.floor(np.cumsum(fitted(left, pats)) + 0.5)
        before = left.sum()
        for p, n in zip(pats, np.diff(upto, prepend=0).astype(np.int64).tolist(), strict=True):
            n = min([n, *(int(left[k]) // m for k, m in p.items())])
            if n:
                for k, m in p.items():
                    left[k] -= n * m
                out.append((tuple(sorted(p.items(), reverse=True)), n))
        if before - left.sum() <= 0.002 * before:
            break
    return out, left


def best_fit(have: np.ndarray) -> list[Group]:
    """Best fit, the longest first, over groups of equal sequences: its work grows with lengths, not with pieces."""
    capacity = len(have) - 1
    waiting: dict[int, list[list]] = {}  # room left: [items, sequences]
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, items: dict[int, int], n: int) -> None:
        waiting.setdefault(room, []).append([items, n])
        rooms[room] = True

    for size in np.flatnonzero(have)[::-1]:
        size, left = int(size), int(have[size])
        while left:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                items, n = waiting[room].pop()
                if not waiting[room]:
                    rooms[room] = False
            else:
                room, items, n = capacity, {}, -(-left // (capacity // size))
            each = room // size
            full = min(n, left // each)
            if full:
                put(room - each * size, items | {size: each}, full)
                left -= full * each
            if full < n and left:
                put(room - left * size, items | {size: left}, 1)
                n, left = n - 1, 0
            if n - full > 0 and items:
                put(room, items, n - full)
    return [(tuple(sorted(items.items(), reverse=True)), n) for groups in waiting.values() for items, n in groups]


def plan(have: np.ndarray) -> list[Group]:
    """Groups of equal sequences that hold every piece of the histogram exactly once."""
    groups, left = by_patterns(have)
    return groups + best_fit(left)


def places(groups: list[Group], capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Runs of ranks: key (length, first rank), first sequence, offset; pieces of a run lie in consecutive sequences."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for items, n in groups:
        offset = 0
        for size, times in items:
            for _ in range(times):
                rows.append((size, int(rank[size]), sequence, offset))
                rank[size] += n
                offset += size
        sequence += n
    rows.sort()
    size, first, seq, off = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return (size << 44) + first, first, seq, off


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...): gapless from 0 within each sequence.

    Only the histogram, of at most `capacity` rows, comes to the driver, and the plan, whose size depends on it alone,
    goes out. Ranks among pieces of one length are counted within salts and shifted by the salts before, so that no
    length, however common, meets in one task.
    """
    cut = written(cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    have = np.zeros(capacity + 1, np.int64)
    by_salt = cut.groupBy("length", "_salt").agg(F.count("*").alias("_n")).checkpoint()
    for r in by_salt.groupBy("length").agg(F.sum("_n")).collect():
        have[r[0]] = r[1]
    sent = cut.sparkSession.sparkContext.broadcast(places(plan(have), capacity))
    before = by_salt.alias("a").join(by_salt.select("length", F.col("_salt").alias("_s"), F.col("_n").alias("_m")), "length")
    before = before.groupBy("length", "_salt").agg(F.sum(F.when(F.col("_s") < F.col("_salt"), F.col("_m")).otherwise(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order)).join(before, ["length", "_salt"])
    ranked = ranked.select(*[c for c in cut.columns if c != "_salt"], (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, seq, off = sent.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq[at] + rank - first[at]), pa.array(off[at])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cuts, ranks and packs all documents; a row for each piece. See pieces() and pack().

    Ids may be null or repeat: each row is packed. Pieces of one length are alike to the plan and ranked by id and piece.
    Texts of any length are cut, an empty table gives an empty one, and
    other columns, whatever their names, are left out.
    """
    return pack(pieces(docs, tokenizer, doc_id, text, capacity, with_ids), capacity)
