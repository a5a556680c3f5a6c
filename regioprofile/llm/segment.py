"""Sampling SentencePiece segmentations without replacement, and decoding them.

A text's lattice has every way to write it in pieces of the model. Pieces get weights by their rank in the vocabulary,
backward sums turn these into the conditional chance of each next piece, and Gumbel top-k draws k different paths by a
best-first search: a path drawn leaves behind, at each of its steps, all paths that branch off there, with the largest
perturbed value among them; the next path starts at the largest of these. The value of the best branch left after the
last path gives each path's inclusion score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plainwords import in_slices
from .wordhash import fingerprints, in_pieces, mix

#: Fixed value: stands for a space in pieces.
SPACE = "▁"
#: Paths for each text, and how strongly frequent pieces are preferred (weight = (10 + rank) ** -SHARP).
PATHS, SHARP = 2, 0.4
#: Characters of text whose lattices are held together.
PIECE_CHARS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0x100000001B3)
_ALL = (1 << 64) - 1


class Pieces:
    """The model's pieces: fingerprints of all their beginnings, weights, bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = len(sp)
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any("\n" in names[i] or SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("pieces reach across words: this model's texts can't be cut at spaces and line breaks")
        self.byte_id = {int(names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.bytes = [bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: -sp.get_score(i)))}
        self.log_weight = np.array([-SHARP * np.log(10 + rank.get(i, size)) for i in range(size)])
        self.byte_weight = float(self.log_weight.min())
        self.byte_table = np.array([self.byte_id.get(b, 0) for b in range(0x80)], np.int32)
        self.longest = max(len(names[i]) for i in plain)
        known: dict[int, int] = {}
        for i in plain:
            for k, h in enumerate(_beginnings(names[i])):
                known[h] = i if k == len(names[i]) - 1 else known.get(h, -1)
        # an open hash table, of which at most an eighth is used: id of a whole piece, -1 of a beginning, -2 of nothing
        bits = (8 * len(known)).bit_length()
        self.shift, self.prints, self.ids = np.uint64(64 - bits), np.zeros((1 << bits) + len(known), np.uint64), np.full((1 << bits) + len(known), -2, np.int32)
        for h, i in known.items():
            at = (h * int(_ODD) & _ALL) >> 64 - bits
            while self.ids[at] != -2:
                at += 1
            self.prints[at], self.ids[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids by fingerprint: -1 for a beginning of pieces, -2 for none."""
        at = (h * _ODD >> self.shift).astype(np.int64)
        out, same = self.ids[at], self.prints[at] == h
        on = np.flatnonzero(~same & (out != -2))
        out[on] = -2
        while len(on):
            at[on] += 1
            ids = self.ids[at[on]]
            hit = self.prints[at[on]] == h[on]
            out[on[hit]] = ids[hit]
            on = on[~hit & (ids != -2)]
        return out


def _beginnings(piece: str) -> list[int]:
    """Fingerprints of the piece's beginnings: polynomials of their characters modulo 2**64."""
    h, out = 0, []
    for c in piece:
        h = (h * int(_MULTIPLIER) + ord(c) + 1) & _ALL
        out.append(h)
    return out


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in turn, a space put before each that isn't empty, and each one's number of them."""
    spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    return np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in spaced], np.int64)


def cut(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where segments start: at texts, at each run of spaces, at line breaks and behind them; no piece crosses a cut."""
    space, line = points == ord(SPACE), points == 10
    first = space | line
    first[1:] &= ~(space[1:] & space[:-1])  # of a run of spaces the first
    first[1:] |= line[:-1]
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return np.flatnonzero(first)


class Lattice:
    """Lattices of segments side by side. Edges of one place are neighbours: id, end, chance, logarithm of it."""

    def __init__(self, pieces: Pieces, own: np.ndarray, size: np.ndarray):
        """own: code points of all segments in turn; size: how many each has."""
        self.start = np.cumsum(size + 1) - size - 1
        points = np.zeros(len(own) + len(size), np.uint32)  # a place behind each segment is its end
        points[np.arange(len(own)) + np.repeat(np.arange(len(size)), size)] = own
        wide = points.astype(np.uint64) + np.uint64(1)
        n = len(points)
        left = np.repeat(size + self.start, size + 1) - np.arange(n)  # characters up to the segment's end
        self.last = left == 0
        # matches, by length: a place stays in the search while its characters begin a piece
        matches = []
        at = np.flatnonzero(left)
        h = np.zeros(len(at), np.uint64)
        spelled = left > 0
        for k in range(pieces.longest):
            more = left[at] > k
            at = at[more]
            h = h[more] * _MULTIPLIER + wide[at + k]
            ids = pieces.find(h)
            some = ids > -2
            at, h, ids = at[some], h[some], ids[some]
            whole = ids >= 0
            if k == 0:
                spelled[at[whole]] = False
            matches.append((at[whole], k + 1, ids[whole], pieces.log_weight[ids[whole]]))
            if not len(at):
                break
        # characters without a piece are spelled in bytes; id -2 stands for several bytes
        at = np.flatnonzero(spelled)
        c = points[at]
        ids = np.where(c < 0x80, pieces.byte_table[np.minimum(c, 0x7F)], -2)
        matches.append((at, 1, ids, pieces.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
        # places in the order of `left`, so that each place's ends come before it
        order = np.argsort(left.astype(np.uint16 if left.max(initial=0) < 1 << 16 else np.int64), kind="stable")
        count = np.zeros(n, np.int64)
        for at, *_ in matches:
            count[at] += 1
        in_order = np.cumsum(count[order])
        self.first = np.empty(n, np.int64)
        self.first[order] = in_order - count[order]
        edges = int(in_order[-1]) if n else 0
        self.place, self.ids, weight, step = np.empty(edges, np.int64), np.empty(edges, np.int32), np.empty(edges), np.empty(edges, np.int64)
        used = self.first.copy()
        for at, k, ids, w in reversed(matches):  # long pieces, the likelier ones, first: choose() goes through them in turn
            e = used[at]
            used[at] += 1
            self.place[e], self.ids[e], weight[e], step[e] = at, ids, w, k
        self.to = self.place + step
        self.count = count
        total = np.zeros(n)
        cut = np.searchsorted(left[order], np.arange(int(left.max(initial=0)) + 2))
        for r in range(1, len(cut) - 1):
            p = order[cut[r] : cut[r + 1]]
            if not len(p):
                continue
            a, b = self.first[p[0]], self.first[p[-1]] + count[p[-1]]
            heads = self.first[p] - a
            own = weight[a:b] + total[self.to[a:b]]
            top = np.maximum.reduceat(own, heads)
            t = top + np.log(np.add.reduceat(np.exp(own - np.repeat(top, count[p])), heads))
            total[p] = t
            weight[a:b] = own - np.repeat(t, count[p])
        self.log_chance, self.chance, self.chars = weight, np.exp(weight), points

    def choose(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place, by a number in [0, 1)."""
        edge, end = self.first[place], self.first[place] + self.count[place] - 1
        left = u - self.chance[edge]
        on = np.flatnonzero((left >= 0) & (edge < end))
        while len(on):
            edge[on] += 1
            left[on] -= self.chance[edge[on]]
            on = on[(left[on] >= 0) & (edge[on] < end[on])]
        return edge

    def walk(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps from each start to its segment's end, and the edges of all steps in turn."""
        steps = np.zeros(len(start), np.int64)
        live = np.flatnonzero(~self.last[start])
        place, taken = start[live], []
        while len(live):
            edge = self.choose(place, uniform(key[live] + np.uint64(len(taken) * 0x9E3779B97F4A7C15 & _ALL)))
            taken.append((live, edge))
            steps[live] += 1
            place = self.to[edge]
            on = ~self.last[place]
            live, place = live[on], place[on]
        off = np.cumsum(steps) - steps
        edges = np.empty(steps.sum(), np.int64)
        for k, (who, e) in enumerate(taken):
            edges[off[who] + k] = e
        return steps, edges


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(mix(key + _ODD) + _ODD) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _cut_gumbel(loc: np.ndarray, top, key: np.ndarray) -> np.ndarray:
    """Gumbel values at loc, given that they don't exceed top; -inf for a location of -inf."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(np.minimum(loc - top, 700.0)) - np.log(uniform(key))))


def _log(x: np.ndarray) -> np.ndarray:
    """Logarithms of chances; those too small to be more than rounding count as none."""
    return np.log(x, out=np.full(x.shape, -np.inf), where=x > 1e-13)


class _Drawn:
    """A drawn path and, for its steps from `first` on, the largest perturbed value among what branches off there."""

    def __init__(self, path: np.ndarray, first: int, values: np.ndarray):
        self.path, self.first, self.values, self.gone = path, first, values, {}


def sample_texts(pieces: Pieces, texts: list[str], keys: np.ndarray, paths: int = PATHS) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """(text, sample, ids, log chance, log inclusion score) of up to `paths` different segmentations of each text."""
    points, sizes = points_of(texts)
    at = cut(points, sizes)
    length = np.diff(at, append=len(points))
    _, one, which = np.unique(fingerprints(points, at, at + length), return_index=True, return_inverse=True)
    by = np.argsort(one)  # in the order of their first places, so that frequent ones lie together
    one, which = one[by], np.argsort(by)[which]
    whole = np.repeat(at[one] - (np.cumsum(length[one]) - length[one]), length[one]) + np.arange(length[one].sum())
    lat = Lattice(pieces, points[whole], length[one])
    start = lat.start[which]
    bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))
    n_seg, first_seg = np.diff(bounds), bounds[:-1]
    doc_of = np.repeat(np.arange(len(texts)), n_seg)
    seg_key = lambda path, doc, k: mix(keys[doc] + np.uint64((path + 1) * 0xD6E8FEB86659FD93 & _ALL) + k.astype(np.uint64) * _ODD)

    def branch_values(edges: np.ndarray, doc: np.ndarray, begin: np.ndarray, before, top, path: int) -> np.ndarray:
        """Values of what branches off along stretches of steps; begin: first step of each step's stretch."""
        own = lat.log_chance[edges]
        upto = np.cumsum(own) - own
        loc = before + (upto - upto[begin]) + _log(1 - lat.chance[edges])
        return _cut_gumbel(loc, top, mix(keys[doc] + np.uint64((path + 77) * 0xA0761D6478BD642F & _ALL)) + (np.arange(len(edges)) - begin).astype(np.uint64) * _ODD)

    root = -np.log(-np.log(uniform(mix(keys + np.uint64(5)))))
    steps, edges = lat.walk(start, seg_key(0, doc_of, np.arange(len(doc_of)) - first_seg[doc_of]))
    seg_end = np.concatenate([[0], np.cumsum(steps)])
    doc_start, doc_end = seg_end[first_seg], seg_end[first_seg + n_seg]
    step_doc = np.repeat(doc_of, steps)
    values = branch_values(edges, step_doc, doc_start[step_doc], 0.0, root[step_doc], 0)
    drawn = [[_Drawn(edges[a:b], 0, values[a:b])] for a, b in zip(doc_start.tolist(), doc_end.tolist(), strict=True)]

    def best(own: list[_Drawn]) -> tuple[float, _Drawn | None, int]:
        top = (-np.inf, None, 0)
        for x in own:
            if len(x.values):
                i = int(x.values.argmax())
                if x.values[i] > top[0]:
                    top = (float(x.values[i]), x, i)
        return top

    for path in range(1, paths):
        heads, starts, start_keys, stretch = [], [], [], []
        u = uniform(mix(keys + np.uint64(1000 + path))).tolist()
        for d, own in enumerate(drawn):
            value, x, i = best(own)
            if x is None:
                continue
            at = x.first + i
            place = int(lat.place[x.path[at]])
            a = int(lat.first[place])
            chance = lat.chance[a : a + lat.count[place]].copy()
            gone = x.gone.setdefault(at, [int(x.path[at]) - a])
            chance[gone] = 0.0
            edge = min(int((np.cumsum(chance) <= u[d] * chance.sum()).sum()), int(np.flatnonzero(chance)[-1]))
            gone.append(edge)
            chance[edge] = 0.0
            head = np.append(x.path[:at], a + edge)
            logs = lat.log_chance[head]
            x.values = x.values.copy()
            x.values[i] = _cut_gumbel(logs[:-1].sum() + _log(chance.sum(keepdims=True)), value, mix(keys[d : d + 1] + np.uint64(2000 + path)))[0]
            done = int(lat.last[lat.to[head[:-1]]].sum())  # segments that end before the new edge
            heads.append((d, value, head, float(logs.sum())))
            starts += [lat.to[head[-1:]], start[first_seg[d] + done + 1 : first_seg[d] + n_seg[d]]]
            start_keys.append(np.arange(done, n_seg[d]))
            stretch.append(n_seg[d] - done)
        if not heads:
            break
        doc = np.array([h[0] for h in heads])
        steps, edges = lat.walk(np.concatenate(starts), seg_key(path, np.repeat(doc, stretch), np.concatenate(start_keys)))
        n_steps = np.add.reduceat(steps, np.cumsum(stretch) - stretch)
        begin = np.cumsum(n_steps) - n_steps
        spread = lambda x: np.repeat(np.array(x), n_steps)
        values = branch_values(edges, spread(doc), spread(begin), spread([h[3] for h in heads]), spread([h[1] for h in heads]), path)
        for (d, _, head, _), a, n in zip(heads, begin.tolist(), n_steps.tolist(), strict=True):
            drawn[d].append(_Drawn(np.concatenate([head, edges[a : a + n]]), len(head), values[a : a + n]))
    for d, own in enumerate(drawn):
        limit = best(own)[0]
        for k, x in enumerate(own):
            ids, chance = lat.ids[x.path], float(lat.log_chance[x.path].sum())
            if len(ids) and ids.min() < 0:
                spelled = [[i] if i >= 0 else [pieces.byte_id[b] for b in chr(int(lat.chars[lat.place[e]])).encode("utf-8", "surrogatepass")] for i, e in zip(ids.tolist(), x.path, strict=True)]
                ids = np.fromiter(chain.from_iterable(spelled), np.int32)
            over = chance - limit  # of the path's own location over the value that the next path has
            yield d, k, ids, chance, 0.0 if over > 700 else float(over if over < -30 else np.log(-np.expm1(-np.exp(over))))


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", paths: int = PATHS, seed: int = 0) -> DataFrame:
    """doc_id, sample, ids, n_pieces, log_chance, log_inclusion, ids_crc32: up to `paths` segmentations of each row.

    Draws depend on the row's id and the seed alone. The segmentations of a row differ; a text that has fewer gets all
    of them, then with inclusion score 1 (logarithm 0). A null or empty text has one, without pieces. Repeated rows get
    equal draws; null ids share one key; a text of any length has one lattice, the product of its segments'; other columns
    are left out, whatever their names; an empty table gives an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _pieces(model)
        for batch in (part for whole in batches for part in in_slices(whole, "text")):  # few texts are Python objects at a time
            keys = batch.column(2).to_numpy().view(np.uint64)
            for first, texts in in_pieces(batch.column(1).to_pylist(), PIECE_CHARS):
                who, sample, ids, chance, inclusion = zip(*sample_texts(held, [t or "" for t in texts], keys[first : first + len(texts)], paths), strict=True)
                sizes = [len(x) for x in ids]
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.array(who) + first)), pa.array(sample, pa.int32()), flat, pa.array(sizes, pa.int32()), pa.array(chance), pa.array(inclusion), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                    ["doc_id", "sample", "ids", "n_pieces", "log_chance", "log_inclusion", "ids_crc32"],
                )

    key = F.xxhash64(F.col(doc_id).cast("string"), F.lit(seed))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key")).mapInArrow(
        run, f"doc_id {kind}, sample int, ids array<int>, n_pieces int, log_chance double, log_inclusion double, ids_crc32 long"
    )


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Replaces the column of ids by the text they stand for; null ids give a null text, ids without bytes nothing."""
    rest = [c for c in df.columns if c not in (ids, into)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(_pieces(model).bytes, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = part.column(ids)
                offsets = own.offsets.to_numpy().astype(np.int64)
                spelled = table.take(own.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
                whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets - offsets[0]), spelled), pa.scalar(b"", pa.large_binary())).to_pylist()
                texts = [None if none else x.decode("utf-8", "replace").removeprefix(" ") for x, none in zip(whole, own.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, into])

    return df.select(*[f"`{c}`" for c in rest], ids).mapInArrow(run, (kinds + ", " if kinds else "") + f"`{into}` string")
