"""Language identification by cross-parsing: how few phrases of a language's own text does a text fall into?

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in that sample; related text needs few, long phrases. The number of phrases is normalised by
the logarithm of the sample's length, so that a language of which little text is labelled is not at a disadvantage. The automata share one table of their
transitions, whose size follows the samples and not their alphabets, so that numpy steps through thousands of
text blocks and all languages at a time. A block starts a phrase of its own; where the phrase from the block before ends
is then followed until both parses start a phrase at the same place, so that no count depends on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Labelled rows drawn for each language, and characters of them that its automaton holds: the bounds of the fit.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 32_000
#: Characters of a text that are stepped through one after another.
BLOCK = 1024
#: Blocks whose parses haven't met their own yet that are followed one by one.
FEW = 24
#: Blocks that are stepped through together.
BLOCKS_AT_ONCE = 6_000


def _letters() -> np.ndarray:
    """For each code point of the first plane: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


_LETTERS: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letters())
    high = points > 0xFFFF
    out = _LETTERS[0][np.where(high, 0, points)]
    if high.any():
        out[high] = [chr(p).isalpha() for p in points[high]]
    return out


def letters_and_gaps(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-case texts with each run of other characters as one space; each text's length, letters."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.zeros(0, np.int64)
    letter = is_letter(points)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of a run of others
    place = np.concatenate([[0], np.cumsum(kept)])
    n_letters = np.concatenate([[0], np.cumsum(letter)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    ends = np.maximum(ends - 1, starts)  # without the line break between texts
    lengths = place[ends] - place[starts]
    # the line break behind a text that ends in a letter is kept; it belongs to no text
    own = np.zeros(len(points), bool)
    for a, b in zip(starts, ends, strict=True):
        own[a:b] = True
    chosen = kept & own
    return np.where(letter[chosen], points[chosen], 32), lengths, n_letters[ends] - n_letters[starts]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of codes: for each state, the next state by code."""
    follow: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in codes:
        new = len(follow)
        follow.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if depth[p] + 1 == depth[q]:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                depth.append(depth[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
        last = new
    return follow


class Transitions:
    """Next states by (state, code) in arrays as large as a few times the number of transitions, whatever the alphabet.

    Each state has a shift, chosen so that the places shift + code of all transitions differ; a place knows its state.
    States draw their shifts at random, those of most transitions first, and again where a place is taken. State 0 has
    no transitions.
    """

    def __init__(self, states: np.ndarray, codes: np.ndarray, to: np.ndarray, width: int):
        """Pairs in rising order of states, which are 1 or more; codes below width."""
        n_states = int(max(states.max(initial=0), to.max(initial=0))) + 1
        size = 1 << max(8, int(4 * len(states) + 2 * width).bit_length())
        rng = np.random.default_rng(0)
        degree = np.bincount(states, minlength=n_states)
        first = np.cumsum(degree) - degree
        self.shift = np.zeros(n_states, np.int32)
        self.owner, self.to = np.full(size + width, -1, np.int32), np.zeros(size + width, np.int32)
        waiting = np.flatnonzero(degree)
        waiting = waiting[np.argsort(-degree[waiting], kind="stable")]
        while len(waiting):
            # about as many transitions at a time as are placed already, so that large states meet an empty table
            some = waiting[: max(1, int(np.searchsorted(np.cumsum(degree[waiting]), max(64, np.count_nonzero(self.owner >= 0)))))]
            self.shift[some] = rng.integers(0, size, len(some))
            own = np.repeat(some, degree[some])
            pair = np.repeat(first[some] - (np.cumsum(degree[some]) - degree[some]), degree[some]) + np.arange(len(own))
            place = self.shift[own] + codes[pair]
            wins = np.zeros(len(own), bool)
            wins[np.unique(place, return_index=True)[1]] = True  # of those that want one place the first gets it
            wins &= self.owner[place] < 0
            settled = np.bincount(own, wins, n_states)[some] == degree[some]
            done = np.repeat(settled, degree[some])
            self.owner[place[done]], self.to[place[done]] = own[done], to[pair[done]]
            waiting = np.concatenate([some[~settled], waiting[len(some) :]])

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each pair, and which pairs have one."""
        place = self.shift.take(state)
        place += code
        return self.to.take(place), self.owner.take(place) == state


class CrossParser:
    """Phrase counts of texts under each language's automaton."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        # a phrase names a place in the sample: it costs the logarithm of the sample's length, here in units of the longest one's
        bits = np.log2([2.0 + len(samples[k]) for k in self.langs])
        self.cost = bits / max(bits, default=1.0)
        streams = [letters_and_gaps([samples[k]])[0] for k in self.langs]
        self.alphabet = np.unique(np.concatenate([np.array([32], np.uint32), *streams]).astype(np.uint32))
        width = len(self.alphabet) + 1  # the last code is any character that no sample has
        self.low = np.full(0x10000, width - 1, np.int32)
        low = self.alphabet[self.alphabet < 0x10000]
        self.low[low] = np.arange(len(low))
        # where a phrase starts with a code; state 0 if it is the phrase's only character
        self.begin = np.zeros((len(self.langs), width), np.int32)
        states, codes, to, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        for k, stream in enumerate(streams):
            one = suffix_automaton(self.codes(stream).tolist())
            sizes = [len(f) for f in one]
            states.append(np.repeat(np.arange(len(one)), sizes) + n)
            codes.append(np.fromiter((c for f in one for c in f), np.int64, sum(sizes)))
            to.append(np.fromiter((t for f in one for t in f.values()), np.int64, sum(sizes)) + n)
            self.begin[k, list(one[0])] = np.fromiter(one[0].values(), np.int64, len(one[0])) + n
            n += len(one)
        self.next = Transitions(np.concatenate(states), np.concatenate(codes), np.concatenate(to), width)

    def codes(self, points: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(points, 0xFFFF)]
        high = np.flatnonzero(points > 0xFFFF)
        if len(high):
            at = np.minimum(np.searchsorted(self.alphabet, points[high]), len(self.alphabet) - 1)
            out[high] = np.where(self.alphabet[at] == points[high], at, len(self.alphabet))
        return out

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) under each language (column); codes of all texts in turn."""
        n_langs = len(self.langs)
        out = np.zeros((len(lengths), n_langs), np.int64)
        if not n_langs or not len(codes):
            return out
        n_blocks = -(-lengths // BLOCK)
        text_of = np.repeat(np.arange(len(lengths)), n_blocks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, n_blocks) + nth * BLOCK
        size = np.minimum(BLOCK, lengths[text_of] - nth * BLOCK)
        begins = np.zeros((n_langs, len(codes)), bool)  # where the parse by blocks starts a phrase
        last = np.empty((n_langs, len(start)), np.int32)  # state behind each block
        counts = np.empty((n_langs, len(start)), np.int64)
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), BLOCKS_AT_ONCE):
            part = order[i : i + BLOCKS_AT_ONCE]
            last[:, part], counts[:, part] = self._blocks(codes, start[part], size[part], begins)
        # blocks that another one comes before are entered in its last state, until no last state changes
        lang, enter = (x.ravel() for x in np.meshgrid(np.arange(n_langs), np.flatnonzero(nth > 0), indexing="ij"))
        while len(enter):
            more, state = self._entered(codes, lang, start[enter], size[enter], last[lang, enter - 1], last[lang, enter], begins)
            counts[lang, enter] += more
            changed = state != last[lang, enter]
            last[lang, enter] = state
            lang, enter = lang[changed], enter[changed] + 1
            some = enter < len(nth)
            some[some] = nth[enter[some]] > 0
            lang, enter = lang[some], enter[some]
        for k in range(n_langs):
            out[:, k] = np.bincount(text_of, counts[k], len(lengths))
        return out

    def _blocks(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last states and phrases of blocks, the longest first, each parsed on its own under all languages."""
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # blocks that have a character at t
        state = np.zeros((len(self.langs), len(start)), np.int32)
        counts = np.zeros(state.shape, np.int32)
        for t, n in enumerate(active):
            at = start[:n] + t
            code = codes[at]
            to, on = self.next.step(state[:, :n], code)
            np.copyto(to, self.begin[:, code], where=~on)
            state[:, :n] = to
            counts[:, :n] += ~on
            begins[:, at] = ~on
        return state, counts

    def _entered(self, codes: np.ndarray, lang: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, last: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more blocks have if entered in these states, and their last states; begins is corrected.

        From the first place on where the parse and that of before both start a phrase they are the same.
        """
        more, out = np.zeros(len(start), np.int64), last.copy()
        on, t = np.arange(len(start)), 0
        while len(on):
            at, k = start[on] + t, lang[on]
            code = codes[at]
            to, some = self.next.step(state, code)
            state = np.where(some, to, self.begin[k, code])
            was = begins[k, at]
            more[on] += (~some).astype(np.int64) - was
            begins[k, at] = ~some
            t += 1
            apart, ended = some | ~was, size[on] <= t
            out[on[apart & ended]] = state[apart & ended]
            stay = apart & ~ended
            on, state = on[stay], state[stay]
        shift, owner, to = (memoryview(x) for x in (self.next.shift, self.next.owner, self.next.to))
        for i, s in zip(on.tolist(), state.tolist(), strict=True):
            k, a, b = int(lang[i]), int(start[i]) + t, int(start[i] + size[i])
            begin, was, n = memoryview(self.begin[k]), memoryview(begins[k]), 0
            for j, c in enumerate(memoryview(np.ascontiguousarray(codes[a:b])), a):
                place = shift[s] + c
                if owner[place] == s:
                    s = to[place]
                    if was[j]:
                        was[j] = False
                        n -= 1
                    continue
                s = begin[c]
                if was[j]:
                    break
                was[j] = True
                n += 1
            else:
                out[i] = s
            more[i] += n
        return more, out

    def predict(self, texts: list[str]) -> pd.DataFrame:
        points, lengths, letters = letters_and_gaps(texts)
        phrases = self.phrases(self.codes(points), lengths)
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "phrases_per_char": 0.0})
        costs = phrases * self.cost
        best = costs.argmin(1)
        least = phrases[np.arange(len(texts)), best]
        # posterior, were each phrase more a halving of the likelihood
        score = 1.0 / np.exp2(-np.minimum(costs - costs[np.arange(len(texts)), best][:, None], 1000)).sum(1)
        none = letters == 0
        return pd.DataFrame(
            {
                "lang_pred": np.where(none, "und", np.array(self.langs, object)[best]),
                "score": np.where(none, 0.0, score),
                "phrases_per_char": np.where(none, 0.0, least / np.maximum(lengths, 1)),
            }
        )


_PARSERS: dict[int, CrossParser] = {}


def language_samples(train: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """At most `chars` characters of labelled text for each language, from about `rows` rows chosen by their text's hash.

    Only rows of non-null text and language count; every row gives an equal share of the characters from its middle.
    """
    each = max(1, 2 * chars // rows)
    t = F.col(text)
    labelled = train.filter(t.isNotNull() & F.col(lang).isNotNull() & t.rlike(r"\p{L}"))
    labelled = labelled.select(F.xxhash64(t).alias("_h"), F.col(lang).cast("string").alias("_l"), middle_of(t, each).alias("_m"))
    found: dict[str, str] = {}
    for r in bounded_sample(labelled, F.col("_h"), "_l", rows).select("_l", "_m").collect():
        if len(found.get(r[0], "")) < chars:
            found[r[0]] = (found.get(r[0], "") + "\n" + r[1])[:chars]
    return found


def middle_of(t, size: int):
    """`size` characters around the middle of a text: used for samples that fit a model, never for scoring."""
    return F.substring(t, F.greatest(F.lit(1), ((F.length(t) - size) / 2).cast("int")), F.lit(size))


def with_language(docs: DataFrame, samples: dict[str, str], text: str = "text", into: str = "language") -> DataFrame:
    """Adds struct `into` (lang_pred, score, phrases_per_char) to docs, from the whole text.

    `und` with score 0 if the text is null, empty or has no letter, or if there is no labelled sample. Ties go to the
    language first in the alphabet. Repeated rows get equal results; texts of any length are parsed whole, and a block's
    end ends no phrase; an empty table stays empty; other columns keep their names and values, but for one named `into`,
    which is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_CHARS for each language
    key = hash(tuple(sorted(samples.items())))

    @F.pandas_udf("lang_pred string, score double, phrases_per_char double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = CrossParser(sent.value)
        for batch in batches:
            yield in_parts(_PARSERS[key].predict, batch)

    # marked as not deterministic, so that a filter on the result doesn't parse each text once more
    return docs.withColumn(into, predict.asNondeterministic()(F.col(text)))


def in_parts(f, batch: pd.Series, chars: int = 1_500_000):
    """f over lists of texts of about `chars` characters together, so that memory doesn't grow with the batch."""
    texts = ["" if t is None else t for t in batch]
    parts, size, own = [], 0, []
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= chars:
            parts.append(f(own))
            own, size = [], 0
    if own or not parts:
        parts.append(f(own))
    return pd.concat(parts, ignore_index=True)


def predict_languages(docs: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", into: str = "language") -> DataFrame:
    """with_language() by samples of the labelled rows `train`."""
    return with_language(docs, language_samples(train, text, lang), text, into)
