"""Benchmark decontamination: a broadcast hash set of the items' word windows, verified in the texts that hold them.

Windows are hashed by differences of prefix sums, so that every window of a text costs a few array operations; a
candidate's bytes are compared with the item's before it counts. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .plainwords import Words, in_slices, item_blocks
from .wordhash import fingerprints

#: Words of a window. An item of fewer words is one window.
WINDOW = 10
#: Words of a text whose windows are hashed together.
CHUNK_WORDS = 200_000
#: Bits of the table that sorts out most windows before the search.
SIEVE_BITS = 20


class WindowSet:
    """All windows of some items' words: sorted fingerprints by length in words, and where each lies in the items' bytes."""

    def __init__(self, texts: list[str | None], window: int = WINDOW):
        words = Words(texts)
        self.bytes = words.bytes
        last = np.cumsum(words.counts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        size = np.minimum(words.counts, window)
        for k in np.unique(size[size > 0]):
            at = [np.arange(last[i] - words.counts[i], last[i] - k + 1) for i in np.flatnonzero(size == k)]
            item = np.repeat(np.flatnonzero(size == k), [len(a) for a in at])
            first = np.concatenate(at)
            start, end = words.start[first], words.end[first + k - 1]
            fp = fingerprints(self.bytes, start, end)
            order = np.argsort(fp, kind="stable")
            fp = fp[order]
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(fp >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.by_length[int(k)] = fp, start[order], end[order], item[order], sieve

    def found(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """Which words lie in an occurrence of a window, and the items of these windows for each text."""
        n, b = len(words.start), words.bytes
        edge = np.zeros(n + 1, np.int32)  # a window adds one at its first word and takes it after its last
        items: list[set[int]] = [set() for _ in words.counts]
        text = words.text_of_word()
        for k, (known, start, end, item, sieve) in self.by_length.items():
            for low in range(0, n - k + 1, CHUNK_WORDS):
                first = np.arange(low, min(low + CHUNK_WORDS, n - k + 1))
                first = first[text[first] == text[first + k - 1]]
                if not len(first):
                    continue
                base = words.start[first[0]]
                fp = fingerprints(b[base : words.end[first[-1] + k - 1]], words.start[first] - base, words.end[first + k - 1] - base)
                first = first[hit := sieve[(fp >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]]
                fp = fp[hit]
                left, right = np.searchsorted(known, fp), np.searchsorted(known, fp, side="right")
                verified: dict[int, tuple[bytes, set[int]]] = {}
                for i in np.flatnonzero(right > left):
                    w = first[i]
                    own = b[words.start[w] : words.end[w + k - 1]].tobytes()
                    at = int(left[i])
                    if at not in verified or verified[at][0] != own:
                        verified[at] = own, {int(item[j]) for j in range(at, right[i]) if self.bytes[start[j] : end[j]].tobytes() == own}
                    if verified[at][1]:
                        edge[w] += 1
                        edge[w + k] -= 1
                        items[text[w]] |= verified[at][1]
        return np.cumsum(edge[:n]) > 0, items


def _spans(text: str, words: Words, hit: np.ndarray) -> list[dict[str, int]]:
    """Stretches of hit words as character offsets; words must be those of this text alone."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    size = words.end - words.start
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    begin, end = words.first[edge[::2]] - 1, words.first[edge[1::2] - 1] + size[edge[1::2] - 1] - 1
    return [{"start": int(chars[s]), "end": int(chars[e])} for s, e in zip(begin, end, strict=True)]


def _merged(a: list[dict[str, int]], b: list[dict[str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in [*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "contamination", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and a struct `into`: n_words, n_hit, items (ids as strings), spans.

    A document word is hit if it lies in any occurrence of `window` consecutive words of an item, or of a whole item of
    fewer words. spans are the stretches of hit words as (start, end) offsets of characters. Null and empty texts have no
    words; items of null text or without a word match nothing, items of null id hit words but are not listed; an id with
    several texts has the windows of each and is listed once. Repeated rows get equal results, an empty table stays
    empty, an empty set of items hits nothing. Texts of any length count whole, hashed by chunks. Columns of docs may have
    any names; one called like `into` is replaced.

    Items beyond BLOCK_CHARS characters are taken in several passes; what a pass found is merged in the next one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    row = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(True).alias("_"))  # in a struct no name can clash
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    x = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast(kind).alias("spans"), F.lit(0).cast("long").alias("n_hit"))
    blocks = list(item_blocks(items, item_id, item_text)) or [[]]
    for i, block in enumerate(blocks):
        x = _passed(x, block, window)
        if i < len(blocks) - 1:
            x = written(x, "scanned")
    verdict = F.struct("n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "spans")
    return x.select(*[F.col("_row").getField(c).alias(c) for c in keep], verdict.alias(into))


def _passed(x: DataFrame, block: list, window: int) -> DataFrame:
    ids = [None if r["item_id"] is None else str(r["item_id"]) for r in block]
    sent = x.sparkSession.sparkContext.broadcast(WindowSet([r["text"] for r in block], window))  # of at most 2 * BLOCK_CHARS characters
    names = x.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in in_slices(batch, "_text"):
                own = part.column("_text").to_pylist()
                words = Words(own)
                hit, found = known.found(words)
                bound = np.concatenate([[0], np.cumsum(words.counts)])
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bound])
                items, spans = part.column("items").to_pylist(), part.column("spans").to_pylist()
                hits = part.column("n_hit").to_pylist()
                for i in np.flatnonzero(n_hit):
                    alone = Words([own[i]])
                    now = _spans(own[i], alone, hit[bound[i] : bound[i + 1]])
                    items[i] = items[i] + [ids[j] for j in found[i] if ids[j] is not None]
                    both = _merged(spans[i], now)
                    if spans[i]:  # words of the merged spans, which are stretches of whole words
                        hits[i] = int(Words([own[i][s:e] for s, e in both]).counts.sum())
                    else:
                        hits[i] = int(n_hit[i])
                    spans[i] = [{"start": s, "end": e} for s, e in both]
                new = {"n_words": pa.array(words.counts.astype(np.int64)), "items": pa.array(items, pa.list_(pa.string())), "n_hit": pa.array(hits, pa.int64()), "spans": pa.array(spans, part.column("spans").type)}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names)

    return x.mapInArrow(run, x.schema)


def without_contamination(docs: DataFrame, items: DataFrame, remove: str = "documents", text: str = "text", max_share: float = 0.0, **options) -> DataFrame:
    """docs without what scan() finds: `remove` is "documents" or "spans".

    Documents go whose share of hit words exceeds max_share; of the others, or of all with "spans", the hit stretches are
    cut out of the text, with a blank in their place. Rows, columns and odd cases are as in scan(); null texts stay null.
    """
    if remove not in ("documents", "spans"):
        raise ValueError('remove is "documents" or "spans"')
    into = "_contamination"
    while into in docs.columns:
        into += "_"
    x = scan(docs, items, text=text, into=into, **options)
    found, body = F.col(into), F.col(f"`{text}`")
    if remove == "documents":
        x = x.filter(found["n_hit"] <= max_share * found["n_words"])
    spans = found["spans"]
    start = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    stop = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(body)))
    pieces = F.zip_with(start, stop, lambda a, b: body.substr(a + 1, b - a))
    cut = F.when(F.size(spans) > 0, F.array_join(pieces, " ")).otherwise(body)
    return x.select(*[(cut if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
