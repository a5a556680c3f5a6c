"""Words of letters and digits, shared by decontamination and lexical search, and reference items in bounded blocks.

A word is a maximal run of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import written

#: Bytes that are part of a word; all others count as a blank.
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _WORD else 0x20 for b in range(256))
#: Characters of reference items that are broadcast at a time. More items are taken in several passes over the texts.
BLOCK_CHARS = 3_000_000


def plain(text: str | None) -> bytes:
    """The text's bytes with A-Z lower-cased and a blank for every byte outside words; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE) if text else b""  # bytes.lower() knows A-Z alone


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


def in_slices(batch: pa.RecordBatch, text: str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch's rows in turn, about `size` bytes of text together, so that few texts are Python objects at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size)) + 1
        yield batch.slice(first, max(1, min(last, batch.num_rows) - first))
        first = max(last, first + 1)


class Words:
    """The words of several texts: one blank after each, their places in these bytes, and how many each text has."""

    def __init__(self, texts: list[str | None]):
        coded = [plain(t) for t in texts]
        whole = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
        inside = whole != 0x20
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.bytes = whole[keep]
        begins = 1 + np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
        del coded
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        self.counts = np.diff(np.searchsorted(first, begins))
        del inside
        blank = np.flatnonzero(self.bytes == 0x20)
        self.end = blank
        self.start = np.concatenate([[0], blank[:-1] + 1]) if len(blank) else blank
        self.first, self.begins = first, begins  # places in the bytes before blanks were joined

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[Row]]:
    """The different (item_id, text) of items in lists of at most about 2 * BLOCK_CHARS characters, each for one pass.

    The blocks are cut by hash after the items' sizes are summed; an item that is larger alone is alone. Null texts go.
    """
    own = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).filter("text is not null").distinct()
    own = written(own.withColumn("_h", F.xxhash64(F.col("item_id").cast("string"), "text")), "items")
    n = max(1, math.ceil((own.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) / BLOCK_CHARS))
    while True:
        of = F.pmod("_h", F.lit(n))
        sizes = own.groupBy(of.alias("b")).agg(F.sum(F.length("text").cast("long")).alias("c"), F.count_distinct("_h").alias("k"))
        if n == 1 or sizes.filter((F.col("k") > 1) & (F.col("c") > 2 * BLOCK_CHARS)).isEmpty():
            break
        n *= 2
    for b in range(n):
        rows = own.filter(of == b).select("item_id", "text").collect()  # bounded, see above
        if rows:
            yield sorted(rows, key=lambda r: (r["text"], str(r["item_id"])))
