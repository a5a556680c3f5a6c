"""Quality classifier by compression: is a text cheaper to store beside good text or beside bad text?

Two zstandard dictionaries hold labelled text, one of each class. The difference of the two compressed sizes, divided by
the text's own size, is turned into a probability by a logistic curve, fitted on labelled rows that went into neither
dictionary. Texts are compressed in blocks, each against the whole dictionaries, because zstandard forgets a dictionary
once a text has filled its window: so every part of a text of any length counts alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, written

#: Bounds of the fit: labelled rows drawn of each class, bytes taken of each for a dictionary, bytes of a dictionary.
SAMPLE_ROWS, SLICE_BYTES, DICT_BYTES = 3000, 1000, 600_000
#: Compression level; from 6 on the matches are good enough to tell the classes apart.
LEVEL = 6
#: Bytes compressed in one call, far below the level's window of 2 MiB; the sizes of a text's blocks are summed.
BLOCK_BYTES = 256 * 1024


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features, the constant first


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    if held:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False)


class Scorer:
    def __init__(self, model: Model):
        self.good, self.bad = _compressor(model.good), _compressor(model.bad)
        self.weights = np.array(model.weights)

    def features(self, texts: list[str]) -> np.ndarray:
        """Constant, normalised size difference, and that difference relative to both sizes."""
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1
        for i, t in enumerate(texts):
            if b := t.encode("utf-8", "surrogatepass"):
                blocks = [b[k : k + BLOCK_BYTES] for k in range(0, len(b), BLOCK_BYTES)]
                g, w = (sum(len(c.compress(x)) for x in blocks) for c in (self.good, self.bad))
                out[i, 1:] = (w - g) / len(b), (w - g) / (w + g)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(text, label) of at most about SAMPLE_ROWS labelled documents of each class, chosen by their id's hash.

    The sample is drawn from the labels alone; only its ids, at most 4 * SAMPLE_ROWS, are broadcast to the texts, which are
    scanned once and not shuffled, but for those drawn. Null ids, labels and texts and labels other than 0 and 1 count for
    nothing. Of an id with several labels the smallest counts, of one with several texts the first in their order.
    """
    own = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    drawn = bounded_sample(own, F.col("_id").cast("string"), "_y", SAMPLE_ROWS)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).filter("_t is not null")
    found = texts.join(F.broadcast(drawn), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    return written(found.select(F.col("_t").alias(text), F.col("_y").alias(label)), "labelled")


def fit(sample: DataFrame, text: str = "text", label: str = "quality") -> Model:
    """Fits on all rows of a bounded sample such as labelled_sample() draws.

    Rows of null text or label count for nothing. With rows of one class or none the score is constant: the share of
    good rows, 0.5 without any.
    """
    rows = sample.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("_t"), F.col(label).cast("int").alias("_y"))
    half = F.pmod(F.xxhash64("_t", F.lit(9)), F.lit(2))
    # a slice of the text at a place drawn by hash goes into a dictionary; texts of the other half are compressed whole
    place = F.lit(1) + F.pmod(F.xxhash64("_t", F.lit(5)), F.greatest(F.lit(1), F.length("_t") - SLICE_BYTES + 1)).cast("int")
    for_dict = [(r[0].encode("utf-8", "surrogatepass"), r[1]) for r in rows.filter(half == 0).select(F.substring(F.col("_t"), place, F.lit(SLICE_BYTES)), "_y").collect()]
    for_dict.sort(key=lambda r: (zlib.crc32(r[0]), r))
    content = {y: b"\n".join(b for b, z in for_dict if z == y)[:DICT_BYTES] for y in (0, 1)}
    model = Model(content[1], content[0], (0.0, 0.0, 0.0))
    if not (content[0] and content[1]):
        n = rows.groupBy("_y").count().collect()
        good = (sum(r[1] for r in n if r[0] == 1) + 0.5) / (sum(r[1] for r in n) + 1)
        return Model(content[1], content[0], (float(np.log(good / (1 - good))), 0.0, 0.0))
    features = rows.filter(half == 1).select("_y", _udf(sample, model, lambda s, texts: pd.DataFrame(s.features(texts), columns=["c", "d", "r"]), "c double, d double, r double")(F.col("_t")).alias("f"))
    found = sorted(features.select("_y", "f.*").collect())  # four numbers for each row of the bounded sample
    if not found:
        return model
    x, y = np.array([r[1:] for r in found], float), np.array([r[0] for r in found], float)
    return Model(content[1], content[0], tuple(_logistic(x, y).tolist()))


_SCORERS: dict[int, Scorer] = {}


def _udf(df: DataFrame, model: Model, of, schema: str):
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES
    key = zlib.crc32(repr((model.weights, zlib.crc32(model.good), zlib.crc32(model.bad))).encode())

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        for batch in batches:
            yield of(_SCORERS[key], ["" if t is None else t for t in batch])

    return run


def with_quality(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """Adds struct `into` (score, predicted) to docs, from the whole text.

    Null text counts as empty; an empty text has no size difference and gets the curve's value there. Repeated rows get
    equal scores; texts of any length count whole, block by block; an empty table stays empty; other columns keep their
    names and values, but for one named `into`, which is replaced.
    """

    def of(scorer: Scorer, texts: list[str]) -> pd.DataFrame:
        s = scorer.scores(texts)
        return pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype("int32")})

    return docs.withColumn(into, _udf(docs, model, of, "score double, predicted int")(F.col(text)))
