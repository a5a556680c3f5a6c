"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation that balances the codes is learnt on a bounded sample; codes are cut into substrings, each the key of a table
that is probed at Hamming distance 0 and 1; of what meets there, pairs whose whole codes are close are compared by the
original vectors in double precision.

Dense groups don't make all their pairs: vectors within half the linking angle of a common leader are a cell, and all of
a cell's members are linked by the triangle inequality. Tables then pair cells, most of which are linked as a whole or
not at all; only where the bounds leave it open are members compared, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hash_share, written

LINK = 0.95
#: Vectors that the rotation is learnt on, and rounds of that.
SAMPLE, ROUNDS = 4096, 30
#: Chance that tables may miss a pair just at the linking cosine.
MISS = 1e-4
#: Members of a cell that are compared together.
BLOCK = 512
#: Cells stored under a key of a table; keys of more are split.
BUCKET = 1024
_EPS = 1e-9


def normalised(rows: list[list | None]) -> list[bytes | None]:
    """Unit vectors as bytes of doubles; None for null, zero and non-finite ones and for null components."""
    out: list[bytes | None] = []
    for r in rows:
        v = None
        if r and None not in r:
            x = np.array(r, np.float64)
            big = np.abs(x).max()
            if np.isfinite(big) and big > 0:
                x = x / big
                v = (x / math.sqrt(float(x @ x))).tobytes()
        out.append(v)
    return out


def matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def itq(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Projection whose signs are the code: directions at right angles, turned until the signs fit the vectors best.

    The vectors are not centred, since the tables reckon with the angles between the vectors themselves: of vectors in a
    narrow cone, those between the centred ones are far larger. Of more dimensions than bits, a random subspace is taken,
    another for each seed, whose angles are those of the whole space in the mean; principal axes would lose what is rare.
    """
    w, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], bits)))
    v = x @ w
    turn = np.eye(bits)
    for _ in range(ROUNDS):
        b = np.where(v @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(b.T @ v)
        turn = (u @ vt).T
    return w @ turn


def table_sizes(n: int, link: float = LINK) -> tuple[int, int]:
    """Bits of a substring (about log2 of the rows) and tables needed for MISS at the linking cosine."""
    bits = min(28, max(8, round(math.log2(max(2, n)))))
    same = 1 - math.acos(link) / math.pi
    meet = same**bits + bits * same ** (bits - 1) * (1 - same)
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def most_bits(bits: int, link: float, angles: float) -> int:
    """Bits of whole codes in which vectors so many linking angles apart may differ: eight standard deviations above the mean."""
    differ = min(1.0, angles * math.acos(link) / math.pi)
    return math.ceil(bits * differ + 8 * math.sqrt(bits * differ * (1 - differ)))


def whole_codes(keys: np.ndarray, bits: int) -> np.ndarray:
    """The substrings of keys_of() as a row of 64-bit numbers for each vector, as many substrings in each as fit."""
    each = 64 // bits
    own = keys & ((1 << bits) - 1)
    own = np.pad(own, ((0, 0), (0, -own.shape[1] % each))).reshape(len(own), -1, each)
    return (own.view(np.uint64) << np.arange(each, dtype=np.uint64) * np.uint64(bits)).sum(2, dtype=np.uint64).view(np.int64)


def keys_of(x: np.ndarray, model: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """A row of table keys for each vector: the table's number above its substring of the code."""
    code = np.concatenate([x @ w >= 0 for w in model], 1)[:, : bits * tables].reshape(len(x), tables, bits)
    return (code * (1 << np.arange(bits, dtype=np.int64))).sum(2) + (np.arange(tables, dtype=np.int64) << 40)


def _arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow of a function from a batch to columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(f(batch), names)

    return df.mapInArrow(run, schema)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.einsum("ij,ij->i", a, b), -1, 1))


def linked_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", link: float = LINK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors.

    Vectors link if they have the same dimension and their cosine is `link` or more. Null, empty, zero and non-finite
    vectors and those with null components link with nothing. Equal vectors are compared as one and count each.
    component_id is the smallest id reachable over links; rows of null id take part, but are never kept; rows that repeat
    an id each get their own row. Vectors may be of any length; other columns are left out, whatever their names; an
    empty table gives an empty one. Each dimension is searched on its own.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = _arrow(rows, lambda b: [b.column(0), pa.array(normalised(b.column(1).to_pylist()), pa.binary())], f"vec_id {kind}, v binary")
    rows = written(rows, "vectors")
    widths = sorted(r[0] for r in rows.filter("v is not null").groupBy(F.length("v")).count().filter("count > 1").collect())
    alone = rows.filter(~F.coalesce(F.length("v").isin(widths or [-1]), F.lit(False)))
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    for width in widths:
        out = out.unionByName(_of_one_dimension(rows.filter(F.length("v") == width), link))
    return out


def _of_one_dimension(rows: DataFrame, link: float) -> DataFrame:
    """linked_vectors() of two or more unit vectors (vec_id, v) of one dimension."""
    spark = rows.sparkSession
    own = written(rows.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("rid", F.monotonically_increasing_id()), "distinct")

    count = own.count()
    bits, tables = table_sizes(count, link)
    share = hash_share(F.col("v"))
    sample = own.filter(share < max(1.5 * SAMPLE, 20.0) / count).orderBy(share, "v").select("v").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        sample = own.orderBy("v").select("v").limit(SAMPLE).toArrow()
    x = matrix(sample.column(0))
    each = min(x.shape[1], 64)
    model = spark.sparkContext.broadcast([itq(x, each, seed) for seed in range(-(-bits * tables // each))])

    def coded(b: pa.RecordBatch) -> list:
        keys = keys_of(matrix(b.column(1)), model.value, bits, tables)
        code = whole_codes(keys, bits)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return [b.column(0), lists(keys), lists(code)]

    codes = written(_arrow(own.select("rid", "v"), coded, "rid long, keys array<long>, code array<long>"), "codes")

    def likely(pairs: DataFrame, a: str, b: str, sides: DataFrame) -> DataFrame:
        """Of the pairs of ids (a, b) those whose whole codes are close enough; sides: rid, code, spread (in linking angles)."""
        side = lambda c: sides.select(F.col("rid").alias(c), F.col("code").alias(f"code_{c}"), F.col("spread").alias(f"spread_{c}"))
        apart = F.aggregate(F.zip_with(f"code_{a}", f"code_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        most = F.lit(most_bits(bits * tables, link, 1.0))
        for spread in (0.5, 1.0):
            most = F.when(F.col(f"spread_{a}") + F.col(f"spread_{b}") >= spread, most_bits(bits * tables, link, 1 + spread)).otherwise(most)
        return pairs.join(side(a), a).join(side(b), b).filter(apart <= most).select(a, b)

    # cells: the smallest leader, among the first members of a vector's buckets, within half the linking angle
    half = math.acos(link) / 2
    exact = codes.select("rid", F.explode("keys").alias("key"))
    lead = exact.groupBy("key").agg(F.min("rid").alias("cell"), F.count("*").alias("m")).filter("m > 1").select("key", "cell")
    near = likely(exact.join(lead, "key").filter("rid <> cell").select("rid", "cell").distinct(), "rid", "cell", codes.withColumn("spread", F.lit(0.0)))
    near = near.join(own.select("rid", "v"), "rid").join(own.select(F.col("rid").alias("cell"), F.col("v").alias("w")), "cell").select("rid", "cell", "v", "w")
    near = _arrow(near, lambda b: [b.column(0), b.column(1), pa.array(_angle(matrix(b.column(2)), matrix(b.column(3))))], "rid long, cell long, angle double").filter(F.col("angle") <= half - _EPS)
    near = near.groupBy("rid").agg(F.min(F.struct("cell", "angle")).alias("c"))
    member = written(
        own.join(near, "rid", "left").select("rid", "low", "n", F.coalesce("c.cell", "rid").alias("cell"), F.coalesce("c.angle", F.lit(0.0)).alias("angle")),
        "cells",
    )
    cells = member.groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("r"), F.count("*").alias("m"))
    cells = written(cells.join(own.select(F.col("rid").alias("cell"), "v"), "cell"), "centres")

    # pairs of cells that meet in a table at distance 0 or 1; the side whose bit is 0 probes
    def probes(b: pa.RecordBatch) -> list:
        keys = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
        flips = np.stack([keys | (1 << k) for k in range(bits)], 2)
        new = flips != keys[:, :, None]
        cell = np.broadcast_to(b.column(0).to_numpy()[:, None, None], flips.shape)
        return [pa.array(np.concatenate([np.repeat(b.column(0).to_numpy(), keys.shape[1]), cell[new]])), pa.array(np.concatenate([keys.ravel(), flips[new]]))]

    own_keys = codes.join(member.select("rid", "cell"), "rid").select("cell", "keys")
    stored = own_keys.select(F.col("cell").alias("b"), F.explode("keys").alias("key")).distinct()
    asked = _arrow(own_keys, probes, "a long, key long").distinct()
    # a key of many cells is split: its stored cells are dealt over parts, and each probe asks all of them
    often = written(stored.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("k")).filter("k > 1"), "split-keys")
    stored = stored.join(often, "key", "left").select("b", "key", F.coalesce(F.pmod(F.xxhash64("b"), F.col("k")), F.lit(0)).cast("int").alias("part"))
    asked = asked.join(often, "key", "left").select("a", "key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)).alias("part"))
    pairs = asked.join(stored, ["key", "part"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cells.select(F.col("cell").alias("a"), F.col("v").alias("va"), F.col("r").alias("ra"), F.col("n").alias("na"))
    right = cells.select(F.col("cell").alias("b"), F.col("v").alias("vb"), F.col("r").alias("rb"), F.col("n").alias("nb"))

    def judged(b: pa.RecordBatch) -> list:
        u, w = matrix(b.column("va")), matrix(b.column("vb"))
        spread = b.column("ra").to_numpy() + b.column("rb").to_numpy()
        angle, cos = _angle(u, w), np.einsum("ij,ij->i", u, w)
        whole = np.where(spread == 0, cos >= link, angle + spread <= 2 * half - _EPS)
        none = np.where(spread == 0, cos < link, angle - spread > 2 * half + _EPS)
        return [*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(np.where(whole, 1, np.where(none, 0, 2)).astype(np.int32))]

    # members of a cell may be half the linking angle away from its centre
    centres = codes.join(cells.select(F.col("cell").alias("rid"), F.when(F.col("m") > 1, 0.5).otherwise(0.0).alias("spread")), "rid")
    pairs = likely(pairs, "a", "b", centres)
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb", "ra", "rb", "na", "nb")
    pairs = written(_arrow(pairs, judged, "a long, b long, na long, nb long, verdict int").filter("verdict > 0"), "pairs")

    # members of pairs that the bounds leave open, block by block
    blocks = member.join(cells.select("cell", "m"), "cell").join(own.select("rid", "v"), "rid")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("rid"), F.ceil(F.col("m") / BLOCK)))
    blocks = blocks.groupBy("cell", "block").agg(F.collect_list(F.struct("rid", "v", "n")).alias("x"))

    def compared(b: pa.RecordBatch) -> list:
        a, c, rid, n = [], [], [], []
        for k in range(b.num_rows):
            one, two = b.column("x")[k].as_py(), b.column("y")[k].as_py()
            u, w = (np.frombuffer(b"".join(e["v"] for e in s), np.float64).reshape(len(s), -1) for s in (one, two))
            hit = u @ w.T >= link
            for side, counts in ((one, hit @ np.array([e["n"] for e in two])), (two, hit.T @ np.array([e["n"] for e in one]))):
                some = np.flatnonzero(counts)
                rid += [side[i]["rid"] for i in some]
                n += counts[some].tolist()
                a += [b.column("a")[k].as_py()] * len(some)
                c += [b.column("b")[k].as_py()] * len(some)
        return [pa.array(x, pa.int64()) for x in (a, c, rid, n)]

    open_pairs = pairs.filter("verdict = 2").select("a", "b")
    open_pairs = open_pairs.join(blocks.select(F.col("cell").alias("a"), "x"), "a").join(blocks.select(F.col("cell").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")
    some = written(_arrow(open_pairs, compared, "a long, b long, rid long, n long"), "members")

    whole = pairs.filter("verdict = 1")
    edges = whole.select("a", "b").unionByName(some.select("a", "b").distinct())
    label = components(edges)
    by_cell = whole.select(F.col("a").alias("cell"), F.col("nb").alias("k")).unionByName(whole.select(F.col("b").alias("cell"), F.col("na").alias("k"))).groupBy("cell").agg(F.sum("k").alias("k"))
    by_member = some.groupBy("rid").agg(F.sum("n").alias("j"))
    found = member.join(cells.select("cell", F.col("n").alias("together")), "cell").join(by_cell, "cell", "left").join(by_member, "rid", "left")
    found = found.join(label, found["cell"] == label["node"], "left")
    found = found.select("rid", "low", F.coalesce("component", "cell").alias("part"), (F.col("together") - 1 + F.coalesce("k", F.lit(0)) + F.coalesce("j", F.lit(0))).alias("n_links"))
    found = written(found, "found")  # so that a large part is summed up in all tasks and its join can be split
    lowest = found.groupBy("part").agg(F.min("low").alias("component_id"))
    found = found.join(lowest, "part").select("rid", "n_links", "component_id")
    result = rows.join(own.select("v", "rid"), "v").join(found, "rid")
    return result.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
