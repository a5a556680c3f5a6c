"""Versioned tables: loads that take effect as a whole, merges that rewrite only what they touch, lasting keys.

A table is a folder of data folders and of manifests with ascending numbers. A manifest names the data folders of its
version by key bucket; it is written under another name and renamed last, which fails if its number exists. Readers take
the manifest with the highest number, so that a load that fails half-way changes nothing for them, a load may read the
table that it replaces, and of two loads at once the second one fails instead of undoing the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import sanitize
from ..operators.match import numbered
from .tables import materialized

_MANIFESTS, _DATA = "manifests", "data"


class LoadConflict(RuntimeError):
    """Another load has published a version since this one began."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    fs, folder = _files(spark, root), _path(spark, f"{root}/{_MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """What the version names, by default the latest: number, rows, schema, key, buckets, folders; None where there is none."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    file = f"{root}/{_MANIFESTS}/{known[-1] if version is None else version:012d}.json"
    return json.loads("\n".join(r[0] for r in spark.read.text(file).collect()))  # one small file


def _publish(spark: SparkSession, root: str, after: int, content: dict) -> dict:
    """Makes the content version after + 1, or raises LoadConflict if there is one already."""
    content = content | {"version": after + 1}
    aside, final = _path(spark, f"{root}/{_MANIFESTS}/.{uuid.uuid4().hex}"), _path(spark, f"{root}/{_MANIFESTS}/{after + 1:012d}.json")
    out = _files(spark, root).create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(aside, final, options)  # without the option to overwrite
    except Py4JJavaError as e:
        _files(spark, root).delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise LoadConflict(f"{root}: version {after + 1} exists") from e
        raise
    return content


def _schema(content: dict) -> T.StructType:
    return T.StructType.fromJson(content["schema"])


def current(spark: SparkSession, root: str, version: int | None = None, raw: bool = False) -> DataFrame:
    """The rows of the latest or another version; raw: with those that a merge has marked as deleted."""
    content = manifest(spark, root, version)
    if content is None:
        raise ValueError(f"{root}: no version {'' if version is None else version}")
    folders = sorted({f"{root}/{f}" for fs in content["folders"].values() for f in fs})
    schema = _schema(content)
    x = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    gone = content.get("deleted")
    return x if raw or not gone else x.filter(~F.coalesce(F.col(f"`{gone}`"), F.lit(False))).drop(gone)


def _bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(n)).cast("int") if key else F.lit(0)


def _written(df: DataFrame, root: str, key: list[str], buckets: int) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Writes rows under a new data folder. Returns the folders by bucket and the rows by bucket; a bucket without rows has none.

    Each bucket is dealt over as many tasks as the session shuffles to per bucket, so that a large one is no single task.
    """
    spark, folder, free = df.sparkSession, f"{_DATA}/{uuid.uuid4().hex}", "bucket"
    while free in df.columns:
        free += "_"
    if not key:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{folder}")
        return {"0": [folder]}, {"0": seen.get["n"]}
    each = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    x = df.withColumn(free, _bucket(key, buckets))
    x = x.repartition(each * buckets, F.col(free), F.pmod(F.xxhash64(F.lit(7), *[F.col(f"`{k}`") for k in key]), F.lit(each)))
    seen = Observation()
    counts = [F.count_if(F.col(free) == b).alias(str(b)) for b in range(buckets)]
    x.observe(seen, *counts).write.partitionBy(free).parquet(f"{root}/{folder}")
    rows = {b: n for b, n in seen.get.items() if n}
    return {b: [f"{folder}/{free}={b}"] for b in rows}, rows


def load(df: DataFrame, root: str, key: list[str] | None = None, buckets: int = 1, deleted: str | None = None, note: dict | None = None) -> int:
    """Publishes the rows as the table's next version, whatever it held; df may read the table. Returns the row count.

    Non-finite numbers become NULL. key and buckets are for tables that merge() is used on: rows are dealt over the buckets
    by their key. deleted: a boolean column that marks rows as deleted. note: more that the manifest keeps. An empty df gives a table without rows; a load that
    fails leaves the version before as it is.
    """
    spark = df.sparkSession
    after = max(versions(spark, root), default=0)
    folders, rows = _written(sanitize(df), root, key or [], buckets if key else 1)
    _publish(spark, root, after, {"schema": df.schema.jsonValue(), "key": key or [], "buckets": buckets if key else 1, "folders": folders, "rows": rows, "deleted": deleted, "note": note or {}})
    return sum(rows.values())


def append(df: DataFrame, root: str) -> int:
    """Publishes a version with more rows; the files of the others stay. Only for tables without a key."""
    spark = df.sparkSession
    before = manifest(spark, root)
    if before is None:
        return load(df, root)
    if before["key"] or df.schema.simpleString() != _schema(before).simpleString():
        raise ValueError(f"{root}: rows are appended to tables without a key and of equal columns only")
    folders, rows = _written(sanitize(df), root, [], 1)
    _publish(spark, root, before["version"], before | {"folders": {"0": before["folders"].get("0", []) + folders["0"]}, "rows": {"0": before["rows"].get("0", 0) + rows["0"]}})
    return rows["0"]


def merge(changes: DataFrame, root: str, key: list[str], order: list[str], mark: str | None = None, deleted: str | None = None, buckets: int = 16) -> dict:
    """Brings changes into the table: of each key the last row in `order` stays, whether stored or new. Returns the manifest.

    A late row (earlier in order than the stored one) changes nothing. `deleted` names a boolean column of the changes; a
    key whose last row has it is not read any more, but stays stored, so that rows that come late don't bring it back.
    Among rows of equal order a deletion wins, then the largest by all columns. Null in order is earliest; a null key is a
    key. `mark` names the column whose largest value the manifest keeps for unseen(). Only buckets that the changes touch
    are written again; the others' files stay, and the same changes once more change no row. The first merge makes the table.
    """
    spark = changes.sparkSession
    before = manifest(spark, root)
    new = materialized(sanitize(changes), "changes")  # read for its buckets, for its mark and for its rows
    n = before["buckets"] if before else buckets
    if before and (before["key"] != key or before.get("deleted") != deleted or _schema(before).simpleString() != new.schema.simpleString()):
        raise ValueError(f"{root}: other key, columns or mark of deletion than the table's")
    touched = {str(r[0]) for r in new.select(_bucket(key, n)).distinct().collect()}  # as many as there are buckets at most
    old = sorted({f for b in touched if before for f in before["folders"].get(b, [])})
    stored = spark.read.schema(new.schema).parquet(*[f"{root}/{f}" for f in old]) if old else None
    rows = new if stored is None else stored.unionByName(new)
    last = [F.col(f"`{c}`") for c in [*order, *([deleted] if deleted else []), *new.columns]]
    kept = rows.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in new.columns]), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(last)])).alias("_r"))
    folders, counts = _written(kept.select("_r.*"), root, key, n) if touched else ({}, {})
    content = before or {"schema": new.schema.jsonValue(), "key": key, "buckets": n, "folders": {}, "rows": {}, "deleted": deleted}
    stay = lambda own: {b: v for b, v in own.items() if b not in touched}
    content = content | {"folders": stay(content["folders"]) | folders, "rows": stay(content["rows"]) | counts}
    if mark:
        top = [x for x in (content.get("mark"), new.agg(F.max(f"`{mark}`").cast("string")).first()[0]) if x is not None]
        kind = new.schema[mark].dataType.simpleString()
        content["mark"] = spark.range(1).select(F.greatest(*[F.lit(x).cast(kind) for x in [*top, *top]]).cast("string")).first()[0] if top else None
    return _publish(spark, root, before["version"] if before else 0, content)


def unseen(source: DataFrame, root: str, mark: str) -> DataFrame:
    """Source rows above the mark of the last merge; all where there is none. Rows of null mark are always among them."""
    known = (manifest(source.sparkSession, root) or {}).get("mark")
    c = F.col(f"`{mark}`")
    return source if known is None else source.filter(c.isNull() | (c > F.lit(known).cast(source.schema[mark].dataType)))


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all but the last `keep` versions and the data that only they name. Returns how many went.

    Data of loads that are under way are named by no manifest and stay.
    """
    known = versions(spark, root)
    gone = known[: max(0, len(known) - max(1, keep))]
    named = lambda vs: {f for v in vs for fs in manifest(spark, root, v)["folders"].values() for f in fs}
    old = named(gone) - named(known[len(gone) :])
    fs = _files(spark, root)
    for v in gone:
        fs.delete(_path(spark, f"{root}/{_MANIFESTS}/{v:012d}.json"), False)
    for f in old:
        fs.delete(_path(spark, f"{root}/{f}"), True)
    return len(gone)


def publish_all(tables: dict[str, DataFrame], root: str, audited: Callable[[dict[str, DataFrame]], DataFrame]) -> dict[str, int]:
    """Stages the tables, audits the staged rows, and loads all of them or none. Returns the failed checks' rows.

    audited: from the staged tables to (check_name, n_bad, passed), such as relational_audit().
    """
    staged = {name: materialized(df, f"staged-{name}") for name, df in tables.items()}
    failed = {r["check_name"]: r["n_bad"] for r in audited(staged).filter("not passed").collect()}  # a row for each check
    if not failed:
        for name, df in staged.items():
            load(df, f"{root}/{name}")
    return failed


def lasting_keys(df: DataFrame, root: str, natural: list[str], into: str) -> DataFrame:
    """Adds a number to each row that its natural key keeps over all loads; a map of them is stored as a versioned table at root.

    New keys are numbered after the largest number so far, in their order. Rows that repeat a natural key are told apart by
    their place among them in the order of their other columns. Null is a value like others in a key. Two loads at once
    can't give a number twice, since the second one's map is refused.
    """
    spark = df.sparkSession
    own = [F.col(f"`{c}`") for c in natural]
    others = [F.asc_nulls_first(f"`{c}`") for c in df.columns if c not in natural] or [F.lit(1)]
    rows = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*own).orderBy(*others)))
    rows = materialized(rows, "keyed")
    key = [*natural, "_nth"]
    same = lambda a, b: [a[c].eqNullSafe(b[f"_k{i}"]) for i, c in enumerate(key)]
    renamed = lambda x: x.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)], F.col("_number"))
    schema = T.StructType([*[rows.schema[c] for c in key], T.StructField("_number", T.LongType())])
    if manifest(spark, root) is None:
        load(spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema])), root)
    known = current(spark, root)
    new = rows.select(*key).distinct()
    stored = renamed(known)
    new = materialized(new.join(stored, same(new, stored), "left_anti"), "new-keys")
    if not new.isEmpty():
        top = known.agg(F.coalesce(F.max("_number"), F.lit(0))).first()[0]
        more = numbered(new, key, "_number").select(*key, (F.col("_number") + top).cast("long").alias("_number"))
        append(spark.createDataFrame([], known.schema).unionByName(more), root)
    stored = renamed(current(spark, root))
    return rows.join(stored, same(rows, stored)).select(*df.columns, F.col("_number").alias(into))
