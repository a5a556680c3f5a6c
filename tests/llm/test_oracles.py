"""The queries that SQL can express, against DuckDB; odd rows too."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from regioprofile.llm import queries

SF = "/root/testdata/sf0.001"
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The documents, pages and vectors with nulls, empty and repeated rows, in a folder of their own."""
    root = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    line = "Word of the day A.\n"
    more = [(None, None, None, None, None), (-1, "", None, "s", 0), (-2, "a b\n\n \t\na b", "xx", None, 9), (-3, line * 300, "xx", "s", 5700), (-3, line * 300, "xx", "s", 5700), (-4, "x" * 3_000_000 + " y" * 60, "en", "s", 1)]
    fields = ", ".join(f"{c} {k}" for c, k in docs.select("doc_id", "text", "lang", "source", "n_chars").dtypes)
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, fields)).repartition(3).write.parquet(f"{root}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    own = spark.createDataFrame([(-5, None, None), (-6, "u", ""), (-7, "u", "é"), (-8, "u", "é"), (-9, "u", "é")], "page_id long, url string, html string")
    pages.unionByName(own).unionByName(pages.limit(7).withColumn("page_id", F.col("page_id") + 1000)).write.parquet(f"{root}/pages.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    few = [(None, "word of the day a"), (-1, None), (-2, ""), (-3, "!!!"), (-4, "A b."), (-5, "b"), (-5, "y Y y y y y y y y y y y"), (0, "of the DAY"), (-4, "A b."), (-6, "é ß λ")]
    items.unionByName(spark.createDataFrame(few, items.schema)).write.parquet(f"{root}/benchmark.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    near = vectors.limit(20).select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i == 3, x * 1.2).otherwise(x)).alias("embedding"))
    bad = spark.createDataFrame([(-1, None), (-2, []), (-3, [0.0, 0.0]), (-4, [float("nan"), 1.0]), (-5, [None, 1.0]), (-6, [1.0, 2.0]), (-7, [2.0, 4.0])], "vec_id long, embedding array<float>")
    vectors.unionByName(near).unionByName(vectors.limit(5).withColumn("vec_id", F.col("vec_id") + 20_000)).unionByName(bad).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("which", ["given", "odd"])
def test_query_equals_sql(spark, odd, key, which):
    if (key, which) == ("op11_spelling_variants", "odd"):
        pytest.skip("the SQL loops over each letter of a word of three million; odd rows of op11 are in test_items_and_words.py")
    root = {"given": SF, "odd": odd}[which]
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "benchmark"):
        path = f"{root}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert glob.glob(f"{root}/*")
    r = con.execute(queries.oracle_sql()[key])
    columns = [c[0] for c in r.description]
    df = queries.queries()[key](spark, root)
    assert {c: KINDS[k] for c, k in df.dtypes} == {c[0]: str(c[1]) for c in r.description}
    want = sorted(repr([plain(row[columns.index(c)]) for c in sorted(columns)]) for row in r.fetchall())
    got = sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect())
    assert got == want and got
