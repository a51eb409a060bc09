import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Nulls, empty and odd texts, repeated rows and ids, one long text.
ODD = [
    (None, None), (900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "One"), (900_005, "One"), (900_005, "One"),
    (None, "a b c d e f g h i j k"), (900_006, "\x1c \x00 É\u2003x"), (900_007, "word " * 60_000), (900_008, "漢字🙂 <|endoftext|> 'll"),
]


@pytest.fixture(scope="session")
def tables(spark):
    """The smallest tables, with odd rows and columns whose names clash added to documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(length(text) as long) as n_chars")
    clash = ", ".join(f"1 as {c}" for c in ("n_words", "uid", "fp", "chunk", "key", "shard", "score", "kept", "spans", "start", "core"))
    return {"documents": docs.unionAll(odd).selectExpr("*", *clash.split(", ")), "benchmark": spark.read.parquet(f"{FOLDER}/benchmark.parquet"), "labels": spark.read.parquet(f"{FOLDER}/labels.parquet"), "pages": spark.read.parquet(f"{FOLDER}/pages.parquet")}


@pytest.fixture(scope="session")
def stored(spark, tables, tmp_path_factory):
    """``documents`` as a stored table, and its rows."""
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    tables["documents"].write.parquet(path)
    docs = spark.read.parquet(path)
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(tables):
    return tables["documents"].where("false")
