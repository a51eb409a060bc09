"""Query registry: a name, a function of the tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Lazy access to the parquet tables of one scale factor: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, rows: list[tuple], fields: str) -> DataFrame:
        """A few fixed rows that the optimizer knows to be few; of a Python list it does not know the size,
        and joins such a table by a shuffle, or by a product that works the other side out once per partition."""
        columns = T.StructType.fromDDL(fields).fields
        structs = [F.struct(*[F.lit(v).cast(c.dataType).alias(c.name) for v, c in zip(row, columns)]) for row in rows]
        return self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def arxiv_name(key: str) -> str:
    """SQL of an arXiv identifier for a key: 100,000 to a month from 2001 on, so that no two keys share one."""
    month = f"{key} div 100000"
    return f"concat(lpad(cast(20 + {month} div 12 AS string), 2, '0'), lpad(cast({month} % 12 + 1 AS string), 2, '0'), '.', lpad(cast({key} % 100000 AS string), 5, '0'))"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, fn=fn: fn(Tables(spark, folder))) for name, (fn, _) in REGISTRY.items()}


def sql_queries() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
