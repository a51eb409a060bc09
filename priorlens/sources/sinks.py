"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64, mode: str = "errorifexists") -> None:
    """Write a table partitioned by a hash bucket of ``audit_id``.

    A bucket keeps the file count bounded whatever the number of audits, and
    rows of one hot audit still spread over several files.
    """
    out = df.withColumn("audit_bucket", F.pmod(F.xxhash64("audit_id"), F.lit(buckets)).cast("int"))
    out.write.mode(mode).partitionBy("audit_bucket").format(fmt).save(path)


def audit_documents(header: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per audit: ``(audit_id, document)``.

    ``header`` has one row per audit; every section becomes an array of its rows
    in a stable order. Section rows are serialised before they are grouped, so a
    group carries plain strings.
    """
    out = header.select("audit_id", F.to_json(F.struct(*header.columns)).alias("_head"))
    parts = []
    for name, df in sections.items():
        body = [c for c in df.columns if c != "audit_id"]
        rows = df.select("audit_id", F.to_json(F.struct(*body)).alias("_j"))
        grouped = rows.groupBy("audit_id").agg(F.array_join(F.array_sort(F.collect_list("_j")), ",").alias(f"_s_{name}"))
        out = out.join(grouped, "audit_id", "left")
        parts += [F.lit(f',"{name}":['), F.coalesce(f"_s_{name}", F.lit("")), F.lit("]")]
    head = F.expr("substring(_head, 1, length(_head) - 1)")
    return out.select("audit_id", F.concat(head, *parts, F.lit("}")).alias("document"))


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    documents.select("document").write.mode(mode).text(path)
