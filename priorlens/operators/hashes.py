"""Content hashes with sorted-key compact JSON, built from the raw document.

Hashes go through VARIANT, not through structs: a struct turns absent nested
keys into nulls and changes the digest. Known gap: VARIANT prints 1.0 as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIM_FIELDS = ("claim_id", "claim_text", "normalized_claim", "facets")
SNAPSHOT_FIELDS = ("id", "title", "doi", "arxiv_id", "providers", "dates", "references", "found_by_query_ids")
IDENTITY_FIELDS = ("audit_id", "claim_id", "claim_freeze_hash", "cutoff")


def _sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_json(document: Column) -> Column:
    """Compact JSON with keys sorted at every level."""
    return F.to_json(F.parse_json(document))


def _field(document: Column, name: str, default: str = "null") -> Column:
    value = F.to_json(F.variant_get(F.parse_json(document), f"$.{name}", "variant"))
    return F.coalesce(F.when(value != "null", value), F.lit(default))


def _pick(document: Column, fields: tuple[str, ...], defaults: dict[str, str] | None = None) -> Column:
    defaults = defaults or {}
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), _field(document, name, defaults.get(name, "null"))]
    return F.concat(*parts, F.lit("}"))


def claim_map_hash(claim_map: Column | str) -> Column:
    """Freeze hash of a claim map given as JSON text."""
    doc = F.col(claim_map) if isinstance(claim_map, str) else claim_map
    return _sha(_pick(doc, CLAIM_FIELDS, {"facets": "[]"}))


def paper_snapshot_json(paper: Column) -> Column:
    """The eight snapshot fields of a paper's JSON text; absent ones become null."""
    return _pick(paper, SNAPSHOT_FIELDS)


def snapshot_hashes(papers: DataFrame) -> DataFrame:
    """``(audit_id, candidate_snapshot_hash)`` from ``papers(audit_id, id, doc)``.

    The digest is over one string per audit, so an audit's eight fields must fit
    a row; audits are hashed independently.
    """
    rows = papers.select("audit_id", F.struct(F.col("id").cast("string").alias("id"), paper_snapshot_json(F.col("doc")).alias("j")).alias("s"))
    joined = rows.groupBy("audit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["j"]), ",").alias("j"))
    return joined.select("audit_id", _sha(F.concat(F.lit("["), F.col("j"), F.lit("]"))).alias("candidate_snapshot_hash"))


def report_hash(document: Column | str) -> Column:
    doc = F.col(document) if isinstance(document, str) else document
    return _sha(canonical_json(doc))


def identity_hash(audit_id: Column, claim_id: Column, freeze_hash: Column, cutoff: Column) -> Column:
    """Digest of the four identity fields; null when one of them is blank."""
    values = dict(audit_id=audit_id, claim_id=claim_id, claim_freeze_hash=freeze_hash, cutoff=cutoff)
    clean = {k: F.trim(F.coalesce(v.cast("string"), F.lit(""))) for k, v in values.items()}
    whole = None
    for v in clean.values():
        whole = (v != "") if whole is None else whole & (v != "")
    return F.when(whole, _sha(F.to_json(F.struct(*[clean[k].alias(k) for k in sorted(clean)]))))


def file_checksums(spark, path: str) -> DataFrame:
    """MD5 of each input file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))
