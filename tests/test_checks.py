"""One mutation of the valid audit per rule; all mutations run as one batch of audits."""

import json

import pytest

from priorlens.operators.checks import violations
from priorlens.plans.audit_documents import MUTATIONS, VALID, build, mutated
from priorlens.sources.reports import report_tables


@pytest.fixture(scope="module")
def found(spark):
    docs = [(k, json.dumps(mutated(k, f), ensure_ascii=False)) for k, f in {**MUTATIONS, **VALID}.items()]
    reports = spark.createDataFrame(docs, "audit_id string, doc string").coalesce(4)
    out = {}
    for r in violations(report_tables(reports)).collect():
        out.setdefault(r["audit_id"], []).append((r["rule"], r["entity_id"], r["detail"]))
    return out


@pytest.mark.parametrize("name", list(VALID))
def test_valid_documents_have_no_violation(found, name):
    assert found.get(name, []) == []


@pytest.mark.parametrize("name", list(MUTATIONS))
def test_mutation_is_found(found, name):
    assert name.split(" ")[0] in {rule for rule, _, _ in found.get(name, [])}, found.get(name)


def test_golden_hashes_match_python(spark):
    from priorlens.operators import hashes
    from pyspark.sql import functions as F

    doc = build()
    row = spark.createDataFrame([(json.dumps(doc["claim_map"], ensure_ascii=False),)], "j string").select(hashes.claim_map_hash(F.col("j")).alias("h")).first()
    assert row["h"] == doc["claim_map"]["freeze_hash"]


def test_findings_are_just_the_expected_ones(found):
    from collections import Counter

    from priorlens.plans.audit_queries import EXPECTED

    want = {}
    for rule, rows in EXPECTED.items():
        for kind, entity, detail in rows:
            if rule == "VAL-01" or not kind.startswith("VAL-01"):
                want.setdefault(kind, []).append((rule, entity, detail))
    assert {k: Counter(v) for k, v in found.items()} == {k: Counter(v) for k, v in want.items()}
