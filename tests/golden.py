"""The valid audit document of the tests."""

from priorlens.plans.audit_documents import build, mutated, snapshot_hash  # noqa: F401
