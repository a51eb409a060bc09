"""DataFrame operators. Every table carries ``audit_id`` so one job serves all audits."""
