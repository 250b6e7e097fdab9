"""All queries over the driver tables and the SQL they are compared with."""

from __future__ import annotations

from tracelake.plans import evidence, links, reports, sessions, texts

FLAGSHIP = "liveness_buckets"
_ALL = [sessions.R, texts.R, links.R, reports.R, evidence.R]
QUERIES: dict = {n: f for r in _ALL for n, f in r.queries.items()}
ORACLE_SQL: dict = {n: s for r in _ALL for n, s in r.sql.items()}
