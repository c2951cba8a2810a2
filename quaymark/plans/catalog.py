"""All registered queries of the core."""

from __future__ import annotations

from quaymark.plans import core_problems, evaluation_queries, grading_queries, ml_queries, outcome_queries, rule_queries, sequence_queries, stream_queries, telemetry_queries, text_queries

MODULES = (outcome_queries, rule_queries, telemetry_queries, sequence_queries, text_queries, grading_queries, evaluation_queries, stream_queries, ml_queries, core_problems)

QUERIES = {k: q for m in MODULES for k, q in m.R.queries.items()}
ORACLES = {k: s for m in MODULES for k, s in m.R.oracles.items()}
