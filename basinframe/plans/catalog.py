"""The registered queries of the relational core and their SQL twins."""

from __future__ import annotations

from . import assembly_plans, assessment_plans, catalogue_plans, container_plans, contract_plans, matching_plans, receiving_plans, registry_plans, sample_plans, stream_plans

MODULES = (registry_plans, sample_plans, matching_plans, catalogue_plans, assessment_plans, contract_plans, container_plans, assembly_plans, receiving_plans, stream_plans)
QUERIES = {name: plan for m in MODULES for name, plan in m.P.queries.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.P.sql.items()}
