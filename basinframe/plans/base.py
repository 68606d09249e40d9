"""How a plan module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Plans:
    def __init__(self):
        self.queries: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(plan: Plan) -> Plan:
            self.queries[plan.__name__] = plan
            if sql:
                self.sql[plan.__name__] = sql
            return plan

        return register
