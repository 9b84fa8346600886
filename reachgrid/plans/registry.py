"""Name → Spark plan and name → SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from reachgrid.plans.views import SQL_VIEWS, Data

Plan = Callable[[Data], DataFrame]


@dataclass
class Registry:
    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
            return lambda spark, sf_dir: plan(Data(spark, sf_dir))
        return {name: bind(plan) for name, plan in self.plans.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {name: with_views(text) for name, text in self.sql.items()}


REGISTRY = Registry()


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in REGISTRY.plans:
            raise ValueError(f"query {name} registered twice")
        REGISTRY.plans[name] = plan
        if sql is not None:
            REGISTRY.sql[name] = sql
        return plan
    return add


def with_views(text: str) -> str:
    """Prefix the WITH definitions of every shared view the text mentions, dependencies first."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)
    visit(text)
    body = text.strip()
    views = ",\n".join(f"{n} AS (\n{SQL_VIEWS[n].strip()}\n)" for n in needed)
    if not needed:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
