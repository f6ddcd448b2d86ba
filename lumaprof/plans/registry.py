"""Query registry: each entry is a plan over the views and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.operators.reuse import release
from lumaprof.plans.adapters import Views
from lumaprof.plans.sql_views import with_views

Plan = Callable[[Views], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = with_views(sql)
        return plan

    return register


def _bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        release()  # what the query before this one kept
        return plan(Views(spark, root))

    return run


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(plan) for name, plan in _PLANS.items()}


def sql() -> dict[str, str]:
    return dict(_SQL)


def r6(column: Column | str) -> Column:
    """Doubles are compared to six decimals."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in rows.dtypes])
