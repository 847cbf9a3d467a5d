"""What ``__spark_entry__`` registers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegrid.llm import queries as q
from lodegrid.llm import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": sql.OP1, "op6_set_join": sql.OP6, "op7_decontamination": sql.OP7, "op10_chat": sql.OP10, "op13_audit": sql.OP13}
