"""Query registry: Spark builder, output columns and the checking SQL."""

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.oracle_tables import ORACLE_TABLES
from ledgerline.sources.domain import Tables

# Output kinds: s text, i integer, b boolean, m money (4 decimals), r ratio (6 decimals),
# f a figure that went through sums, logs or powers: compared in single precision.
PLACES = {"m": 4, "r": 6}


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    columns: list[tuple[str, str]]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def parse_columns(columns: str | list[str]) -> list[tuple[str, str]]:
    parts = columns.split() if isinstance(columns, str) else columns
    pairs = [p.rpartition(":") if ":" in p else (p, ":", "s") for p in parts]
    return [(name, kind) for name, _, kind in pairs]


def query(key: str, columns: str | list[str], sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert key not in REGISTRY, key
        REGISTRY[key] = Query(build, parse_columns(columns), sql)
        return build

    return register


def present(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Fixed column order, one integer and one float type, rounded floats."""
    out = []
    for name, kind in columns:
        c = F.col(f"`{name}`")
        if kind in PLACES:
            c = F.round(c.cast("double"), PLACES[kind])
        elif kind == "f":
            c = c.cast("float").cast("double")
        elif kind == "i":
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def run(key: str, spark: SparkSession, path: str) -> DataFrame:
    q = REGISTRY[key]
    return present(q.build(Tables(spark, path)), q.columns)


def _needed(text: str) -> list[str]:
    """Oracle tables a statement mentions, in dependency order."""
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in ORACLE_TABLES:
            if name not in found and re.search(rf"\b{name}\b", sql):
                if ORACLE_TABLES[name] is not sql:
                    visit(ORACLE_TABLES[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def oracle(key: str) -> str | None:
    q = REGISTRY[key]
    if q.sql is None:
        return None
    cells = []
    for name, kind in q.columns:
        c = f'"{name}"'
        if kind in PLACES:
            c = f"round(cast({c} as double), {PLACES[kind]})"
        elif kind == "f":
            c = f"cast(cast({c} as float) as double)"
        elif kind == "i":
            c = f"cast({c} as bigint)"
        cells.append(f'{c} as "{name}"')
    tables = [f"{name} as ({ORACLE_TABLES[name].strip()})" for name in _needed(q.sql)]
    body = f"select {', '.join(cells)} from ({q.sql.strip()}) result"
    return (f"with recursive {', '.join(tables)} " if tables else "") + body
