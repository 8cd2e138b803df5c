"""All registered queries and their DuckDB statements.

``both`` registers a statement that Spark and DuckDB share; ``op`` registers a function
over the transit tables, with DuckDB's statement beside it where SQL can express it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoline.plans.adapter import Network, duck

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _names(text: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def _listed(text: str, spark: bool) -> str:
    """@list(expression; order): the values as one comma-joined text."""
    to = r"listagg(CAST(\1 AS STRING), ',') WITHIN GROUP (ORDER BY \2)" if spark else r"string_agg(CAST(\1 AS STRING), ',' ORDER BY \2)"
    return re.sub(r"@list\((.+?); (.+?)\)(?=@)@", to, text)


def _counted(text: str) -> str:
    """count_if(x) as count(*) FILTER (WHERE x), whose type is the same in both engines."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(*) FILTER (WHERE {text[at + 9 : end - 1]}){text[end:]}"
    return text


def both(name: str, text: str, duckdb: str | None = None) -> None:
    """One statement for both engines over {tables}; ``duckdb`` replaces it where the dialects part."""
    used = _names(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        net = Network(spark, sf_dir)
        return spark.sql(_listed(text, True), **{u: net[u] for u in used})

    _add(name, run, duckdb or text)


def op(name: str, oracle: str | None = None):
    """Register a function of a Network."""

    def register(f: Callable[[Network], DataFrame]):
        _add(name, lambda spark, sf_dir: f(Network(spark, sf_dir)), oracle)
        return f

    return register


def _add(name: str, run: Query, oracle: str | None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = run
    if oracle:
        _ORACLES[name] = duck(_counted(_listed(oracle.format(**{u: u for u in _names(oracle)}), False)))


def _load() -> None:
    from chronoline.plans import q_audit, q_filters, q_joins, q_rules, q_search, q_sources, q_windows  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
