"""Registered queries: a Spark builder, the columns it returns, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import portable_round
from .views import Views, with_views

DIGITS = 6


@dataclass
class Query:
    key: str
    op: str
    columns: list[tuple[str, str]]
    build: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def register(key: str, op: str, spec: str, build: Callable[[Views], DataFrame], sql: str | None = None,
             views: str = "") -> None:
    """``spec``: ``name:kind`` with kinds i (bigint), d (double, six digits), s (string), b (boolean).

    ``views`` names the civic views the SQL reads; they become its WITH clause.
    """
    if key in REGISTRY:
        raise ValueError(key)
    cols = _columns(spec)
    text = None
    if sql is not None:
        exprs = {
            "i": "CAST({c} AS BIGINT) AS {c}", "s": "CAST({c} AS VARCHAR) AS {c}",
            "b": "CAST({c} AS BOOLEAN) AS {c}",
            "d": "floor(CAST({c} AS DOUBLE) * 1e6 + 0.5e0) / 1e6 AS {c}",
        }
        outer = ", ".join(exprs[k].format(c=c) for c, k in cols)
        head = with_views(*views.split()) if views else ""
        body = sql.strip()
        if body.upper().startswith("WITH "):
            if head:
                body = head + ", " + body[5:]
        else:
            body = f"{head} {body}"
        text = f"SELECT {outer} FROM ({body}) AS answer"
    REGISTRY[key] = Query(key, op, cols, build, text)


def query(key: str, op: str, spec: str, sql: str | None = None, views: str = ""):
    def wrap(fn):
        register(key, op, spec, fn, sql, views)
        return fn

    return wrap


def run(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = q.build(Views(spark, sf_dir))
    out = []
    for name, kind in q.columns:
        c = F.col(name)
        out.append({
            "i": lambda c: c.cast("bigint"), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean"),
            "d": lambda c: portable_round(c.cast("double"), DIGITS),
        }[kind](c).alias(name))
    return df.select(*out)


def scalar(key: str, op: str, view: str, key_column: str, columns: dict, views: str | None = None) -> None:
    """A query of column functions over one view: ``columns`` maps ``name:kind`` to (Spark column, SQL text)."""
    spec = f"{key_column}:i " + " ".join(columns)
    names = {k.split(":")[0]: v for k, v in columns.items()}
    sql = f"SELECT {key_column}, " + ", ".join(f"{v[1]} AS {n}" for n, v in names.items()) + f" FROM {view}"

    def build(v: Views) -> DataFrame:
        return getattr(v, view).select(key_column, *[c[0]().alias(n) for n, c in names.items()])

    register(key, op, spec, build, sql, view if views is None else views)
