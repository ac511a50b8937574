"""Query registry: each entry names its inventory row, the Spark callable and,
where plain SQL can say it, the SQL to check it against."""

from __future__ import annotations

import re
from collections.abc import Callable

from cardloom.sources.standins import SQL as VIEWS

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}
ROWS: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the stand-in views it (transitively) mentions."""
    def mentioned(text: str) -> set[str]:
        return {v for v in VIEWS if re.search(rf"\b{v}\b", text)}

    need, todo = set(), mentioned(sql)
    while todo:
        need |= todo
        todo = set().union(*(mentioned(VIEWS[v]) - {v} for v in todo)) - need
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need]
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s+recursive", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with", "", body)
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(row: str, name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t`` is a ``Standins`` bound to (spark, folder)."""
    from cardloom.sources.standins import Standins

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Standins(spark, folder))
        ROWS[name] = row
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn
    return register
