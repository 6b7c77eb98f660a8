"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from ..oracle import with_views

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, with_views(sql, *views) if sql else None)
        return fn
    return deco


# DuckDB spelling of the title-case rule (Python ``str.title``), used by oracles.
def duck_title(expr: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(lower(" + expr + r"), "
            r"'[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+'), "
            "lambda p: case when p[1] = 'ß' then 'Ss' else upper(p[1]) end || p[2:]), '')")


# DuckDB upper-cases 'ß' to 'ẞ'; Python (and Spark) give 'SS'.
def duck_upper_first(expr: str) -> str:
    return f"(case when left({expr}, 1) = 'ß' then 'SS' else upper(left({expr}, 1)) end)"
