"""Registered queries: name -> (query, DuckDB SQL or None). One module for each part of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
Entries = dict[str, tuple[Query, str | None]]


def entries() -> Entries:
    from . import aggregates, frames, joins, language, scalars, trace, windows

    out: Entries = {}
    for module in (frames, scalars, aggregates, windows, joins, trace, language):
        for name, entry in module.entries().items():
            if name in out:
                raise ValueError(f"{name} is registered twice")
            out[name] = entry
    return out
