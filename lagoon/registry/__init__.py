"""Named queries over the fixture domain, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lagoon.registry.views import with_views
from lagoon.sources.domain import Domain, load_domain


@dataclass(frozen=True)
class Entry:
    build: Callable[[Domain], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = Entry(build, with_views(sql) if sql else None)
        return build

    return add


def entries() -> dict[str, Entry]:
    from lagoon.registry import (  # noqa: F401
        accounts,
        activity,
        audits,
        collection,
        purchases,
        rooms,
        scalars,
        social,
        streams,
        trades,
    )

    return dict(_ENTRIES)


def run(name: str, spark, folder: str) -> DataFrame:
    return entries()[name].build(load_domain(spark, folder))
