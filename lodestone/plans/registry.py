"""Named queries with their SQL, gathered by module."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, function, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = function
        if sql:
            self.sql[name] = sql

    def __call__(self, name: str, sql: str | None = None):
        def keep(function):
            self.add(name, function, sql)
            return function

        return keep
