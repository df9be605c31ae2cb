"""A small collector for the query modules."""

from __future__ import annotations


class Collector:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(function):
            self.queries[name] = function
            if oracle is not None:
                self.oracles[name] = oracle
            return function
        return add
