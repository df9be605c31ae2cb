"""All registered queries and their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("history", "ancestry", "ci", "evaluation", "text", "similarity", "reach", "review", "features", "modelling", "streams", "storage")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
