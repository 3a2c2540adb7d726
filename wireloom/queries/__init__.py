"""Registered queries: one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

from wireloom.queries import detection, graphs, learning, sheets, survey, texts, vectors


def registered() -> dict:
    """Name: (query of a session and a data folder, SQL or None)."""
    out = {}
    for module in (vectors, detection, sheets, graphs, texts, learning, survey):
        out.update({name: (query, module.ORACLES.get(name)) for name, (query, _) in module.ENTRIES.items()})
    return out
