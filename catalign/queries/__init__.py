"""Driver query registry: every entry reads the given tables in full."""

from __future__ import annotations

from . import facts, flows, matching, modelcalls, relational, text

_MODULES = [matching, text, relational, facts, modelcalls, flows]


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
