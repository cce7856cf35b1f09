"""Named queries over the test tables, and the SQL each must agree with."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("sources", "clean", "joins", "placement", "locality", "metrics", "stats", "stateful",
            "infer")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        for name, value in getattr(import_module(f"{__name__}.{family}"), attribute).items():
            if name in out:
                raise ValueError(f"query {name!r} is registered twice")
            out[name] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
