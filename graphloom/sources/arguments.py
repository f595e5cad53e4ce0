"""Command line arguments of the form key:value."""

from __future__ import annotations

from collections.abc import Iterable


def parse(arguments: Iterable[str], separator: str = ":") -> dict[str, str]:
    """Keys and values; arguments without a value, or with the value "Nan", are skipped."""
    found = {}
    for a in arguments:
        key, _, value = a.partition(separator)
        if key.strip() and value.strip() and value.strip() != "Nan":
            found[key.strip()] = value.strip()
    return found
