"""User-supplied derivations: a named function from a table to named tables, with what it needs and gives."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lapsegrid.operators.joins import fold
from lapsegrid.sources.tables import TableSpec, check_grain


@dataclass(frozen=True)
class Derivation:
    """``build(table, parameters)`` gives one table per spec. ``needs`` are columns it cannot do without."""

    name: str
    build: Callable[[DataFrame, Mapping], dict[str, DataFrame]]
    gives: tuple[TableSpec, ...]
    needs: tuple[str, ...] = ()
    defaults: Mapping = field(default_factory=dict)


_KNOWN: dict[str, Derivation] = {}


def register(derivation: Derivation) -> Derivation:
    if derivation.name in _KNOWN:
        raise ValueError(f"derivation {derivation.name} is already registered")
    _KNOWN[derivation.name] = derivation
    return derivation


def registered() -> list[str]:
    return sorted(_KNOWN)


def derive(base: DataFrame, names: Sequence[str], parameters: Mapping[str, Mapping] | None = None, grain: Sequence[str] = ("stem", "identity", "frame_index"),
           verify: bool = True) -> tuple[DataFrame, dict[str, DataFrame], dict[str, str]]:
    """Run derivations in the order named. A table whose grain is the base's and that folds becomes columns seen
    by the next one; others are returned beside it. A derivation without its inputs is skipped with a reason."""
    tables: dict[str, DataFrame] = {}
    skipped: dict[str, str] = {}
    for name in names:
        if name not in _KNOWN:
            raise KeyError(f"unknown derivation {name}; known: {registered()}")
        d = _KNOWN[name]
        lacking = [c for c in d.needs if c not in base.columns]
        if lacking:
            skipped[name] = f"needs {', '.join(lacking)}"
            continue
        given = d.build(base, {**d.defaults, **(parameters or {}).get(name, {})})
        for spec in d.gives:
            if spec.name not in given:
                continue
            table = check_grain(given[spec.name], spec.grain) if verify else given[spec.name]
            if spec.fold and tuple(spec.grain) == tuple(grain):
                base = fold(base, table, grain)
            else:
                tables[spec.name] = table
    return base, tables, skipped
