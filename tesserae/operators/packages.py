"""Operators under a name and a version, each with closed options, for callers that name them in configuration."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tesserae.operators import crosswalk, fingerprint, fixpoint, gates, profile, resolution, windows
from tesserae.sources import readers, sinks


@dataclass(frozen=True)
class Package:
    """An operator: what it is called, its version, its function, and which parameters are tables."""

    name: str
    version: tuple[int, int, int]
    run: Callable
    tables: tuple[str, ...]

    @property
    def options(self) -> dict[str, inspect.Parameter]:
        """The options it knows, in order; those without a default must be given."""
        return {k: p for k, p in inspect.signature(self.run).parameters.items() if k not in self.tables}

    def __call__(self, tables: Mapping[str, DataFrame], options: Mapping[str, object] | None = None):
        """Apply it to its tables; missing, unknown and misnamed tables or options are refused before anything runs."""
        options = dict(options or {})
        needed = {k for k, p in self.options.items() if p.default is p.empty}
        for what, given, known, must in (("tables", set(tables), set(self.tables), set(self.tables)), ("options", set(options), set(self.options), needed)):
            if unknown := sorted(given - known):
                raise ValueError(f"{self.name}: unknown {what}: {', '.join(unknown)}")
            if missing := sorted(must - given):
                raise ValueError(f"{self.name}: missing {what}: {', '.join(missing)}")
        return self.run(**tables, **options)


def _resolve(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    return resolution.resolve(left, right, resolution.ResolveConfig.of(**options))


def _with_fields(run: Callable, config: type) -> Callable:
    """run with a signature that lists the fields of its configuration."""
    own = [p for p in inspect.signature(run).parameters.values() if p.kind is not p.VAR_KEYWORD]
    run.__signature__ = inspect.Signature(own + [p.replace(kind=inspect.Parameter.KEYWORD_ONLY) for p in inspect.signature(config).parameters.values()])
    return run


CATALOG: dict[str, Package] = {
    p.name: p
    for p in [
        Package("resolve", (1, 1, 0), _with_fields(_resolve, resolution.ResolveConfig), ("left", "right")),
        Package("validate_contract", (1, 1, 0), gates.validate_contract, ("df",)),
        Package("derive_contract", (1, 0, 0), gates.derive_contract, ("df",)),
        Package("describe", (1, 1, 0), profile.describe, ("df",)),
        Package("export_parquet", (1, 1, 0), sinks.export_parquet, ("df",)),
        Package("write_sized", (1, 0, 0), sinks.write_sized, ("df",)),
        Package("discover_links", (1, 0, 0), readers.discover_links, ("pages",)),
        Package("table_fingerprint", (2, 0, 0), fingerprint.table_fingerprint, ("df",)),
        Package("reachable", (1, 0, 0), fixpoint.reachable, ("edges", "seeds")),
        Package("seeded_sample", (2, 0, 0), windows.seeded_sample, ("df",)),
        Package("unadmitted", (1, 0, 0), crosswalk.unadmitted, ("edges", "register")),
    ]
}

_TERM = re.compile(r"\s*(\^|~|>=|<=|>|<|=)?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?\s*\Z")


def _meets(version: tuple[int, int, int], constraint: str) -> bool:
    """Whether a version meets a constraint: terms joined by commas, each a version or the first parts of one, after ^ (or nothing), ~, =, <, <=, > or >=."""
    for term in constraint.split(","):
        if not (m := _TERM.match(term)):
            raise ValueError(f"no version constraint: {constraint}")
        sign, given = m[1] or "^", [int(x) for x in m.groups()[1:] if x is not None]
        low = tuple(given + [0] * (3 - len(given)))
        after = lambda k: tuple(low[:k] + (low[k] + 1,) + (0,) * (2 - k))
        if sign == "^":  # up to the next change of the first part that is not 0
            part = next((k for k, x in enumerate(low[: len(given)]) if x), len(given) - 1)
            ok = low <= version < after(part)
        elif sign in "~=":
            ok = low <= version < after(min(len(given) - 1, 1) if sign == "~" else len(given) - 1)
        else:
            edge = after(len(given) - 1)
            ok = {">=": version >= low, "<": version < low, ">": version >= edge, "<=": version < edge}[sign]
        if not ok:
            return False
    return True


def operator(reference: str) -> Package:
    """The operator that `name` or `name@constraint` names; an unknown name, or a version that doesn't meet the constraint, is refused."""
    name, _, constraint = (x.strip() for x in reference.partition("@"))
    if name not in CATALOG:
        raise ValueError(f"unknown operator {name}; known: {', '.join(sorted(CATALOG))}")
    found = CATALOG[name]
    if "@" in reference and not _meets(found.version, constraint):
        raise ValueError(f"{reference} is not met by version {'.'.join(map(str, found.version))}")
    return found
